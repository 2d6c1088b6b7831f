"""Language identification against a plain loop over zstandard, and what learning sees."""

import pyarrow as pa
import pytest
import zstandard

from steadyhum.llm import language

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string"


def plain(text, model, min_margin=language.MIN_MARGIN):
    """(language, score, margin, rejected): every window compressed anew with every dictionary."""
    if not model.dictionaries or not text or not any(c.isalpha() for c in text):
        return "und", 0.0, 0.0, True
    data, sizes = text.lower().encode("utf-8", "replace"), []
    for name, raw in model.dictionaries:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_dict_id=False)
        total = 0
        for at in range(0, len(data), 4096):
            total += len(packer.compress(data[at : at + 4096]))
        sizes.append((total, name))
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], 0.5 + 0.5 * margin, margin, margin < min_margin


def test_predictions_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(~language.held_out(docs.doc_id)).select("doc_id", "text", "lang"))
    assert [name for name, _ in model.dictionaries] == ["de", "en", "es", "fr"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id], model)
        assert (r.lang_pred, r.rejected) == (want[0], want[3])
        assert (r.score, r.margin) == pytest.approx(want[1:3], abs=1e-12)


@pytest.mark.parametrize("doc_id", [1, 2, 3, 4, None])
def test_a_language_whose_rows_share_an_id_takes_nothing_from_others(spark, doc_id):
    """2,000 German rows under one id, and 300 English ones with ids of their own."""
    german = "der schnelle braune fuchs springt über den faulen hund und läuft durch den wald nummer"
    english = "the quick brown fox jumps over the lazy dog and then runs through the forest number"
    rows = [(doc_id, f"{german} {i} {i * 7919 % 1009}", "de") for i in range(2000)]
    rows += [(1000 + i, f"{english} {i} {i * 7919 % 1009}", "en") for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(table)
    assert [name for name, _ in model.dictionaries] == ["de", "en"]
    assert min(len(raw) for _, raw in model.dictionaries) > 20_000
    told = language.predict_language(table, model).select("lang", "language.lang_pred").distinct().collect()
    assert sorted(map(tuple, told)) == [("de", "de"), ("en", "en")]


def test_learning_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = [(i % 50, f"satz {'wort ' * (i % 9)}{i}", f"l{i % 6:02}") for i in range(600)]
    rows += [(1, "copy", "copies")] * 100 + [(2, None, "none"), (3, "", "none"), (4, "text", None)]
    table = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(table, rows_per_language=20, sample_chars=10)
    assert [name for name, _ in model.dictionaries] == ["copies"] + [f"l{i:02}" for i in range(6)]
    assert all(raw.count(b"\n") == 19 and len(raw) <= 20 * 11 for _, raw in model.dictionaries)
    assert language.learn(table.repartition(7, "text"), rows_per_language=20, sample_chars=10) == model
    few = language.learn(table, rows_per_language=20, most_languages=2)
    assert len(few.dictionaries) == 2 and all(raw for _, raw in few.dictionaries)


def test_workers_give_arrow_memory_back_when_a_task_ends(monkeypatch):
    """The pool is told once, after the task's own batches are gone."""
    from steadyhum.llm import common

    held = []

    class Pool:
        def release_unused(self):
            held.append(pa.total_allocated_bytes())

    def run(batches):
        for batch in batches:
            copy = pa.concat_arrays([batch, batch])
            yield len(copy)

    before = pa.total_allocated_bytes()
    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.releasing(run)(pa.array(range(10**6)) for _ in range(3))) == [2 * 10**6] * 3
    assert len(held) == 1 and held[0] < before + 10**6
