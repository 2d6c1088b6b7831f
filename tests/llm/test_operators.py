"""Every text operator against plain Python on small tables full of odd rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from steadyhum.llm import (
    chat,
    exactdup,
    fingerprint,
    language,
    neardup,
    packing,
    pii,
    records,
    shingles,
    warc,
    wordtable,
)
from steadyhum.llm.differencing import pack
from steadyhum.llm.encoding import default_path, encoder
from steadyhum.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
BASE = " ".join(WORDS[(i * i + 3 * i) % 12] + str(i % 37) for i in range(200))
EDIT = BASE.replace("alpha0 ", "omega ", 1)
SAID = "Write to a.b@c.example.org or +1 (415) 555-2671. Pay 4111 1111 1111 1111 from 10.0.0.256 or 10.0.0.25!"
ROWS = [
    (0, BASE), (1, EDIT), (2, BASE.upper()), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "one two"),
    (9, SAID), (10, "a@b.com_c@d.com 1.2.3.4.5.6.7.8"), (11, "x " * 9000 + "12@mail.example.com"), (12, "é" * 7001 + "\nSecond. Third! 日本"),
    (None, "no id"), (None, None), (15, "same row"), (15, "same row"), (16, "a<|endoftext|>b"), (17, "q" * 3000), (18, "Σας\x00\x01"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, sha256 string, keep_id long, language string, spans string, band long, span_doc string, dropped_id long"


def full(rows):
    return [(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, "l", "p", 3, "d", 4) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(full(ROWS), SCHEMA).repartition(3, "text")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows=ROWS):
    return [(i, t or "") for i, t in rows]


def test_warc_round_trip(spark, empty):
    pages = [(1, "http://x/\n é", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "http://y", None), (4, "http://z", ""),
             (5, "u", "é" * 5000), (None, "v", "<p>a</p>"), (None, "w", "alone"), (6, "r", "twice"), (6, "r", "twice"), (7, "s", "twice")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    want = collections.Counter()
    for p, _, h in pages:
        data, f = (h or "").encode(), first.get(h or "")
        other = f is not None and f != p
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[(p, len(data), digest, "revisit" if other else "response", f if other else None)] += 1
    assert collections.Counter(tuple(r) for r in warc.round_trip(df).collect()) == want
    index = warc.write_archives(df, warc.fresh_path(spark, "archive"))
    some = warc.read_archives(index.where("page_id = 5")).collect()
    assert [r.payload.decode() for r in some] == ["é" * 5000]
    assert warc.round_trip(df.limit(0)).collect() == []
    longer = warc.with_references(df, least_bytes=6).where("refers_to is not null").collect()
    assert {r.payload.decode() for r in longer} == {"<p>a</p>"}


def test_packing_covers_every_id_once(docs, empty):
    e = encoder(default_path("byte_bpe_50k.json")).library
    rows = packing.pack_documents(docs).collect()
    got, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
        assert r.length * 4 == len(r.ids) and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    want = collections.Counter()
    for i, t in texts():
        ids = np.array([*e.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids), ids.tobytes())] += 1
    for (i, n, data), times in want.items():
        pieces = sorted(got[(i, n)])
        if times == 1 and sum((j, m) == (i, n) for j, m, _ in want) == 1:
            assert b"".join(p for _, p in pieces) == data
    assert sum(r.length for r in rows) == sum(n * c for (_, n, _), c in want.items())
    for parts in sequences.values():
        at = 0
        for offset, length, total in sorted(parts):
            assert offset == at
            at += length
        assert at == total <= 2048
    assert packing.packed_pieces(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=80), st.integers(60, 200))
def test_differencing_keeps_every_size_within_capacity(sizes, capacity):
    owner, loads = pack(np.array(sizes, np.int64), capacity)
    assert len(owner) == len(sizes) and max(loads, default=0) <= capacity
    assert np.bincount(owner, weights=sizes, minlength=len(loads)).tolist() == loads.tolist()


def test_personal_data_as_the_plain_expressions_find_it(docs, empty):
    rows = pii.report(docs).collect()
    want = collections.Counter((i, brute.sha(brute.written(brute.base_spans(t)))) for i, t in texts())
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert {r.doc_id: r.spans for r in rows}[9] == brute.written(brute.base_spans(SAID))
    assert pii.report(empty).collect() == []
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[9].text == "Write to [EMAIL] or [PHONE]. Pay [CARD] from 10.0.0.256 or [IP]!"
    assert masked[9].n_chars == len(masked[9].text) and masked[0].text == BASE and masked[4].text is None
    assert pii.mask(docs).columns == docs.columns and pii.mask(docs).count() == len(ROWS)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab1.2@+-_ (5)9%", max_size=60), min_size=1, max_size=30))
def test_base_spans_of_any_text(spark, some):
    rows = pii.scan(spark.createDataFrame([(t,) for t in some], "t string"), "t", "m").collect()
    for r in rows:
        mine = [(m["start"], m["rank"], m["end"]) for m in r.m if m["rank"] < 4]
        assert sorted(mine) == brute.base_spans(r.t)


def test_contexts_discover_identifiers(spark):
    seeds = [(i, f"please contact me via name{i}@mail.example.com today") for i in range(12)]
    found = [(100, "please contact me via handle77x today"), (101, "build handle77y runs"), (102, "an item 123456x here")]
    rows = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(seeds + found, "doc_id long, text string")).collect()}
    assert rows[100] == "identifier:22:31" and rows[101] == rows[102] == ""


def identifiers(spark, said):
    rows = pii.report(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",")] for r in rows}
    return [{t[int(a) : int(b)] for k, a, b in (s for s in spans[i] if len(s) == 3) if k == "identifier"} for i, t in enumerate(said)]


def test_identifiers_found_support_further_contexts(spark):
    said = [f"please contact me via name{i}@mail.example.com today" for i in range(12)]
    said += [f"please contact me via handle{i}x today" for i in range(8)]
    said += [f"the owner is handle{i}x again" for i in range(8)] + ["the owner is stranger9z again"]
    said += ["the colour is handle1x again", "the colour is stranger9y again"]
    got = identifiers(spark, said)
    assert got[28] == {"stranger9z"} and got[12] == {"handle0x"} and got[30] == set()


def test_contexts_with_more_unseen_values_than_seeds(spark):
    said = [f"please contact me via name{i}@mail.example.com today" for i in range(12)]
    said += [f"please contact me via handle{i}x today" for i in range(100)]
    assert identifiers(spark, said)[12:] == [{f"handle{i}x"} for i in range(100)]


def test_identifiers_in_a_list_share_its_context(spark):
    said = [f"please contact me via name{i}@mail.example.com today" for i in range(12)]
    many = [f"handle{i}x" for i in range(600)]
    said += ["please contact me via " + ", ".join(many) + " today", "at room 12 via handle1x"]
    got = identifiers(spark, said)
    assert got[12] == set(many) and got[13] == set()


def test_token_records(spark, docs, empty):
    e = encoder(default_path("word_bpe_49k.json")).library
    want, start = [], 0
    ordered = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in ordered:
        ids = [*e.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = sorted(records.round_trip(docs).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == collections.Counter(want)
    assert [r.doc_id for r in got] == [i for i, _ in ordered]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert records.round_trip(empty).collect() == []
    index = records.write_records(docs, records.fresh_path(spark, "ids"))
    shuffled = records.read_records(index.orderBy(F.rand(3)).limit(5)).collect()
    assert len(shuffled) == 5


def test_broken_records_are_seen():
    record = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(record)) == b"payload"
    for at in (0, 9, 14, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))


def plain_components(rows):
    split, lower = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = split.findall(t.translate(lower))
        n = min(len(w), 5)
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()))
    comp = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    return sets, comp


def test_near_duplicates_as_all_pairs_find_them(spark, docs, empty):
    sets, comp = plain_components(texts())
    got = neardup.near_components(docs).collect()
    want = collections.Counter((i, len(s), comp[i], i is None or comp[i] == i) for i, s in sets)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert neardup.near_components(empty).collect() == []
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(i is None or comp[i] == i for i, _ in sets)


def test_near_duplicates_of_a_family_of_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(words)
        for k in rng.choice(120, rng.integers(0, 6), replace=False):
            w[k] = f"e{rng.integers(1 << 30)}"
        rows.append((1000 - i, " ".join(w)))
    sets, comp = plain_components(rows)
    got = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and len(set(comp.values())) > 1


def test_near_duplicates_of_few_shingles(spark):
    rows = []
    for i in range(2000):
        words = [f"w{i}x{k}" for k in range(11)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:10]))]  # 7 and 6 shingles
    got = neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4000 and [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


def test_chance_agreement_of_few_shingles_is_a_quarter():
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(300):
        a, b = (shingles.minima(rng.integers(0, 1 << 63, 1, dtype=np.uint64)) for _ in range(2))
        bits = shingles.packed_signature(a) ^ shingles.packed_signature(b)
        pairs = np.unpackbits(bits.view(np.uint8)).reshape(-1, 2)
        agree.append(1 - pairs.any(axis=1).mean())
    assert abs(np.mean(agree) - 0.25) < 0.01 and max(agree) < 0.4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\tcé", max_size=40), max_size=20))
def test_shingle_sets_count_as_plain_sets(some):
    plain, _ = plain_components(list(enumerate(some)))
    assert [len(s) for s in shingles.sets_of([t.encode() for t in some])] == [len(s) for _, s in plain]


def test_shingles_of_a_text_in_many_chunks(monkeypatch):
    text = (" ".join(f"word{i}" for i in range(3000)) + " " + "z" * 500 + " end").encode()
    whole = shingles.shingle_set(shingles.word_hashes(text))
    assert len(whole) == 3002 - 4
    monkeypatch.setattr(shingles, "CHUNK_BYTES", 600)
    assert np.array_equal(shingles.shingle_set(shingles.word_hashes(text)), whole)


def test_language_on_held_out_rows(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    odd = language.identify(docs).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (4, 5, 6)} == {"und"}
    assert language.identify(empty).collect() == []
    kept = language.keep_identified(docs.union(spark.createDataFrame([(50, None, *full(ROWS)[0][2:])], SCHEMA)))
    assert kept.columns == docs.columns


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "a<|turn|>b</s>\\"), (1, 2, "assistant", "<\\/s> </s> <\\\\s>[INST]"),
            (2, 0, "assistant", "x" * 9000), (2, 0, "assistant", "x" * 9000), (2, None, None, "no turn"), (None, 3, "user", ""), (3, 5, "ro\nle", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    convs = collections.defaultdict(list)
    said = "</s>[INST] ok [/INST]"
    for c, t, r, x in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        convs[c].append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{o}\n{x}\n" for _, o, x in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
    assert {r.conv_id for r in chat.format_conversations(df.limit(0)).collect()} == {-7}


@given(st.lists(st.sampled_from([*"<s>/[INST]|\\tun\n", "</s>", "<|turn|>", "<|end|>"]), max_size=30).map("".join))
def test_escapes_are_undone(text):
    safe = chat.escape(text)
    assert not any(c in safe for c in chat.CONTROL) and chat.unescape(safe) == text
    assert chat.parse(chat.render(text, text)[0]) == (text, text)


def test_events_fold_to_the_final_messages(spark):
    events = [
        (1, 0, 0, 1, "open", "user", "hi"),
        (1, 1, 0, 2, "open", "assistant", ""), (1, 1, 0, 3, "delta", None, "wro"), (1, 1, 0, 4, "delta", None, "ng"),
        (1, 2, 0, 5, "open", "user", "what?"),
        (1, 1, 0, 6, "regenerate", None, None), (1, 1, 0, 7, "delta", None, "right"),
        (1, 0, 0, 8, "edit", None, "hello"),
        (1, 2, 0, 9, "open", "user", "thanks"),
        (2, 0, 0, 1, "open", "user", "other"), (2, 5, 0, 2, "open", "assistant", "gone"), (2, 0, 0, 3, "regenerate", None, "new"),
    ]
    df = spark.createDataFrame(events, "conv_id long, turn long, part long, sequence long, kind string, role string, text string")
    rows = chat.format_events(df.orderBy(F.rand(1))).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, *chat.parse(r.segment)) for r in rows] == [
        (1, "user", "hello"), (1, "assistant", "right"), (1, "user", "thanks"), (2, "user", "new")
    ]


def test_fingerprints_and_neighbours(spark, docs, empty):
    plain = [r for r in ROWS if r[0] is not None and r[0] != 15]
    df = spark.createDataFrame(full(plain), SCHEMA).repartition(4)
    got = {r.doc_id: r for r in fingerprint.edited_prints(df).collect()}
    ordered = sorted(texts(plain))
    for k, (i, t) in enumerate(ordered):
        cut, after = len(t) // 4, ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    assert got[0].fingerprint == got[3].fingerprint != got[1].fingerprint
    assert fingerprint.edited_prints(docs).count() == len(ROWS) and fingerprint.edited_prints(empty).count() == 0


def test_changed_branches_locate_an_edit(spark):
    a = "One. Two.\nThree. Four!\n\nFive."
    df = spark.createDataFrame([(a, a.replace("Three", "Thrice"))], "a string, b string")
    prints = df.select(fingerprint.fingerprint(F.col("a")).alias("a"), fingerprint.fingerprint(F.col("b")).alias("b"))
    row = prints.select(fingerprint.changed_branches(F.col("a"), F.col("b")).alias("c"), fingerprint.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert len(row.c) == 1 and 0.5 < row.l < 1


def test_long_texts_without_sentence_marks_have_many_leaves(spark):
    rng = np.random.default_rng(3)
    drawn = lambda letters, n: "".join(rng.choice(list(letters), n))
    whole = {
        "words": " ".join(WORDS[k] + str(k) for k in rng.integers(0, 12, 3000))[:6000],
        "han": drawn("天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏", 6000),
        "acid": drawn("ACGT", 6000),
        "digits": drawn("0123456789", 6000),
        "consonants": drawn("BCDFGHKLMNP", 6000),
    }
    same = {"run": "q" * 6000, "line": ("一" * 300 + "。") * 20}
    rows = [(k, t, t[:2000] + "天7x" + t[2000:4500] + t[::-1][:1500]) for k, t in (whole | same).items()]
    df = spark.createDataFrame(rows, "kind string, a string, b string").withColumns(
        {c: fingerprint.fingerprint(F.col(t)) for c, t in (("x", "a"), ("y", "b"))}
    )
    got = df.select(
        "kind", "a", F.flatten(F.transform(F.split("a", fingerprint.SENTENCE_END, -1), fingerprint.pieces)).alias("cut"),
        fingerprint.likeness(F.col("x"), F.col("y")).alias("near"), fingerprint.changed_pieces(F.col("x"), F.col("y")).alias("at"),
    ).collect()
    for r in got:
        assert "".join(r.cut) == r.a and max(map(len, r.cut)) <= 256 * 25, r.kind
        if r.kind in whole:
            assert 0.4 < r.near < 1 and len(r.cut) > 10 and 0 < len(r.at) < 0.6 * len(r.cut), (r.kind, r.near, len(r.cut))


@pytest.mark.parametrize("capacity", [1, 3, 65536])
def test_exact_copies(spark, docs, empty, capacity):
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    want = collections.Counter()
    for i, t in texts():
        keep = max((j for j in groups[t] if j is not None), default=None)
        want[(i, keep, len(groups[t]), i == keep, brute.sha(t))] += 1
    index = exactdup.build_index(docs, capacity=capacity)
    got = exactdup.look_up(docs, index).drop("bucket", "chain").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert index.directory.agg(F.max("n_entries")).first()[0] <= capacity
    bounds = sorted((r.prefix << (64 - r.depth), (r.prefix + 1) << (64 - r.depth)) for r in index.directory.collect())
    assert bounds[0][0] == 0 and bounds[-1][1] == 1 << 64 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))
    assert exactdup.exact_groups(empty).collect() == []
    kept = exactdup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(c for (_, _, _, k, _), c in want.items() if k)


def test_colliding_texts_are_told_apart_by_their_bytes(spark, docs, monkeypatch):
    """Five hashes for all texts, close together: chains are long and the directory is as deep as the hash."""
    monkeypatch.setattr(exactdup, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    index = exactdup.build_index(docs, capacity=1)
    assert index.directory.agg(F.max("depth")).first()[0] >= 62
    assert index.directory.agg(F.sum("n_entries")).first()[0] == 5 == index.entries.select("bucket").distinct().count()
    groups = collections.defaultdict(list)
    for i, t in texts():
        groups[t].append(i)
    got = collections.defaultdict(list)
    for r in exactdup.look_up(docs, index).collect():
        got[r.text_sha256].append((r.keep_id, r.group_size))
    assert {k: v for k, v in got.items()} == {
        brute.sha(t): [(max((j for j in ids if j is not None), default=None), len(ids))] * len(ids) for t, ids in groups.items()
    }
    assert index.entries.agg(F.max("chain")).first()[0] >= 2


def test_entries_are_found_through_the_directory_alone(docs):
    index = exactdup.build_index(docs, capacity=3)
    gone = index.directory.orderBy(F.desc("n_entries")).first().bucket
    less = exactdup.Index(index.entries, index.directory.where(F.col("bucket") != gone))
    missing = index.entries.where(F.col("bucket") == gone).agg(F.sum("group_size")).first()[0]
    assert exactdup.look_up(docs, less).count() == exactdup.look_up(docs, index).count() - missing < docs.count()


@pytest.mark.parametrize("table_words", [0, wordtable.TABLE_WORDS])
def test_word_table_encodes_and_decodes_as_the_library(docs, empty, table_words):
    e = encoder(default_path("byte_bpe_50k.json")).library
    want = collections.Counter()
    for i, t in texts():
        ids = e.encode(t, add_special_tokens=False).ids
        want[(i, tuple(ids), e.decode(ids, skip_special_tokens=False))] += 1
    got = wordtable.encode(docs, table_words=table_words, decoded=True).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert wordtable.encode(empty, table_words=table_words).collect() == []


@pytest.mark.parametrize("bits", [64, 4])
def test_words_beyond_the_table_move_once_per_chunk_and_not_per_occurrence(spark, tmp_path, bits):
    """Ids come back to the documents' chunks, so the rows that move do not grow with occurrences; shared hashes are told apart."""
    r, e = np.random.default_rng(4), encoder(default_path("byte_bpe_50k.json")).library
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 200, 300))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = wordtable.encode(docs, table_words=50, decoded=True, hash_bits=bits)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {x.doc_id: (x.ids, x.decoded) for x in got.collect()} == {
        i: (e.encode(t, add_special_tokens=False).ids, t) for i, t in rows
    }
    split = wordtable.split_words(wordtable.in_chunks(docs), default_path("byte_bpe_50k.json"))
    assert split.select("chunk").distinct().count() == 3
    folder = wordtable.word_table(split, default_path("byte_bpe_50k.json"), bits)
    common, rest, shared = wordtable.divide(folder, spark, 0)
    dealt = spark.read.parquet(rest).count() if bits == 64 else 0
    assert spark.read.schema("hash long").parquet(common).count() == 0
    assert (len(shared) > 200 and not dealt) if bits == 4 else (not shared and 400 < dealt <= 3 * 2 * 200)


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, table = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == docs.columns, name
        table = corpus_pipeline.materialize(out, name)
        assert 0 < table.count() <= before
        before = table.count()
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF)
    assert last.select("doc_id").distinct().count() == before
    assert QUERIES["pipeline"](spark, SF).count() == last.count()


def test_a_task_run_twice_in_another_order_leaves_one_readable_archive(spark):
    """The index names the files of one attempt; a second attempt, rows in another order, is another file."""
    pages = [(i, f"http://x/{i}", f"page {i} " * (i + 1)) for i in range(30)]
    schema = "page_id long, url string, html string"
    folder = warc.fresh_path(spark, "twice")
    first = warc.write_archives(spark.createDataFrame(pages, schema).coalesce(1), folder).collect()
    before = spark.createDataFrame(first, warc.INDEX)
    warc.write_archives(spark.createDataFrame(pages[::-1], schema).coalesce(1), folder).collect()
    assert {r.page_id: r.payload.decode() for r in warc.read_archives(before).collect()} == {i: h for i, _, h in pages}
