"""Collocations against plain Python, and the counting trie alone."""

import collections
import re

import numpy as np
import pytest

from steadyhum.llm import phrases

SCHEMA = "text string, lang string, doc_id long, n long, word string, id long, size int"


def brute(docs, least, longest=4, share=80, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = collections.Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[lang, w[i : i + n]] = max(inside[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * inside[lang, w] >= share * a:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]  # noqa: E741
            cuts.append((2000000 * a // (l + r), k, l, r))
        score, _, l, r = min(cuts)  # noqa: E741
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {
        (lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    }


def check(spark, docs, least, top=2000):
    df = spark.createDataFrame([(t, lang, 1, 2, "x", 3, 4) for t, lang in docs], SCHEMA).repartition(3)
    got = {tuple(r) for r in phrases.collocations(df, min_count=least, top=top).collect()}
    assert got == brute(docs, least, top=top)


def corpus(seed, n):
    r = np.random.default_rng(seed)
    lexicon = ["the", "The", "of", "é", "naïve", "a b", "x-y", "x", "日本", "q\x00", "İ"] + [f"w{i}" for i in range(20)]
    common = ["of the w1 x", "new york city", "x x x x x x", "New York"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(r.integers(0, 25)):
            said = common[r.integers(4)] if r.random() < 0.3 else " ".join(r.choice(lexicon, r.integers(1, 7)))
            parts.append(said + r.choice([" ", ", ", "\n", "\t ", ". ", "!?", "\r\n", "\x0b"]))
        docs.append(("".join(parts), ["en", "de", None, "und", ""][r.integers(5)]))
    return docs + [("", "en"), (None, "en"), ("...", "fr"), ("   \t", None)]


@pytest.mark.parametrize("seed, least", [(1, 3), (2, 10)])
def test_equals_plain_python(spark, seed, least):
    check(spark, corpus(seed, 120), least)


def test_ranks_end_with_the_best(spark):
    check(spark, corpus(3, 120), 2, top=7)


def test_small_tries_and_slices_change_nothing(spark, monkeypatch):
    """Spills, bursts and cuts happen all the time here; workers are forked with these settings."""
    docs = corpus(4, 60)
    data = {}
    for held in (phrases.PHRASES_HELD, 50):
        tries = {n: phrases.Trie(n, 5) for n in (2, 3)}
        words, found = phrases.Words(0), collections.Counter()
        for text, _ in docs:
            for part in phrases.cut((text or "").encode(), 30):
                if not part:
                    continue
                _, _, _, ids, pieces = words.split(np.frombuffer(part, np.uint8), np.zeros(1, int))
                for n, trie in tries.items():
                    at = np.arange(max(0, len(ids) - n + 1))
                    at = at[pieces[at] == pieces[at + n - 1]]
                    trie.add(phrases.phrases_at(ids, at, n))
                    if len(trie) > held:
                        for p, c in trie.spill(held // 2):
                            found.update(dict.fromkeys(map(bytes, p), 0))
                            for key, k in zip(map(bytes, p), c.tolist(), strict=True):
                                found[key] += k
                        assert len(trie) <= held // 2
        for trie in tries.values():
            for p, c in trie.spill():
                for key, k in zip(map(bytes, p), c.tolist(), strict=True):
                    found[key] += k
            assert len(trie) == 0
        data[held] = found
    assert data[50] == data[phrases.PHRASES_HELD]
    assert sum(data[50].values()) == sum(
        max(0, len(re.findall("[^ \t]+", piece)) - n + 1)
        for text, _ in docs
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text or "")
        for n in (2, 3)
    )


def test_runs_are_sorted_and_merge_to_sums():
    r = np.random.default_rng(8)
    some = r.integers(0, 5, (4000, 3)).astype(np.uint64) << np.uint64(40)
    found = collections.defaultdict(list)
    for half in (some[:1500], some[1500:]):
        trie = phrases.Trie(3, 10)
        trie.add(half)
        for p, c in trie.spill():
            for lang, size, part, ids, counts in phrases.runs("en", p, c, 7):
                own = np.frombuffer(ids, np.uint64).reshape(-1, size)
                assert lang == "en" and own.tolist() == sorted(own.tolist()) and 0 <= part < 7
                found[part].append((own, np.frombuffer(counts, np.uint64)))
    got = {}
    for own in found.values():
        p, c = phrases.merged(np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]), 30)
        assert not got.keys() & set(map(tuple, p.tolist()))
        got |= dict(zip(map(tuple, p.tolist()), c.tolist(), strict=True))
    want = collections.Counter(map(tuple, some.tolist()))
    assert got == {k: n for k, n in want.items() if n >= 30}


def test_filter_holds_all_it_was_given(spark):
    r = np.random.default_rng(2)
    ids = r.integers(-(2**62), 2**62, (3000, 2))
    df = spark.createDataFrame([("en" if i % 3 else "", x) for i, x in enumerate(ids.tolist())], "lang string, ids array<long>")
    known = phrases.Filter(*phrases.write_filter(df.repartition(4), 2))
    keys = ids.view(np.uint64)
    which = np.arange(3000) % 3 > 0
    assert known.has(phrases.filter_keys("en", keys[which])).all() and known.has(phrases.filter_keys("", keys[~which])).all()
    assert known.has(phrases.filter_keys("fr", keys)).mean() < 0.05


def test_ids_are_taken_anew_when_words_share_one(spark, monkeypatch):
    docs = spark.createDataFrame([("a b a b c", "en")], "text string, lang string")
    real, seeds = phrases.count_words, []

    def with_a_clash(docs, seed):
        seeds.append(seed)
        found = real(docs, seed)
        return found if seed else found.selectExpr("lang", "if(id is null, null, 7L) as id", "word", "n")

    monkeypatch.setattr(phrases, "count_words", with_a_clash)
    kept, seed = phrases.vocabulary(phrases.spoken(docs), 2)
    assert seeds == [0, 1] and seed == 1
    assert sorted((r.word or "", r.n) for r in kept.collect()) == [("", 5), ("a", 2), ("b", 2)]


def test_an_empty_table(spark):
    check(spark, [], 1)
