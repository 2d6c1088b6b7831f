"""Removal of repeated passages against a plain scan, and its parts."""

import hashlib

import numpy as np
import pytest

from steadyhum.llm import suffixdedup
from steadyhum.llm.files import read_ranges

SCHEMA = "doc_id long, text string, block long, bits string, n_bytes long"


def brute(docs, length):
    """[(doc_id, removed spans, kept bytes)], ascending by id."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            seen.add(s)
        spans, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end]:
                end += 1
            if end > at:
                spans.append((at, end))
            at = max(end, at + 1)
        out.append((doc_id, len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def check(spark, docs, length, block_bytes=suffixdedup.BLOCK_BYTES, partitions=3):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA).repartition(partitions)
    got = [
        (r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))
        for r in suffixdedup.remove_repeats(df, length, block_bytes).collect()
    ]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == brute(docs, length)


def corpus(seed, n, alphabet="ab é"):
    """Texts with shared passages at any offsets, near copies, copies and runs."""
    r = np.random.default_rng(seed)
    letters = lambda k: "".join(r.choice(list(alphabet), int(k)))
    passages = [letters(r.integers(20, 400)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [letters(r.integers(0, 300))]
        for _ in range(r.integers(0, 3)):
            p = passages[r.integers(len(passages))]
            a = r.integers(0, len(p))
            parts += [p[a : a + r.integers(1, len(p) + 1)], letters(r.integers(0, 90))]
        docs.append((int(r.integers(-50, 50)) * 1000 + i, "".join(parts)))
    docs += [(docs[k][0] + 100000, docs[k][1]) for k in range(0, n, 4)]
    docs += [(docs[k][0] + 200000, docs[k][1][: len(docs[k][1]) // 2] + "!" + docs[k][1][len(docs[k][1]) // 2 :]) for k in range(0, n, 5)]
    docs += [(900000, "x" * 700), (900001, "xy" * 300), (900002, None), (900003, ""), (None, passages[0]), (900004, "ab" * 49)]
    return docs


@pytest.mark.parametrize("seed, length, block_bytes", [(1, 100, 1000), (2, 100, 1 << 20), (3, 30, 500), (4, 12, 300), (5, 1, 200)])
def test_equals_a_plain_scan(spark, seed, length, block_bytes):
    check(spark, corpus(seed, 30, "abcdefgh é" if length > 12 else "ab"), length, block_bytes)


def test_a_long_text_and_an_empty_table(spark):
    r = np.random.default_rng(9)
    long = "".join(r.choice(list("abcdef "), 300_000))
    check(spark, [(1, long), (2, "-" + long[1000:5000] + "+" + long[200_000:200_050]), (3, long[5:105])], 100, 1 << 16)
    check(spark, [], 100)


def test_rows_with_equal_ids_lose_a_passage_once(spark):
    text = "".join(np.random.default_rng(3).choice(list("abcdefgh"), 250))
    df = spark.createDataFrame([(7, text, 1, "x", 2), (7, "- " + text, 1, "x", 2)], SCHEMA).repartition(2)
    rows = suffixdedup.remove_repeats(df, 100).collect()
    assert sorted(r.n_removed for r in rows) == [0, 250] and sum(len(r.kept) for r in rows) == 252


def test_covers_serve_every_pair_of_suffixes():
    for period, offsets in suffixdedup.COVERS.items():
        assert {(a - b) % period for a in offsets for b in offsets} == set(range(period))
    for length in range(1, 300):
        period, _ = suffixdedup.cover_for(length)
        assert length - period + 1 >= 1


def test_fingerprints_depend_on_the_bytes_alone():
    r = np.random.default_rng(1)
    data = r.integers(0, 3, 3 * suffixdedup.SLICE).astype(np.uint8)
    for size in (1, 2, 13, 44, 100, 156):
        every = np.arange(len(data) - size + 1)
        got = suffixdedup.fingerprints(data, size, every)
        some = np.sort(r.choice(every, 300, replace=False))
        assert (suffixdedup.fingerprints(data, size, some) == got[some]).all()
        for i in some.tolist():
            assert suffixdedup.fingerprints(data[i : i + size].copy(), size, np.zeros(1, int))[0] == got[i]
        strings = {bytes(data[i : i + size]) for i in range(len(got))}
        assert len(np.unique(got)) == len(strings)
    assert len(suffixdedup.fingerprints(data, 9, np.zeros(0, int))) == 0


def test_blocks_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} é" * 20) for i in range(20)], "doc_id long, text string").coalesce(1)
    index = suffixdedup.write_blocks(df, f"file:{tmp_path}/blocks", 1000).collect()
    assert len(index) > 3
    back = []
    for row in index:
        (packed,) = read_ranges(row.file, [(row.offset, row.length)])
        block = suffixdedup.Block.from_bytes(packed)
        for i, a, b in zip(block.doc_ids, block.starts, block.ends, strict=True):
            back.append((i, bytes(block.data[a:b]).decode()))
    assert sorted(back) == [(i, f"text {i} é" * 20) for i in range(20)]


def test_report_has_digests(spark):
    text = "".join(np.random.default_rng(4).choice(list("abcdefgh"), 150))
    df = spark.createDataFrame([(1, text), (2, text + "?")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixdedup.repeat_report(df).collect()}
    assert rows[2].n_removed == 150 and rows[2].n_spans == 1
    assert rows[2].kept_sha256 == hashlib.sha256(b"?").hexdigest()
