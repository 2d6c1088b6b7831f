"""Vector codes against plain integer arithmetic."""

import hashlib
import math
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from steadyhum.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, part int, error long"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error, label_error)} and the digest of the codebooks."""
    usable = [
        (i, [math.floor(scale * Fraction(x)) for x in v], label)
        for i, v, label in rows
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)
    ]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    if not usable:
        return [], hashlib.sha256(b"").hexdigest()
    width = len(usable[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in usable]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def best(p, own):
        far = [sum((a - b) ** 2 for a, b in zip(own, e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        chosen = [[best(p, c[p])[0] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, chosen, strict=True) if a[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    out, by_label = [], {}
    for (i, _, label), c in zip(usable, cut, strict=True):
        found = [best(p, c[p]) for p in range(parts)]
        error = sum(d for _, d in found)
        out.append((i, "".join(f"{e:02x}" for e, _ in found), error, label))
        by_label[label] = by_label.get(label, 0) + error
    flat = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, c, e, by_label[label]) for i, c, e, label in out], hashlib.sha256(flat.encode()).hexdigest()


def report(spark, rows):
    full = [(i, v, label, "x", 1, 2) for i, v, label in rows]
    got = vectorcodes.code_report(spark.createDataFrame(full, SCHEMA).repartition(3)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    digests = {r.codebooks_sha256 for r in got}
    return sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=key), digests


def check(spark, rows):
    want, digest = brute(rows)
    got, digests = report(spark, rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert got == sorted(want, key=key)
    assert digests == ({digest} if want else set())


def test_codes_equal_plain_arithmetic(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=32).round(2).tolist(), i % 3 if i % 5 else None) for i in range(150)]
    rows += [(200 + i, [float(i % 2)] * 32, 7) for i in range(20)]  # repeated vectors and ties
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 31, 1), (303, [None] + [1.0] * 31, 1)]
    rows += [(304, [math.nan] * 32, 1), (305, [math.inf] + [0.0] * 31, 1), (306, [0.5] * 16, 1)]
    rows += [(None, [0.25] * 32, None), (5, [0.1] * 32, 2)]  # a null id, a repeated id
    check(spark, rows)


def test_few_rows_and_none(spark):
    check(spark, [(3, [-0.00001] * 8, None), (1, [2.5] * 8, 1)])
    check(spark, [])
    check(spark, [(1, None, 1)])


def test_components_too_large_for_int64_products(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=8) * 10.0 ** (i % 6)).tolist(), 1) for i in range(40)]
    check(spark, rows)
    big = np.array([[[1 << 40, -(1 << 40)]]], dtype=np.int64)
    codes, error = vectorcodes.nearest(big, np.array([[[0, 0], [1 << 40, 1 << 40]]], dtype=np.int64))
    assert codes.tolist() == [[0]] and error.tolist() == [[2 << 80]]


@settings(max_examples=60, deadline=None)
@given(
    st.integers(1, 9), st.integers(1, 40), st.sampled_from([None, 3, 8, 20]), st.integers(0, 2**32 - 1), st.integers(1, 28)
)
def test_limb_products_are_exact(rows, width, bits, seed, size):
    r = np.random.default_rng(seed)
    a = r.integers(-(1 << size), 1 << size, (2, rows, width))
    b = r.integers(-(1 << size), 1 << size, (2, width, 4))
    want = a.astype(object) @ b.astype(object)
    assert (vectorcodes.dot_products(a, b, bits) == want.astype(np.int64)).all()


def test_floors_go_down():
    got = vectorcodes.to_integers(np.array([-0.00001, 0.00001, -1.0, 1e30]))
    assert got.tolist() == [-1, 0, -4096, math.floor(4096 * Fraction(1e30))]


def test_decoded_vectors_are_the_entries(spark):
    rows = [(i, [i / 4] * 8, 1) for i in range(6)]
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    codes, books = vectorcodes.compress(df)
    back = {r.vec_id: r.vector for r in vectorcodes.decompress(codes, books).collect()}
    assert back == {i: v for i, v, _ in rows}
