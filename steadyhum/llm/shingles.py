"""Sets of word shingles of texts, and b-bit MinHash sketches of them, with numpy.

A word is a run of bytes other than blank, tab, newline, vertical tab, form feed and carriage
return, with A-Z lower-cased. All words of a batch of texts are hashed together: a word's hash
is the difference of two prefix sums of a polynomial over the bytes, modulo 2^64.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE_WORDS = 5
CHUNK_BYTES = 2 << 20
BANDS = 24
ROWS = 4
HASHES = 384  # the first BANDS * ROWS of them make the bands, all of them the signature
LOW_BITS = 2

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C13  # odd, so that it has an inverse modulo 2^64
MIX_1, MIX_2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
FACTORS = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).reshape(HASHES, 1)
TERMS = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32).reshape(HASHES, 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = U(base)
    return np.cumprod(out, dtype=np.uint64)


POWERS = _powers(BASE, CHUNK_BYTES + 1)
INVERSES = _powers(pow(BASE, -1, 1 << 64), CHUNK_BYTES + 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * MIX_1
    h = (h ^ (h >> U(27))) * MIX_2
    return h ^ (h >> U(31))


def chunk_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of at most ``CHUNK_BYTES`` bytes."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~BLANK[data]
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * POWERS[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * INVERSES[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * MIX_1)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    if len(text) <= CHUNK_BYTES:
        return chunk_words(np.frombuffer(text, np.uint8))[1]
    out, at = [], 0
    data = np.frombuffer(text, np.uint8)
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        if end < len(data):
            blanks = np.flatnonzero(BLANK[data[at:end]])
            if len(blanks) == 0:  # one word longer than a chunk: hash it by its digest
                rest = np.flatnonzero(BLANK[data[end:]])
                stop = end + int(rest[0]) if len(rest) else len(data)
                digest = hashlib.blake2b(text[at:stop].lower(), digest_size=8).digest()
                out.append(np.frombuffer(digest, np.uint64))
                at = stop
                continue
            end = at + int(blanks[-1]) + 1
        out.append(chunk_words(data[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, SHINGLE_WORDS)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * MIX_2 + words[k : n - width + 1 + k])
    return np.unique(h)


def sets_of(texts: list[bytes]) -> list[np.ndarray]:
    """Shingle sets of many texts; short ones are hashed together."""
    out: list[np.ndarray] = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        lengths = np.array([len(texts[i]) + 1 for i in group])
        starts, hashes = chunk_words(np.frombuffer(b"\n".join(texts[i] for i in group), np.uint8))
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        for j, i in enumerate(group):
            out[i] = shingle_set(hashes[cuts[j] : cuts[j + 1]])

    for i, text in enumerate(texts):
        if len(text) + 1 > CHUNK_BYTES // 2:
            out[i] = shingle_set(word_hashes(text))
            continue
        if size + len(text) + 1 > CHUNK_BYTES:
            flush()
            group, size = [], 0
        group.append(i)
        size += len(text) + 1
    if group:
        flush()
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two shingle sets have 100 * shared >= percent * all, both not empty."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The ``HASHES`` MinHash minima of a set that is not empty."""
    x = (shingles >> U(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        part = FACTORS * x[at : at + 4096] + TERMS
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, of all bits of its minima and the band's number."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in best[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        h = mix(h * MIX_2 + column.astype(np.uint64))
    return h.view(np.int64)


def packed_signature(best: np.ndarray) -> np.ndarray:
    """The low bits of the mixed minima, 64 / LOW_BITS of them to a long.

    Without mixing, the low bits of ``a * x + b`` with odd ``a`` would agree for all hashes or for none.
    """
    per = 64 // LOW_BITS
    low = (mix(best.astype(np.uint64)) & U((1 << LOW_BITS) - 1)).reshape(-1, per)
    shifts = (np.arange(per, dtype=np.uint64) * U(LOW_BITS))[None, :]
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)
