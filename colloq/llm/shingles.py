"""Words and n-gram identifiers of texts, vectorised over the bytes of a batch.

Words are the maximal runs of bytes other than white space (x20, x09-x0D) after A-Z are
lower-cased. A word's identifier is a 64-bit hash of its bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random 64-bit number for each byte; A-Z share those of a-z.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = 1 << 20
_tables = {BASE: np.ones(1, "uint64"), INVERSE: np.ones(1, "uint64")}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    while len(have := _tables[base]) < n:
        _tables[base] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of an ordered pair of identifiers."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(identifiers of all words of a batch, bounds: text k has those from bounds[k] to bounds[k + 1])."""
    data = [(t or "").encode() for t in texts]
    ends = np.cumsum([0, *(len(d) + 1 for d in data)])  # a space between texts
    raw = np.frombuffer(b" ".join([*data, b""]), "uint8")
    space = IS_SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.r_[0, edge]
    start, stop = edge[::2], edge[1::2]
    out = np.empty(len(start), "uint64")
    # Words never cross a space, so sums over pieces of the batch that end at one are exact.
    at = 0
    while at < len(start):
        to = max(int(np.searchsorted(stop, start[at] + STEP)), at + 1)
        lo, hi = int(start[at]), int(stop[to - 1])
        sums = np.zeros(hi - lo + 1, "uint64")
        # Eight bytes for each byte of a piece, never of a whole text.
        inside = BYTE_CODE[raw[lo:hi]]
        inside[space[lo:hi]] = 0
        inside *= powers(BASE, hi - lo)
        np.cumsum(inside, out=sums[1:])
        s, e = start[at:to] - lo, stop[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * powers(INVERSE, hi - lo)[s] + (e - s).astype("uint64")
        at = to
    return mix(out), np.searchsorted(start, ends)


def blocks(batches, limit: int = 1 << 18):
    """(other columns as lists, texts) of Arrow batches in pieces of about ``limit`` characters.

    ``text`` is the last column of a batch. A text is never cut: one that is longer
    than the limit is a block of its own.
    """
    for batch in batches:
        *rest, texts = (c.to_pylist() for c in batch.columns)
        at, size = 0, 0
        for k, t in enumerate(texts):
            n = len(t) if t else 0
            if k > at and size + n > limit:
                yield [c[at:k] for c in rest], texts[at:k]
                at, size = k, 0
            size += n
        if at < len(texts):
            yield [c[at:] for c in rest], texts[at:]


def shingle_sets(texts: list[str | None], n: int):
    """For each text the sorted distinct identifiers of its n-word shingles.

    A text with fewer than n words has its whole sequence as one; without words, none.
    """
    ids, bounds = word_ids(texts)
    grams = ids
    for k in range(1, n):
        if len(grams) < 2:
            grams = grams[:0]
            break
        grams = pair(grams[:-1], ids[k:])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = ids[a : a + 1]
            for k in range(a + 1, b):
                whole = pair(whole, ids[k : k + 1])
            yield whole + np.uint64(b - a - 1)
        else:
            yield ids[:0]
