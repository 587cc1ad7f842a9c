"""Shelves of words inside tasks: the numbered words of a stretch, packed for the way, and slices of them.

A shelf is ``SHELF`` numbers under one stem, and the first ``REACH`` of the next shelf too. Places on it are counted from its first number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers of a shelf, a power of two, and how far it reaches into the next: references no longer than that lie on one shelf.
SHELF, REACH = 4096, 512
#: Numbered words of a file stand in blocks of so many numbers, a power of two.
BLOCK = 32
KEYS = ("meeting_id", "speaker", "stem", "shelf")
#: Texts are sent on when they are so many bytes.
AT_ONCE = 4 << 20
#: First and last bytes that may belong to white space, which are looked at closely.
EDGES = frozenset([*range(0x21), *range(0x80, 0x100)])
PIECE = pa.struct([("child_pos", pa.int32()), ("word_pos", pa.int64()), ("mine", pa.bool_()), ("starttime", pa.float64()), ("endtime", pa.float64()), ("text", pa.string()), ("there", pa.bool_())])


def _changes(columns: list, n: int) -> np.ndarray:
    """Where rows begin that differ from the row before, and the end."""
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(new), [n]])


def _codes(c: pa.Array) -> np.ndarray:
    return c.dictionary_encode(null_encoding="encode").indices.to_numpy()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of words (stem, n and the rest) as one row for each shelf in a batch. A shelf's first words go to the shelf before, too."""
    codec = pa.Codec("zstd")
    for b in batches:
        if not b.num_rows:
            continue
        n = b["n"].to_numpy()
        near = np.flatnonzero((n >= SHELF) & (n & (SHELF - 1) < REACH))
        rows = np.concatenate([np.arange(len(n)), near])
        shelf = np.concatenate([n // SHELF, n[near] // SHELF - 1])
        names = [_codes(b[c])[rows] for c in KEYS[:3]]
        first = _changes([*names, shelf], len(rows))
        if len(first) > len(rows) // 16:  # words of many files by turns
            order = np.lexsort((n[rows], shelf, *reversed(names)))
            rows, shelf, names = rows[order], shelf[order], [c[order] for c in names]
            first = _changes([*names, shelf], len(rows))
        # A space after each text, so that slices are joined already.
        text = pc.binary_join_element_wise(b["text"].cast(pa.large_binary()), *(pa.scalar(x, pa.large_binary()) for x in (b"", b" "))).take(pa.array(rows))
        length = pc.fill_null(pc.binary_length(text), 0).to_numpy().astype("<i4")
        ends, data = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]), memoryview(text.buffers()[2] or b"")
        # Times as the differences of their bits, which are exact and mostly small. What is missing comes before all else.
        start, end = (pc.fill_null(b[c], -np.inf).to_numpy()[rows].view("<i8") for c in ("starttime", "endtime"))
        at = (n[rows] - shelf * SHELF).astype("<i2")
        steps, later, lasts = np.diff(at, prepend=at[:1]), np.diff(start, prepend=start[:1]), end - start
        steps[first[:-1]], later[first[:-1]] = at[first[:-1]], start[first[:-1]]
        found = []
        for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
            raw = b"".join((steps[x:y].tobytes(), length[x:y].tobytes(), later[x:y].tobytes(), lasts[x:y].tobytes(), data[ends[x] : ends[y]]))
            found.append(struct.pack("<II", y - x, len(raw)) + codec.compress(raw, asbytes=True))
        heads = pa.array(rows[first[:-1]])
        yield pa.RecordBatch.from_arrays([*(b[c].take(heads) for c in KEYS[:3]), pa.array(shelf[first[:-1]]), pa.array(found, pa.binary())], names=[*KEYS, "words"])


class Shelf:
    """The words of one shelf in order of their places; of equal ids the one that starts last."""

    def __init__(self, packs: list[bytes]):
        codec, parts, texts = pa.Codec("zstd"), [], []
        for pack in packs:
            m, size = struct.unpack_from("<II", pack)
            raw = codec.decompress(memoryview(pack)[8:], size, asbytes=True)
            start = np.cumsum(np.frombuffer(raw, "<i8", m, 6 * m))
            at = np.cumsum(np.frombuffer(raw, "<i2", m), dtype=np.int64)
            parts.append((at, np.frombuffer(raw, "<i4", m, 2 * m), start, start + np.frombuffer(raw, "<i8", m, 14 * m), raw[22 * m :]))
        parts.sort(key=lambda p: p[0][0])
        at, length, start, end = (np.concatenate([p[k] for p in parts]) for k in range(4))
        start, end, joined = start.view("f8"), end.view("f8"), b"".join(p[4] for p in parts)
        #: Where a word's text begins among the joined ones, each with a space after it; words without text take no place.
        place = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        if (np.diff(at) <= 0).any():
            known, texts = {}, [joined[x:y] for x, y in zip(place[:-1].tolist(), place[1:].tolist())]
            number = lambda t: (t != t, 0.0 if t != t else t)
            for k in sorted(range(len(at)), key=lambda k: (at[k], number(start[k]), number(end[k]), texts[k] != b"", texts[k][:-1])):
                known[int(at[k])] = k
            order = list(known.values())
            at, length, start, end, joined = at[order], length[order], start[order], end[order], b"".join(texts[k] for k in order)
            place = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        self.at, self.start, self.end, self.place, self.joined = at, start, end, place, joined
        # Times of 0 are missing; one more for slices that begin at the end.
        self.low = np.append(np.where((start == 0) | (start == -np.inf), np.inf, start), np.inf)
        self.high = np.append(np.where((end == 0) | (end == -np.inf), -np.inf, end), -np.inf)

    def text(self, x: int, y: int) -> bytes | None:
        """The texts of words x to y, without y."""
        return self.joined[self.place[x] : self.place[y] - 1] if self.place[x] < self.place[y] else None

    def slices(self, first: np.ndarray, last: np.ndarray) -> tuple:
        """(first byte, byte after, least start, greatest end) of the words at places first to last, each inclusive."""
        i, j = np.searchsorted(self.at, first, "left"), np.searchsorted(self.at, last, "right")
        both = np.column_stack([i, j]).ravel()
        low, high = np.minimum.reduceat(self.low, both)[::2], np.maximum.reduceat(self.high, both)[::2]
        return self.place[i], self.place[j] - 1, np.where(i < j, low, np.inf), np.where(i < j, high, -np.inf)


def _acts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, where shelves begin, where acts begin) of sorted rows, cut so that all rows of a shelf and an act are in one batch."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        shelves = [*(_codes(b[c]) for c in KEYS[:3]), b["shelf"].to_numpy()]
        acts = _changes([*shelves, _codes(b["doc_order"])], b.num_rows)
        cut, held = acts[-2], b.slice(acts[-2])
        if cut:
            yield b.slice(0, cut), _changes([c[:cut] for c in shelves], cut), acts[:-1]
    if held is not None:
        yield held, np.array([0, held.num_rows]), np.array([0, held.num_rows])


def _met(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """(batch, rows, shelf) of sorted rows that ask for something of a shelf, then (batch, None, None): rows of acts that lie on one shelf whole, or those of others.

    An act does if as many of its references as it has are there, none of them by parts.
    """
    known, shelf, packs = None, None, []
    for b, ends, acts in _acts(batches):
        words = b["words"].is_valid().to_numpy(zero_copy_only=False)
        there = np.add.reduceat(b["part"].is_null().to_numpy(zero_copy_only=False).astype(int), acts[:-1])
        there = np.repeat(there, np.diff(acts)) == pc.fill_null(b["refs"], -1).to_numpy()
        asked = ~words & (there == whole)
        for x, y in zip(ends[:-1], ends[1:]):
            if (key := tuple(b[c][x].as_py() for c in KEYS)) != known:
                known, shelf, packs = key, None, []
            packs += [b["words"][k].as_py() for k in (x + np.flatnonzero(words[x:y])).tolist()]
            if packs and len(rows := x + np.flatnonzero(asked[x:y])):
                shelf = shelf or Shelf(packs)
                yield b, rows, shelf
        yield b, None, None


def _lists(c: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows that hold arrays, and where each row's begin, and the end."""
    own = c.take(pa.array(rows))
    return own.flatten().to_numpy(), np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])


def _stripped(t: bytes) -> bytes:
    if t and (t[0] in EDGES or t[-1] in EDGES):
        return t.decode("utf-8", "surrogateescape").strip().encode("utf-8", "surrogateescape")
    return t


def _strings(texts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(texts))])


def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(act keys, text, starttime, endtime) of acts that lie on one shelf; acts without text are dropped."""
    rows, texts, starts, ends, size = [], [], [], [], 0

    def sent(b):
        at = pa.array(rows, pa.int64())
        time = lambda t: pa.array(np.where(np.isinf(t), 0.0, t), pa.float64())
        out = [*(b[c].take(at) for c in ("meeting_id", "speaker", "doc_order")), _strings(texts), time(np.array(starts)), time(np.array(ends))]
        for x in (rows, texts, starts, ends):
            x.clear()
        return pa.RecordBatch.from_arrays(out, names=["meeting_id", "speaker", "doc_order", "text", "starttime", "endtime"])

    for b, own, shelf in _met(batches, True):
        if shelf is None:
            if rows:
                yield sent(b)
                size = 0
            continue
        (first, begin), (final, _) = _lists(b["first"], own), _lists(b["last"], own)
        # The rows of one act stand together.
        acts = _changes([pc.fill_null(b["doc_order"], 0).to_numpy()[own]], len(own))
        begin = begin[acts]
        x, y, low, high = shelf.slices(first, final)
        low, high = np.minimum.reduceat(low, begin[:-1]).tolist(), np.maximum.reduceat(high, begin[:-1]).tolist()
        x, y, begin, joined = x.tolist(), y.tolist(), begin.tolist(), shelf.joined
        for k, row in enumerate(own[acts[:-1]].tolist()):
            # A slice without texts ends before it begins.
            text = _stripped(b" ".join([joined[x[r] : y[r]] for r in range(begin[k], begin[k + 1]) if x[r] <= y[r]]))
            if text:
                rows.append(row)
                texts.append(text)
                starts.append(low[k])
                ends.append(high[k])
                size += len(text)
            if size > AT_ONCE:
                yield sent(b)
                size = 0


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(act keys, piece) of acts that lie on several shelves: an item for each block's slice where an id is asked for under one spelling, else one for each word."""
    rows, found, size = [], [], 0
    time = lambda t: None if np.isinf(t) else float(t)

    def items(shelf, first, last, child, base, part):
        i, j = np.searchsorted(shelf.at, first, "left"), np.searchsorted(shelf.at, last, "right")
        if not (part["mine"] and part["raw"]):
            there = part["raw"] or not part["in_range"]
            own = lambda t: None if t == -np.inf else float(t)
            return [(child, base + int(shelf.at[k]), part["mine"], own(shelf.start[k]), own(shelf.end[k]), shelf.text(k, k + 1), there) for k in range(i, j)]
        # Where both spellings are one, nothing else can stand in these places: a slice is one text and two times, whatever its words.
        begin = i + _changes([shelf.at[i:j] // BLOCK], j - i) if i < j else [i]
        return [(child, base + int(shelf.at[x]), True, time(shelf.low[x:y].min()), time(shelf.high[x:y].max()), shelf.text(x, y), True) for x, y in zip(begin[:-1], begin[1:])]

    def sent(b):
        at, flat = pa.array(rows, pa.int64()), [x for own in found for x in own]
        columns = [pa.array([x[k] for x in flat], pa.binary()).view(pa.string()) if t.name == "text" else pa.array([x[k] for x in flat], t.type) for k, t in enumerate(PIECE)]
        ends = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32))
        out = [*(b[c].take(at) for c in ("meeting_id", "speaker", "doc_order")), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(PIECE)))]
        rows.clear()
        found.clear()
        return pa.RecordBatch.from_arrays(out, names=["meeting_id", "speaker", "doc_order", "piece"])

    for b, own, shelf in _met(batches, False):
        if shelf is None:
            if rows:
                yield sent(b)
                size = 0
            continue
        taken = [b[c].take(pa.array(own)).to_pylist() for c in ("first", "last", "child_pos", "part")]
        for row, first, last, child, part in zip(own.tolist(), *taken):
            # Without part, a range or ids one after another, all of this shelf.
            its = [x for k, (f, n) in enumerate(zip(first, last)) for x in items(shelf, f, n, child, part["base"] if part else k - f, part or {"mine": True, "raw": True})]
            if its:
                rows.append(row)
                found.append(its)
                size += sum(100 + len(x[5] or b"") for x in its)
            if size > AT_ONCE:
                yield sent(b)
                size = 0
