"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

1. Documents are tokenised where they lie; documents longer than the capacity are
   cut into full pieces after a shorter first one. Only (length, id) rows go on.
2. Pieces are range-sorted by length and ranked within their length. Ranks come
   from ranges of (length, id), so that a length which a third of all pieces have
   is spread over many tasks, and need only a count per range and length.
3. Rounds of best fit. There are at most ``capacity`` different lengths and as many
   different gaps, so a round works on sorted classes with their counts: each
   length sweeps to its successor (the smallest gap that holds it), where several
   lengths want the same gap the longest ranks first, equal pieces and equal gaps
   are matched by rank, gaps shrink, and the next round begins. Where the longest
   length left has no gap, new sequences open. The state is bounded by the
   capacity, not by the number of documents; it holds runs of ranks.
4. Every piece finds its run by binary search in a table that is broadcast and
   whose size the capacity bounds.

Defined results: a null or empty text is the end token alone; rows with equal ids
are packed one by one; a null doc_id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from array import array
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloq.llm.common import lean, table, written

VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks whose ids a worker keeps at a time; more only cost their encoding again.
CACHED_CHUNKS = 300_000


class ChunkIds(dict):
    """Little-endian ids of text chunks, filled on demand.

    The vocabulary's pattern lets a token begin with one space and otherwise never
    crosses into white space, so a text may be encoded chunk by chunk, where a chunk
    ends before a space that a non-space follows. Words repeat; their ids are looked up.
    """

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead = encode, lead

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        ids = array("I", self.encode(self.lead + chunk)).tobytes()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    """Token ids of whole texts as bytes of little-endian unsigned 32-bit numbers.

    The ids are those of the tokenizers library over the vocabulary's JSON. A text that holds an
    added token's literal goes to that library as a whole; for all others the rank
    file gives the same ids in less time.
    """

    def __init__(self, name: str = VOCABULARY, folder: str | None = None):
        import base64
        import json
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranked, whole = (os.path.join(folder, f) if folder else public_tokenizers.path(f) for f in (f"{name}.tiktoken", f"{name}.json"))
        with open(ranked, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.later = ChunkIds(self.encode, ""), ChunkIds(self.encode, " ")
        with open(whole, encoding="utf-8") as lines:
            self.added = [t["content"] for t in json.load(lines)["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(whole)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        chunks = text.split(" ")
        if "" in chunks or any(c[0].isspace() for c in chunks):
            return array("I", self.encode(text)).tobytes()
        return self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))


@functools.lru_cache(maxsize=2)
def encoder(name: str, folder: str | None) -> Encoder:
    return Encoder(name, folder)


def cut(ids: bytes, capacity: int, end: bytes):
    """(piece, start, length, crc32) of a document's ids and the end token after them."""
    ids += end
    n = len(ids) // 4
    at, k = 0, 0
    while at < n:
        length = (n - 1) % capacity + 1 if at == 0 else capacity
        yield k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])
        at, k = at + length, k + 1


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    def run(batches):
        encode, end = encoder(vocabulary, folder), array("I", [end_id]).tobytes()
        for batch in batches:
            out = [(d, *p) for d, t in zip(batch[0].to_pylist(), batch[1].to_pylist()) for p in cut(encode(t), capacity, end)]
            columns = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Runs (first rank, first sequence, offset) of each length, and the number of sequences.

    Pieces of a run have consecutive ranks and go, one each, into consecutive sequences.
    """
    left = {n: c for n, c in counts.items() if c}
    placed = dict.fromkeys(left, 0)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    gaps: dict[int, deque] = {}  # gap -> runs [first sequence, count]
    opened = 0
    while left:
        lengths, open_gaps = sorted(left, reverse=True), sorted(gaps)
        wanted: dict[int, int] = {}  # gap -> the longest length that wants it
        for n in lengths:
            k = bisect.bisect_left(open_gaps, n)
            if k < len(open_gaps):
                wanted.setdefault(open_gaps[k], n)
            elif n == lengths[0]:  # nothing holds the longest: open as many as it fills
                each = capacity // n
                more = -(-left[n] // each)
                gaps.setdefault(capacity, deque()).append([opened, more])
                opened += more
                wanted[capacity] = n
                break
        moved = []
        for gap, n in wanted.items():
            queue = gaps[gap]
            while queue and left[n]:
                first, count = queue[0]
                take = min(count, left[n])
                runs[n].append((placed[n], first, capacity - gap))
                placed[n] += take
                left[n] -= take
                if gap > n:
                    moved.append((gap - n, [first, take]))
                if take == count:
                    queue.popleft()
                else:
                    queue[0] = [first + take, count - take]
            if not queue:
                del gaps[gap]
        for gap, run in moved:
            gaps.setdefault(gap, deque()).append(run)
        left = {n: c for n, c in left.items() if c}
    return dict(runs), opened


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds range (its number) and rank (within range and length)."""

    def run(batches):
        from pyspark import TaskContext

        number, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch["length"].to_numpy(zero_copy_only=False)
            if not len(n):
                continue
            starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
            ranks = np.arange(len(n)) - np.repeat(starts, np.diff(np.r_[starts, len(n)]))
            if n[0] == last:
                ranks[: starts[1] if len(starts) > 1 else len(n)] += seen
            last, seen = n[-1], int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), number, "int32")), pa.array(ranks)], [*batch.schema.names, "range", "rank"])

    keys = ["length", "doc_id", "piece", "ids_crc32"]
    return pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), PIECES + ", range int, rank long")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    # Written before it is range-sorted: sampling the ranges would else tokenise every text again.
    rows = written(ranked(written(pieces, "pieces")), "ranked")
    # One count per range and length: as many as there are ranges and lengths together.
    parts = rows.groupBy("length", "range").count().orderBy("length", "range").collect()
    counts: dict[int, int] = defaultdict(int)
    before = {}
    for n, part, count in parts:
        before[n, part] = counts[n]
        counts[n] += count
    runs, _ = best_fit(counts, capacity)
    shared = spark.sparkContext.broadcast((before, {n: tuple(np.array(x, "int64") for x in zip(*r)) for n, r in runs.items()}))

    def place(batches):
        offset_of, table_of = shared.value
        for batch in batches:
            n = batch["length"].to_numpy(zero_copy_only=False)
            part = batch["range"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False).copy()
            sequence, offset = np.empty(len(n), "int64"), np.empty(len(n), "int64")
            starts = np.flatnonzero(np.r_[True, (n[1:] != n[:-1]) | (part[1:] != part[:-1])]) if len(n) else []
            for s, e in zip(starts, [*starts[1:], len(n)]):
                own = rank[s:e] + offset_of[int(n[s]), int(part[s])]
                first_rank, first_sequence, at = table_of[int(n[s])]
                k = np.searchsorted(first_rank, own, "right") - 1
                sequence[s:e], offset[s:e] = first_sequence[k] + own - first_rank[k], at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(token_pieces(docs, capacity, end_id), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return pack_documents(docs)
