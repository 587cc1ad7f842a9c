"""Importance resampling towards a target: hashed n-gram features, weights by bucket, Gumbel scores, an exact draw.

Features are the runs of 1 to ``n`` words of a text, repeats counted, hashed into ``BUCKETS`` buckets by crc32. A bucket's gain says how much more
frequent it is in the target than in the source; a document's weight is the mean gain of its features, and its score
adds Gumbel noise that only its id decides, so that drawing the highest scores is a weighted draw without replacement.

Texts over ``CHUNK_BYTES`` are cut into chunks at word boundaries. A chunk owns the words that start in it
and carries the next n - 1 words, so every run of words belongs to the chunk that owns its first word, and none is lost or
counted twice. Chunks are dealt out by (row, chunk): a very long text is the work of many tasks. Counts and gains of chunks
are summed by document; other texts are one chunk and need no shuffle. Counts of all texts are summed in each task first: what is
shuffled is a row for each task and bucket, and the driver sees one row for each bucket, ``BUCKETS`` in all.
The draw orders documents by ``colloq.llm.ranks``: a range sort, of which nothing grows on the driver.

Words are runs of letters a-z, digits and characters beyond ASCII, after A-Z are lower-cased.

Defined results: a null or empty text, or one without words, has no features and weight 0; it is scored but, having fewer than
``LEAST_WORDS`` words, not drawn; a null id is hashed as the empty text and comes last among equal scores; repeated rows are
scored and drawn each (ties: smaller doc_id, then fewer features); no target texts leave gains by the source alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import lean, table, written
from colloq.llm.ranks import CRC_TABLE, crc_sql, grouped_ranks

N = 2
BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that are looked at in one go.
BLOCK_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 64

FOLD = np.arange(256, dtype="uint8")
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype="uint32")
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def extended(crc: np.ndarray, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The crc32 of texts whose crc32 is ``crc`` with raw[start:stop] put behind each."""
    size = stop - start
    order = np.argsort(-size, kind="stable")
    state, at, sizes = ~crc[order], start[order], size[order]
    many = int(np.searchsorted(-sizes, -LONG_WORD, side="left"))
    for k in range(many):
        state[k] = ~np.uint32(zlib.crc32(raw[at[k] : at[k] + sizes[k]].tobytes(), int(~state[k])))
    state, at, sizes = state, at[many:], sizes[many:]
    for j in range(int(sizes[0]) if len(sizes) else 0):
        m = many + int(np.searchsorted(-sizes, -j, side="left"))
        own = state[many:m]
        state[many:m] = CRC[(own ^ raw[at[: m - many] + j]) & 255] ^ (own >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    return out


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words in bytes."""
    inside = IS_WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.r_[0, edge]
    if len(raw) and inside[-1]:
        edge = np.r_[edge, len(raw)]
    return edge[::2], edge[1::2]


def features(pieces: list[bytes], owned: list[int], n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its piece, words that each piece owns); owned: how many words, or -1 for all."""
    raw = FOLD[np.frombuffer(b" ".join([*pieces, b""]), "uint8")]
    ends = np.cumsum([0, *(len(p) + 1 for p in pieces)])
    start, stop = words_of(raw)
    piece = np.searchsorted(ends, start, side="right") - 1
    first = np.searchsorted(start, ends)
    counts = np.diff(first)
    own = np.where(np.array(owned) < 0, counts, np.minimum(counts, owned)) if len(pieces) else counts
    starts_here = np.arange(len(start)) - first[piece] < own[piece]
    crc = np.zeros(len(start), "uint32")
    space = np.array([32], "uint8")
    buckets, places = [], []
    for k in range(n):
        if k:
            crc = crc[:-1] if len(crc) else crc
            crc = extended(crc, space, np.zeros(len(crc), "int64"), np.ones(len(crc), "int64"))
        crc = extended(crc, raw, start[k:], stop[k:])
        whole = starts_here[: len(crc)] & (piece[: len(crc)] == piece[k:])
        buckets.append((crc[whole] % BUCKETS).astype("int64"))
        places.append(piece[: len(crc)][whole])
    return np.concatenate(buckets), np.concatenate(places), own


def chunks(text: bytes, size: int, n: int = N) -> Iterator[tuple[bytes, int]]:
    """(piece, words that it owns) of a text, cut at word boundaries about every ``size`` bytes."""
    raw = np.frombuffer(text, "uint8")

    def run_end(at: int, inside: bool) -> int:
        """Where the run of word bytes (or of others) that holds ``at`` ends."""
        while at < len(raw):
            other = np.flatnonzero(IS_WORD[raw[at : at + size]] != inside)
            if len(other):
                return at + int(other[0])
            at += size
        return len(raw)

    at = 0
    while at < len(raw):
        cut = min(at + size, len(raw))
        if cut < len(raw) and IS_WORD[raw[cut - 1]]:
            cut = run_end(cut, True)
        end = cut
        for _ in range(n - 1):
            end = run_end(run_end(end, False), True)
        yield text[at:end], len(words_of(raw[at:cut])[0])
        at = cut


def _blocks(batches):
    """(ids, rows, pieces, owned) of batches with (doc_id, row, owned, piece) in blocks of about ``BLOCK_BYTES``."""
    for batch in batches:
        ids, rows, owned, texts = (batch.column(k) for k in range(4))
        sizes = [len(t) if t is not None else 0 for t in (x.as_buffer() for x in texts)]
        at = 0
        while at < len(sizes):
            to, total = at, 0
            while to < len(sizes) and (to == at or total + sizes[to] <= BLOCK_BYTES):
                total += sizes[to]
                to += 1
            pieces = [x.as_py() or b"" for x in texts[at:to]]
            yield ids[at:to], rows[at:to], pieces, owned[at:to].to_pylist()
            at = to


def pieces_of(docs: DataFrame, size: int, n: int = N) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, owned, piece) of texts up to ``size`` bytes, whole and where they are, and of chunks of longer ones, dealt out."""
    own = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("piece"))
    short = own.where(F.length("piece") <= size).select("doc_id", "row", F.lit(-1).cast("long").alias("owned"), "piece")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                for c, (piece, owned) in enumerate(chunks(text, size, n)):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], pa.array([c], "int64"), pa.array([owned], "int64"), pa.array([piece], "binary")], names=["doc_id", "row", "chunk", "owned", "piece"])

    long = own.where(F.length("piece") > size).mapInArrow(lean(cut), f"doc_id {kind}, row long, chunk long, owned long, piece binary")
    long = long.repartition("row", "chunk").select("doc_id", "row", "owned", "piece")
    return short, long


def bucket_counts(docs: DataFrame, n: int = N) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, "int64")
        for _, _, pieces, owned in _blocks(batches):
            total += np.bincount(features(pieces, owned, n)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, "int64"), pa.array(total[at], "int64")], names=["bucket", "n"])

    short, long = pieces_of(docs, CHUNK_BYTES, n)
    rows = short.unionByName(long).mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, "int64")
    for r in rows.collect():  # a row for each bucket
        out[r.bucket] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Floored 1000 times the logarithm of the smoothed ratio of frequencies, by bucket."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS) / ((float(s) + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist())]


def weighed(docs: DataFrame, gain: list[int], n: int = N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        by = np.array(gain, "int64")
        for ids, rows, pieces, owned in _blocks(batches):
            bucket, piece, words = features(pieces, owned, n)
            order = np.argsort(piece, kind="stable")
            sums = np.r_[0, np.cumsum(by[bucket[order]])]
            at = np.searchsorted(piece[order], np.arange(len(pieces) + 1))
            yield pa.RecordBatch.from_arrays(
                [ids, rows, pa.array(words, "int64"), pa.array(np.diff(at), "int64"), pa.array(sums[at[1:]] - sums[at[:-1]], "int64")], names=["doc_id", "row", "n_words", "n_features", "gain"]
            )

    schema = f"doc_id {kind}, row long, n_words long, n_features long, gain long"
    short, long = (p.mapInArrow(lean(run), schema) for p in pieces_of(docs, CHUNK_BYTES, n))
    names = ("n_words", "n_features", "gain")
    summed = long.groupBy("doc_id", "row").agg(*[F.sum(c).alias(c) for c in names])
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(gain - pmod(gain, n_features)) div n_features"))
    return short.unionByName(summed).select("doc_id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, n: int = N, counted: Callable = bucket_counts) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``percent`` of the documents with ``least_words`` words have ranks."""
    gain = gains(counted(docs, n), counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = written(weighed(docs, gain, n).withColumn("score", (F.col("weight") + noise).cast("long")), "weights")
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    order = grouped_ranks(rows.where(enough), [], ["-score", "doc_id", "n_features"], [])
    rank = F.when(F.col("pos") <= drawn, F.col("pos")).cast("long")
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return order.select(*names, rank.alias("rank")).unionByName(rows.where(~enough).select(*names, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _feature_sql(name: str, ids: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
{name}_w AS (SELECT {ids}, regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {name}),
{name}_f AS (SELECT {ids}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM {name}_w)"""


OP13_SQL = f"""
WITH {CRC_TABLE},{_feature_sql("documents", "doc_id")},{_feature_sql("benchmark", "item_id")},
hashed AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS bucket FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f), crc_table),
s AS (SELECT bucket, count(*) AS n FROM documents_f JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM benchmark_f JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM documents_f) AS s_all, (SELECT count(*) FROM benchmark_f) AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS g FROM documents_f JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(len(w), 0) AS n_words,
    coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    ('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::BIGINT AS h
  FROM documents_w d LEFT JOIN sums USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 25 * n // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
