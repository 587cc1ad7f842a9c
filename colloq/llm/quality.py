"""Quality by nearest-neighbour voting in a latent-semantic space.

1. A bounded sample of labelled documents (``MAX_LABELLED`` rows, by a hash of the id)
   is turned into term counts: hashed words, hashed shapes of words (case, marks,
   digits), pairs of shapes, and words that repeat their neighbour.
2. On the driver the counts become log-scaled, idf-weighted, unit vectors and a
   truncated singular value decomposition of them spans the latent space. Its size
   is the sample's bound times ``DIMENSIONS``; only that is broadcast.
3. Every document of the input is projected into that space, and the cosines with *all*
   labelled vectors are computed block by block as exact matrix products. The
   ``NEIGHBOURS`` nearest, and all that are as near as the last of them, vote with their labels, weighted by similarity.

Scores use texts only. Defined results: a null or empty text, or one without a term of
the space, has no neighbours and scores the sample's share of good labels; without labelled rows
the score is 0.5; null labels, or those that are neither 0 nor 1, are ignored;
repeated rows score alike; a very long text is one vector of all its terms; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import DOCUMENT_COLUMNS, crc_mod, lean, plus, table
from colloq.llm.shingles import blocks, mix, word_ids

#: Bounds of what is fitted and broadcast, whatever the input.
MAX_LABELLED = 4096
TERMS = 4096
DIMENSIONS = 48
NEIGHBOURS = 24
THRESHOLD = 0.3
#: Share of the terms that words get; shapes have the rest.
WORD_TERMS = 2048
#: Terms for words that repeat their neighbour.
REPEAT_TERMS = 8
#: Weight of the sample's share of good labels beside the neighbours' votes.
PRIOR = 0.3

_CLASS = np.full(128, 7, "uint8")  # other marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _k, _c in enumerate(".,!?|#$%&*", 8):
    _CLASS[ord(_c)] = _k


def _classes(data: np.ndarray) -> np.ndarray:
    """A class for each code point: space, upper, lower, digit, marks; letters beyond ASCII are 4 or 5."""
    out = np.full(len(data), 4, "uint8")
    low = data < 128
    out[low] = _CLASS[data[low]]
    # Latin capitals with accents; others count as lower case.
    out[(data >= 0xC0) & (data <= 0xDE)] = 5
    return out


def term_counts(texts: list[str | None]):
    """(text, term, count) arrays of a block of texts."""
    ids, bounds = word_ids(texts)
    k = np.repeat(np.arange(len(texts)), np.diff(bounds))
    words = (mix(ids + np.uint64(5)) % np.uint64(WORD_TERMS)).astype("int64")
    repeat = np.flatnonzero((ids[1:] == ids[:-1]) & (k[1:] == k[:-1]))
    # Shapes: runs of classes with their lengths up to 2, as trigrams of runs.
    raw = np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    kind = _classes(raw)
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[ends[:-1]] = True
    start = np.flatnonzero(new)
    size = np.minimum(np.diff(np.r_[start, len(raw)]), 2) if len(start) else start
    run = kind[start].astype("uint64") * np.uint64(3) + size.astype("uint64")
    at = np.searchsorted(ends, start, "right")
    parts = [(k, words)]
    # A word said twice in a row is a term as well, one of a few.
    parts.append((k[1:][repeat], WORD_TERMS + (mix(ids[1:][repeat] + np.uint64(9)) % np.uint64(REPEAT_TERMS)).astype("int64")))
    for n in (2, 3):
        if len(run) >= n:
            gram = np.full(len(run) - n + 1, n, "uint64")
            for j in range(n):
                gram = mix(gram * np.uint64(0x9E3779B97F4A7C15) + run[j : len(run) - n + 1 + j])
            same = at[n - 1 :] == at[: len(at) - n + 1]
            parts.append((at[: len(at) - n + 1][same], WORD_TERMS + REPEAT_TERMS + (gram[same] % np.uint64(TERMS - WORD_TERMS - REPEAT_TERMS)).astype("int64")))
    cell = np.concatenate([a * TERMS + b for a, b in parts])
    cell, count = np.unique(cell, return_counts=True)
    return cell // TERMS, cell % TERMS, count


class Space:
    """Latent space and labelled vectors; all of it bounded by the sample's bound."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        dense = np.zeros((len(rows), TERMS), "float32")
        for k, (term, count) in enumerate(rows):
            dense[k, term] = np.log1p(count)
        self.idf = np.log((1 + len(rows)) / (1 + (dense > 0).sum(0))).astype("float32") + 0.1
        dense *= self.idf
        self._unit(dense)
        # Randomised subspace iteration.
        rng = np.random.default_rng(11)
        basis = rng.standard_normal((TERMS, min(DIMENSIONS + 16, len(rows))), "float32")
        for _ in range(6):
            basis, _ = np.linalg.qr(dense.T @ (dense @ basis))
        _, _, turn = np.linalg.svd(dense @ basis, full_matrices=False)
        self.project = np.ascontiguousarray((basis @ turn.T)[:, :DIMENSIONS].astype("float32"))
        self.vectors = dense @ self.project
        self._unit(self.vectors)
        self.labels = labels.astype("float32")

    @staticmethod
    def _unit(x: np.ndarray) -> None:
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        text, term, count = term_counts(texts)
        weight = np.log1p(count).astype("float32") * self.idf[term]
        out = np.full(len(texts), float(self.labels.mean()))
        # Sparse rows times the projection, then all cosines of the block.
        spread = np.zeros((len(texts), self.project.shape[1]), "float32")
        begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, "int64")
        if not len(begin):
            return out
        spread[text[begin]] = np.add.reduceat(weight[:, None] * self.project[term], begin, axis=0)
        has = np.flatnonzero(np.linalg.norm(spread, axis=1) > 1e-6)
        own = spread[has]
        self._unit(own)
        for s in range(0, len(has), 256):
            cosine = own[s : s + 256] @ self.vectors.T
            n = min(NEIGHBOURS, cosine.shape[1])
            near = np.argpartition(cosine, cosine.shape[1] - n, axis=1)[:, -n:]
            top = np.take_along_axis(cosine, near, 1)
            weight = np.maximum(top, 1e-3) ** 8
            votes, total = (weight * self.labels[near]).sum(1), weight.sum(1)
            # Of neighbours that are as near as the last one, all vote.
            least = top.min(1, keepdims=True)
            for j in np.flatnonzero((cosine >= least).sum(1) > n):
                all_ = cosine[j] >= least[j]
                weight = np.maximum(cosine[j][all_], 1e-3) ** 8
                votes[j], total[j] = (weight * self.labels[all_]).sum(), weight.sum()
            out[has[s : s + 256]] = (votes + PRIOR * self.labels.mean()) / (total + PRIOR)
        return np.round(np.clip(out, 0, 1), 4)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Space | None:
    """Learns from at most ``most`` labelled documents; ``labels`` holds those that may be learned from."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    # First ids, then texts: the ids are few enough to be broadcast, as ``most`` bounds them.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)

    def run(batches):
        for (label,), texts in blocks(batches):
            text, term, count = term_counts(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
            term, count = term.astype("<u2"), np.minimum(count, 65535).astype("<u2")
            packed = [term[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(packed, pa.binary())], ["quality", "terms"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    rows = texts.mapInArrow(lean(run), "quality int, terms binary").orderBy(F.xxhash64("terms"), "quality").limit(most).collect()
    if not rows:
        return None
    pairs = [(np.frombuffer(t, "<u2")[: len(t) // 4], np.frombuffer(t, "<u2")[len(t) // 4 :]) for _, t in rows]
    return Space(pairs, np.array([q for q, _ in rows]))


def score(docs: DataFrame, space: Space | None) -> DataFrame:
    """``docs`` with a column score (replacing one of that name)."""
    docs = docs.drop("score")
    if space is None:
        return docs.withColumn("score", F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(space)
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = [None if t is None else t for t in batch["text"].to_pylist()]
            found = [shared.value.scores(t) for _, t in blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], 1 << 17)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else [], pa.float64())], [*names, "score"])

    return docs.mapInArrow(lean(run), plus(docs, "score double"))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0)


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    space = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score(docs, space).select(
        "doc_id",
        (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score ``THRESHOLD`` or more."""
    space = fit(docs, learnable(table(spark, sf_dir, "labels")))
    return score(docs.select(*DOCUMENT_COLUMNS), space).where(F.col("score") >= THRESHOLD).select(*DOCUMENT_COLUMNS)
