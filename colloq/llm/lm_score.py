"""Language-model scores by deleted interpolation of bigrams.

P(w | v) = a_k f(w | v) + b_k f(w) + c_k / (V + 1), where the f are maximum-likelihood
estimates from all training documents, k is the bucket of the context's frequency
(its binary logarithm) and a_k + b_k + c_k = 1. The weights come from expectation
maximisation over held-out counts: one fold of the training documents is deleted from the
counts, and its bigrams are predicted from the others. Final estimates use all of them.

Counting and looking up never send a row per token:

1. Documents are packed into blocks of a few megabytes, one fold each, and written.
2. Every block sends its distinct words and bigrams once, as sorted 64-bit identifiers with counts, cut into ranges of identifiers. A range's task adds the counts of
   a team of ``FAN`` blocks. While there are several teams, what a team has in a range is sent on like a block, cut into
   narrower ranges, to a team of teams; the last level answers, and each level hands the answers down in the order in which it was asked.
3. Blocks of the held-out fold meet their answers and become a histogram of
   (bucket, f(w | v), f(w)), both estimates to an eighth of a binary order; its number
   of cells is fixed. The driver runs EM on the histogram.
4. All blocks meet their answers and score their documents.

Words and bigrams are counted by 64-bit identifiers, of which two are equal with probability 2 ** -64 per pair.
A block sends at most as many rows as its team has ranges, whose number is fixed (a team's text over ``RANGE_BYTES``), so rows grow
in proportion to the input, times levels, of which there is one for each power of ``FAN`` in the number of blocks. A group holds what
about ``FAN`` senders have in one range, also where every block has the same word.

Defined results: a null or empty text is its end token alone; null ids count as the
empty text in folds; repeated rows count as often as they occur; a very long text is a block of its own; without training
documents the model is uniform; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import Scratch, lean, pieces, table, text_bytes, written
from colloq.llm.shingles import mix, word_ids

BLOCK_BYTES = 4 << 20
#: Bytes of text whose identifiers one range's task counts, about.
RANGE_BYTES = 8 << 20
#: Blocks, or teams of them, in one team.
FAN = 1024
TEST, HELD_OUT, COUNTED = 0, 1, 2
#: Identifiers of the tokens before and after a text, which no word has but by chance.
BEGIN, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
BIGRAM_BITS = 64
BUCKETS = 24
#: Histogram: eighths of binary orders from 2 ** -40 to 1; 0 is an estimate of zero.
STEPS, ORDERS = 8, 40


def fold_of(ids: list, modulus: int = 7, test: int = 2, held_out: int = 3) -> list[int]:
    crc = (zlib.crc32(("" if i is None else str(i)).encode()) % modulus for i in ids)
    return [TEST if r == test else HELD_OUT if r == held_out else COUNTED for r in crc]


def pack_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, fold, payload): compressed Arrow tables of (doc_id, text)."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {TEST: [], HELD_OUT: [], COUNTED: []}
        size = dict.fromkeys(waiting, 0)
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def flush(fold):
            nonlocal made
            rows, sink = waiting[fold], io.BytesIO()
            data = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.large_string())})
            with pa.ipc.new_stream(sink, data.schema, options=options) as out:
                out.write_table(data)
            made += 1
            waiting[fold], size[fold] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([fold], pa.int32()), pa.array([sink.getvalue()], pa.binary())], ["block", "fold", "payload"]
            )

        for batch in batches:
            ids, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for i, t, f in zip(ids, texts, fold_of(ids)):
                waiting[f].append((i, t))
                size[f] += len(t or "")
                if size[f] >= block_bytes:
                    yield flush(f)
        for f in waiting:
            if waiting[f]:
                yield flush(f)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "block long, fold int, payload binary")


class Tokens:
    """A block's documents as tokens, with its distinct words and bigrams."""

    def __init__(self, payload: bytes):
        data = pa.ipc.open_stream(payload).read_all()
        self.ids, texts = data["doc_id"].to_pylist(), data["text"].to_pylist()
        words, bounds = [], [0]
        at = 0
        while at < len(texts):  # a megabyte at a time
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") < 1 << 20):
                size += len(texts[to] or "")
                to += 1
            w, b = word_ids(texts[at:to])
            words.append(w)
            bounds.extend((b[1:] + bounds[-1]).tolist())
            at = to
        bounds = np.array(bounds)
        n = len(texts)
        self.size = np.diff(bounds) + 1  # words and the end
        self.first = np.cumsum(self.size) - self.size
        token = np.full(int(self.size.sum()), END)
        token[np.arange(bounds[-1]) + np.repeat(np.arange(n), np.diff(bounds))] = np.concatenate(words) if words else []
        before = np.r_[END, token[:-1]] if len(token) else token
        before[self.first] = BEGIN
        self.word, self.word_at = np.unique(token, return_inverse=True)
        pair = mix(before * np.uint64(0xD6E8FEB86659FD93) + mix(token + np.uint64(0x632BE59BD9B4E019))) >> np.uint64(64 - BIGRAM_BITS)
        self.pair, one, self.pair_at, self.pair_n = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        self.word_n = np.bincount(self.word_at, minlength=len(self.word))
        # Words of each distinct bigram; the begin token has the count of the end token.
        self.then = self.word_at[one]
        before_at = np.r_[0, self.word_at[:-1]] if len(token) else self.word_at
        before_at[self.first] = np.searchsorted(self.word, END) if n else 0
        self.context = before_at[one]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes; ascending ones should be given as differences."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view("uint8").reshape(-1, 8)[:, :width].T
    return bytes([width]) + zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zlib.decompress(data[1:]), "uint8").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), "uint8")
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0)) if len(ascending) else ascending


def cuts(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where the keys of each range begin, and the end."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], "uint64")
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


REQUEST = "team long, range int, kind int, block long, fold int, keys binary, counted binary, held_out binary"


def _requests(rows: list) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = [f.split()[0] for f in REQUEST.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(names), kinds)], names)


def requests(blocks: DataFrame, n: int, ranges: int, fan: int = FAN) -> DataFrame:
    """What each of ``n`` blocks has: kind 1 are words, 2 bigrams; the counts are training counts, without and of the held-out fold."""

    def run(batches):
        for batch in batches:
            for block, fold, payload, team in zip(*(batch[c] for c in ("block", "fold", "payload", "team"))):
                t, out, own = Tokens(payload.as_buffer()), [], fold.as_py()
                for kind, keys, count, bits in ((1, t.word, t.word_n, 64), (2, t.pair, t.pair_n, BIGRAM_BITS)):
                    at = cuts(keys, bits, ranges)
                    for r in np.flatnonzero(np.diff(at)).tolist():
                        part = slice(at[r], at[r + 1])
                        two = (packed(count[part] * (own == f)) for f in (COUNTED, HELD_OUT))
                        out.append((team.as_py(), r, kind, block.as_py(), own, packed(deltas(keys[part])), *two))
                yield from _requests(out).to_batches()

    team = F.floor(F.pmod(F.xxhash64("block"), F.lit(max(n, 1))) / fan).cast("long")
    return blocks.withColumn("team", team).mapInArrow(lean(run), REQUEST)


def _added(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The distinct keys of requests, both sums of counts for each key, and where each request's keys are among them."""
    keys = [np.cumsum(unpacked(x.as_buffer())) for x in table["keys"]]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for column in ("counted", "held_out"):
        n = np.concatenate([unpacked(x.as_buffer()) for x in table[column]]).astype("float64")
        sums.append(np.bincount(at, n, len(every)).astype("uint64"))
    return every, sums, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


NODE = "team long, range int, kind int, keys binary, counted binary, held_out binary, block array<long>, fold array<int>, at array<binary>"


def gathered(asked: DataFrame) -> DataFrame:
    """What each team has in each range: its distinct keys with summed counts, and where each request's keys are among them."""

    def run(table: pa.Table) -> pa.Table:
        every, sums, own = _added(table)
        one = [[table[c][0].as_py()] for c in ("team", "range", "kind")]
        row = [*one, [packed(deltas(every))], *([packed(n)] for n in sums), [table["block"].to_pylist()], [table["fold"].to_pylist()], [[packed(deltas(x)) for x in own]]]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        return pa.table([pa.array(c, k) for c, k in zip(row, kinds)], [f.split()[0] for f in NODE.split(", ")])

    return asked.groupBy("team", "range", "kind").applyInArrow(run, NODE)


def merged(nodes: DataFrame, ranges: int, fan: int = FAN) -> DataFrame:
    """The requests of teams: what a team has in one range, sent like a block to the team of its team."""

    def run(batches):
        for batch in batches:
            for team, rng, kind, *data in zip(*(batch[c].to_pylist() for c in ("team", "range", "kind", "keys", "counted", "held_out"))):
                every, counted, held_out = (unpacked(x) for x in data)
                every, out = np.cumsum(every), []
                at = cuts(every, 64 if kind == 1 else BIGRAM_BITS, ranges)
                for r in np.flatnonzero(np.diff(at)).tolist():
                    part = slice(at[r], at[r + 1])
                    out.append((team // fan, r, kind, (team << 32) + rng, -1, packed(deltas(every[part])), packed(counted[part]), packed(held_out[part])))
                yield from _requests(out).to_batches()

    return nodes.select("team", "range", "kind", "keys", "counted", "held_out").mapInArrow(lean(run), REQUEST)


ANSWER = "range int, kind int, block long, fold int, counted binary, held_out binary, tokens long, tokens_counted long, distinct long"


def _answers(asked: pa.Table | dict, own: list[np.ndarray], sums: list[np.ndarray], totals: list[int]) -> pa.Table:
    first = [k == 0 for k in range(len(own))]
    return pa.table(
        {
            **{c: asked[c] for c in ("range", "kind", "block", "fold")},
            **{c: pa.array([packed(n[x]) for x in own], pa.binary()) for c, n in zip(("counted", "held_out"), sums)},
            **{c: pa.array([n * f for f in first], pa.int64()) for c, n in zip(("tokens", "tokens_counted", "distinct"), totals)},
        }
    )


def answers(asked: DataFrame) -> DataFrame:
    """For each request of the only team the training counts, without and of the held-out fold, in the order of its keys.

    tokens, tokens_counted and distinct, on one row of each range, are totals of the training counts.
    """

    def run(table: pa.Table) -> pa.Table:
        _, sums, own = _added(table)
        total = sums[0] + sums[1]
        return _answers(table, own, sums, [int(total.sum()), int(sums[0].sum()), int((total > 0).sum())])

    return asked.groupBy("team", "range", "kind").applyInArrow(run, ANSWER)


def relayed(nodes: DataFrame, replies: DataFrame) -> DataFrame:
    """Answers to the requests gathered in ``nodes`` out of the answers that these were given, with their totals."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("range")
        sums = [np.concatenate([unpacked(x.as_buffer()) for x in right[c]]) for c in ("counted", "held_out")]
        own = [np.cumsum(unpacked(x)) for x in left["at"][0].as_py()]
        asked = {"block": pa.array(left["block"][0].as_py(), pa.int64()), "fold": pa.array(left["fold"][0].as_py(), pa.int32())}
        asked |= {c: pa.array([left[c][0].as_py()] * len(own), pa.int32()) for c in ("range", "kind")}
        return _answers(asked, own, sums, [sum(right[c].to_pylist()) for c in ("tokens", "tokens_counted", "distinct")])

    sender = (F.shiftleft(F.col("team"), 32) + F.col("range")).alias("sender")
    of_team = replies.groupBy(F.col("block").alias("sender"), "kind")
    return nodes.select(sender, "kind", "range", "block", "fold", "at").groupBy("sender", "kind").cogroup(of_team).applyInArrow(run, ANSWER)


def counts(asked: DataFrame, n: int, ranges: list[int], fan: int, scratch: Scratch) -> DataFrame:
    """Answers to the requests of ``n`` senders, level by level; ``ranges`` are those of the levels above."""
    teams = -(-n // fan)
    if teams <= 1:
        return answers(asked)
    nodes = scratch.written(gathered(asked), "nodes")
    above = counts(merged(nodes, ranges[0], fan), teams, ranges[1:], fan, scratch)
    return relayed(nodes, scratch.written(above, "answered"))


def answered(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """([words' counts, bigrams' counts] without, and of, the held-out fold) of one block."""
    t = t.sort_by([("kind", "ascending"), ("range", "ascending")])
    kind = t["kind"].to_numpy()
    out = []
    for column in ("counted", "held_out"):
        parts = [unpacked(x.as_buffer()) for x in t[column]]
        out.append([np.concatenate([p for p, k in zip(parts, kind) if k == which]).astype("float64") for which in (1, 2)])
    return out[0], out[1]


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(context, 0) + 1).astype("int64"), BUCKETS - 1)


def quantised(f: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        q = np.round((np.log2(f) + ORDERS) * STEPS) + 1
    return np.where(f > 0, np.clip(q, 1, STEPS * ORDERS + 1), 0).astype("int64")


def _share(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.asarray(b) > 0)


def histogram(blocks: DataFrame, replies: DataFrame, tokens_counted: int) -> DataFrame:
    """(cell, n) of the held-out fold's bigrams under the counts without it."""
    side = STEPS * ORDERS + 2

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left["payload"][0].as_buffer())
        (word, pair), _ = answered(right)
        context = word[t.context]
        cell = (bucket(context) * side + quantised(_share(pair, context))) * side + quantised(_share(word[t.then], tokens_counted))
        cell, at = np.unique(cell, return_inverse=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(np.bincount(at, t.pair_n).astype("int64"))})

    held = blocks.where(F.col("fold") == HELD_OUT).groupBy("block").cogroup(replies.where(F.col("fold") == HELD_OUT).groupBy("block"))
    return held.applyInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, n: np.ndarray, floor: float, rounds: int = 50) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket by expectation maximisation."""
    side = STEPS * ORDERS + 2
    k, high, low = cells // (side * side), cells // side % side, cells % side
    value = np.r_[0.0, 2.0 ** (np.arange(side - 1) / STEPS - ORDERS)]
    f = np.stack([value[high], value[low], np.full(len(k), floor)], 1)
    # A bucket that no held-out bigram falls into keeps what all of them prefer.
    every = np.full(3, 1 / 3)
    weights = np.tile(every, (BUCKETS, 1))
    for _ in range(rounds):
        part = weights[k] * f
        part *= (n / part.sum(1))[:, None]
        sums = np.stack([np.bincount(k, part[:, j], BUCKETS) for j in range(3)], 1)
        total = sums.sum(1, keepdims=True)
        every = sums.sum(0) / max(sums.sum(), 1e-300) if len(k) else every
        weights = np.where(total > 0, sums / np.maximum(total, 1e-300), every)
    # No text is impossible: the uniform part keeps a little.
    weights = np.maximum(weights, 1e-6)
    return weights / weights.sum(1, keepdims=True)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, replies: DataFrame, tokens: int, distinct: int, weights: np.ndarray) -> DataFrame:
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left["payload"][0].as_buffer())
        kept, gone = answered(right)
        word, pair = kept[0] + gone[0], kept[1] + gone[1]
        base = np.log10((word + 1) / (tokens + distinct + 1))
        context = word[t.context]
        w = weights[bucket(context)]
        p = w[:, 0] * _share(pair, context) + w[:, 1] * _share(word[t.then], tokens) + w[:, 2] / (distinct + 1)
        add = lambda x: np.add.reduceat(x, t.first)
        m = len(t.ids)
        return pa.table(
            {
                "doc_id": pa.array(t.ids, pa.int64()),
                "held_out": pa.array([left["fold"][0].as_py() == TEST] * m),
                "n_tokens": pa.array(t.size.astype("int64")),
                "n_known": pa.array(add((word > 0).astype("int64")[t.word_at])),
                "train_tokens": pa.array([tokens] * m, pa.int64()),
                "base_score": pa.array(add(base[t.word_at])),
                "score": pa.array(add(np.log10(p)[t.pair_at])),
            }
        )

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORED)


def level_ranges(total: int, n: int, range_bytes: int, fan: int) -> list[int]:
    """Into how many ranges the identifiers are cut at each level, for ``n`` blocks with ``total`` bytes of text."""
    out, size = [], fan
    while True:
        out.append(pieces(total * min(size, n) // max(n, 1), range_bytes))
        if size >= n:
            return out
        size *= fan


def fit(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> tuple[DataFrame, DataFrame, int, int, np.ndarray]:
    """Blocks, their counts, training tokens, distinct ones, and weights: what ``score_blocks`` takes."""
    blocks = written(pack_blocks(docs, block_bytes), "lm-blocks")
    n = blocks.count()
    ranges = level_ranges(text_bytes(docs), n, range_bytes, fan)
    scratch = Scratch(docs.sparkSession, "lm-levels")
    replies = written(counts(requests(blocks, n, ranges[0], fan), n, ranges[1:], fan, scratch), "lm-counts")
    scratch.close()
    sums = replies.where("kind = 1").agg(*(F.sum(c) for c in ("tokens", "tokens_counted", "distinct"))).first()
    tokens, counted, distinct = (int(x or 0) for x in sums)
    hist = histogram(blocks, replies, counted).toArrow()
    weights = learn_weights(hist["cell"].to_numpy(), hist["n"].to_numpy().astype("float64"), 1 / (distinct + 1))
    return blocks, replies, tokens, distinct, weights


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """Scores of all documents; those of the test fold are not learned from."""
    return score_blocks(*fit(docs, block_bytes, range_bytes, fan))


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
