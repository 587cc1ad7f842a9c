"""Exact removal of repeated byte strings by distributed bucket-pointer refinement.

A byte goes if some string of ``size`` bytes that covers it also starts anywhere else.
Suffixes are refined as in a bucket-pointer-refinement suffix sort: they begin in
buckets of equal q-grams, and a bucket's members are told apart by the bucket
identifiers at later offsets; identifiers just refined serve the next step, so the
compared length doubles (8, 16, 32, ..., 64, ..., 200 bytes). Two changes let it run
over many machines. Identifiers are 64-bit names made from a bucket's content instead
of positions in a sorted array, so that all tasks agree on them without a global
sort; what is asked is only whether a bucket has another member. And suffixes are
not all sent:

1. Of every ``size`` bytes, the q-gram with the least name speaks (the leftmost of equals).
   It depends on those bytes alone, so equal strings have equal speakers. Neighbouring
   starts share a speaker: an interval of starts is one row, with the speaker's bucket and the
   refined bucket of the whole stretch that these starts cover.
2. A speaker's bucket with one member is done: its starts are unique. One with a single stretch and
   several members is done too: its starts are repeated. Only mixed buckets are refined.
3. Stretches that occur again in a mixed bucket are repeated. If some stretch is alone, one member of each
   stretch sends its bytes on, and is cut at fixed offsets from the speaker into blocks of ``GRID``
   starts. A block's core is what all its strings share: a core that is alone has unique starts only.
   A block that occurs again is repeated. Where a core occurs again and its block doesn't, single
   starts are refined to ``size`` bytes and counted.
4. Every text gathers its own intervals, merges them and drops those bytes.

Texts are known by their MD5. All groups are partial aggregates or joins, which copies of a text or a
passage that many texts hold can't make one task's list; the only rows gathered per key are a text's own
intervals, as a set. Texts travel compressed, once to the refinement and once to the result.

Defined results: a null or empty text has no bytes and no spans; texts under ``size``
bytes lose nothing; repeated rows count as copies; strings never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import table, written
from colloq.llm.shingles import mix

SIZE, GRAM = 200, 32
#: Starts in a block, by offset from their speaker.
GRID = 16
BLOCK = 1 << 20


def refine(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Names of the buckets of all strings of the given sizes (8 or more, ascending), by start.

    A longer name is made of two names, one of them at a later offset.
    """
    at, out = 8, []
    names = mix(np.ndarray((max(0, len(data) - 7),), "<u8", data.data, strides=(1,)).astype("uint64")) if len(data) > 7 else np.zeros(0, "uint64")
    for size in sizes:
        while at < size:
            step = min(at, size - at)
            names = mix(names[:-step] * np.uint64(0xD6E8FEB86659FD93) + names[step:] * np.uint64(0xA0761D6478BD642F) + np.uint64(step))
            at += step
        out.append(names)
    return out


def segments(data: np.ndarray, size: int):
    """(first start, bytes) of pieces that hold every string of ``size`` bytes once."""
    for s in range(0, len(data) - size + 1, BLOCK):
        yield s, data[s : s + BLOCK + size - 1]


def least_from(keys: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` keys, by first key."""
    at = 1
    while at < window:
        step = min(at, window - at)
        keys = np.minimum(keys[:-step], keys[step:])
        at += step
    return keys


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, and where each begins and the last ends."""
    return np.frombuffer(b"".join(texts), "uint8"), np.cumsum([0, *map(len, texts)])


def starts_of(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Whether a string of ``size`` bytes from each start stays in its text."""
    ok = np.zeros(n + 1, "int32")
    last = bounds[1:] - size + 1
    full = last > bounds[:-1]
    np.add.at(ok, bounds[:-1][full], 1)
    np.add.at(ok, last[full], -1)
    return np.cumsum(ok[:-1]) > 0


def intervals(texts: list[bytes], size: int, gram: int):
    """(text, speaker's bucket, stretch's bucket, first start, last start, speaker) of all texts.

    Where a very long text is worked on in pieces, an interval may end early; its
    stretch then has a name of its own, and its starts are told apart one by one.
    """
    data, bounds = joined(texts)
    valid_at, low, out = starts_of(bounds, size, len(data)), np.uint64((1 << 24) - 1), []
    for s, part in segments(data, size):
        valid = np.flatnonzero(valid_at[s : s + len(part) - size + 1])
        if not len(valid):
            continue
        grams, whole = refine(part, gram, size)
        keys = (grams & ~low) | np.arange(len(grams), dtype="uint64")
        speaks = (least_from(keys, size - gram + 1) & low).astype("int64")[valid]
        new = np.flatnonzero(np.r_[True, (speaks[1:] != speaks[:-1]) | (valid[1:] != valid[:-1] + 1)])
        first, last, who = valid[new], valid[np.r_[new[1:], len(valid)] - 1], speaks[new]
        shape = ((last - first) * 4096 + who - first).astype("uint64")
        stretch = mix(whole[first] * np.uint64(0x9FB21C651E98DF25) + mix(whole[last] + shape))
        text = np.searchsorted(bounds, first + s, "right") - 1
        out.append((text, grams[who], stretch, first + s - bounds[text], last + s - bounds[text], who + s - bounds[text]))
    return [np.concatenate(x) for x in zip(*out)] if out else None


def text_blocks(batches, limit: int = BLOCK):
    """(other columns, texts as bytes) in blocks; text is the first column."""
    for batch in batches:
        texts = batch[0].to_pylist()
        at, size = 0, 0
        for k, t in enumerate(texts):
            if k > at and size + len(t) > limit:
                yield [c.slice(at, k - at) for c in batch.columns[1:]], texts[at:k]
                at, size = k, 0
            size += len(t)
        if at < len(texts):
            yield [c.slice(at) for c in batch.columns[1:]], texts[at:]


def content_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the MD5 of each text."""
    both = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _place(lo: np.ndarray, hi: np.ndarray, who: np.ndarray) -> np.ndarray:
    """An interval and its speaker in one number."""
    return (lo.astype("int64") << 32) | ((hi - lo).astype("int64") << 16) | (who - lo).astype("int64")


def _placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = at >> 32
    return lo, lo + ((at >> 16) & 0xFFFF), lo + (at & 0xFFFF)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _bytes():
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_bytes, packed): every text, compressed."""

    def run(batches):
        for (ids,), block in text_blocks(batches):
            k1, k2 = content_keys(block)
            yield _batch(doc_id=ids, k1=k1, k2=k2, n_bytes=pa.array([len(t) for t in block], pa.int64()), packed=pa.array([pa.compress(t, "zstd", asbytes=True) for t in block], pa.binary()))

    return docs.select(_bytes().alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, k1 long, k2 long, n_bytes long, packed binary")


def unpacked_texts(packed: pa.Array, n_bytes: pa.Array) -> list[bytes]:
    return [pa.decompress(z, n, "zstd", asbytes=True) for z, n in zip(packed.to_pylist(), n_bytes.to_pylist())]


def occurrences(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(speaker, stretch, k1, k2, at) of every interval of every document."""

    def run(batches):
        for _, block in text_blocks(batches):
            if (found := intervals(block, size, gram)) is None:
                continue
            text, speaker, stretch, lo, hi, who = found
            k1, k2 = content_keys(block)
            yield _batch(speaker=speaker.view("int64"), stretch=stretch.view("int64"), k1=k1[text], k2=k2[text], at=_place(lo, hi, who))

    return docs.where(F.octet_length("text") >= size).select(_bytes().alias("text")).mapInArrow(run, "speaker long, stretch long, k1 long, k2 long, at long")


def stretch_bytes(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(k1, k2, at, speaker, m, bytes) for wanted (k1, k2, at, speaker, m); one document stands for each text."""

    def run(batches):
        for batch in batches:
            out = []
            texts = unpacked_texts(batch["packed"], batch["n_bytes"])
            for k1, k2, text, spans in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), texts, batch["spans"].to_pylist()):
                for x in spans:
                    lo = x["at"] >> 32
                    out.append((k1, k2, x["at"], x["speaker"], x["m"], text[lo : lo + ((x["at"] >> 16) & 0xFFFF) + size]))
            if out:
                c = list(zip(*out))
                yield _batch(**{n: pa.array(v, pa.int64()) for n, v in zip(("k1", "k2", "at", "speaker", "m"), c)}, bytes=pa.array(c[5], pa.binary()))

    texts = packed_texts(docs.where(F.octet_length("text") >= size)).groupBy("k1", "k2").agg(F.first("packed").alias("packed"), F.first("n_bytes").alias("n_bytes"))
    spans = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "speaker", "m")).alias("spans"))
    return texts.join(spans, ["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, at long, speaker long, m long, bytes binary")


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: the owner and the place among its own of each of sum(n) items."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch[c].to_numpy(zero_copy_only=False) for c in names]


def grid_blocks(stretches: DataFrame, size: int) -> DataFrame:
    """(k1, k2, at, first, last, core, block, m): blocks of starts at fixed offsets from their speaker."""

    def run(batches):
        for batch in batches:
            k1, k2, at, speaker, m = _columns(batch, "k1", "k2", "at", "speaker", "m")
            lo, hi, who = _placed(at)
            data, base = joined(batch["bytes"].to_pylist())
            cores, whole = refine(data, size - GRID + 1, size)
            one = (who - hi) // GRID
            r, k = _spread((who - lo) // GRID - one + 1)
            j = one[r] + k
            first = np.maximum(lo[r], who[r] - j * GRID - GRID + 1)
            last = np.minimum(hi[r], who[r] - j * GRID)
            here = base[r] - lo[r]
            core = mix(cores[here + who[r] - j * GRID] * np.uint64(0x9FB21C651E98DF25) + mix(speaker.view("uint64")[r] + j.astype("uint64")))
            shape = ((who[r] - first) * 4096 + who[r] - last).astype("uint64")
            block = mix(whole[here + first] * np.uint64(0xA0761D6478BD642F) + mix(whole[here + last] + mix(core + shape)))
            yield _batch(k1=k1[r], k2=k2[r], at=at[r], first=first, last=last, core=core.view("int64"), block=block.view("int64"), m=m[r])

    return stretches.mapInArrow(run, "k1 long, k2 long, at long, first long, last long, core long, block long, m long")


def single_starts(stretches: DataFrame, open_: DataFrame, size: int) -> DataFrame:
    """(name, k1, k2, start, m) of every start in open blocks."""

    def run(batches):
        for batch in batches:
            k1, k2, at, speaker, m = _columns(batch, "k1", "k2", "at", "speaker", "m")
            data, base = joined(batch["bytes"].to_pylist())
            (whole,) = refine(data, size)
            spans = batch["spans"].to_pylist()
            r = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
            first = np.array([y["first"] for x in spans for y in x], "int64")
            last = np.array([y["last"] for x in spans for y in x], "int64")
            b, k = _spread(last - first + 1)
            r, start = r[b], first[b] + k
            name = mix(whole[base[r] - (at[r] >> 32) + start] + mix(speaker.view("uint64")[r]))
            yield _batch(name=name.view("int64"), k1=k1[r], k2=k2[r], start=start, m=m[r])

    spans = open_.groupBy("k1", "k2", "at").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return stretches.join(spans, ["k1", "k2", "at"]).mapInArrow(run, "name long, k1 long, k2 long, start long, m long")


def repeated_spans(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(k1, k2, lo, hi): intervals of repeated starts by text; some may come more than once."""
    rows = occurrences(docs, size, gram)
    buckets = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("n > 1")
    mixed = F.col("a") != F.col("b")
    met = rows.join(buckets, "speaker").select("k1", "k2", "at", F.when(mixed, F.col("speaker")).alias("speaker"), F.when(mixed, F.col("stretch")).alias("stretch"))
    met = written(met, "met")
    unclear = met.where("speaker IS NOT NULL")
    members = unclear.groupBy("speaker", "stretch").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    again = unclear.join(members.where("m > 1").select("speaker", "stretch"), ["speaker", "stretch"], "left_semi")
    alone = members.groupBy("speaker").agg(F.min("m").alias("fewest")).where("fewest = 1").select("speaker")
    wanted = members.join(alone, "speaker").select("speaker", "m", "one.*")
    stretches = written(stretch_bytes(docs, wanted, size), "stretches")
    blocks = written(grid_blocks(stretches, size), "blocks")
    sums = blocks.groupBy("core", "block").agg(F.sum("m").alias("n"))
    more = blocks.where("m = 1").join(sums.where("n > 1").select("core", "block"), ["core", "block"], "left_semi")
    open_ = sums.groupBy("core").agg(F.sum("n").alias("n"), F.min("n").alias("fewest")).where("n > 1 AND fewest = 1").select("core")
    starts = written(single_starts(stretches, blocks.join(open_, "core", "left_semi"), size), "starts")
    names = starts.groupBy("name").agg(F.sum("m").alias("n"), F.min("m").alias("fewest")).where("n > 1 AND fewest = 1").select("name")
    single = starts.where("m = 1").join(names, "name", "left_semi")
    whole = met.where("speaker IS NULL").select("k1", "k2", "at").union(again.select("k1", "k2", "at"))
    lo = F.shiftright("at", 32)
    return (
        whole.select("k1", "k2", lo.alias("lo"), (lo + F.shiftright("at", 16).bitwiseAND(0xFFFF)).alias("hi"))
        .union(more.select("k1", "k2", "first", "last"))
        .union(single.select("k1", "k2", "start", F.col("start")))
    )


def kept_bytes(text: bytes, lo: list[int], hi: list[int], size: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left) for intervals of repeated starts."""
    if not lo:
        return 0, 0, text
    order = np.argsort(np.array(lo))
    a, b = np.array(lo)[order], np.maximum.accumulate(np.array(hi)[order] + size)
    new = np.r_[True, a[1:] > b[:-1]]
    begin, end = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(b) - 1]]
    left = [text[x:y] for x, y in zip([0, *end.tolist()], [*begin.tolist(), len(text)])]
    return int((end - begin).sum()), len(begin), b"".join(left)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document (and ``kept``, the bytes that are left)."""

    def run(batches):
        for batch in batches:
            out = []
            texts = unpacked_texts(batch["packed"], batch["n_bytes"])
            for text, spans in zip(texts, batch["spans"].to_pylist()):
                removed, runs, left = kept_bytes(text, [x["lo"] for x in spans or ()], [x["hi"] for x in spans or ()], size)
                out.append((removed, runs, hashlib.sha256(left).hexdigest(), left))
            c = list(zip(*out)) or [()] * 4
            kept = {"kept": pa.array(c[3], pa.binary())} if keep_text else {}
            yield _batch(doc_id=batch["doc_id"], n_bytes=batch["n_bytes"], n_removed=pa.array(c[0], pa.int64()), n_spans=pa.array(c[1], pa.int64()), kept_sha256=pa.array(c[2], pa.string()), **kept)

    # A set: copies of a text bring its intervals once each.
    spans = repeated_spans(docs, size, gram).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = packed_texts(docs).join(spans, ["k1", "k2"], "left")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
