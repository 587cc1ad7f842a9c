"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidate edges.

1. Each text becomes a set of shingle identifiers. One hash per shingle is enough for
   the whole sketch: its top bits name the bin, the least value of a bin is the bin's
   sketch. Empty bins borrow from a bin that a hash of (bin, attempt) picks until it
   finds one that is not empty (optimal densification).
2. Rows with equal sets are one node, known by the digest of the set, so that copies
   cost a group-by and no pairs.
3. The sketch is cut into bands. In each band's bucket every node gets an edge to the
   bucket's centre: as many edges as rows, not pairs. The centre is the node that shares
   the largest buckets, which the middle of a group of near copies does.
4. Edges are confirmed on full sets, and components of confirmed links are formed.
5. Stars alone would lose links between two nodes of a bucket that its centre is not linked with both. So the nodes of
   a centre whose star still holds several classes are described by their differences from a reference set: what
   most of them have (``centred``). The node with the fewest differences draws a second star. Two nodes of
   different classes are now linked only if they share differences, and by the prefix filter one of their rarest ones (``prefixes``).
   An equi-join on (group, difference) finds all pairs that can be links, and those are confirmed on full sets.

Nothing is capped: there is no limit on buckets, candidates or partners. With 26 bands of 4 bins
a pair at similarity 0.8 meets in some bucket but for about one in a million.

Defined results: null and empty texts, or those without words, have an empty set and are
linked with nothing; a very long text is one set like any other; of equal ranks the node with the greatest digest is a
centre, which no result depends on; rows with equal ids and different texts are nodes of their own;
a null id is never a component's least id unless all its ids are null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import DOCUMENT_COLUMNS, Scratch, lean, table, written
from colloq.llm.components import components
from colloq.llm.shingles import blocks, mix, shingle_sets

BANDS, ROWS = 26, 4
BINS = BANDS * ROWS
#: Where bins 1, 2, ... begin among 64-bit values.
EDGES = np.array([(k << 64) // BINS for k in range(1, BINS)], "uint64")
#: Bins that an empty bin asks in turn; the attempts beyond are as many again as needed.
PROBES = (mix(np.arange(BINS * 256, dtype="uint64") + np.uint64(77)) % np.uint64(BINS)).astype("int64").reshape(256, BINS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One value for each bin of a sorted, non-empty set of 64-bit identifiers."""
    first = np.r_[0, np.searchsorted(shingles, EDGES)]
    full = np.diff(np.r_[first, len(shingles)]) > 0
    values = shingles[np.minimum(first, len(shingles) - 1)]
    if full.all():
        return values
    source = np.where(full, np.arange(BINS), -1)
    for probe in PROBES:
        empty = source < 0
        if not empty.any():
            break
        source[empty] = np.where(full[probe], probe, -1)[empty]
    source[source < 0] = np.flatnonzero(full)[0]
    return values[source]


def band_keys(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype="uint64")
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, k])
    return key


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, bands): a row per document; node is null for an empty set."""

    def run(batches):
        for (ids, keys), texts in blocks(batches):
            sizes, digests, bands = [], [], []
            for s in shingle_sets(texts, n):
                sizes.append(len(s))
                digests.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                bands.append(band_keys(sketch(s)).view("int64") if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "node", "bands"],
            )

    return keyed(docs).mapInArrow(lean(run), "doc_id long, text_key long, n_shingles long, node binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, text_key), once each."""

    def run(batches):
        for (keys,), texts in blocks(batches):
            sets = [s.tobytes() for s in shingle_sets(texts, n)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"])

    d, w = keyed(docs), wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("text_key").alias("wanted_key"))
    texts = d.join(w, (F.col("text_key") == F.col("wanted_key")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("node", "text")
    return texts.mapInArrow(lean(run), "node binary, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) with shared (shingles in both) and linked (whether that is enough)."""

    def run(batches):
        for batch in batches:
            shared = []
            for x, y in zip(batch["sa"], batch["sb"]):
                x, y = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared.append(int((y[np.minimum(at, len(y) - 1)] == x).sum()))
            names = ["a", "b", "na", "nb"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(shared, pa.int64())], [*names, "shared"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "na", "nb", "sa", "sb")
    found = both.mapInArrow(lean(run), "a binary, b binary, na long, nb long, shared long")
    return found.withColumn("linked", F.expr(f"100 * shared >= {percent} * (na + nb - shared)"))


def _pairs(stars: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b of rows with structs m and c."""
    low, high = F.least("m.node", "c.node"), F.greatest("m.node", "c.node")
    own = F.col("m.node") < F.col("c.node")
    sizes = F.when(own, F.col("m.size")).otherwise(F.col("c.size")), F.when(own, F.col("c.size")).otherwise(F.col("m.size"))
    return stars.select(low.alias("a"), high.alias("b"), sizes[0].alias("na"), sizes[1].alias("nb")).distinct()


def _numbers(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), "uint64")


def differences(rays: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, x, root, nc, nx, added, lacking): what each x of a group has that its centre lacks, and the reverse."""

    def run(batches):
        for batch in batches:
            added, lacking, nc, nx = [], [], [], []
            for sc, sx in zip(batch["sc"], batch["sx"]):
                c, x = _numbers(sc), _numbers(sx)
                added.append(np.setdiff1d(x, c, assume_unique=True).tobytes())
                lacking.append(np.setdiff1d(c, x, assume_unique=True).tobytes())
                nc.append(len(c))
                nx.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch["g"], batch["x"], batch["root"], pa.array(nc, pa.int64()), pa.array(nx, pa.int64()), pa.array(added, pa.binary()), pa.array(lacking, pa.binary())],
                ["g", "x", "root", "nc", "nx", "added", "lacking"],
            )

    rows = rays.join(sets.select(F.col("node").alias("c"), F.col("shingles").alias("sc")), "c")
    rows = rows.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("sx")), "x")
    return rows.select(F.xxhash64("c").alias("g"), "x", "root", "sc", "sx").mapInArrow(lean(run), "g long, x binary, root binary, nc long, nx long, added binary, lacking binary")


def _elements(rows: DataFrame) -> DataFrame:
    """(g, element, added) of every difference."""

    def run(batches):
        for batch in batches:
            parts = [(g, _numbers(v), kind) for kind in (True, False) for g, v in zip(batch["g"].to_pylist(), batch["added" if kind else "lacking"])]
            if parts:
                n = [len(p[1]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([p[0] for p in parts], n)), pa.array(np.concatenate([p[1] for p in parts]).view("int64")), pa.array(np.repeat([p[2] for p in parts], n))],
                    ["g", "element", "added"],
                )

    return rows.select("g", "added", "lacking").mapInArrow(lean(run), "g long, element long, added boolean")


def centred(diffs: DataFrame, percent: int) -> DataFrame:
    """(g, x, root, nx, nr, added, lacking, na, nl, cost): differences from what most of a group have.

    The reference set of a group is its centre's set with every element turned over that more than half of the
    group differ in: what a single centre has changed for itself is not a difference of all others.
    """
    sizes = diffs.groupBy("g").agg(F.count(F.lit(1)).alias("m"))
    counts = _elements(diffs).groupBy("g", "element", "added").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    turned = counts.join(sizes, "g").where("2 * k > m").groupBy("g").agg(F.collect_list(F.struct("element", "added")).alias("turned"))

    def run(batches):
        for batch in batches:
            out = []
            for nc, a, k, turned in zip(batch["nc"].to_pylist(), batch["added"], batch["lacking"], batch["turned"].to_pylist()):
                a, k = _numbers(a), _numbers(k)
                new = np.array([t["element"] for t in turned or () if t["added"]], "int64").view("uint64")
                old = np.array([t["element"] for t in turned or () if not t["added"]], "int64").view("uint64")
                # What x shares with the turned elements is no difference now; what it doesn't share is one.
                has = np.union1d(np.setdiff1d(a, new), np.setdiff1d(old, k))
                lacks = np.union1d(np.setdiff1d(k, old), np.setdiff1d(new, a))
                out.append((nc + len(new) - len(old), has.tobytes(), lacks.tobytes(), len(has), len(lacks), percent * len(has) + 100 * len(lacks)))
            c = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in ("g", "x", "root", "nx")), *(pa.array(v, t) for v, t in zip(c, kinds))], ["g", "x", "root", "nx", "nr", "added", "lacking", "na", "nl", "cost"]
            )

    return diffs.join(turned, "g", "left").mapInArrow(lean(run), "g long, x binary, root binary, nx long, nr long, added binary, lacking binary, na long, nl long, cost long")


def second_stars(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): roots of classes that a group's member of least cost links, by exact overlaps of differences."""

    def run(batches):
        for batch in batches:
            linked = []
            for nr, nx, a, k, b in zip(batch["nr"].to_pylist(), batch["nx"].to_pylist(), batch["added"], batch["lacking"], batch["b"].to_pylist()):
                a, k, a2, k2 = _numbers(a), _numbers(k), np.frombuffer(b["added"], "uint64"), np.frombuffer(b["lacking"], "uint64")
                shared = nr - len(np.union1d(k, k2)) + len(np.intersect1d(a, a2, assume_unique=True))
                linked.append(100 * shared >= percent * (nx + b["nx"] - shared))
            yield pa.RecordBatch.from_arrays([batch["root"], batch["other"], pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    best = rows.groupBy("g").agg(F.min_by(F.struct("root", "nx", "added", "lacking"), F.struct("cost", "x")).alias("b"))
    met = rows.join(best, "g").where("root <> b.root").select("*", F.col("b.root").alias("other"))
    return met.mapInArrow(lean(run), "a binary, b binary, linked boolean").where("linked").select("a", "b").distinct()


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(key, x, root, outside, nx, nr, na, nl, cost, has): the differences by which x can meet a partner of another class.

    With q = 100 + percent and s = (100 - percent) |R|, x and y are linked if and only if
    q (a + l) >= cost(x) + cost(y) - s, where a and l count added and lacking elements in common
    (cost is percent |added| + 100 |lacking|). A pair with cost(x) + cost(y) <= s is linked to the member of least cost
    as well, so two classes need a + l > 0. Pairs with a > 0 meet by an added element, those with a = 0 by a lacking one. The
    least numbers in common follow from x alone: l <= min(|lacking|) and |y| >= percent |x| / 100; and
    if x is in the class of the member of least cost, its partner isn't, and costs more than s less that least cost.
    With at least t of n elements in common in one order, two rows share one of their n - t + 1 first: the rarest.
    """
    q = 100 + percent
    least = rows.groupBy("g").agg(F.min_by("root", F.struct("cost", "x")).alias("main"), F.min("cost").alias("least"), F.max(F.col("nl") - F.col("na")).alias("gap"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    rows = rows.join(least.where("r0 <> r1").drop("r0", "r1"), "g").withColumn("outside", F.col("root") != F.col("main")).drop("main")

    def run(batches):
        for batch in batches:
            owner, keys, has, first = [], [], [], []
            columns = (batch[n].to_pylist() for n in ("g", "nx", "nr", "na", "nl", "cost", "least", "gap", "outside"))
            for k, (g, nx, nr, na, nl, cost, low, gap, outside) in enumerate(zip(*columns)):
                s = (100 - percent) * nr
                need = -(-(100 * (cost - s) + percent * (percent * nx - 100 * nr)) // (100 * q))
                need = max(1, need, 1 if outside else -(-(percent * (na - nl) - low) // q))
                lack = max(1, -(-(cost - s) // percent), 1 if outside else -(-(cost - low) // q)) if cost - s <= percent * gap else nl + 1
                salt = mix(np.array([g], "int64").view("uint64"))
                for kind, n, t, column in ((True, na, need, "added"), (False, nl, lack, "lacking")):
                    if t <= n and n:
                        owner.append(np.full(n, k))
                        keys.append(mix(_numbers(batch[column][k]) ^ salt ^ np.uint64(kind)))
                        has.append(np.full(n, kind))
                        first.append(np.full(n, n - t + 1))
            if owner:
                at = pa.array(np.concatenate(owner))
                names = ("g", "x", "root", "outside", "nx", "nr", "na", "nl", "cost")
                yield pa.RecordBatch.from_arrays(
                    [*(batch[n].take(at) for n in names), pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(has)), pa.array(np.concatenate(first))],
                    [*names, "key", "has", "first"],
                )

    each = rows.mapInArrow(lean(run), "g long, x binary, root binary, outside boolean, nx long, nr long, na long, nl long, cost long, key long, has boolean, first long")
    # Keys of one class only come first in the order, as those of one member do: they make no pair of two classes.
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "k")
    shared = each.join(counts, "key")
    own = ["x", "root", "outside", "nx", "nr", "na", "nl", "cost", "has"]
    # Elements that no member of another class has come first in the order and meet nobody.
    taken = F.col("first") - (F.when(F.col("has"), F.col("na")).otherwise(F.col("nl")) - F.size("keys"))
    kept = shared.groupBy("g", *own, "first").agg(F.sort_array(F.collect_list(F.struct("k", "key"))).alias("keys")).where(taken > 0)
    return kept.select(*own, F.explode(F.slice("keys", F.lit(1), taken.cast("int"))["key"]).alias("key"))


def crossing(rows: DataFrame) -> DataFrame:
    """Rows that are outside the main class with those of every other class that share a key, as columns y_; members of one class don't meet."""
    y = rows.select(*[F.col(c).alias(f"y_{c}") for c in ("x", "root", "outside", "nx", "na", "nl", "cost")], "key")
    kinds = rows.select("key", F.col("root").alias("y_root")).distinct()
    asked = rows.where("outside").join(kinds, "key").where("root <> y_root")
    return asked.join(y, ["key", "y_root"])


def possible_links(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b, na, nb, ra, rb) of different classes that share a key and whose counts allow a link."""
    common = F.least("nl", "y_nl") + F.when(F.col("has"), F.least("na", "y_na")).otherwise(F.lit(0))
    fits = 100 * F.least("nx", "y_nx") >= percent * F.greatest("nx", "y_nx")
    fits = fits & (F.col("cost") + F.col("y_cost") - (100 - percent) * F.col("nr") <= (100 + percent) * common)
    both = crossing(rows).where(fits & (~F.col("y_outside") | (F.col("x") < F.col("y_x"))))
    own = F.col("x") < F.col("y_x")
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return both.select(
        F.least("x", "y_x").alias("a"), F.greatest("x", "y_x").alias("b"), pick("nx", "y_nx").alias("na"), pick("y_nx", "nx").alias("nb"), pick("root", "y_root").alias("ra"), pick("y_root", "root").alias("rb")
    ).distinct()


def renamed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with root replaced by what ``merged`` (node, root) says of it."""
    to = merged.select(F.col("node").alias("was"), F.col("root").alias("now"))
    return rows.join(to, F.col("root") == F.col("was"), "left").withColumn("root", F.coalesce("now", "root")).drop("was", "now")


def classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, node) of every document, and (node, doc_id, root) of every node."""
    rows = written(nodes(docs, n), "sketches")
    scratch = Scratch(docs.sparkSession, "near")
    # One row per node; the least document id (and its text) stands for it.
    unique = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"), F.min("n_shingles").alias("size"), F.min("bands").alias("bands"))
    unique = scratch.written(unique.select("node", "least.doc_id", "least.text_key", "size", "bands"), "nodes")
    members = unique.select("node", "size", F.explode("bands").alias("key"))
    # Buckets of more than one node; a key is of one band.
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = scratch.written(members.join(shared, "key").select("key", "node", "size", "n"), "buckets")
    # A node in many large buckets is near the middle of its group: the best centre for a star.
    rank = bucket.groupBy("node").agg(F.sum("n").alias("rank"))
    ranked = scratch.written(bucket.drop("n").join(rank, "node").select("key", F.struct("rank", "node", "size").alias("m")), "members")
    scratch.drop(bucket)
    centre = ranked.groupBy("key").agg(F.max("m").alias("c"))
    rays = ranked.join(centre, "key").where("m.node <> c.node").select("c", "m").distinct()
    rays = scratch.written(rays, "rays")
    wanted = unique.select("node", "doc_id", "text_key").join(ranked.select("m.node").distinct(), "node")
    sets = scratch.written(sets_of(docs, wanted, n), "sets")
    scratch.drop(ranked)
    first = scratch.written(overlaps(_pairs(rays), sets, percent).where("linked").select("a", "b"), "stars")
    found = components(first, scratch)
    named = unique.select("node", "doc_id").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.written(named, "named")
    scratch.drop(first, found, unique)
    # Centres whose stars still hold several classes, with all their rays and the centres themselves.
    rays = rays.select(F.col("c.node").alias("c"), F.col("m.node").alias("x"))
    rays = rays.union(rays.select("c", F.col("c").alias("x")).distinct())
    rays = scratch.written(rays.join(named.select(F.col("node").alias("x"), "root"), "x"), "rays")
    several = rays.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("c")
    several = scratch.written(several, "several")
    if several.limit(1).count():
        open_ = scratch.written(rays.join(several, "c", "left_semi"), "open")
        diffs = scratch.written(differences(open_, sets), "differences")
        scratch.drop(open_)
        own = scratch.written(centred(diffs, percent), "centred")
        scratch.drop(diffs)
        merged = components(second_stars(own, percent), scratch)
        named, own = renamed(named, merged), scratch.written(renamed(own, merged), "centred")
        keys = scratch.written(prefixes(own, percent), "prefixes")
        pairs = scratch.written(possible_links(keys, percent), "pairs")
        confirmed = overlaps(pairs, sets, percent).where("linked").select("a", "b").join(pairs.select("a", "b", "ra", "rb"), ["a", "b"])
        named = renamed(named, components(confirmed.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), scratch))
    named = written(named, "classes")
    scratch.close()
    return rows.select("doc_id", "text_key", "n_shingles", "node"), named


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows, named = classes(docs, n, percent)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(named.join(least, "root").select("node", "component_id"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates: that with the least id (null ids last).

    Of repeated rows one stays. Documents without words stay, all of them.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    rows, named = classes(docs, n, percent)
    by_root = rows.join(named.select("node", "root"), "node")
    first = by_root.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f")).select("f.doc_id", "f.text_key")
    copies = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("node").alias("node"))
    wordless = copies.where("node IS NULL").select("doc_id", "text_key", F.lit(1).alias("copies"))
    same = F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.text_key") == F.col("c.text_key"))
    keep = first.alias("f").join(copies.alias("c"), same).select("c.doc_id", "c.text_key", "c.copies").union(wordless)
    keep = written(keep.select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "copies"), "kept")
    on = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key"))
    if not keep.where("copies > 1").limit(1).count():
        return docs.join(keep, on, "left_semi")
    once = docs.join(keep.where("copies = 1"), on, "left_semi")
    again = docs.join(keep.where("copies > 1"), on).groupBy("kept_id", "kept_key").agg(F.first(F.struct(*DOCUMENT_COLUMNS)).alias("d")).select("d.*")
    return once.union(again)
