"""Benchmark decontamination by templates: typed placeholders, window joins, slot consistency.

Numbers, names and units become placeholders, so that a question whose parameters
were changed keeps its template. Each run of ``WINDOW`` words of a template is
hashed, and the hashes of benchmark items meet those of documents in an equi-join.

A capitalised word may be a name or not, and where it stands doesn't tell (an item's first word may stand inside a document's
sentence). So there are two readings, each a template of its own: the first takes all capitalised words for words, the
second for names; listed names are names in both. A window that has fewer than two words
beside its slots says nothing as a template, so it keeps its values and is found where they are the same.

An item is found in a document if, in one reading and one alignment, at least ``SHARE`` of its windows are there
and their slots agree: one value of the item stands for one value of the document, and for names the reverse too (two numbers
or units may become equal). An alignment is one diagonal (document position less item position), or a cell of ``2 * SHIFT``
neighbouring diagonals; cells overlap by half, so that words put in or left out may shift the rest by ``SHIFT`` words in total.

Where a phrase repeats, an item's window meets several places of a cell, whose values contradict. Such a cell is judged by its
chain: for each window one of its places or none, so that the windows less the sum of steps between diagonals (the words
put in or left out) are most; of equals the one with most windows, then with the greatest places in order.

Everything is DataFrame functions, and no text is copied beside its windows. Benchmark windows are broadcast if there are at
most ``BROADCAST_ROWS`` of them and else joined by a shuffle of (ids, position, window).

Defined results: null or empty texts match nothing; items and documents under ``WINDOW`` words
are one window of all their words, so a short item only matches a document that is
no longer than it; null item ids are reported as null; equal items are reported each;
documents with equal ids and texts are reported once; of several alignments that agree the one with most windows counts (ties: the first
reading, then a single diagonal, then the lowest); a very long text is a row per word, and what
is gathered for one alignment is at most ``2 * SHIFT`` times its item's windows; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import DOCUMENT_COLUMNS, table, written

WINDOW = 5
SHARE = 0.8
SHIFT = 8
BROADCAST_ROWS = 200_000
MARK = "§"
#: Names in both readings, wherever they stand and however they are written.
NAMES = (
    "alice bob carol dave emma frank grace henry jack john james mary maria anna peter paul sarah susan tom tim "
    "david michael robert william linda jennifer elizabeth thomas daniel laura julia pierre marie jean hans karl juan carlos luis"
).split()
UNITS = (
    "kilometers kilometres kilometer kilometre kilograms kilogram centimeters centimetres meters metres meter metre miles mile "
    "inches inch feet foot yards yard grams gram pounds pound ounces ounce tons ton liters litres liter litre gallons gallon "
    "seconds second minutes minute hours hour days day weeks week months month years year dollars dollar euros euro cents cent "
    "percent degrees degree km kg cm mm mg lb oz ml kwh mph"
).split()


def _either(words: list[str]) -> str:
    """A pattern for any of ``words``, by first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


def marked(text: Column) -> Column:
    """Words in lower case, parted by one space; slots begin with a mark and their type (d, n, u, or c: n in the second reading only)."""
    bare = F.replace(text, F.lit(MARK), F.lit(" "))
    # Points and commas stay inside numbers only.
    spaced = F.regexp_replace(bare, r"(?=[^a-z \p{L}\p{N}])(?:[^.,]|(?<![0-9])[.,]|[.,](?![0-9]))", " ")
    # From here on every word follows a space, which is where the patterns begin.
    words = F.concat(F.lit(" "), F.regexp_replace(spaced, " {2,}", " "), F.lit(" "))
    low = F.lower(F.regexp_replace(words, r" (?=\p{Lu}\p{L})", f" {MARK}c"))
    named = F.regexp_replace(low, rf" (?:{MARK}c)?({_either(NAMES)})(?= )", f" {MARK}n$1")
    units = F.regexp_replace(named, rf" ([0-9]++(?:[.,][0-9]++)*+) ?(?:{MARK}c)?({_either(UNITS)})(?= )", f" $1 {MARK}u$2")
    numbers = F.regexp_replace(units, " (?=[0-9])", f" {MARK}d")
    return F.trim(F.when(named.rlike("[0-9]"), numbers).otherwise(named))


def _reading(marked: Column, second: bool) -> Column:
    """Template words: a slot is its mark and type."""
    kinds = F.replace(marked, F.lit(f"{MARK}c"), F.lit(f"{MARK}n" if second else ""))
    return F.split(F.regexp_replace(kinds, f"({MARK}[dnu])[^ ]*+", "$1"), " ")


def windows(texts: DataFrame, n: int, *keys: str) -> DataFrame:
    """keys, values (the text's marked words), pos, window and templates: a row per window of the column text.

    templates is 1 or 2 for a window of one reading, 3 where both are the same. All of it is generated code: no lambda, and no
    filter on what is computed here, nor the inner form of explode, which asks for arrays that aren't empty: either would compute it again.
    """
    out = texts.where("text IS NOT NULL").select(*keys, marked(F.col("text")).alias("marked"))
    out = out.select(*keys, F.split("marked", " ").alias("values"), _reading(F.col("marked"), False).alias("first"), _reading(F.col("marked"), True).alias("second"))
    size = F.size("values")
    starts = F.when(F.get("values", F.lit(0)) == "", 0).when(size < n, 1).otherwise(size - (n - 1))
    out = out.select(*keys, "values", "first", "second", F.posexplode_outer(F.slice("values", F.lit(1), starts)).alias("pos", "word")).where("pos IS NOT NULL")

    def window(own: str) -> Column:
        at = lambda c: [F.get(c, F.col("pos") + k) for k in range(n)]
        words = sum((F.coalesce((~w.startswith(MARK)).cast("int"), F.lit(0)) for w in at(own)[1:]), (~at(own)[0].startswith(MARK)).cast("int"))
        full = F.when(words >= 2, F.xxhash64(*at(own))).otherwise(F.xxhash64(*at("values")))
        whole = F.xxhash64(F.array_join(F.when(words >= 2, F.col(own)).otherwise(F.col("values")), " "))
        return F.when(size < n, whole).otherwise(full)

    out = out.select(*keys, "values", "pos", window("first").alias("w1"), window("second").alias("w2"))
    one = lambda w, t: F.struct(F.col(w).alias("window"), F.lit(t).alias("templates"))
    out = out.select(*keys, "values", "pos", F.explode_outer(F.when(F.col("w1") == F.col("w2"), F.array(one("w1", 3))).otherwise(F.array(one("w1", 1), one("w2", 2)))).alias("w"))
    return out.select(*keys, "values", "pos", "w.window", "w.templates")


def _here(n: int) -> Column:
    """The marked words of the window at pos."""
    return F.array(*[F.get("values", F.col("pos") + k) for k in range(n)])


def _bindings(template: Column) -> Column:
    """(a, b) for every slot of a window: the item's value and the document's."""
    name = lambda x: F.replace(x, F.lit(f"{MARK}c"), F.lit(f"{MARK}n"))
    both = F.arrays_zip("item_values", "own_values")
    slots = F.filter(both, lambda s: s["item_values"].startswith(MARK) & ((template == 2) | ~s["item_values"].startswith(f"{MARK}c")))
    return F.transform(slots, lambda s: F.named_struct(F.lit("a"), name(s["item_values"]), F.lit("b"), name(s["own_values"])))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _agreed(met: Column) -> Column:
    """(n_found, n_slots) of an alignment's places, or null if their slots contradict."""

    def judged(bound: Column) -> Column:
        names = F.filter(bound, lambda s: s["a"].startswith(f"{MARK}n"))
        one = (F.size(bound) == F.size(F.array_distinct(bound["a"]))) & (F.size(names) == F.size(F.array_distinct(names["b"])))
        return F.when(one, F.struct(F.size(F.array_distinct(met["i"])).alias("n_found"), F.size(bound).alias("n_slots")))

    return _let(F.array_distinct(F.flatten(met["bound"])), judged)


def _chain(met: Column) -> Column:
    """The places of a cell's chain: one fold over (item position, diagonal), with the best chain that ends on each diagonal as its state."""
    wide = 2 * SHIFT
    code = lambda h: h["i"] * wide + h["k"]
    ends = "array<struct<value:int,n:int,path:array<int>>>"
    none = F.array_repeat(F.struct(F.lit(0).alias("value"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("path")), wide).cast(ends)
    start = F.struct(F.lit(-1).alias("i"), none.alias("before"), none.alias("ends"))

    def step(s: Column, h: Column) -> Column:
        # Places of one window don't follow each other: all go on from what was before it.
        before = F.when(s["i"] == h["i"], s["before"]).otherwise(s["ends"])
        come = F.array_max(F.transform(before, lambda c, j: F.struct((c["value"] - F.abs(j - h["k"])).alias("value"), c["n"].alias("n"), c["path"].alias("path"))))
        further = _let(come, lambda b: F.struct((b["value"] + 1).alias("value"), (b["n"] + 1).alias("n"), F.concat(b["path"], F.array(code(h))).alias("path")))
        after = F.transform(s["ends"], lambda c, k: F.when(k == h["k"], further).otherwise(c))
        return F.struct(h["i"].alias("i"), before.alias("before"), after.cast(ends).alias("ends"))

    places = F.array_sort(F.transform(met, lambda h: F.struct(h["i"].alias("i"), h["k"].alias("k"))))
    best = F.aggregate(places, start, step, lambda s: F.array_max(s["ends"])["path"])
    return _let(best, lambda path: F.filter(met, lambda h: F.array_contains(path, code(h))))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, text_key, item_id, n_windows, n_found, share, n_slots): items that documents hold."""
    items = benchmark.select("item_id", F.col("text").alias("text"), F.xxhash64("text").alias("item_key"))
    item = windows(items, n, "item_id", "item_key")
    item = written(item.select("item_id", "item_key", F.col("pos").alias("item_pos"), "window", F.col("templates").alias("item_templates"), _here(n).alias("item_values")), "windows")
    sizes = item.groupBy("item_id", "item_key").agg((F.max("item_pos") + 1).alias("n_windows"))
    few = item.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    keys = ["doc_id", "text_key"]
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    templates = F.col("item_templates").bitwiseAND(F.col("templates"))
    hit = [*keys, "item_id", "item_key", "pos", "item_pos", "item_values"]
    if few:
        hits = windows(own, n, *keys).join(small(item), "window").where(templates > 0).select(*hit, templates.alias("templates"), _here(n).alias("own_values"))
    else:
        # The rows that a shuffle joins are slim; values come from the texts of documents with hits, each split once.
        slim = windows(own, n, *keys).select(*keys, "pos", "window", "templates").join(item, "window").where(templates > 0).select(*hit, templates.alias("templates"))
        slim = written(slim, "hits")
        places = slim.groupBy(*keys).agg(F.collect_set("pos").alias("places")).select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "places")
        same = (F.col("text_key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
        texts = own.where("text IS NOT NULL").join(places, same).select(*keys, "places", F.split(marked(F.col("text")), " ").alias("values"))
        texts = texts.select(*keys, "values", F.explode("places").alias("pos")).select(*keys, "pos", _here(n).alias("own_values"))
        same = F.col("h.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("h.text_key") == F.col("t.text_key")) & (F.col("h.pos") == F.col("t.pos"))
        hits = slim.alias("h").join(texts.distinct().alias("t"), same).select("h.*", "t.own_values")
    hits = hits.select("*", F.explode(F.when(F.col("templates") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array("templates"))).alias("template"))
    diagonal = F.col("pos") - F.col("item_pos")
    cell = lambda d: F.floor(d / (2 * SHIFT))
    # A way is an alignment, and k is the diagonal's place in it.
    way = lambda kind, at, k: F.struct(F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at")).alias("way"), F.pmod(k, F.lit(2 * SHIFT)).cast("int").alias("k"))
    ways = F.array(way(0, diagonal, F.lit(0)), way(1, cell(diagonal), diagonal), way(2, cell(diagonal + SHIFT), diagonal + SHIFT))
    pair = ["doc_id", "text_key", "item_id", "item_key"]
    hits = hits.select(*pair, "template", "item_pos", _bindings(F.col("template")).alias("bound"), F.explode(ways).alias("w"))
    # Repeated rows bring nothing new to a set, and sets are merged within tasks before any shuffle.
    place = F.struct(F.col("item_pos").alias("i"), F.col("w.k").alias("k"), "bound")
    aligned = hits.groupBy(*pair, "template", F.col("w.way").alias("way")).agg(F.collect_set(place).alias("met"))
    sizes = small(sizes.select(F.col("item_id").alias("sized_id"), F.col("item_key").alias("sized_key"), "n_windows"))
    aligned = aligned.join(sizes, F.col("item_id").eqNullSafe(F.col("sized_id")) & (F.col("item_key") == F.col("sized_key")))
    aligned = aligned.where(F.size(F.array_distinct("met.i")) >= share * F.col("n_windows"))
    met = F.col("met")
    judged = F.coalesce(_agreed(met), F.when(F.col("way.kind") > 0, _let(_chain(met), _agreed)))
    ranked = lambda j: F.when(j.isNotNull(), F.struct(j["n_found"].alias("n_found"), (-F.col("template")).alias("t"), (-F.col("way.kind")).alias("k"), (-F.col("way.at")).alias("at"), j["n_slots"].alias("n_slots")))
    found = aligned.groupBy(*pair, "n_windows").agg(F.max(_let(judged, ranked)).alias("b"))
    # Nothing stands for no agreement: the comparison is null there.
    out = found.where(F.col("b.n_found") >= share * F.col("n_windows")).alias("f")
    return out.select("f.doc_id", "f.text_key", "f.item_id", "n_windows", "f.b.n_found", "f.b.n_slots", (F.col("f.b.n_found") / F.col("n_windows")).alias("share"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_found", "share", "n_slots")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a benchmark item."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key")).distinct()
    found = written(found, "found")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    on = (F.xxhash64("text") == F.col("found_key")) & F.col("doc_id").eqNullSafe(F.col("found_id"))
    return docs.select(*DOCUMENT_COLUMNS).join(found, on, "left_anti")
