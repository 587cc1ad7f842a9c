"""Word references of dialogue acts, resolved where the words of a stretch of numbers meet what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions import shelves
from colloq.functions.shelves import BLOCK, KEYS, REACH, SHELF
from colloq.functions.text import strip
from colloq.sources.corpus import addressees

PLACE = "meeting_id string, speaker string, stem string, shelf long"
ACT = "meeting_id string, speaker string, doc_order long"
PIECES = "array<struct<child_pos:int,word_pos:bigint,mine:boolean,starttime:double,endtime:double,text:string,there:boolean>>"
PART = "struct<base:bigint,mine:boolean,raw:boolean,in_range:boolean>"


def _digits(c: Column) -> Column:
    """What follows the last ".words" of an id, if something stands before and only digits after."""
    after = F.substring_index(c, ".words", -1)
    return F.when((F.length(c) > F.length(after) + 6) & after.rlike("^[0-9]+$"), after)


def _place(c: Column) -> tuple[Column, Column]:
    """(stem, number) of an id; one that isn't a stem and a number written plainly is a stem of its own with number -1. Neither is ever null, so no join asks for that."""
    number = F.substring_index(c, ".words", -1)
    n = number.try_cast("long")
    n = F.when((n >= 0) & (n.cast("string") == number) & (F.length(c) > F.length(number) + 6), n)
    return F.coalesce(F.when(n.isNull(), c).otherwise(F.left(c, F.length(c) - F.length(number))), F.lit("")), F.coalesce(n, F.lit(-1).cast("long"))


def _block(n: Column) -> Column:
    return F.shiftright(n, BLOCK.bit_length() - 1)


def _shelf(n: Column) -> Column:
    return F.shiftright(n, SHELF.bit_length() - 1)


def parsed_refs(acts: DataFrame) -> DataFrame:
    """(act keys, child_pos, in_range, stem, first, last, ids, of): what each reference says; of how many.

    A reference with two ids and ``..`` between is a range of numbered words, counted
    up from the first; one that counts down names none. Others name their ids as they are.
    """
    refs = acts.select("meeting_id", "speaker", "doc_order", F.size("refs").alias("of"), F.posexplode("refs").alias("child_pos", "href"))
    ids = refs.withColumn("ids", F.regexp_extract_all("href", F.lit(r"id\(([^)]+)\)"), F.lit(1)))
    ids = ids.withColumns({"one": F.get("ids", F.lit(0)), "two": F.get("ids", F.lit(1))})
    first, last = (_digits(F.col(c)).try_cast("long") for c in ("one", "two"))
    ids = ids.withColumns({"first": first, "last": last, "stem": F.left("one", F.length("one") - F.length(F.substring_index("one", ".words", -1)))})
    ranged = (F.size("ids") == 2) & F.col("href").contains("..") & F.col("first").isNotNull() & F.col("last").isNotNull()
    return ids.select("meeting_id", "speaker", "doc_order", "child_pos", ranged.alias("in_range"), "stem", "first", "last", "ids", "of")


def resolved_refs(acts: DataFrame) -> DataFrame:
    """(act keys, child_pos, word_pos, word_id, in_range): the words that each reference names, one by one."""
    refs = parsed_refs(acts)
    up = F.when(F.col("first") <= F.col("last"), F.sequence("first", "last")).otherwise(F.array().cast("array<long>"))
    named = F.when(F.col("in_range"), F.transform(up, lambda n: F.concat("stem", n.cast("string")))).otherwise(F.col("ids"))
    rows = refs.select("meeting_id", "speaker", "doc_order", "child_pos", "in_range", named.alias("named"))
    # Outer, as the inner form first asks for arrays that aren't empty, which computes them all over again.
    return rows.select("meeting_id", "speaker", "doc_order", "child_pos", "in_range", F.posexplode_outer("named").alias("word_pos", "word_id")).where("word_pos IS NOT NULL")


def reference_counts(acts: DataFrame) -> DataFrame:
    """(meeting_id, n, ids, last): of the words that a meeting's references name (``resolved_refs``) how many, how many different ids, and the last place in a reference.

    A range is runs in blocks of ``BLOCK`` numbers under its stem, and a block's numbers are bits: rows are blocks that references touch, not words, and
    they add up before they are shuffled. An id that stands alone is one number of a block, or no number of a stem of its own.
    """
    refs = parsed_refs(acts)
    up = F.col("in_range") & (F.col("first") <= F.col("last"))
    size = F.when(F.col("in_range"), F.when(up, F.col("last") - F.col("first") + 1).otherwise(0)).otherwise(F.size("ids"))
    piece = lambda stem, first, last, block: F.struct(stem.alias("stem"), block.alias("block"), (F.greatest(first, block * BLOCK) - block * BLOCK).cast("int").alias("low"), (F.least(last, block * BLOCK + (BLOCK - 1)) - block * BLOCK).cast("int").alias("high"))
    ranged = F.transform(F.sequence(_block(F.col("first")), _block(F.col("last"))), lambda b: piece(F.col("stem"), F.col("first"), F.col("last"), b))

    def single(id: Column) -> Column:
        stem, n = _place(id)
        return piece(stem, n, n, _block(n))

    pieces = F.when(up, ranged).when(~F.col("in_range"), F.transform("ids", single))
    rows = refs.select("meeting_id", size.cast("long").alias("size"), F.posexplode_outer(pieces).alias("pos", "piece")).where("piece IS NOT NULL")
    # Bits low to high of a block's number of bits; a reference's size is counted with the first of its pieces.
    ones = lambda c: F.expr(f"shiftleft(1L, {c} + 1) - 1L")
    bits = (ones("piece.high").bitwiseXOR(F.expr("shiftleft(1L, piece.low) - 1L"))).alias("bits")
    rows = rows.select("meeting_id", "piece.stem", "piece.block", bits, F.when(F.col("pos") == 0, F.col("size")).alias("size"))
    blocks = rows.groupBy("meeting_id", "stem", "block").agg(F.bit_or("bits").alias("bits"), F.sum("size").alias("n"), F.max("size").alias("most"))
    return blocks.groupBy("meeting_id").agg(F.sum("n").alias("n"), F.sum(F.bit_count("bits")).alias("ids"), (F.max("most") - 1).cast("int").alias("last"))


def _runs(acts: DataFrame) -> DataFrame:
    """(act keys, child_pos, in_range, of, runs): each reference as runs of numbers under one stem (base, mine, raw, stem, first, last); base is the place of number ``first`` in it.

    An id is asked for under the act's own meeting and speaker (mine) and as it is (raw), once if both are the same.
    """
    keys = ["meeting_id", "speaker", "doc_order", "child_pos"]
    refs = parsed_refs(acts)
    own = F.concat("meeting_id", F.lit("."), "speaker", F.lit(".words"))
    run = lambda stem, first, last, base, mine, raw: F.struct(stem.alias("stem"), first.alias("first"), last.alias("last"), base.alias("base"), F.lit(mine).alias("mine"), F.lit(raw).alias("raw"))
    none = F.lit(0).cast("long")
    whole = lambda stem, mine, raw: run(stem, F.col("first"), F.col("last"), none, mine, raw)
    ranges = F.when(F.col("stem") == own, F.array(whole(own, True, True))).otherwise(F.array(whole(own, True, False), whole(F.col("stem"), False, True)))

    def single(id: Column, pos: Column, mine: bool, raw: bool) -> Column:
        stem, n = _place(id)
        return run(stem, n, n, pos.cast("long"), mine, raw)

    def ways(id: Column, pos: Column) -> Column:
        renamed = F.when(id.contains("words"), F.concat(own, F.substring_index(id, "words", -1))).otherwise(id)
        return F.when(renamed == id, F.array(single(id, pos, True, True))).otherwise(F.array(single(renamed, pos, True, False), single(id, pos, False, True)))

    up = F.when(F.col("first") <= F.col("last"), ranges)
    runs = F.when(F.col("in_range"), up).otherwise(F.flatten(F.transform("ids", ways)))
    return refs.select(*keys, "in_range", "of", runs.alias("runs"))


def _asked(acts: DataFrame) -> DataFrame:
    """(act keys, child_pos, in_range, base, mine, raw, stem, first, last): ``_runs`` one by one."""
    keys = ["meeting_id", "speaker", "doc_order", "child_pos", "in_range"]
    # Outer, and filtered on what comes out, so that nothing asks for the arrays beforehand and computes them again.
    return _runs(acts).select(*keys, F.explode_outer("runs").alias("run")).where("run IS NOT NULL").select(*keys, "run.*")


def _places(acts: DataFrame, whole: bool) -> DataFrame:
    """(act keys, child_pos, refs, stem, shelf, first, last, part): what is asked of each shelf, by places on it; refs is how many references the act has.

    With ``whole``, a reference that lies on one shelf under one spelling is one row without part. Others are a row for each run and shelf.
    """
    one, many = F.get("runs", F.lit(0)), F.size("runs") > 1
    home = F.when(many, F.array_min(F.transform("runs", lambda r: _shelf(r["first"])))).otherwise(_shelf(one["first"]))
    rows = _runs(acts).withColumn("home", home)
    low = lambda n: n.bitwiseAND(SHELF - 1)
    near = lambda r: (_shelf(r["last"]) == F.col("home")) | ((_shelf(r["last"]) == F.col("home") + 1) & (low(r["last"]) < REACH))
    here = lambda r: r["mine"] & r["raw"] & (r["stem"] == one["stem"]) & near(r)
    alone = F.lit(whole) & F.when(many, F.forall("runs", here)).otherwise(here(one))
    on = lambda n: (low(n) + (_shelf(n) - F.col("home")) * SHELF).cast("int")
    ask = lambda stem, shelf, first, last, part: F.struct(stem.alias("stem"), shelf.alias("shelf"), first.alias("first"), last.alias("last"), part.cast(PART).alias("part"))
    each = lambda c: F.when(many, F.transform("runs", lambda r: on(r[c]))).otherwise(F.array(on(one[c])))

    def parted(r: Column) -> Column:
        first, last = _shelf(r["first"]), _shelf(r["last"])

        def part(b: Column) -> Column:
            base = r["base"] + F.when(b == first, -low(r["first"])).otherwise(b * SHELF - r["first"])
            kind = F.struct(base.alias("base"), r["mine"].alias("mine"), r["raw"].alias("raw"), F.col("in_range").alias("in_range"))
            ends = F.when(b == first, low(r["first"])).otherwise(0), F.when(b == last, low(r["last"])).otherwise(SHELF - 1)
            return ask(r["stem"], b, *(F.array(e.cast("int")) for e in ends), kind)

        return F.transform(F.sequence(first, last), part)

    asks = F.when(alone, F.array(ask(one["stem"], F.col("home"), each("first"), each("last"), F.lit(None)))).otherwise(F.flatten(F.transform("runs", parted)))
    keys = ["meeting_id", "speaker", F.col("doc_order").cast("long"), "child_pos", F.col("of").alias("refs")]
    return rows.select(*keys, F.explode_outer(asks).alias("ask")).where("ask IS NOT NULL").select("meeting_id", "speaker", "doc_order", "child_pos", "refs", "ask.*")


def _met(acts: DataFrame, words: DataFrame, whole: bool) -> DataFrame:
    """What is asked of shelves (``_places``) and their words (packed by tasks before they go), by shelf, words first."""
    stem, n = _place(F.col("word_id"))
    rows = words.select("meeting_id", "speaker", stem.alias("stem"), n.alias("n"), F.col("starttime").cast("double"), F.col("endtime").cast("double"), "text")
    # A task for a few small files each would spend its time on starting Python: no more tasks pack words than will take them.
    packed = rows.coalesce(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(shelves.packed, f"{PLACE}, words binary")
    met = _places(acts, whole).unionByName(packed, allowMissingColumns=True)
    return met.repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("words").isNull(), "doc_order", "child_pos")


def _pieces(acts: DataFrame, words: DataFrame) -> DataFrame:
    """(act keys, piece): the words of each reference in each block that it touches, one item for the whole slice where an id is asked for under one spelling, else one for each word."""
    return _met(acts, words, False).mapInArrow(shelves.pieces, f"{ACT}, piece {PIECES}")


def act_texts(acts: DataFrame, words: DataFrame) -> DataFrame:
    """(act keys, text, starttime, endtime): words in order; times of 0 count as missing.

    An id is looked up under the act's own meeting and speaker, then as it is. Words of a range that
    the file lacks are skipped, as are other unknown ids; an act without words or text is dropped.
    Of words with equal ids the one that starts last counts.

    Words go to their shelf once, packed, and what acts ask for goes there too. The text of an act that lies on one shelf is whole there, so it isn't
    shuffled, however often acts overlap. Of other acts a row for each shelf goes on: in it each block's slice is one text and two times.
    """
    met = _met(acts, words, True)
    whole = met.mapInArrow(shelves.whole_texts, f"{ACT}, text string, starttime double, endtime double")
    return whole.unionByName(_gathered(met.mapInArrow(shelves.pieces, f"{ACT}, piece {PIECES}")))


def _gathered(pieces: DataFrame) -> DataFrame:
    """``act_texts`` of acts whose pieces come from several shelves or spellings."""
    keys = ["meeting_id", "speaker"]
    found = pieces.groupBy(*keys, "doc_order").agg(F.sort_array(F.flatten(F.collect_list("piece"))).alias("found"))
    alike = lambda x, y: (x["child_pos"] == y["child_pos"]) & (x["word_pos"] == y["word_pos"])
    after = lambda x, i, own: F.coalesce(~(alike(x, F.get("found", i + 1)) & own(x, F.get("found", i + 1))), F.lit(True))
    # First one word of each spelling, then one of each place. A word of a range must be in the file as the range spells it.
    found = found.withColumn("found", F.filter("found", lambda x, i: after(x, i, lambda a, b: a["mine"] == b["mine"])))
    before = lambda x, i: (i > 0) & F.coalesce(alike(x, F.get("found", i - 1)), F.lit(False))
    found = found.withColumn("found", F.filter("found", lambda x, i: after(x, i, lambda a, b: F.lit(True)) & (x["there"] | before(x, i))))
    text = strip(F.array_join(F.col("found.text"), " "))
    time = lambda f, c: F.coalesce(f(F.filter(F.col(f"found.{c}"), lambda t: t != 0.0)), F.lit(0.0))
    rows = found.select(*keys, "doc_order", text.alias("text"), time(F.array_min, "starttime").alias("starttime"), time(F.array_max, "endtime").alias("endtime"))
    # Not a filter on text, which would move below the arrays and compute them within each other.
    some = F.explode_outer(F.when(F.col("text") != "", F.array(F.struct("text", "starttime", "endtime")))).alias("act")
    return rows.select(*keys, "doc_order", some).where("act IS NOT NULL").select(*keys, "doc_order", "act.*")


def assembled(acts: DataFrame, words: DataFrame) -> DataFrame:
    """Acts as the timeline needs them."""
    rows = acts.drop("refs").join(act_texts(acts, words), ["meeting_id", "speaker", "doc_order"])
    return rows.select(
        "meeting_id", "speaker", addressees(F.col("addressee_text")).alias("addressee"), "text", "starttime", "endtime", "dact_id",
        (F.col("addressee_text") != "").alias("has_explicit_addressee"), "doc_order",
    )
