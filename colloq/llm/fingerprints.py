"""Document fingerprints: closed syncmers of words as anchors, matched by identifier and position. DataFrame functions only.

A k-mer is ``K`` words in a row; its inner substrings are the runs of ``S`` words in it. It is an anchor (a closed syncmer) if the inner
substring with the least hash is its first or its last. Whether it is one depends on its own words alone, so an edit changes
only anchors that touch it, and every ``2 * K - S`` words in a row hold one at least. A fingerprint is the ``SIZE`` distinct anchors of the whole text with
the least identifiers, each with the position (in words) where it first comes: ``identifier << POSITION_BITS | position``, in hexadecimal.

Likeness is taken from anchors with the least identifiers of both fingerprints together: those in both count if they are
aligned, that is, if the next one before or after them in the text has moved by the same number of words, give or take
``SLACK`` (one single common anchor counts). With c such of u anchors it is 2c / (c + u): the share of the anchors of either text that the other one has.

Words are runs of letters, marks and digits in lower case; a character of a script without spaces is a word.
The document after each one, by falling id, is found from (id, hash of text) alone, range-sorted; texts are shuffled once, and of the
next document only its fingerprint and as many characters as are put in.

Defined results: a null text is empty; an empty text has an empty fingerprint, and two of them have likeness 1; a text
with words but without an anchor (under ``2 * K - S`` words) has one for all its words, and one without words one for its characters; null ids come last;
repeated rows are returned each, and the next document of all of them is the next different one, by id and then by hash; the only
document is its own next one; positions beyond 2 ** POSITION_BITS count as that; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.llm.common import table, written

K, S = 6, 2
SIZE = 64
POSITION_BITS = 27
SLACK = 8
#: Characters that are words of their own.
ALONE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
LONGS = "array<bigint>"
NO_ID = "\x00"


def _packed(identifier: Column, position: Column) -> Column:
    most = (1 << POSITION_BITS) - 1
    return F.shiftleft(F.shiftrightunsigned(identifier, POSITION_BITS + 1), POSITION_BITS).bitwiseOR(F.least(position, F.lit(most)).cast("long"))


def _words(text: Column) -> Column:
    low = F.lower(text)
    spaced = F.when((F.octet_length(low) > F.length(low)) & low.rlike(ALONE), F.regexp_replace(low, f"({ALONE})", " $1 ")).otherwise(low)
    return F.array_remove(F.split(spaced, r"[^\p{L}\p{M}\p{N}]+"), "")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the anchors of a text column (no nulls) as sorted whole numbers.

    Every array is a column of its own and is used more than once by the next step, so the plan keeps it and doesn't compute it for each element.
    """
    own = df.columns
    out = df.select(*own, _words(F.col(text)).alias("__w"))
    inner = lambda w, i: F.xxhash64(w, *[F.get("__w", i + j) for j in range(1, S)])
    out = out.select(*own, "__w", F.transform(F.slice("__w", F.lit(1), F.greatest(F.size("__w") - (S - 1), F.lit(0))), inner).alias("__g"))
    edge = K - S

    def anchor(g: Column, i: Column) -> Column:
        others = [F.get("__g", i + j) for j in range(1, edge + 1)]
        least = F.least(g, *others)
        whole = F.xxhash64(g, *[F.get("__g", i + j) for j in range(S, edge + 1, S)])
        return F.when((i < F.size("__g") - edge) & ((g == least) | (others[-1] == least)), _packed(whole, i))

    out = out.select(*own, "__w", F.sort_array(F.array_compact(F.transform("__g", anchor))).alias("__a"))
    hashed = lambda x: F.shiftright(x, POSITION_BITS)
    new = lambda x, i: (i == 0) | (hashed(x) != hashed(F.get("__a", i - 1)))
    rest = F.when(F.size("__w") > 0, F.array(_packed(F.xxhash64(F.array_join("__w", " ")), F.lit(0)))).when(F.col(text) != "", F.array(_packed(F.xxhash64(text), F.lit(0))))
    found = F.when(F.size("__a") > 0, F.slice(F.filter("__a", new), 1, SIZE)).otherwise(F.coalesce(rest, F.array().cast(LONGS)))
    return out.select(*own, found.alias(name))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two columns of anchors."""
    own = df.columns
    hashes = lambda c: F.transform(c, lambda x: F.shiftright(x, POSITION_BITS))
    place = lambda x: x.bitwiseAND((1 << POSITION_BITS) - 1)
    out = df.select(*own, hashes(a).alias("__ha"), hashes(b).alias("__hb"))
    out = out.select(*own, "__hb", F.slice(F.sort_array(F.array_union("__ha", "__hb")), 1, SIZE).alias("__u"))

    def common(x: Column) -> Column:
        at = F.array_position("__hb", F.shiftright(x, POSITION_BITS)).cast("int")
        here = F.array_contains("__u", F.shiftright(x, POSITION_BITS)) & (at > 0)
        return F.when(here, F.struct(place(x).alias("at"), (place(F.get(b, at - 1)) - place(x)).alias("moved")))

    out = out.select(*own, "__u", F.sort_array(F.array_compact(F.transform(a, common))).alias("__c"))
    near = lambda x, k: F.coalesce(F.abs(x["moved"] - F.get("__c", k)["moved"]) <= SLACK, F.lit(False))
    aligned = F.size(F.filter("__c", lambda x, i: (F.size("__c") == 1) | near(x, i - 1) | near(x, i + 1)))
    out = out.select(*own, F.size("__u").alias("__n"), aligned.alias("__m"))
    share = F.when(F.col("__n") == 0, 1.0).otherwise(2.0 * F.col("__m") / (F.col("__m") + F.col("__n")))
    return out.select(*own, share.alias(name))


def next_documents(docs: DataFrame) -> DataFrame:
    """(id, key, n, next_id, next_key) for every different (id, text): what follows by falling doc_id; after the last the first.

    Rows are range-sorted; the first of each range, one row for each, are broadcast for the last ones of those before.
    """
    spark = docs.sparkSession
    falling = [F.col("doc_id").desc_nulls_last(), F.col("key").asc()]
    slim = docs.groupBy("doc_id", "id", "key").agg(F.max("n").alias("n"))
    slim = slim.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *falling).withColumn("part", F.spark_partition_id())
    slim = written(slim, "ids")
    in_part = W.partitionBy("part").orderBy(*falling)
    own = F.struct("id", "key")
    rows = slim.select("id", "key", "n", "part", F.lead(own).over(in_part).alias("next"), F.row_number().over(in_part).alias("place"))
    heads = rows.where("place = 1").select("part", own.alias("head"))
    over = W.partitionBy(F.lit(0)).orderBy("part")  # as many rows as ranges
    after = F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select("part", after.alias("after"))
    return rows.join(F.broadcast(heads), "part").select("id", "key", "n", F.coalesce("next", "after").alias("next")).select("id", "key", "n", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited, anchors, edited_anchors, near_edited, near_next) for every row.

    edited: the last third of the characters replaced by the first as many of the next document.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    links = next_documents(keyed.withColumn("n", F.length("text")))
    # Both joins read this one shuffle of texts, as both ask for the same columns: doc_id comes back from id.
    own = with_fingerprint(keyed.drop("doc_id"), "text", "anchors").repartition("id", "key")
    asked = links.select(F.col("next_id").alias("id"), F.col("next_key").alias("key"), F.col("id").alias("to_id"), F.col("key").alias("to_key"), F.floor(F.col("n") / 3).cast("int").alias("need"))
    given = own.join(asked.hint("shuffle_hash"), ["id", "key"]).select("to_id", "to_key", F.substring("text", F.lit(1), F.col("need")).alias("put"), F.col("anchors").alias("next_anchors"))
    # Copies of a document give the same.
    given = given.groupBy(F.col("to_id").alias("id"), F.col("to_key").alias("key")).agg(F.first("put").alias("put"), F.first("next_anchors").alias("next_anchors"))
    n = F.length("text")
    doc_id = F.nullif("id", F.lit(NO_ID)).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    both = own.join(given, ["id", "key"]).select(doc_id, n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 3)).cast("int")), F.col("put")).alias("edited"), "anchors", "next_anchors")
    both = with_fingerprint(both, "edited", "edited_anchors")
    both = with_likeness(with_likeness(both, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    return both.drop("next_anchors")


def shown(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lower(F.hex(x))), ",")


def op12_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    return found.select("doc_id", "n_chars", sha.alias("edited_sha256"), shown("anchors").alias("fingerprint"), shown("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")
