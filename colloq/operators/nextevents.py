"""The next act that fits, without meeting all later acts: a timeline's index of blocks.

Acts of a meeting stand in blocks of ``BLOCK`` neighbours, and for every meeting there is a list of its blocks
with what stands in them: speakers, and the least and greatest set of addressees. A search looks at the block where it begins, an equi-join
on (meeting, block). Only if nothing fits there does it look for the next block that must hold something, in the meeting's list, and
then at that block. So a search is three lookups at most, however far it goes, and acts of a long meeting are in many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.plans.tables import kept

BLOCK = 64


def block_of(idx: Column) -> Column:
    return F.floor(idx / BLOCK).cast("int")


@dataclass(frozen=True)
class Index:
    """leaves: (meeting_id, block, turns: array of k, s (speaker), a (set of addressees or null)); texts: (meeting_id, block, texts: array of k, speaker, text); tops: (meeting_id, blocks)."""

    leaves: DataFrame
    texts: DataFrame
    tops: DataFrame


def index(acts: DataFrame, addressees: bool = True) -> Index:
    """Of acts with idx. Written, as every search reads it; searches read turns only. Without ``addressees`` nobody counts as addressed."""
    named = F.when(F.col("has_explicit_addressee") & F.lit(addressees), F.array_sort(F.array_distinct("addressee")))
    turn = F.struct(F.col("idx").alias("k"), F.col("speaker").alias("s"), named.alias("a"))
    text = F.struct(F.col("idx").alias("k"), "speaker", "text")
    sorted_list = lambda x: F.array_sort(F.collect_list(x))
    leaves = acts.groupBy("meeting_id", block_of(F.col("idx")).alias("block")).agg(sorted_list(turn).alias("turns"), sorted_list(text).alias("texts"))
    leaves = kept(leaves, "timeline")
    sets = F.filter("turns.a", lambda a: a.isNotNull())
    content = F.struct("block", F.array_distinct("turns.s").alias("speakers"), F.array_min(sets).alias("least"), F.array_max(sets).alias("most"))
    tops = leaves.groupBy("meeting_id").agg(F.array_sort(F.collect_list(content)).alias("blocks"))
    return Index(leaves.drop("texts"), leaves.drop("turns"), tops)


def first_after(asked: DataFrame, of: Index, after: str, fits: Callable[[Column], Column], may_fit: Callable[[Column], Column], name: str) -> DataFrame:
    """``asked`` (with meeting_id) with the first turn later than ``after`` that fits, as ``name``; rows without one go.

    fits says so of a turn, may_fit of a block: whether some turn of it fits.
    """
    own = asked.columns
    hit = F.get(F.filter("turns", lambda t: (t["k"] > F.col(after)) & fits(t)), F.lit(0))
    keyed = asked.withColumn("block", block_of(F.col(after) + 1))
    # Written, as what was found and what wasn't go different ways.
    near = kept(keyed.join(of.leaves, ["meeting_id", "block"], "left").select(*own, F.col("block").alias("__from"), hit.alias(name)), "searched")
    found = near.where(F.col(name).isNotNull()).select(*own, name)
    # The rest is few: searches that leave their block.
    far = near.where(F.col(name).isNull()).select(*own, "__from").join(of.tops, "meeting_id")
    later = F.get(F.filter("blocks", lambda b: (b["block"] > F.col("__from")) & may_fit(b)), F.lit(0))["block"]
    far = far.select(*own, later.alias("block")).where("block IS NOT NULL").join(of.leaves, ["meeting_id", "block"])
    return found.unionByName(far.withColumn(name, hit).where(F.col(name).isNotNull()).select(*own, name))


def turns_between(asked: DataFrame, of: Index, first: str, stop: str, name: str) -> DataFrame:
    """(meeting_id, idx, name): the (speaker, text) of acts from ``first`` up to, without, ``stop``.

    Every asked row becomes one for each block that it touches, which grows with the turns that it gets.
    """
    spread = asked.select("meeting_id", "idx", first, stop, F.explode(F.sequence(block_of(F.col(first)), block_of(F.col(stop) - 1))).alias("block"))
    here = F.filter("texts", lambda t: (t["k"] >= F.col(first)) & (t["k"] < F.col(stop)))
    pieces = spread.join(of.texts, ["meeting_id", "block"]).select("meeting_id", "idx", F.struct("block", here.alias("turns")).alias("piece"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["turns"]))
    return pieces.groupBy("meeting_id", "idx").agg(F.transform(joined, lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))).alias(name))
