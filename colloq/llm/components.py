"""Connected components by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) can reach; a table of ``scratch`` if given.

    Every round hangs neighbours on least neighbours. Both steps are group-bys
    with a minimum and an equi-join, so a node with very many links is a row in
    many tasks, never one task's list. Rounds are written as tables, and dropped after the next one.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    links = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # Large star: larger neighbours go to the least of a node's neighbours and itself.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = scratch.written(small, "links")
        scratch.drop(links)
        # Done when every node hangs on one root and no root hangs on another.
        depth = then.join(then.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        twice = then.groupBy("u").count().where("count > 1").limit(1).count()
        links = then
        if not depth and not twice:
            break
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found.scratch_path = links.scratch_path
    return found
