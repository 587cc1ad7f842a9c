"""Numbers along a global order, and ranks in groups: sampled ranges and a prefix sum of their sizes.

Rows are range-partitioned by their whole sort key, so neither ids with one common prefix nor one group
with most of the rows puts them into one task. A row's number is its place in its range plus the sizes of the ranges before.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.plans.tables import kept

#: monotonically_increasing_id is the partition shifted by so many bits, plus the row's place in it.
PLACE_BITS = 33


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted and written, with __part (the range) and __at (the place in it, from 0)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = rows.withColumn("__id", at)
    return kept(rows.select(*df.columns, F.shiftright("__id", PLACE_BITS).cast("int").alias("__part"), F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1).alias("__at")), name)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """Adds the number of each row along ``order``; rows with equal keys are numbered in any order, once and for all."""
    rows = in_ranges(df, order, "numbered")
    # A row for each range; how many there are is a setting.
    sizes = sorted(rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = accumulate((r["n"] for r in sizes), initial=first)
    starts = df.sparkSession.createDataFrame([(r["__part"], b) for r, b in zip(sizes, before)], "__part int, __before long")
    return rows.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column | None = None, name: str = "rank") -> DataFrame:
    """Adds the 1-based rank of each row in its group; ``bucket``, if given, comes before ``order``. One row for each group is joined back."""
    keys = [*map(F.col, groups), *([] if bucket is None else [bucket]), *order]
    rows = numbered(df, keys, "__n")
    if not groups:
        return rows.withColumnRenamed("__n", name)
    group = F.struct(*groups)
    starts = rows.groupBy(group.alias("__group")).agg(F.min("__n").alias("__first"))
    return rows.join(starts, F.col("__group").eqNullSafe(group)).select(*df.columns, (F.col("__n") - F.col("__first") + 1).alias(name))
