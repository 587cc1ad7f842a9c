"""Class targets, category quotas, and the samples that fill them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.config import DECISIONS, DEFAULT, Settings
from colloq.operators.decisions import with_percent
from colloq.operators.labels import POSITION
from colloq.operators.quality import confidence_score
from colloq.plans.ranking import in_ranges


def class_targets(speak: int, silent: int, ratio: float = 0.5, most: int | None = None) -> tuple[int, int]:
    """How many samples of each class to aim at."""
    total = most if most and speak + silent > most else 2 * min(speak, silent)
    want = int(total * ratio)
    return min(want, speak), min(total - want, silent)


def _shared(gap: int, room: dict[str, int]) -> dict[str, int]:
    """What each category gets of a gap that is handed out in order, each up to its room."""
    before = accumulate(room.values(), initial=0)
    return {k: max(0, min(r, gap - b)) for (k, r), b in zip(room.items(), before)}


def category_quotas(available: dict[str, int], target: int, ratio: float = 0.35) -> dict[str, int]:
    """Samples to take of each category; ``available`` is in order of first appearance.

    Shares in proportion, at most a cap and at least a floor, and never more than there are. What is missing is
    handed out by falling availability regardless of the cap, what is too much is taken back by falling share down to the floor;
    among equals the first to appear comes first.
    """
    total = sum(available.values())
    floor = max(1, target // (2 * max(1, len(available))))
    most = max(floor, int(target * ratio))
    share = {k: min(n, most, max(floor, int(target * (n / total)))) for k, n in available.items()}
    gap = target - sum(share.values())
    by = lambda size: sorted(available, key=lambda k: -size[k])
    given = _shared(gap, {k: available[k] - share[k] for k in by(available)})
    taken = _shared(-gap, {k: max(0, share[k] - floor) for k in by(share)})
    return {k: share[k] + given[k] - taken[k] for k in available}


def category_counts(samples: DataFrame) -> DataFrame:
    """(decision, category, n, first): eight rows at most; first is where the category first appears."""
    return samples.groupBy("decision", "category").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*POSITION)).alias("first"))


def quotas(samples: DataFrame, settings: Settings = DEFAULT) -> list[tuple[str, str, int, int, int, int]]:
    """(decision, category, n, place in order, quota, target of the class)."""
    rows = sorted(category_counts(samples).collect(), key=lambda r: (DECISIONS.index(r.decision), tuple(r["first"])))
    own = {d: {r.category: r.n for r in rows if r.decision == d} for d in DECISIONS}
    targets = class_targets(*(sum(own[d].values()) for d in DECISIONS), settings.speak_ratio, settings.max_samples)
    out = []
    for d, target in zip(DECISIONS, targets):
        found = category_quotas(own[d], target, settings.category_ratio)
        out += [(d, c, own[d][c], len(out) + k, q, target) for k, (c, q) in enumerate(found.items())]
    return out


def selected(keys: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``keys`` of the samples that fill the quotas, with sample_id in the order SPEAK, SILENT, category, confidence, position.

    Keys are range-sorted once. How many of a category stand in each range, a histogram of its positions, says where its quota is
    used up: ranges beyond that are not read again, and what a sample's number is follows from its place in its range.
    Keys are read twice, for counts and in order: hand in a table or a cached frame.
    """
    spark = keys.sparkSession
    plan = quotas(keys, settings)
    places = spark.createDataFrame([(d, c, place) for d, c, _, place, _, _ in plan], "decision string, category string, __place int")
    order = keys.join(F.broadcast(places), ["decision", "category"]).withColumn("__score", -confidence_score(F.col("confidence")))
    rows = in_ranges(order, [F.col("__place"), F.col("__score"), *map(F.col, POSITION)], "positions")
    # At most a row for each range and eight more.
    found = sorted(rows.groupBy("__place", "__part").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    cut, seen, number = [], {}, 0
    quota = {place: q for *_, place, q, _ in plan}
    for r in found:
        earlier = seen.get(r["__place"], 0)
        left = min(r["n"], quota[r["__place"]] - earlier)
        if left > 0:
            cut.append((r["__place"], r["__part"], r["first"], left, number))
            number += left
        seen[r["__place"]] = earlier + r["n"]
    cut = spark.createDataFrame(cut, "__place int, __part int, __first long, __left long, __before long")
    kept_rows = rows.join(F.broadcast(cut), ["__place", "__part"]).where("__at - __first < __left")
    return kept_rows.select(*keys.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("sample_id"))


def balanced(samples: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The samples that fill the quotas, with sample_id; their positions are all different.

    Samples are read twice (for their keys and for their texts): hand in a table or a cached frame.
    """
    drawn = selected(samples.select(*POSITION, "decision", "confidence", "category"), settings)
    return samples.join(drawn.select(*POSITION, "sample_id"), list(POSITION)).select(*samples.columns, "sample_id")


def distribution(samples: DataFrame) -> DataFrame:
    """Counts of categories with their share of their class."""
    from pyspark.sql import Window as W

    rows = samples.groupBy("decision", "category").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("decision")))


def confidence_share(samples: DataFrame) -> DataFrame:
    """Samples of each confidence and their percentage."""
    return with_percent(samples.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")))
