"""Labels from what happened next, and the category of each decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.config import CATEGORIES, CONFIDENCES, DEFAULT, Settings
from colloq.functions.text import is_incomplete, mentions

#: The order in which samples come when nothing else decides.
POSITION = ("meeting_id", "sequence_id", "turn_index", "target_speaker")


def reason() -> Column:
    target, speaker, to = F.col("target_speaker"), F.col("current_turn.speaker"), F.col("addressees_in_current")
    spoke = F.when(F.col("target_is_addressed"), F.concat(target, F.lit(" was explicitly addressed by "), speaker, F.lit(" and spoke (ground truth)")))
    spoke = spoke.otherwise(F.concat(target, F.lit(" spoke next in conversation (ground truth)")))
    other = F.concat(speaker, F.lit(" addressed "), F.array_join(to, ", "), F.lit(", not "), target, F.lit(" (ground truth: did not speak)"))
    silent = F.when(F.size(to) > 0, other).otherwise(F.concat(target, F.lit(" did not speak next (ground truth)")))
    return F.when(F.col("target_spoke_next"), spoke).otherwise(silent)


def labeled(points: DataFrame) -> DataFrame:
    decision = F.when(F.col("target_spoke_next"), "SPEAK").otherwise("SILENT")
    return points.withColumns({"decision": decision, "confidence": F.lit("high"), "reason": reason()})


def recent(window: int) -> Column:
    """Whether the target spoke in the last turns before the current one."""
    turns = F.col("context_turns")
    last = F.slice(turns, F.greatest(F.lit(1), F.size(turns) - window + 1), F.lit(window))
    return F.array_contains(F.transform(last, lambda t: t["speaker"]), F.col("target_speaker"))


def category(settings: Settings = DEFAULT) -> Column:
    addressed, text = F.col("target_is_addressed"), F.col("current_turn.text")
    speak = F.when(addressed, "I1").when(recent(settings.recent_speak), "I2").otherwise("I3")
    silent = (
        F.when(mentions(text, F.col("target_speaker")) & ~addressed, "S2")
        .when(is_incomplete(text), "S4")
        .when(recent(settings.recent_silent), "S3")
        .when((F.size("addressees_in_current") > 0) & ~addressed, "S5")
        .otherwise("S1")
    )
    return F.when(F.col("decision") == "SPEAK", speak).otherwise(silent)


def categorized(points: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Decision points with decision, confidence, reason and category."""
    return labeled(points).withColumn("category", category(settings))


def crosstab(samples: DataFrame) -> DataFrame:
    """Samples of each category by confidence."""
    return samples.groupBy("category").agg(*[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES])


def addressed_rate(samples: DataFrame) -> DataFrame:
    """How often those who were addressed spoke next; null if no one was."""
    a = F.count_if("target_is_addressed")
    both = F.count_if(F.col("target_is_addressed") & F.col("target_spoke_next"))
    return samples.agg(a.alias("addressed"), both.alias("spoke"), F.try_divide(both.cast("double"), a).alias("rate"))


def first_of_each(samples: DataFrame, n: int = 2) -> DataFrame:
    """The first samples of every category; a top-k of each partition goes to the shuffle."""
    rank = F.row_number().over(W.partitionBy("category").orderBy(*POSITION))
    return samples.withColumn("rank", rank).where(F.col("rank") <= n)


def category_names() -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
