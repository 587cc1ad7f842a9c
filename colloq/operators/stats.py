"""Reports over intermediate samples, as frames, and compiled into one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.config import CATEGORIES, CONFIDENCES, DECISIONS, NO_CONTEXT


def overview(s: DataFrame) -> DataFrame:
    speakers = s.select(F.explode("all_speakers").alias("x")).agg(F.countDistinct("x").alias("speakers"))
    own = s.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("meeting_id").alias("meetings"), F.countDistinct("sequence_id").alias("sequences"))
    # Two frames of one row each.
    return own.join(F.broadcast(speakers)).withColumn("samples_per_sequence", F.try_divide(F.col("total").cast("double"), F.col("sequences")))


def decision_distribution(s: DataFrame) -> DataFrame:
    speak, silent, n = F.count_if(F.col("decision") == "SPEAK"), F.count_if(F.col("decision") == "SILENT"), F.count(F.lit(1))
    return s.agg(
        speak.alias("speak"), silent.alias("silent"), F.try_divide(speak * 100.0, n).alias("speak_percent"),
        F.try_divide(silent * 100.0, n).alias("silent_percent"), F.try_divide(silent.cast("double"), speak).alias("silent_to_speak"),
    )


def category_distribution(s: DataFrame) -> DataFrame:
    """All categories, those without samples too."""
    names = s.sparkSession.createDataFrame(list(CATEGORIES.items()), "category string, name string")
    counts = s.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(counts, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return rows.withColumn("percent", F.try_divide(F.col("n") * 100.0, F.sum("n").over(W.partitionBy())))


def confidence_grid(s: DataFrame) -> DataFrame:
    """Every decision (and ``ALL``) with every confidence."""
    grid = s.sparkSession.createDataFrame([(d, c) for d in ("ALL", *DECISIONS) for c in CONFIDENCES], "decision string, confidence string")
    counts = s.select(F.explode(F.array(F.lit("ALL"), "decision")).alias("decision"), "confidence").groupBy("decision", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["decision", "confidence"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def context_length() -> Column:
    """Lines of the context, counted by their ends."""
    ends = F.length("context") - F.length(F.replace("context", F.lit("\n"), F.lit("")))
    return F.when(F.col("context") == NO_CONTEXT, 0).otherwise(ends + 1)


def context_stats(s: DataFrame) -> DataFrame:
    n = context_length()
    return s.agg(F.avg(n).alias("avg_turns"), F.min(n).alias("min_turns"), F.max(n).alias("max_turns"), F.count_if(n == 0).alias("without"))


def context_histogram(s: DataFrame, shortest: int = 10) -> DataFrame:
    """Samples by length of context, of the shortest lengths."""
    return s.groupBy(context_length().alias("turns")).agg(F.count(F.lit(1)).alias("n")).orderBy("turns").limit(shortest)


def duplicate_audit(s: DataFrame) -> DataFrame:
    # 128 bits of each pair are shuffled, not the contexts.
    pair = F.unhex(F.md5(F.concat_ws("\x00", "context", "current_turn").cast("binary")))
    ids, pairs = F.countDistinct("decision_point_id"), F.countDistinct(pair)
    n = F.count(F.lit(1))
    return s.agg(n.alias("total"), ids.alias("unique_ids"), (n - ids).alias("duplicate_ids"), pairs.alias("unique_pairs"), (n - pairs).alias("duplicate_pairs"))


def per_meeting(s: DataFrame) -> DataFrame:
    """Meetings by falling number of samples, ties by first appearance."""
    return s.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"), F.min("sample_id").alias("first")).orderBy(F.desc("n"), "first").drop("first")


def meeting_names(s: DataFrame) -> DataFrame:
    """(meeting_id), sorted."""
    return s.select("meeting_id").distinct().orderBy("meeting_id")


def speaker_names(s: DataFrame) -> DataFrame:
    """(speaker), sorted."""
    return s.select(F.explode("all_speakers").alias("speaker")).distinct().orderBy("speaker")


def stratified_examples(s: DataFrame, each: int = 5, seed: int = 7) -> DataFrame:
    """Up to so many samples of each category, in a pseudo-random order that the seed fixes."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), "decision_point_id").cast("binary"))
    rank = F.row_number().over(W.partitionBy("category").orderBy(order, "decision_point_id"))
    return s.withColumn("rank", rank).where(F.col("rank") <= each)


def compiled(s: DataFrame, lists: bool = True) -> dict:
    """All reports as one nested document (its keys are fixed values); ratios without a divisor are None.

    With ``lists`` it holds the names of meetings and speakers and the samples of every meeting, a row each; without them
    its size doesn't depend on the input, and ``colloq.sources.report`` puts them in by tasks.
    """
    o, d, c, a = (f(s).first() for f in (overview, decision_distribution, context_stats, duplicate_audit))
    grid = {(r.decision, r.confidence): r.n for r in confidence_grid(s).collect()}
    total = o.total
    share = lambda n: n / total * 100 if total else None
    speakers = [r[0] for r in speaker_names(s).collect()] if lists else []
    meetings = {r.meeting_id: r.n for r in per_meeting(s).collect()} if lists else {}
    return {
        "dataset_overview": {
            "total_samples": total, "unique_meetings": o.meetings, "meetings": sorted(meetings), "unique_sequences": o.sequences,
            "unique_speakers": o.speakers, "speakers": speakers, "samples_per_sequence": o.samples_per_sequence,
        },
        "decision_distribution": {
            "SPEAK": d.speak, "SILENT": d.silent, "speak_percentage": d.speak_percent, "silent_percentage": d.silent_percent, "silent_to_speak_ratio": d.silent_to_speak,
        },
        "category_distribution": {r.category: {"count": r.n, "percentage": r.percent, "name": r.name} for r in sorted(category_distribution(s).collect(), key=lambda r: r.category)},
        "confidence_distribution": {
            "overall": {k: {"count": grid["ALL", k], "percentage": share(grid["ALL", k])} for k in CONFIDENCES},
            "by_decision": {x: {k: grid[x, k] for k in CONFIDENCES} for x in DECISIONS},
        },
        "context_statistics": {"average_turns": c.avg_turns, "min_turns": c.min_turns, "max_turns": c.max_turns, "samples_with_no_context": c.without},
        "duplicate_analysis": {
            "unique_decision_points": a.unique_ids, "duplicate_decision_points": a.duplicate_ids,
            "unique_context_current_pairs": a.unique_pairs, "duplicate_context_current_pairs": a.duplicate_pairs,
        },
        "samples_per_meeting": meetings,
    }
