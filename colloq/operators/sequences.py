"""Addressed exchanges: context, addressing turn, response, continuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.config import DEFAULT, EXPLICIT_SOURCE, INFERRED_SOURCE, Settings
from colloq.operators.nextevents import Index, block_of, first_after, index, turns_between
from colloq.operators.timeline import context_window, first_response
from colloq.plans.ranking import numbered
from colloq.plans.tables import kept

TURN = "array<struct<speaker:string,text:string>>"


def candidates(acts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Acts that address someone who answers, with context, response and participants."""
    rows = first_response(context_window(acts, settings.context_turns), settings.response_horizon)
    rows = rows.where("has_explicit_addressee AND response IS NOT NULL")
    return rows.withColumn("participants", F.array_distinct(F.concat(F.array("speaker"), "addressee")))


def spans(found: DataFrame, of: Index) -> DataFrame:
    """(meeting_id, idx, first, stop): the turns first..stop - 1 of each candidate that has a continuation; they follow one another.

    It begins with the first participant after the response and ends before an act that addresses another
    set of speakers, and before the next other speaker; others before it begins are skipped. Both ends are searches in the timeline's index.
    """
    asked = found.select("meeting_id", "idx", F.col("response.idx").alias("after"), "participants", F.array_sort(F.array_distinct("addressee")).alias("own"))
    inside = lambda t: F.array_contains("participants", t["s"])
    turned = lambda t: t["a"].isNotNull() & (t["a"] != F.col("own"))
    turns = lambda b: b["least"].isNotNull() & ((b["least"] != F.col("own")) | (b["most"] != F.col("own")))
    begun = first_after(asked, of, "after", lambda t: inside(t) | turned(t), lambda b: F.arrays_overlap(b["speakers"], "participants") | turns(b), "begin")
    begun = begun.where(~turned(F.col("begin"))).withColumn("first", F.col("begin.k"))
    outside = lambda b: F.size(F.array_except(b["speakers"], "participants")) > 0
    ended = first_after(begun, of, "first", lambda t: ~inside(t) | turned(t), lambda b: outside(b) | turns(b), "end")
    # Those that nothing ends run to the end of their meeting.
    last = of.leaves.groupBy("meeting_id").agg((F.max(F.element_at("turns.k", -1)) + 1).alias("n"))
    ends = ended.select("meeting_id", "idx", F.col("end.k").alias("stop"))
    return begun.join(ends, ["meeting_id", "idx"], "left").join(last, "meeting_id").select("meeting_id", "idx", "first", F.coalesce("stop", "n").alias("stop"))


def with_turns(found: DataFrame, ends: DataFrame, of: Index) -> DataFrame:
    """Candidates with continuation, the turns of their spans (meeting_id, idx, first, stop); none without a span."""
    more = turns_between(ends.join(found.select("meeting_id", "idx"), ["meeting_id", "idx"], "left_semi"), of, "first", "stop", "continuation")
    return found.join(more, ["meeting_id", "idx"], "left").withColumn("continuation", F.coalesce("continuation", F.array().cast(TURN)))


def with_continuations(found: DataFrame, acts: DataFrame, stop_at_new_addressee: bool = True) -> DataFrame:
    """Candidates with continuation, later turns of the participants until the exchange ends. They are read twice: hand in a table."""
    of = index(acts, stop_at_new_addressee)
    return with_turns(found, spans(found, of), of)


def steps(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(meeting_id, i, next, first, stop): where a scan goes on after each candidate, by the number of turns of response and continuation, and its span."""
    length = F.coalesce(F.col("stop") - F.col("first"), F.lit(0))
    rows = found.join(ends, ["meeting_id", "idx"], "left")
    return rows.select("meeting_id", F.col("idx").alias("i"), (F.col("response.idx") + length + 1).alias("next"), "first", "stop")


def greedy(steps: DataFrame) -> DataFrame:
    """(meeting_id, idx): the candidates that a scan takes which, after each, goes on at its step (meeting_id, i, next). Read more than once.

    It goes on by the number of continuation turns, so it can land inside them. A candidate that no earlier one's step passes
    over is taken whatever came before. Where the first candidate of a block is such a one, a segment begins: segments are scanned by
    themselves, one fold each, so a long meeting is the work of many tasks. What is ordered within a meeting is a row for each block.
    """
    rows = steps.select("meeting_id", "i", "next", block_of(F.col("i")).alias("block"))
    blocks = rows.groupBy("meeting_id", "block").agg(F.max("next").alias("far"), F.min("i").alias("head"))
    w = W.partitionBy("meeting_id").orderBy("block")
    free = F.coalesce(F.max("far").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) <= F.col("head")
    blocks = blocks.withColumn("free", free.cast("int")).select("meeting_id", "block", F.sum("free").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("segment"))
    rows = rows.join(blocks, ["meeting_id", "block"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("taken"))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("i", "next"))),
        start,
        lambda a, x: F.when(x["i"] >= a["at"], F.struct(x["next"].alias("at"), F.array_append(a["taken"], x["i"]).alias("taken"))).otherwise(a),
    )
    return rows.groupBy("meeting_id", "segment").agg(fold["taken"].alias("taken")).select("meeting_id", F.explode("taken").alias("idx"))


def _rows(found: DataFrame, infix: str, explicit: bool, confidence: Column, reason: Column, source: str) -> DataFrame:
    rows = numbered(found, [F.col("meeting_id"), F.col("idx")], "n", 0)
    turn = F.struct(
        "speaker",
        F.col("addressee").alias("addressees"),
        "text",
        F.lit(explicit).alias("is_explicit"),
        confidence.cast("int").alias("inference_confidence"),
        reason.alias("inference_reason"),
    )
    return rows.select(
        "meeting_id",
        F.concat("meeting_id", F.lit(infix), "n").alias("sequence_id"),
        "context",
        turn.alias("addressing_turn"),
        F.struct(F.col("response.speaker").alias("speaker"), F.col("response.text").alias("text")).alias("response"),
        "continuation",
        F.lit(source).alias("source"),
    )


def explicit_sequences(acts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Sequences from acts (with idx) that name their addressees."""
    found = kept(candidates(acts, settings), "candidates")
    of = index(acts)
    went = kept(steps(found, spans(found, of)), "steps")
    ends = went.where("first IS NOT NULL").select("meeting_id", F.col("i").alias("idx"), "first", "stop")
    rows = with_turns(found.join(greedy(went), ["meeting_id", "idx"], "left_semi"), ends, of)
    return _rows(rows, "_seq", True, F.lit(10), F.lit("Explicit"), EXPLICIT_SOURCE)


def inferred_sequences(acts: DataFrame, replies: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Sequences from the timeline of acts without addressees and parsed replies.

    replies: (meeting_id, idx, addressee, confidence, reason). Every act may begin one.
    """
    answered = acts.drop("addressee", "has_explicit_addressee").join(replies, ["meeting_id", "idx"], "left")
    sure = F.coalesce((F.size("addressee") > 0) & (F.col("confidence") >= settings.min_confidence), F.lit(False))
    rows = answered.withColumn("has_explicit_addressee", sure).withColumn("addressee", F.coalesce("addressee", F.array().cast("array<string>")))
    found = with_continuations(kept(candidates(rows, settings), "candidates"), rows, stop_at_new_addressee=False)
    return _rows(found, "_inferred", False, F.col("confidence"), F.col("reason"), INFERRED_SOURCE)


def merged(explicit: DataFrame, inferred: DataFrame) -> DataFrame:
    """All sequences by meeting and sequence id, compared as text."""
    return explicit.unionByName(inferred).orderBy("meeting_id", "sequence_id")


def per_meeting(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n"))


def sequence_stats(sequences: DataFrame) -> DataFrame:
    """Totals, and the extent of contexts and continuations, in one row."""
    c, k = F.size("context"), F.size("continuation")
    return sequences.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.countDistinct("meeting_id").alias("meetings"),
        F.countDistinct("addressing_turn.speaker").alias("speakers"),
        *[f(x).alias(f"{n}_{name}") for name, x in (("context", c), ("continuation", k)) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
    )


def source_pivot(sequences: DataFrame) -> DataFrame:
    """Explicit, inferred and all sequences of each meeting."""
    count = lambda s: F.count_if(F.col("source") == s)
    return sequences.groupBy("meeting_id").agg(count(EXPLICIT_SOURCE).alias("explicit"), count(INFERRED_SOURCE).alias("inferred"), F.count(F.lit(1)).alias("total"))


def confidence_histogram(sequences: DataFrame) -> DataFrame:
    """Inferred sequences by confidence, with shares, highest first."""
    rows = sequences.where(F.col("source") == INFERRED_SOURCE).groupBy(F.col("addressing_turn.inference_confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy())).orderBy(F.desc("confidence"))


def expansion(sequences: DataFrame) -> DataFrame:
    """How much inference adds, and how sure it was; nulls where there is nothing to divide by."""
    explicit, inferred = F.count_if(F.col("source") == EXPLICIT_SOURCE), F.count_if(F.col("source") == INFERRED_SOURCE)
    sure = F.when(F.col("source") == INFERRED_SOURCE, F.col("addressing_turn.inference_confidence"))
    return sequences.agg(
        explicit.alias("explicit"), inferred.alias("inferred"), F.try_divide(inferred * 100.0, explicit).alias("expansion_percent"),
        F.avg(sure).alias("avg_confidence"), F.min(sure).alias("min_confidence"), F.max(sure).alias("max_confidence"),
    )
