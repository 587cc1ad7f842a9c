"""Acts in the order of a meeting, meetings worth reading, and who speaks in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIME_ORDER = ("starttime", "speaker", "doc_order")


def indexed(acts: DataFrame) -> DataFrame:
    """Acts with idx, their 0-based place in their meeting by start, speaker and document order."""
    place = F.row_number().over(W.partitionBy("meeting_id").orderBy(*TIME_ORDER))
    return acts.withColumn("idx", place - 1)


def meetings_with_addressees(acts: DataFrame, limit: int | None = 10) -> DataFrame:
    """Ids of the first meetings, in order, with an act that names an addressee."""
    found = acts.groupBy("meeting_id").agg(F.bool_or("has_explicit_addressee").alias("any")).where("any").select("meeting_id")
    return found if limit is None else found.orderBy("meeting_id").limit(limit)


def in_meetings(acts: DataFrame, meetings: DataFrame) -> DataFrame:
    return acts.join(meetings.select("meeting_id"), "meeting_id", "left_semi")


def speakers(acts: DataFrame) -> DataFrame:
    """(meeting_id, all_speakers): sorted."""
    return acts.groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("all_speakers"))


def with_speakers(acts: DataFrame, known: DataFrame) -> DataFrame:
    """Adds all_speakers from (meeting_id, speaker) rows; A to D where a meeting is unknown."""
    fallback = F.array(*map(F.lit, "ABCD"))
    return acts.join(speakers(known), "meeting_id", "left").withColumn("all_speakers", F.coalesce("all_speakers", fallback))


def context_window(acts: DataFrame, turns: int = 10) -> DataFrame:
    """Adds context, the preceding acts of any speaker."""
    w = W.partitionBy("meeting_id").orderBy("idx").rowsBetween(-turns, -1)
    return acts.withColumn("context", F.collect_list(F.struct("speaker", "text")).over(w))


def first_response(acts: DataFrame, horizon: int = 19) -> DataFrame:
    """Adds response (idx, speaker, text): the first of the next acts whose speaker is addressed."""
    w = W.partitionBy("meeting_id").orderBy("idx").rowsBetween(1, horizon)
    ahead = F.collect_list(F.struct("idx", "speaker", "text")).over(w)
    rows = acts.withColumn("ahead", ahead)
    return rows.withColumn("response", F.get(F.filter("ahead", lambda x: F.array_contains("addressee", x["speaker"])), F.lit(0))).drop("ahead")
