"""Conversations as meetings: pairs are interleaved and every line of a turn is an act."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def acts(conversations: DataFrame) -> DataFrame:
    """(meeting_id, speaker, addressee, text, starttime, endtime, dact_id, has_explicit_addressee, doc_order)."""
    lines = conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    even, ln = F.col("conv_id") % 2 == 0, F.col("pos") + 1
    number = F.floor(F.col("conv_id") / 2).cast("string")
    first = F.when(even, F.lit("B")).otherwise(F.lit("D"))
    to_user = F.when(even, F.lit("A")).otherwise(F.lit("C"))
    none = F.array().cast("array<string>")
    addressee = (
        F.when(ln > 1, none)
        .when((F.col("role") == "user") & (F.col("turn") % 4 < 2), F.array(first))
        .when(F.col("role") == "user", F.array(F.lit("B"), F.lit("D")))
        .when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.array(to_user))
        .otherwise(none)
    )
    speaker = F.when(F.col("role") == "user", to_user).when(F.col("role") == "assistant", first).otherwise(F.lit("E"))
    start = (F.col("turn") * 100 + ln * 2 + F.col("conv_id") % 2).cast("double")
    return lines.select(
        F.concat(F.lit("M"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("meeting_id"),
        speaker.alias("speaker"),
        addressee.alias("addressee"),
        F.trim("line").alias("text"),
        start.alias("starttime"),
        (start + 1).alias("endtime"),
        F.concat_ws(".", "conv_id", "turn", ln).alias("dact_id"),
        (F.size(addressee) > 0).alias("has_explicit_addressee"),
        ln.cast("long").alias("doc_order"),
    )
