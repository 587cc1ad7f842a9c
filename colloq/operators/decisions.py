"""Decision points: for each turn of a sequence, whether each other speaker spoke next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions.text import normalize


def sequence_speakers() -> Column:
    """Everyone who speaks or is addressed in a sequence, sorted."""
    own = F.concat(
        F.col("context.speaker"), F.array("addressing_turn.speaker"), F.col("addressing_turn.addressees"), F.array("response.speaker"), F.col("continuation.speaker")
    )
    return F.array_sort(F.array_distinct(own))


def timeline() -> Column:
    """Turns of a sequence in order, with their kind and whom they address."""
    none = F.array().cast("array<string>")

    def turn(t: Column, kind: str, addressees: Column = none) -> Column:
        return F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"), addressees.alias("addressees"), F.lit(kind).alias("turn_type"))

    first = F.col("addressing_turn")
    return F.concat(
        F.transform("context", lambda t: turn(t, "context")),
        F.array(turn(first, "addressing", first["addressees"])),
        F.array(turn(F.col("response"), "response")),
        F.transform("continuation", lambda t: turn(t, "continuation")),
    )


def _turns(sequences: DataFrame) -> DataFrame:
    return sequences.select("meeting_id", "sequence_id", sequence_speakers().alias("all_speakers"), timeline().alias("turns"))


def _pair(t: Column) -> Column:
    return F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"))


def _points(rows: DataFrame, before: Column, follower: Column, *more: str) -> DataFrame:
    """Points of rows with all_speakers, turn_index, turn and target_speaker, by the turns before and the next speaker."""
    return rows.select(
        F.concat("sequence_id", F.lit("_turn"), "turn_index", F.lit("_target"), "target_speaker").alias("decision_point_id"),
        "sequence_id",
        "meeting_id",
        "target_speaker",
        "all_speakers",
        "turn_index",
        F.col("turn.turn_type").alias("turn_type"),
        F.transform(before, _pair).alias("context_turns"),
        _pair(F.col("turn")).alias("current_turn"),
        F.col("turn.addressees").alias("addressees_in_current"),
        F.array_contains("turn.addressees", F.col("target_speaker")).alias("target_is_addressed"),
        F.coalesce(follower == F.col("target_speaker"), F.lit(False)).alias("target_spoke_next"),
        *more,
    )


def _all_before() -> tuple[Column, Column]:
    """The turns before turn_index, and who speaks after it."""
    return F.slice("turns", F.lit(1), F.col("turn_index")), F.get("turns", F.col("turn_index") + 1)["speaker"]


def recent_points(sequences: DataFrame, context: int) -> DataFrame:
    """``decision_points`` with the last ``context`` turns only, and normal and normal_before: normalised text, and (speaker, normal) of those turns.

    A turn's row holds the turns near it, not its whole sequence, and a text is normalised once, not for each speaker and neighbour.
    """
    own = lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text"), t["addressees"].alias("addressees"), t["turn_type"].alias("turn_type"), normalize(t["text"]).alias("normal"))
    rows = _turns(sequences).withColumn("turns", F.transform("turns", own))
    near = F.transform(
        "turns",
        lambda t, i: F.struct(
            t.alias("turn"), F.slice("turns", F.greatest(i - context, F.lit(0)) + 1, F.least(i, F.lit(context))).alias("before"), F.get("turns", i + 1)["speaker"].alias("follower")
        ),
    )
    each = rows.select("meeting_id", "sequence_id", "all_speakers", F.posexplode_outer(near).alias("turn_index", "near")).select("*", "near.*").drop("near")
    others = F.explode_outer(F.filter("all_speakers", lambda s: s != F.col("turn.speaker")))
    named = each.select("*", others.alias("target_speaker")).where("target_speaker IS NOT NULL")
    named = named.withColumns({"normal": F.col("turn.normal"), "normal_before": F.transform("before", lambda t: F.struct(t["speaker"].alias("speaker"), t["normal"].alias("normal")))})
    return _points(named, F.col("before"), F.col("follower"), "normal", "normal_before")


def decision_points(sequences: DataFrame) -> DataFrame:
    """One row per turn and other speaker. Contexts are slices, made only where they are used."""
    # Outer, as the inner form asks first for arrays that aren't empty, which makes them twice; a sequence always has turns.
    each = _turns(sequences).select("*", F.posexplode_outer("turns").alias("turn_index", "turn"))
    others = F.explode_outer(F.filter("all_speakers", lambda s: s != F.col("turn.speaker")))
    return _points(each.select("*", others.alias("target_speaker")).where("target_speaker IS NOT NULL"), *_all_before())


def points_of(keys: DataFrame, sequences: DataFrame) -> DataFrame:
    """The decision points that keys (meeting_id, sequence_id, turn_index, target_speaker) name, with the other columns of keys.

    A sequence meets its own keys, all in one row, and makes only the contexts that are asked for.
    """
    place = ("meeting_id", "sequence_id")
    more = [c for c in keys.columns if c not in (*place, "turn_index", "target_speaker")]
    asked = keys.groupBy(*place).agg(F.collect_list(F.struct("turn_index", "target_speaker", *more)).alias("asked"))
    rows = _turns(sequences).join(asked, list(place)).select(*place, "all_speakers", "turns", F.explode("asked").alias("key")).select("*", "key.*")
    return _points(rows.withColumn("turn", F.get("turns", "turn_index")), *_all_before(), *more)


def turn_type_counts(points: DataFrame) -> DataFrame:
    rows = points.groupBy("turn_type").agg(F.count(F.lit(1)).alias("n"))
    return with_percent(rows)


def with_percent(counts: DataFrame) -> DataFrame:
    """Adds percent of all to rows with n; there are few of them."""
    from pyspark.sql import Window as W

    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def point_stats(points: DataFrame) -> DataFrame:
    c, s = F.size("context_turns"), F.size("all_speakers")
    return points.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("target_is_addressed").alias("addressed"),
        F.count_if("target_spoke_next").alias("spoke"),
        *[f(x).alias(f"{n}_{name}") for name, x in (("context", c), ("speakers", s)) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))],
    )


def heads(points: DataFrame, n: int = 5, turns: int = 2, chars: int = 60) -> DataFrame:
    """The first points, with their last context turns and the start of their text."""
    last = F.slice("context_turns", F.greatest(F.lit(1), F.size("context_turns") - turns + 1), F.lit(turns))
    first = points.orderBy("meeting_id", "sequence_id", "turn_index", "target_speaker").limit(n)
    return first.select("decision_point_id", "turn_type", last.alias("last_turns"), F.substring("current_turn.text", 1, chars).alias("text"))
