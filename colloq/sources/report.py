"""The statistics document as a file: what grows with the input is written by tasks, the rest is stitched around it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.operators import stats
from colloq.sources.sinks import write_stitched


def _json(c: str) -> Column:
    """A string as JSON: the one item of an array, without the brackets."""
    text = F.to_json(F.array(F.col(c)))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def write_statistics(s: DataFrame, path: str) -> None:
    """``stats.compiled`` of intermediate samples as one JSON file. Names and counts of meetings never reach the driver."""
    document = json.dumps(stats.compiled(s, lists=False), indent=2)
    counts = stats.per_meeting(s).select(F.concat(_json("meeting_id"), F.lit(": "), "n").alias("value"))
    lists = {
        '"meetings": [': stats.meeting_names(s).select(_json("meeting_id").alias("value")),
        '"speakers": [': stats.speaker_names(s).select(_json("speaker").alias("value")),
        '"samples_per_meeting": {': counts,
    }
    parts: list[str | DataFrame] = []
    for opened, rows in lists.items():
        before, _, document = document.partition(opened)
        parts += [before + opened, rows]
    write_stitched(s.sparkSession, path, [*parts, document + "\n"])
