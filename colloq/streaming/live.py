"""Sequences that arrive as files, turned into labelled samples as a stream.

Everything from a sequence to its samples looks at one row, so the batch operators
serve a stream as they are. Repeated samples are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.config import DEFAULT, Settings
from colloq.operators.quality import filtered, signature
from colloq.plans.pipeline import samples
from colloq.sources.files import SEQUENCES


def sequence_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences from JSON lines that are put into a folder."""
    return spark.readStream.schema(SEQUENCES).json(folder)


def sample_stream(found: DataFrame, settings: Settings = DEFAULT, late: str = "1 hour") -> DataFrame:
    """Good samples of a stream of sequences, without repeats of a signature within ``late``."""
    rows = filtered(samples(found, settings), settings).withColumn("signature", F.xxhash64(signature(settings.signature_context)))
    rows = rows.withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", late)
    return rows.dropDuplicatesWithinWatermark(["signature"]).drop("signature", "seen_at")


def write_samples(rows: DataFrame, out: str, checkpoint: str):
    """Starts writing samples as JSON lines; once the present input is done, the query ends."""
    return rows.writeStream.format("json").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
