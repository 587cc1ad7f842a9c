"""The annotated corpus as XML: meetings, words, dialogue acts."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.functions.text import strip

SPEAKER = "struct<_nxt_agent:string,_global_name:string,_role:string>"
WORDS = "`_nite:id` string, _starttime string, _endtime string, _VALUE string"
ACT = "struct<`_nite:id`:string,_addressee:string,`nite:child`:array<struct<_href:string>>>"
SPEAKERS = "meeting_id string, speaker string, participant_id string, role string"


def _part(name: Column, k: int) -> Column:
    """The k-th part of a file's name between dots."""
    return F.get(F.split(name, r"\."), F.lit(k))


def meeting_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """(meeting_id, speaker, participant_id, role) of ``corpusResources/meetings.xml``.

    Entries without a meeting or letter are skipped; of equal keys the last counts. A missing file warns and gives no rows.
    """
    path = f"{folder}/corpusResources/meetings.xml"
    try:
        raw = spark.read.format("xml").option("rowTag", "meeting").schema(f"_observation string, speaker array<{SPEAKER}>").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        warnings.warn(f"no {path}", stacklevel=2)
        return spark.createDataFrame([], SPEAKERS)
    rows = raw.where("_observation IS NOT NULL").select(F.col("_observation").alias("meeting_id"), F.monotonically_increasing_id().alias("m"), "speaker")
    rows = rows.select("meeting_id", "m", F.posexplode("speaker").alias("pos", "s"))
    rows = rows.where("s._nxt_agent IS NOT NULL AND s._nxt_agent <> ''")
    # A later entry of a meeting replaces the whole earlier one.
    last = F.max("m").over(W.partitionBy("meeting_id"))
    rows = rows.withColumn("last", last).where("m = last")
    return rows.groupBy("meeting_id", F.col("s._nxt_agent").alias("speaker")).agg(
        F.max_by("s._global_name", "pos").alias("participant_id"), F.max_by("s._role", "pos").alias("role")
    )


def _files(spark: SparkSession, form: str, pattern: str) -> DataFrameReader:
    """A reader of a folder's files whose names fit. The folder is listed once: a pattern in a path makes each file a path of its own, which a job of up to 10,000 tasks lists."""
    return spark.read.format(form).option("pathGlobFilter", pattern)


def words(spark: SparkSession, folder: str) -> DataFrame:
    """(meeting_id, speaker, word_id, text, starttime, endtime) of all ``words/*.words.xml``; only w elements."""
    raw = _files(spark, "xml", "*.words.xml").option("rowTag", "w").option("mode", "FAILFAST").schema(WORDS).load(f"{folder}/words")
    name = F.col("_metadata.file_name")
    seconds = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c).cast("double")), F.lit(0.0))
    return raw.select(
        _part(name, 0).alias("meeting_id"),
        _part(name, 1).alias("speaker"),
        F.coalesce("`_nite:id`", F.lit("")).alias("word_id"),
        F.coalesce("_VALUE", F.lit("")).alias("text"),
        seconds("_starttime").alias("starttime"),
        seconds("_endtime").alias("endtime"),
    )


def act_refs(spark: SparkSession, folder: str, charset: str = "UTF-8") -> DataFrame:
    """(meeting_id, speaker, dact_id, addressee, annotated, doc_order, refs) of all acts.

    Files are parsed whole, so that acts keep their order in the document.
    """
    raw = _files(spark, "binaryFile", "*.dialog-act.xml").load(f"{folder}/dialogueActs")
    name = F.element_at(F.split("path", "/"), -1)
    body = F.regexp_replace(F.decode("content", charset), r"^\s*<\?xml[^>]*\?>", "")
    acts = raw.select(_part(name, 0).alias("meeting_id"), _part(name, 1).alias("speaker"), F.from_xml(body, f"dact array<{ACT}>").alias("x"))
    rows = acts.select("meeting_id", "speaker", F.posexplode_outer("x.dact").alias("doc_order", "a")).where("doc_order IS NOT NULL")
    refs = F.filter(F.transform(F.coalesce("a.`nite:child`", F.array().cast("array<struct<_href:string>>")), lambda c: c["_href"]), lambda h: h.isNotNull() & (h != ""))
    return rows.select(
        "meeting_id",
        "speaker",
        F.coalesce("a.`_nite:id`", F.lit("")).alias("dact_id"),
        strip(F.coalesce("a._addressee", F.lit(""))).alias("addressee_text"),
        F.col("a._addressee").isNotNull().alias("annotated"),
        F.col("doc_order").cast("long").alias("doc_order"),
        refs.alias("refs"),
    )


def annotated_meetings(refs: DataFrame, limit: int | None = 10) -> DataFrame:
    """Meetings in which some act has the addressee attribute, even an empty one."""
    found = refs.groupBy("meeting_id").agg(F.bool_or("annotated").alias("any")).where("any").select("meeting_id")
    return found if limit is None else found.orderBy("meeting_id").limit(limit)


def addressees(text: Column) -> Column:
    """Split at commas, items untrimmed; nothing gives no addressees."""
    return F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))
