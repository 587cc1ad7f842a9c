"""JSON files between stages, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.sources.sinks import _opened, listed

TURN = "struct<speaker:string,text:string>"
SEQUENCES = (
    f"meeting_id string, sequence_id string, context array<{TURN}>, addressing_turn struct<speaker:string,addressees:array<string>,text:string,"
    f"is_explicit:boolean,inference_confidence:int,inference_reason:string>, response {TURN}, continuation array<{TURN}>, source string"
)
DECISION_POINTS = (
    "decision_point_id string, sequence_id string, meeting_id string, target_speaker string, all_speakers array<string>, turn_index int, "
    f"turn_type string, context_turns array<{TURN}>, current_turn {TURN}, addressees_in_current array<string>, target_is_addressed boolean, target_spoke_next boolean"
)
SAMPLES = DECISION_POINTS + ", decision string, confidence string, reason string, category string"
INTERMEDIATE = (
    "sample_id bigint, decision_point_id string, meeting_id string, sequence_id string, target_speaker string, all_speakers array<string>, "
    "context string, current_turn string, decision string, confidence string, reason string, category string"
)


#: How ``sinks.write_array`` begins and ends a file: only whole elements end at the start of a line.
HEAD, TAIL = b'[\n{\n  "', b"\n}\n]\n"


def _by_lines(spark: SparkSession, path: str) -> bool:
    """Whether this is one file that begins and ends as ``sinks.write_array`` writes them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return False
    size = fs.getFileStatus(at).getLen()
    if size < len(HEAD) + len(TAIL):
        return False
    given = fs.open(at)
    try:
        head = bytes(given.readNBytes(len(HEAD)))
        given.seek(size - len(TAIL))
        return head == HEAD and bytes(given.readNBytes(len(TAIL))) == TAIL
    finally:
        given.close()


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One top-level JSON array in each file.

    A parser takes a file whole, in one task. Files as ``sinks.write_array`` makes them are parted where elements end instead, by as many tasks as they
    have splits: strings hold no bare line breaks, and what is nested is indented.
    """
    if not _by_lines(spark, path):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    rows = spark.read.option("lineSep", "\n}").text(path)
    element = F.regexp_replace("value", r"^\s*[\[,]?\s*", "")
    # Nothing but the closing bracket follows the last element.
    rows = rows.where(F.trim(F.translate("value", "\n", "")) != "]")
    return rows.select(F.from_json(F.concat(element, F.lit("\n}")), schema, {"mode": "FAILFAST"}).alias("element")).select("element.*")


#: Texts of files are sent on when they are so many characters.
AT_ONCE = 4 << 20


def read_each(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object in each ``.json`` file under a folder that all machines see, its subfolders too; hidden files are left out.

    Spark's own readers keep every file's name and size on the driver. Here it lists the folder's own entries only: tasks list the subfolders that
    ``sinks.write_each`` makes, and open the files.
    """

    def run(frames):
        import pandas as pd

        store, base = _opened(folder)
        for frame in frames:
            texts, size = [], 0
            for path in frame["path"]:
                name = path.rpartition("/")[2]
                if not name.endswith(".json") or name[0] in "._":
                    continue
                with store.open_input_stream(f"{base}/{path}") as given:
                    texts.append(given.read().decode())
                size += len(texts[-1])
                if size > AT_ONCE:
                    yield pd.DataFrame({"value": texts})
                    texts, size = [], 0
            if texts:
                yield pd.DataFrame({"value": texts})

    rows = listed(spark, folder).select("path").mapInPandas(run, "value string")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("element")).select("element.*")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By extension: ``.json`` files hold an array, anything else (``.jsonl``, folders) lines."""
    return read_array(spark, path, schema) if path.endswith(".json") else read_lines(spark, path, schema)
