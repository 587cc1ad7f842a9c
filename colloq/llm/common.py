"""What the corpus operators share: places to keep tables, folds, and shapes of rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What documents hold; stages of a pipeline hand these on.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Bytes of one Arrow batch at most. Rows may be whole texts or sets of shingles, and a batch is held by the JVM and by Python at once.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input; from then on the session's Arrow batches are bounded by ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _temporary() -> str:
    return "file://" + tempfile.mkdtemp(prefix="colloq-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one
    machine, as in tests, a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = _temporary()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def passing(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which the file system deletes when the session ends, whatever became of the job."""
    path = fresh_path(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage in a way that outlives executors, and fixes what a later
    evaluation would otherwise compute anew (sampled ranges, batch bounds). The table lasts as long as the session.
    """
    return _stored(df, f"{passing(df.sparkSession, name)}/rows")


def lean(run):
    """``run`` over Arrow batches; at a task's end unused memory goes back to the system.

    Python workers are kept for later tasks, and an idle one would otherwise hold its largest task's memory beside the JVM's.
    """

    def each(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return each


class Scratch:
    """Tables in one shared folder that only the steps in between need; each goes when it has been read for the last time."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, passing(spark, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.made += 1
        path = f"{self.path}/{name}-{self.made}"
        back = _stored(df, path)
        back.scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that ``written`` of this scratch has returned."""
        for t in tables:
            self._delete(t.scratch_path)

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of UTF-8 in a text column: one aggregate over that column alone."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])


def pieces(total: int, each: int, least: int = 1) -> int:
    """Into how many parts of about ``each`` bytes ``total`` goes."""
    return max(least, -(-total // each))


def plus(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with more fields."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields])
