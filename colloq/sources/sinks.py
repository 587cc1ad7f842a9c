"""Where results go: JSON lines, one array, a file per sample, reports, object stores."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.config import CATEGORIES, DEFAULT, Settings

def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """A folder of JSON lines, in order across its files; nulls are kept."""
    out = df.orderBy(*order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A file on any Hadoop file system, where Spark's own outputs go too."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _fragments(df: DataFrame, folder: str) -> list[str]:
    """The column value of ``df`` as text files, written by tasks; values of one file are parted by commas. Returns the files that hold any, in the order of partitions."""
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition, which is a file
    rows = df.select(place.alias("n"), "value").select(F.when(F.col("n") == 0, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    rows.write.option("compression", "none").text(folder)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-") and f.getLen())


def write_stitched(spark: SparkSession, path: str, parts: list[str | DataFrame]) -> None:
    """One text file of texts and of frames with a column value, whose rows are parted by commas.

    Tasks write the rows of frames, in their order. The files are then joined where the file system can do that by itself (``concat``); elsewhere they are
    copied one after another through a buffer of a fixed size. The driver never holds rows, only the names of files.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop, folder = jvm.org.apache.hadoop.fs.Path, f"{path}.parts-{uuid.uuid4().hex}"
    fs = hadoop(path).getFileSystem(conf)
    try:
        names: list[str] = []
        for k, part in enumerate(parts):
            if isinstance(part, str):
                write_text(spark, part, own := f"{folder}/text-{k}")
                names.append(own)
                continue
            for j, name in enumerate(_fragments(part, f"{folder}/rows-{k}")):
                if j:
                    write_text(spark, ",", own := f"{folder}/comma-{k}-{j}")
                    names.append(own)
                names.append(name)
        target = hadoop(f"{folder}/whole")
        fs.create(target, True).close()
        sources = spark.sparkContext._gateway.new_array(hadoop, len(names))
        for k, name in enumerate(names):
            sources[k] = hadoop(name)
        try:
            fs.concat(target, sources)
        except (Py4JJavaError, CapturedException) as e:
            if "UnsupportedOperationException" not in f"{type(e).__name__} {e}":
                raise
            out = fs.create(target, True)
            try:
                for name in names:
                    own = fs.open(hadoop(name))
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, 1 << 16, False)
                    finally:
                        own.close()
            finally:
                out.close()
        fs.mkdirs(hadoop(path).getParent())
        fs.delete(hadoop(path), True)
        if not fs.rename(target, hadoop(path)):
            raise OSError(f"can't write {path}")
    finally:
        fs.delete(hadoop(folder), True)


def write_array(df: DataFrame, path: str, *order: str) -> None:
    """One indented array in one file, of any size; in ``order``, if given. Rows are written by tasks."""
    rows = df.orderBy(*order) if order else df
    value = F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false", "pretty": "true"})
    write_stitched(df.sparkSession, path, ["[\n", rows.select(value.alias("value")), "]\n"])


def write_each(df: DataFrame, folder: str, number: str = "sample_id", per_folder: int | None = None) -> None:
    """One JSON file per row, ``{number}.json``, written by the tasks into a folder that all of them see.

    Opt-in: as many files as rows. A repeated task writes the same files again. With ``per_folder``, numbers stand in subfolders of so many, so that no
    one ever has to list all files: ``{number // per_folder}/{number}.json``.
    """
    name = F.col(number).cast("string")
    if per_folder:
        name = F.concat(F.floor(F.col(number) / per_folder).cast("string"), F.lit("/"), name)
    rows = df.select(name.alias("n"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))

    def run(part):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        made = set()
        for r in part:
            path = f"{base}/{r.n}.json"
            if (own := path.rpartition("/")[0]) not in made:
                store.create_dir(own, recursive=True)
                made.add(own)
            with store.open_output_stream(path) as out:
                out.write(json.dumps(json.loads(r.j), indent=2).encode())

    rows.foreachPartition(run)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    write_text(spark, json.dumps(document, indent=2), path)


def filtering_summary(balanced: DataFrame, settings: Settings = DEFAULT) -> dict:
    """Totals, distributions and the configuration of the filtering stage."""
    rows = balanced.groupBy("decision", "category", "confidence").count().collect()  # at most 8 x 4 rows

    def by(field: str) -> dict:
        out: dict[str, int] = {}
        for r in rows:
            out[r[field]] = out.get(r[field], 0) + r["count"]
        return out

    return {
        "total_samples": sum(r["count"] for r in rows),
        "speak_samples": by("decision").get("SPEAK", 0),
        "silent_samples": by("decision").get("SILENT", 0),
        "category_distribution": by("category"),
        "confidence_distribution": by("confidence"),
        "filtering_config": {
            "speak_ratio": settings.speak_ratio,
            "max_category_ratio": settings.category_ratio,
            "min_text_length": settings.min_text_length,
            "deduplication": f"text + context ({settings.signature_context} turns) + label",
        },
    }


def example_report(examples: DataFrame) -> str:
    """A text report of a few samples of each category (rows with rank)."""
    # The report's layout and headings.
    rule = "=" * 70
    found: dict[str, list] = {}
    for r in examples.orderBy("category", "rank").collect():
        found.setdefault(r.category, []).append(r)
    out = [rule, "TRAINING DATASET EXAMPLE SAMPLES", rule, ""]
    for key, name in CATEGORIES.items():
        out += ["", rule, f"{key}: {name}", rule, ""]
        if key not in found:
            out.append("No samples in this category.")
        for k, r in enumerate(found.get(key, []), 1):
            out += [f"Example {k}:", "-" * 70, f"Sample ID: {r.sample_id}", f"Meeting: {r.meeting_id}", f"Target Speaker: {r.target_speaker}"]
            out += ["", "Context:", r.context, "", "Current Turn:", r.current_turn, ""]
            out += [f"Decision: {r.decision}", f"Confidence: {r.confidence}", f"Reason: {r.reason}", ""]
    return "\n".join(out) + "\n"


def object_keys(local_dir: str, prefix: str = "") -> Iterator[tuple[str, str]]:
    """(file, key) for every file under a folder; ValueError if it isn't one."""
    if not os.path.isdir(local_dir):
        raise ValueError(f"not a directory: {local_dir}")
    prefix = prefix.strip("/")
    for base, _, names in sorted(os.walk(local_dir)):
        for name in sorted(names):
            path = os.path.join(base, name)
            relative = PurePosixPath(Path(path).relative_to(local_dir).as_posix())
            yield path, f"{prefix}/{relative}" if prefix else str(relative)


def upload(spark: SparkSession, local_dir: str, store: str, prefix: str = "") -> list[str]:
    """Copies a folder of the driver's machine, which tasks can't see, to a Hadoop file system (``s3a://bucket``) and returns the keys.

    One file after another; failed ones are skipped with a warning. Folders that all machines see are for ``copy_tree``.
    """
    import warnings

    jvm, done = spark.sparkContext._jvm, []
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    for local, key in object_keys(local_dir, prefix):
        try:
            to = path(f"{store.rstrip('/')}/{key}")
            to.getFileSystem(conf).copyFromLocalFile(False, True, path(f"file://{os.path.abspath(local)}"), to)
            done.append(key)
        except Exception as e:  # one file's failure leaves the others
            warnings.warn(f"{local}: {e}", stacklevel=2)
    return done


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


#: What is known of every copied file; error is null where it went well.
MANIFEST = "key string, bytes long, modified long, sha256 string, error string"


def listed(spark: SparkSession, source: str) -> DataFrame:
    """(path, bytes, modified) of all files under a folder that all machines see, relative to it; hidden ones too. ValueError if it isn't one.

    The driver lists the folder's own entries; tasks list what is under its subfolders.
    """
    from pyarrow import fs

    store, base = _opened(source)
    if store.get_file_info(base).type != fs.FileType.Directory:
        raise ValueError(f"not a directory: {source}")
    below = [i.base_name for i in store.get_file_info(fs.FileSelector(base))]
    tops = spark.createDataFrame([(n,) for n in below], "name string").repartition(max(1, min(len(below), 1000)))

    def run(frames):
        import pandas as pd

        at, root = _opened(source)
        for frame in frames:
            for name in frame["name"]:
                own = at.get_file_info(f"{root}/{name}")
                found = [own] if own.type == fs.FileType.File else [i for i in at.get_file_info(fs.FileSelector(own.path, recursive=True)) if i.type == fs.FileType.File]
                yield pd.DataFrame({"path": [i.path[len(root) :].lstrip("/") for i in found], "bytes": [i.size for i in found], "modified": [i.mtime_ns or 0 for i in found]})

    return tops.mapInPandas(run, "path string, bytes long, modified long")


def copy_tree(spark: SparkSession, source: str, store: str, manifest: str, prefix: str = "", tasks: int = 64) -> DataFrame:
    """Copies all files under ``source`` to ``store`` by tasks and returns the manifest's rows for them.

    Keys are prefix and relative path. A file goes to a name of its own first and is then renamed, so a key holds a whole file or none, and a
    task that is run again puts the same bytes in place. The manifest (Parquet, added to by every run) says what is there: files that it has with the same
    size and time aren't copied again. A file that can't be copied has its error there and is tried by the next run; the others go on.
    """
    start = prefix.strip("/")
    files = listed(spark, source).withColumn("key", F.concat(F.lit(f"{start}/" if start else ""), "path"))
    at = spark._jvm.org.apache.hadoop.fs.Path(manifest)
    known = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if known:
        done = spark.read.schema(MANIFEST).parquet(manifest).where("error IS NULL").select("key", "bytes", "modified")
        files = files.join(done, ["key", "bytes", "modified"], "left_anti")

    def run(frames):
        import hashlib

        import pandas as pd

        (own, base), (to, out) = _opened(source), _opened(store)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                target, error, digest = f"{out}/{r.key}", None, hashlib.sha256()
                part = f"{target}.{uuid.uuid4().hex}.part"
                try:
                    to.create_dir(target.rpartition("/")[0], recursive=True)
                    with own.open_input_stream(f"{base}/{r.path}") as given, to.open_output_stream(part) as taken:
                        while block := given.read(1 << 20):
                            digest.update(block)
                            taken.write(block)
                    to.move(part, target)
                except Exception as e:  # one file's failure leaves the others
                    error = str(e)
                rows.append((r.key, r.bytes, r.modified, None if error else digest.hexdigest(), error))
            yield pd.DataFrame(rows, columns=["key", "bytes", "modified", "sha256", "error"])

    files.repartition(tasks, "key").mapInPandas(run, MANIFEST).write.mode("append").parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def size_report(spark: SparkSession, path: str, rows: int) -> tuple[int, float | None]:
    """Bytes under a path of any Hadoop file system, and bytes per row (None without rows)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return size, size / rows if rows else None
