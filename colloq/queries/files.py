"""Queries over what sinks have written and sources read back, and over reports and model calls."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.config import CONFIDENCES, DEFAULT, DECISIONS
from colloq.operators import balance as B
from colloq.operators import formatting as FM
from colloq.operators import inference as I
from colloq.operators import sequences as Q
from colloq.operators import stats as S
from colloq.plans import pipeline as P
from colloq.plans.tables import fresh, kept
from colloq.queries import engine as E
from colloq.sources import corpus, export, files, report, sinks


def _folder(spark: SparkSession) -> str:
    return fresh(spark, "files")


def _corpus(spark, d) -> str:
    folder = _folder(spark)
    export.write_corpus(E.acts(spark, d), folder)
    return folder


def xml_meeting_speakers(spark, d):
    return corpus.meeting_speakers(spark, _corpus(spark, d))


def xml_words(spark, d):
    return corpus.words(spark, _corpus(spark, d))


def xml_act_refs(spark, d):
    return corpus.act_refs(spark, _corpus(spark, d)).withColumn("refs", F.array_join("refs", " "))


def xml_discovery(spark, d):
    return corpus.annotated_meetings(corpus.act_refs(spark, _corpus(spark, d)), DEFAULT.meeting_limit)


def xml_acts(spark, d):
    rows = P.corpus_acts(spark, _corpus(spark, d), replace(DEFAULT, meeting_limit=None))
    return rows.select("meeting_id", "idx", "speaker", F.array_join("addressee", ",").alias("addressee"), "text", "starttime", "endtime", "has_explicit_addressee")


def json_lines_sequences(spark, d):
    path = f"{_folder(spark)}/lines"
    sinks.write_lines(E.sequences(spark, d), path, "meeting_id", "sequence_id")
    return E._flat_sequences(files.read_lines(spark, path, files.SEQUENCES))


def json_array_sequences(spark, d):
    path = f"{_folder(spark)}/array.json"
    sinks.write_array(E.sequences(spark, d), path)
    return E._flat_sequences(files.read_array(spark, path, files.SEQUENCES))


def json_dispatch(spark, d):
    """The same sequences by either reader, as the name of the file says."""
    folder, found = _folder(spark), E.sequences(spark, d)
    sinks.write_array(found, f"{folder}/a.json")
    sinks.write_lines(found, f"{folder}/b.jsonl")
    count = lambda name: files.read(spark, f"{folder}/{name}", files.SEQUENCES).groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n")).withColumn("form", F.lit(name))
    return count("a.json").unionByName(count("b.jsonl"))


def file_per_sample(spark, d):
    folder = f"{_folder(spark)}/each"
    sinks.write_each(E._final(spark, d), folder, per_folder=1000)
    return files.read_each(spark, folder, files.INTERMEDIATE).select("sample_id", "decision_point_id", "decision", "category")


def summary_document(spark, d):
    path = f"{_folder(spark)}/summary.json"
    sinks.write_document(spark, sinks.filtering_summary(E._final(spark, d)), path)
    schema = "total_samples long, speak_samples long, silent_samples long, category_distribution map<string,long>, confidence_distribution map<string,long>, filtering_config map<string,string>"
    r = files.read_array(spark, path, schema)
    one = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("total_samples", "speak_samples", "silent_samples")]
    maps = [F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value"))) for c in ("category_distribution", "confidence_distribution", "filtering_config")]
    return r.select(F.explode(F.concat(F.array(*one), *maps)).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def statistics_document(spark, d):
    path = f"{_folder(spark)}/statistics.json"
    report.write_statistics(kept(E._flat(spark, d), "flat"), path)
    schema = (
        "dataset_overview struct<total_samples:long,unique_meetings:long,unique_sequences:long,unique_speakers:long>, decision_distribution struct<SPEAK:long,SILENT:long>, "
        "category_distribution map<string,struct<count:long>>, duplicate_analysis struct<unique_decision_points:long,unique_context_current_pairs:long>, samples_per_meeting map<string,long>"
    )
    r = files.read_array(spark, path, schema)
    fields = ("dataset_overview.total_samples", "dataset_overview.unique_meetings", "dataset_overview.unique_sequences", "dataset_overview.unique_speakers", "decision_distribution.SPEAK",
              "decision_distribution.SILENT", "duplicate_analysis.unique_decision_points", "duplicate_analysis.unique_context_current_pairs")
    one = [F.struct(F.lit(c.split(".")[1]).alias("key"), F.col(c).alias("value")) for c in fields]
    named = F.transform(F.map_entries("category_distribution"), lambda e: F.struct(e["key"].alias("key"), e["value"]["count"].alias("value")))
    return r.select(F.explode(F.concat(F.array(*one), named, F.map_entries("samples_per_meeting"))).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def statistics_figures(spark, d):
    """What the statistics document holds beside its counts: shares, grids, extents, and its lists in order."""
    path = f"{_folder(spark)}/statistics.json"
    report.write_statistics(kept(E._flat(spark, d), "flat"), path)
    grid = "struct<high:double,medium:double,low:double>"
    share = "struct<count:double,percentage:double>"
    schema = (
        "dataset_overview struct<samples_per_sequence:double,meetings:array<string>,speakers:array<string>>, "
        "decision_distribution struct<speak_percentage:double,silent_percentage:double,silent_to_speak_ratio:double>, "
        "category_distribution map<string,struct<percentage:double,name:string>>, "
        f"confidence_distribution struct<overall:struct<high:{share},medium:{share},low:{share}>,by_decision:struct<SPEAK:{grid},SILENT:{grid}>>, "
        "context_statistics struct<average_turns:double,min_turns:double,max_turns:double,samples_with_no_context:double>, "
        "duplicate_analysis struct<duplicate_decision_points:double,duplicate_context_current_pairs:double>"
    )
    r = files.read_array(spark, path, schema)
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.col(value).alias("value"))
    own = [pair(c.split(".")[1], c) for c in (
        "dataset_overview.samples_per_sequence", "decision_distribution.speak_percentage", "decision_distribution.silent_percentage", "decision_distribution.silent_to_speak_ratio",
        "context_statistics.average_turns", "context_statistics.min_turns", "context_statistics.max_turns", "context_statistics.samples_with_no_context",
        "duplicate_analysis.duplicate_decision_points", "duplicate_analysis.duplicate_context_current_pairs",
    )]
    for k in CONFIDENCES:
        own += [pair(f"overall {k}", f"confidence_distribution.overall.{k}.count"), pair(f"overall percentage {k}", f"confidence_distribution.overall.{k}.percentage")]
        own += [pair(f"{x} {k}", f"confidence_distribution.by_decision.{x}.{k}") for x in DECISIONS]
    named = F.transform(F.map_entries("category_distribution"), lambda e: F.struct(F.concat(F.lit("percentage "), e["key"], F.lit(" "), e["value"]["name"]).alias("key"), e["value"]["percentage"].alias("value")))
    placed = lambda c: F.transform(f"dataset_overview.{c}s", lambda x, i: F.struct(F.concat(F.lit(f"{c} "), x).alias("key"), (i + 1).cast("double").alias("value")))
    lists = [placed("meeting"), placed("speaker")]
    return r.select(F.explode(F.concat(F.array(*own), named, *lists)).alias("e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def example_bodies(spark, d):
    """Every example of the report, whole: its heading, context, turn and labels."""
    path = f"{_folder(spark)}/sample_examples.txt"
    sinks.write_text(spark, sinks.example_report(S.stratified_examples(E._flat(spark, d))), path)
    body = F.explode(F.split("value", r"\n(?=Example [0-9]+:\n-{70}\n)"))
    rows = spark.read.text(path, wholetext=True).select(body.alias("body")).where(F.col("body").startswith("Example "))
    # What follows the reason of a category's last example is the next heading.
    whole = F.regexp_extract("body", r"(?s)^(.*?\nReason: [^\n]*)", 1)
    return rows.select(F.regexp_extract("body", r"\nSample ID: ([0-9]+)\n", 1).cast("long").alias("sample_id"), F.md5(whole.cast("binary")).alias("body"))


def example_lines(spark, d):
    """Lines of the report that say what a sample is, with how often each comes."""
    path = f"{_folder(spark)}/sample_examples.txt"
    sinks.write_text(spark, sinks.example_report(S.stratified_examples(E._flat(spark, d))), path)
    rows = spark.read.text(path).where(F.col("value").rlike("^(Sample ID|Meeting|Target Speaker|Decision|Confidence|Reason|Example [0-9]+|[IS][0-9]): |^Example [0-9]+:$"))
    return rows.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def uploaded_objects(spark, d):
    folder = _folder(spark)
    local, store = f"{folder}/local", f"{folder}/store"
    found = E._final(spark, d).groupBy("decision").count().orderBy("decision").collect()
    sinks.write_document(spark, {r.decision: r["count"] for r in found}, f"{local}/summary.json")
    for r in found:
        sinks.write_text(spark, f"{r['count']}\n", f"{local}/counts/{r.decision}.txt")
    sinks.copy_tree(spark, local, store, f"{folder}/manifest", "/run/1/", tasks=4)
    rows = spark.read.text(f"{store}/run/1/counts/*.txt").select(F.regexp_extract("_metadata.file_path", "(run/1/.*)$", 1).alias("key"), F.col("value").cast("long").alias("n"))
    total = files.read_array(spark, f"{store}/run/1/summary.json", ", ".join(f"{k} long" for k in DECISIONS)).select(F.lit("run/1/summary.json").alias("key"), sum((F.col(k) for k in DECISIONS), F.lit(0)).cast("long").alias("n"))
    return rows.unionByName(total)


def size_metrics(spark, d):
    path, rows = f"{_folder(spark)}/text", FM.training_text(E._flat(spark, d)).select("text")
    rows.write.text(path)
    # Texts have several lines; each begins with the same tag.
    n = spark.read.text(path).where(F.col("value").startswith("<|system|>")).count()
    size, each = sinks.size_report(spark, path, n)
    return spark.createDataFrame([(size, n, each)], "bytes long, samples long, bytes_per_sample double")


def merge_head(spark, d):
    """The first of all sequences by meeting and id, compared as text."""
    rows = E._merged(spark, d).limit(12)
    return rows.select("meeting_id", "sequence_id", "source", F.col("addressing_turn.text").alias("text"))


def one_meeting(spark, d):
    found = E.sequences(spark, d)
    first = found.agg(F.min("meeting_id")).first()[0]
    return E._flat_sequences(I.only_meeting(found, first))


def _balanced(spark, d) -> DataFrame:
    return B.balanced(E.unique_samples(spark, d))


def filtered_examples(spark, d):
    return FM.first_examples(_balanced(spark, d))


def balanced_confidence(spark, d):
    return B.confidence_share(_balanced(spark, d))


def first_of_class(spark, d):
    flat = E._flat(spark, d)
    rows = [FM.first_of_class(flat, k).select("decision", "sample_id") for k in DECISIONS]
    texts = FM.training_text(flat.join(rows[0].unionByName(rows[1]).select("sample_id"), "sample_id", "left_semi"))
    return texts.select("sample_id", F.md5(F.col("text").cast("binary")).alias("text"))


NAMES = (
    "xml_meeting_speakers xml_words xml_act_refs xml_discovery xml_acts json_lines_sequences json_array_sequences json_dispatch file_per_sample summary_document "
    "statistics_document statistics_figures example_lines example_bodies uploaded_objects size_metrics merge_head one_meeting filtered_examples balanced_confidence first_of_class"
).split()
E.QUERIES.update({name: globals()[name] for name in NAMES})
