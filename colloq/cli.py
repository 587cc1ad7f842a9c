"""Command line: a corpus folder or a table of conversations in, training data and reports out."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession

from colloq.config import DEFAULT
from colloq.operators import stats
from colloq.operators.formatting import training_text
from colloq.operators.inference import CALLS_PER_PAUSE, PAUSE_SECONDS, only_meeting
from colloq.operators.timeline import indexed
from colloq.plans import pipeline
from colloq.sources import conversations, corpus, report, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="colloq", description=__doc__)
    p.add_argument("--corpus", help="folder with corpusResources, words and dialogueActs")
    p.add_argument("--conversations", help="Parquet table of conversations, instead of a corpus")
    p.add_argument("--output", required=True, help="folder for results")
    p.add_argument("--meeting", help="only this meeting")
    p.add_argument("--max-turns", type=int, default=None)
    p.add_argument("--stride", type=int, default=1)
    p.add_argument("--max-samples-per-meeting", type=int, default=None)
    p.add_argument("--replies", help="Parquet table (prompt, reply) of a model's answers")
    p.add_argument("--provider", help="module:function that answers a prompt; replies are kept in --reply-store")
    p.add_argument("--reply-store", help="folder of replies that all machines see; a run that was stopped asks only for what is missing there")
    p.add_argument("--pause", type=float, default=PAUSE_SECONDS, help=f"seconds that all calls together rest after every {CALLS_PER_PAUSE}")
    p.add_argument("--callers", type=int, default=4, help="tasks that call at the same time")
    return p


def named(provider: str) -> Callable[[str], str | None]:
    """The function that ``module:function`` names."""
    module, _, name = provider.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.provider and not args.reply_store:
        raise SystemExit("--provider needs --reply-store")
    spark = SparkSession.builder.appName("colloq").getOrCreate()
    settings = replace(DEFAULT, max_turns=args.max_turns, stride=args.stride, samples_per_meeting=args.max_samples_per_meeting)
    acts = indexed(conversations.acts(spark.read.parquet(args.conversations))) if args.conversations else pipeline.corpus_acts(spark, args.corpus, settings)
    acts = acts.persist()
    speakers = corpus.meeting_speakers(spark, args.corpus) if args.corpus and (args.replies or args.reply_store) else acts
    provider = named(args.provider) if args.provider else None
    found = pipeline.sequences(acts, speakers, provider, settings, args.pause, args.reply_store, args.callers)
    if args.replies:
        timeline = pipeline.unaddressed(acts, settings)
        asked = pipeline.prompts(timeline, speakers, settings).join(spark.read.parquet(args.replies), "prompt")
        replies = pipeline.parsed(asked).select("meeting_id", "idx", "addressee", "confidence", "reason")
        found = found.unionByName(pipeline.inferred_sequences(timeline, replies, settings))
    if args.meeting:
        found = only_meeting(found, args.meeting)
    sinks.write_lines(found, f"{args.output}/sequences", "meeting_id", "sequence_id")
    flat = pipeline.final_samples(found, settings).persist()
    sinks.write_lines(flat, f"{args.output}/training_data_intermediate", "sample_id")
    sinks.write_lines(training_text(flat).orderBy("sample_id").select("text"), f"{args.output}/training_data_formatted")
    report.write_statistics(flat, f"{args.output}/data_statistics.json")
    sinks.write_document(spark, sinks.filtering_summary(flat, settings), f"{args.output}/filtering_summary.json")
    sinks.write_text(spark, sinks.example_report(stats.stratified_examples(flat, settings.examples)), f"{args.output}/sample_examples.txt")
    for frame in (acts, flat):
        frame.unpersist()


if __name__ == "__main__":
    main()
