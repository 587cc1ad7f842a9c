"""Addressees from a model's replies: prompts, a pluggable provider, the reply parser.

No provider calls a network. ``replay`` joins stored replies; ``call`` runs any
provider in ``mapInPandas``, with a pause after every few calls of a task; ``ask_missing`` keeps replies in a
store by digest of the prompt, so that runs can be stopped and taken up again, and ``answered`` reads them from there.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.config import DEFAULT, NO_REASON, Settings
from colloq.functions.text import is_low_quality, speaker_lines
from colloq.operators.timeline import context_window, indexed, with_speakers

#: Fixed value: what a model is asked, with {speakers}, {context}, {speaker} and {text} to fill in.
PROMPT = """You are analyzing a multi-party meeting conversation to determine who is being addressed.

SPEAKERS IN MEETING: {speakers}

PREVIOUS CONVERSATION:
{context}

CURRENT UTTERANCE:
Speaker {speaker}: "{text}"

TASK: Determine who Speaker {speaker} is addressing in the current utterance.

RULES:
- Reply "ALL" if addressing everyone in the meeting
- Reply "NONE" if unclear, rhetorical, or talking to self/thinking aloud
- Otherwise list specific speaker letter(s) separated by commas (e.g., "A" or "A,B,C")
- Consider: name mentions, questions, previous conversation flow, context

OUTPUT FORMAT (must follow exactly):
ADDRESSEES: [speaker letters or ALL or NONE]
CONFIDENCE: [0-10, where 0=completely unsure, 10=absolutely certain]
REASON: [one sentence explaining why you chose these addressees]

EXAMPLES:

Example 1:
ADDRESSEES: A
CONFIDENCE: 9
REASON: Direct name mention and direct question to specific person.

Example 2:
ADDRESSEES: B,C
CONFIDENCE: 7
REASON: Uses "you both" referring to the two people who just spoke.

Example 3:
ADDRESSEES: ALL
CONFIDENCE: 8
REASON: Uses "everyone" and asks a general group question.

Example 4:
ADDRESSEES: NONE
CONFIDENCE: 6
REASON: Appears to be thinking aloud, no clear addressee indicated.

YOUR ANSWER:"""
#: How a model is to be called, and what a call is taken to cost.
MODEL_OPTIONS = {"temperature": 0, "top_p": 0.8, "top_k": 20, "max_output_tokens": 500}
CALLS_PER_PAUSE, PAUSE_SECONDS = 10, 1.0
TOKENS_IN, TOKENS_OUT, PRICE_IN, PRICE_OUT = 650, 50, 0.00001875, 0.000075


def unaddressed(acts: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The timeline of acts without addressees that are worth asking about, numbered anew.

    ``stride`` keeps every so many of them, then at most so many of a meeting stay;
    a limit of turns of 0 or None is none.
    """
    rows = indexed(acts.where(~F.col("has_explicit_addressee") & ~is_low_quality(F.col("text"), settings.min_text_length, settings.min_word_share)).drop("idx"))
    if settings.stride > 1:
        rows = rows.where(F.col("idx") % settings.stride == 0).withColumn("idx", (F.col("idx") / settings.stride).cast("int"))
    if settings.samples_per_meeting is not None:
        rows = rows.where(F.col("idx") < settings.samples_per_meeting)
    if settings.max_turns:
        rows = rows.where(F.col("idx") < settings.max_turns)
    return rows


def prompts(acts: DataFrame, speakers: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(meeting_id, idx, dact_id, all_speakers, prompt) for a timeline of unaddressed acts."""
    rows = with_speakers(context_window(acts, settings.context_turns), speakers)
    fill = {"speakers": F.array_join(F.array_sort("all_speakers"), ", "), "context": speaker_lines(F.col("context")), "speaker": F.col("speaker"), "text": F.col("text")}
    parts: list[Column] = []
    rest = PROMPT
    while rest:
        cut = min(((rest.find("{" + k + "}"), k) for k in fill if "{" + k + "}" in rest), default=(len(rest), ""))
        parts.append(F.lit(rest[: cut[0]]))
        if cut[1]:
            parts.append(fill[cut[1]])
        rest = rest[cut[0] + len(cut[1]) + 2 :] if cut[1] else ""
    return rows.select("meeting_id", "idx", "dact_id", "all_speakers", F.concat(*parts).alias("prompt"))


def replay(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds reply from stored (dact_id, reply); acts without one are skipped."""
    return asked.join(stored.select("dact_id", "reply"), "dact_id").where("reply IS NOT NULL")


def client(generate: Callable[..., str | None], options: dict = MODEL_OPTIONS) -> Callable[[str], str | None]:
    """A provider that asks ``generate(prompt, **options)``."""
    return lambda prompt: generate(prompt, **options)


def call(asked: DataFrame, provider: Callable[[str], str | None], per_pause: int = CALLS_PER_PAUSE, pause: float = 0.0) -> DataFrame:
    """Adds reply from ``provider(prompt)``; a call that fails or gives None skips its row.

    With ``pause`` (``PAUSE_SECONDS`` is usual) a task rests that many seconds after every ``per_pause`` answered calls.
    """
    names = asked.columns

    def run(frames):
        done = 0
        for frame in frames:
            replies = []
            for prompt in frame["prompt"]:
                try:
                    replies.append(provider(prompt))
                except Exception:  # one failed call loses one row
                    replies.append(None)
                done += replies[-1] is not None
                if pause and replies[-1] is not None and done % per_pause == 0:
                    time.sleep(pause)
            yield frame.assign(reply=replies)[[*names, "reply"]]

    from pyspark.sql import types as T

    return asked.mapInPandas(run, T.StructType([*asked.schema.fields, T.StructField("reply", T.StringType())])).where("reply IS NOT NULL")


#: What a store of replies holds.
REPLIES = "digest string, reply string"


def digest(prompt: Column) -> Column:
    return F.sha2(prompt.cast("binary"), 256)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """(digest, reply) of a store, one for each digest; none if it isn't there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], REPLIES)
    rows = spark.read.schema(REPLIES).option("recursiveFileLookup", "true").parquet(store)
    return rows.groupBy("digest").agg(F.min("reply").alias("reply"))


def ask_missing(asked: DataFrame, provider: Callable[[str], str | None], store: str, per_pause: int = CALLS_PER_PAUSE, pause: float = PAUSE_SECONDS, callers: int = 4) -> None:
    """Asks for the prompts that a store has no reply to, each different one once, and puts the replies there.

    A task writes its replies every ``per_pause`` answers, under a name that readers see only when the file is whole, so a run that is stopped loses
    at most that many of each task and the next one asks for the rest. A call that fails or gives None isn't stored, and is
    made again by the next run. There are ``callers`` tasks at most, and each rests ``callers`` times as long, so all of them together make no
    more than ``per_pause`` calls in ``pause`` seconds.
    """
    prompts = asked.select(digest(F.col("prompt")).alias("digest"), "prompt").where("prompt IS NOT NULL").dropDuplicates(["digest"])
    missing = prompts.join(stored(asked.sparkSession, store), "digest", "left_anti").repartition(callers, "digest")

    def run(rows):
        from pyarrow import Table, fs, parquet

        to, base = fs.FileSystem.from_uri(store if "://" in store else f"file://{os.path.abspath(store)}")
        to.create_dir(base, recursive=True)
        answers: list[tuple[str, str]] = []

        def put():
            name = uuid.uuid4().hex
            table = Table.from_pydict({"digest": [d for d, _ in answers], "reply": [r for _, r in answers]})
            with to.open_output_stream(f"{base}/_{name}") as out:
                parquet.write_table(table, out)
            to.move(f"{base}/_{name}", f"{base}/{name}.parquet")
            answers.clear()

        for r in rows:
            try:
                reply = provider(r.prompt)
            except Exception:  # one failed call loses one prompt
                reply = None
            if reply is None:
                continue
            answers.append((r.digest, reply))
            if len(answers) == per_pause:
                put()
                if pause:
                    time.sleep(pause * callers)
        if answers:
            put()

    missing.foreachPartition(run)


def answered(asked: DataFrame, store: str) -> DataFrame:
    """Adds reply from a store; rows whose prompt has none are skipped."""
    return asked.withColumn("digest", digest(F.col("prompt"))).join(stored(asked.sparkSession, store), "digest").drop("digest")


def parsed(rows: DataFrame) -> DataFrame:
    """Adds addressee, confidence and reason to rows with reply and all_speakers."""
    # Python's \s holds all white space and its dot stops at a line feed only.
    space = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
    field = lambda name, what: F.regexp_extract("reply", rf"(?i){name}:{space}*({what})", 1)
    said = F.upper(F.regexp_replace(field("ADDRESSEES", r"[^\n]+"), rf"^{space}+|{space}+\z", ""))
    listed = F.filter(F.split(F.regexp_replace(said, "[^A-Z,]", ""), ","), lambda x: F.array_contains("all_speakers", x))
    addressee = F.when(said.isin("", "NONE"), F.array().cast("array<string>")).when(said == "ALL", F.col("all_speakers")).otherwise(listed)
    number = F.expr(rf"try_cast(nullif(regexp_extract(reply, '(?i)CONFIDENCE:[\\t-\\r\\x1c-\\x1f\\x85\\p{{Z}}]*([0-9]+)', 1), '') AS decimal(38, 0))")
    digits = field("CONFIDENCE", "[0-9]+")
    confidence = F.when(digits == "", 0).otherwise(F.least(F.lit(10), F.coalesce(number, F.lit(10)))).cast("int")
    why = F.regexp_replace(field("REASON", r"[^\n]+"), rf"^{space}+|{space}+\z", "")
    return rows.withColumn("addressee", addressee).withColumn("confidence", confidence).withColumn("reason", F.when(why == "", F.lit(NO_REASON)).otherwise(why))


def call_cost(calls: Column) -> Column:
    """What so many calls are taken to cost."""
    return calls * TOKENS_IN / 1000 * PRICE_IN + calls * TOKENS_OUT / 1000 * PRICE_OUT


def only_meeting(sequences: DataFrame, meeting_id: str) -> DataFrame:
    """The sequences of one meeting; ValueError if it has none."""
    rows = sequences.where(F.col("meeting_id") == meeting_id)
    if not rows.limit(1).count():
        raise ValueError(f"unknown meeting: {meeting_id}")
    return rows
