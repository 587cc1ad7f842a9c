"""Samples as flat rows and as training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.functions.text import speaker_lines

#: Fixed value: what a model is told first.
SYSTEM_PROMPT = """You are a turn-taking decision model for a voice AI agent. Your job is to decide whether the AI agent should START TALKING or STAY SILENT after a detected pause in conversation.

You will receive:
1. An instruction telling you which speaker role the AI agent plays
2. The previous conversation context with speaker-labeled transcript
3. The current line: the most recent utterance before the pause

RULES FOR DECIDING:

STAY SILENT when:
- The current speaker is talking to someone else, not the AI agent
- The AI agent's name/role has not been referenced or addressed
- The speaker is mid-thought, brainstorming, or thinking aloud
- The sentence is clearly incomplete
- The conversation is between other participants
- Someone mentions the AI agent in passing but not requesting response

START TALKING when:
- The speaker directly addresses the AI agent by name/role
- The speaker asked the AI agent something and this is a follow-up
- The context makes it unambiguous the speaker is waiting for AI response
- The speaker redirects the conversation to the AI agent

IMPORTANT: When uncertain, prefer SILENT

Output your decision in this exact format:
<decision>SILENT or SPEAK</decision>
<confidence>high, medium, or low</confidence>
<reason>one line explanation</reason>"""
#: The instruction around the target speaker.
INSTRUCTION = ("You are playing the role of Speaker ", ". Decide if you should SPEAK or stay SILENT after the current utterance.")
INTERMEDIATE = ("sample_id", "decision_point_id", "meeting_id", "sequence_id", "target_speaker", "all_speakers", "context", "current_turn", "decision", "confidence", "reason", "category")


def _current() -> Column:
    return F.concat(F.lit("Speaker "), F.col("current_turn.speaker"), F.lit(": "), F.col("current_turn.text"))


def intermediate(samples: DataFrame) -> DataFrame:
    """Twelve flat columns; samples have sample_id."""
    return samples.withColumn("context", speaker_lines(F.col("context_turns"))).withColumn("current_turn", _current()).select(*INTERMEDIATE)


def training_text(flat: DataFrame) -> DataFrame:
    """(sample_id, text) of intermediate rows."""

    def tag(name: str, *inner: Column) -> list[Column]:
        return [F.lit(f"<|{name}|>"), *inner, F.lit(f"<|/{name}|>\n")]

    text = F.concat(
        *tag("system", F.lit(SYSTEM_PROMPT)),
        *tag("instruction", F.lit(INSTRUCTION[0]), F.col("target_speaker"), F.lit(INSTRUCTION[1])),
        *tag("context", F.col("context")),
        *tag("current", F.col("current_turn")),
        F.lit("<decision>"), F.col("decision"), F.lit("</decision>\n<confidence>"), F.col("confidence"),
        F.lit("</confidence>\n<reason>"), F.col("reason"), F.lit("</reason>"),
    )
    return flat.select("sample_id", text.alias("text"))


def first_of_class(flat: DataFrame, decision: str) -> DataFrame:
    """The first sample of a class; no row if there is none."""
    return flat.where(F.col("decision") == decision).orderBy("sample_id").limit(1)


def first_examples(samples: DataFrame, n: int = 5, chars: int = 100) -> DataFrame:
    """The first numbered samples as a console shows them: labels, and the start of the turn behind its speaker."""
    line = F.concat(F.lit("["), "current_turn.speaker", F.lit("] "), F.substring("current_turn.text", 1, chars), F.lit("..."))
    return samples.orderBy("sample_id").limit(n).select("sample_id", "decision", "category", "confidence", line.alias("line"))
