"""Text predicates as columns, with Unicode word and space classes.

Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII; the classes here hold the letters, numbers and
white space of all scripts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x1c-\x1f\x85\p{Z}"
#: Utterances that are filler, without case, around white space.
FILLERS = (
    r"mm+\s*[-.]?\s*hm+\s*\.?",
    r"uh+\s*[-.]?\s*huh+\s*\.?",
    r"um+\s*\.?",
    r"uh+\s*\.?",
    r"er+\s*\.?",
    r"ah+\s*\.?",
    r"oh+\s*\.?",
    r"hm+\s*\.?",
    r"\.",
)
#: Words that leave a sentence open.
HESITATIONS = ("...", "um", "uh", "hmm")


def filler_pattern() -> str:
    return "^(?:" + "|".join(FILLERS).replace(r"\s", f"[{SPACE}]") + ")$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda x: x != "")


def words_only(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{WORD}{SPACE}]", "")


def normalize(c: Column) -> Column:
    return F.array_join(tokens(words_only(F.lower(c))), " ")


def is_filler(c: Column) -> Column:
    return F.lower(strip(c)).rlike(filler_pattern())


def is_low_quality(c: Column, min_length: int = 3, min_share: float = 0.5) -> Column:
    """Empty, filler, too short without marks, or mostly marks. A null text is low quality."""
    kept = words_only(c)
    low = (strip(c) == "") | is_filler(c) | (F.length(strip(kept)) < min_length) | (F.length(kept) < F.lit(float(min_share)) * F.length(c))
    return F.coalesce(low, F.lit(True))


def mentions(text: Column, target: Column) -> Column:
    """Whether a speaker is named: as a word of its own, or after or before certain words."""
    low, name = F.lower(text), F.lower(target)
    as_word = F.array_contains(F.split(low, f"[^{WORD}]+"), name)
    odd = F.rlike(low, F.concat(F.lit(f"(^|[^{WORD}])"), name, F.lit(f"([^{WORD}]|$)")))
    alone = F.when(name.rlike(f"^[{WORD}]+$"), as_word).otherwise(odd)
    near = [low.contains(F.concat(F.lit(a), name, F.lit(b))) for a, b in (("speaker ", ""), ("", " said"), ("tell ", ""), ("ask ", ""))]
    return alone | near[0] | near[1] | near[2] | near[3]


def is_incomplete(text: Column) -> Column:
    own = strip(text)
    words = tokens(own)
    last = F.transform(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), F.lit(2)), F.lower)
    return own.endswith("...") | (F.size(words) <= 2) | F.arrays_overlap(last, F.array(*map(F.lit, HESITATIONS)))


def speaker_lines(turns: Column) -> Column:
    """Turns as lines, or the placeholder where there are none."""
    from colloq.config import NO_CONTEXT

    lines = F.array_join(F.transform(turns, lambda t: F.concat(F.lit("Speaker "), t["speaker"], F.lit(": "), t["text"])), "\n")
    return F.when(F.size(turns) > 0, lines).otherwise(F.lit(NO_CONTEXT))
