"""Every constant of the pipeline, with the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

#: Category codes and names, in report order.
CATEGORIES = {
    "I1": "Direct address",
    "I2": "Context follow-up",
    "I3": "Implicit redirect",
    "S1": "No reference",
    "S2": "Mentioned but not addressed",
    "S3": "Context shifted away",
    "S4": "Incomplete sentence",
    "S5": "Explicit context switch",
}
DECISIONS = ("SPEAK", "SILENT")
CONFIDENCES = ("high", "medium", "low")
#: Where a sequence came from.
EXPLICIT_SOURCE = "explicit"
INFERRED_SOURCE = "gemini_inferred"
NO_CONTEXT = "(No previous context)"
NO_REASON = "No explanation provided"


@dataclass(frozen=True)
class Settings:
    context_turns: int = 10
    response_horizon: int = 19
    meeting_limit: int | None = 10
    min_confidence: int = 6
    stride: int = 1
    samples_per_meeting: int | None = None
    max_turns: int | None = None
    recent_speak: int = 3
    recent_silent: int = 2
    signature_context: int = 3
    min_text_length: int = 3
    min_word_share: float = 0.5
    speak_ratio: float = 0.5
    category_ratio: float = 0.35
    max_samples: int | None = None
    examples: int = 5


DEFAULT = Settings()
