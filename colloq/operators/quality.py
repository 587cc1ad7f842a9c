"""Low-quality samples go, and of samples that read alike the best stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloq.config import DEFAULT, Settings
from colloq.functions.text import is_low_quality, normalize
from colloq.operators.labels import POSITION


def confidence_score(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def filtered(samples: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return samples.where(~is_low_quality(F.col("current_turn.text"), settings.min_text_length, settings.min_word_share))


def signature(context: int = 3, normal: bool = False) -> Column:
    """Normalised text, the last turns and the decision; neither target nor meeting. With ``normal`` texts were normalised before (``recent_points``)."""
    turns = F.col("normal_before" if normal else "context_turns")
    last = F.slice(turns, F.greatest(F.lit(1), F.size(turns) - context + 1), F.lit(context))
    lines = F.array_join(F.transform(last, lambda t: F.concat(t["speaker"], F.lit(":"), t["normal"] if normal else normalize(t["text"]))), "|")
    return F.concat_ws(":::", F.col("normal") if normal else normalize(F.col("current_turn.text")), lines, F.col("decision"))


def signature_key(context: int = 3, normal: bool = False) -> Column:
    """128 bits of the signature, which is what a shuffle carries of it."""
    return F.unhex(F.md5(signature(context, normal).cast("binary")))


def _best(samples: DataFrame, key: Column, *columns: str) -> DataFrame:
    """One row for each key: the most confident, then the first. A minimum of ordered structs, which tasks take before the shuffle."""
    order = F.struct((-confidence_score(F.col("confidence"))).alias("o"), *POSITION)
    row = F.struct(order.alias("order"), F.struct(*columns).alias("sample"))
    return samples.groupBy(key.alias("signature")).agg(F.min(row).alias("best")).select("best.sample.*")


def deduplicated(samples: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One sample for each signature: the most confident, then the first.

    A signature that a third of all samples have is one row from each task.
    """
    return _best(samples, signature_key(settings.signature_context), *samples.columns)


#: What is kept of a sample while it is compared, counted and drawn; texts are joined to the survivors.
KEYS = (*POSITION, "decision", "confidence", "category")


def unique_keys(samples: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``KEYS`` of the samples that ``deduplicated`` keeps: neither text nor context is shuffled."""
    return _best(samples, signature_key(settings.signature_context, "normal_before" in samples.columns), *KEYS)
