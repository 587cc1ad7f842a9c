"""The whole way from acts to training text, lazily composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloq.config import DEFAULT, Settings
from colloq.operators import quality as Q
from colloq.operators.balance import selected
from colloq.operators.decisions import decision_points, points_of, recent_points
from colloq.operators.formatting import intermediate, training_text
from colloq.operators.inference import answered, ask_missing, call, parsed, prompts, unaddressed
from colloq.operators.labels import POSITION, categorized, reason
from colloq.operators.quality import filtered
from colloq.operators.sequences import explicit_sequences, inferred_sequences
from colloq.operators.timeline import in_meetings, indexed
from colloq.operators.words import assembled
from colloq.plans.tables import kept
from colloq.sources import corpus


def corpus_acts(spark: SparkSession, folder: str, settings: Settings = DEFAULT, charset: str = "UTF-8") -> DataFrame:
    """Indexed acts of the meetings that are worth reading. Files of acts are parsed once, into a table, as three steps ask for them."""
    refs = kept(corpus.act_refs(spark, folder, charset).repartition("meeting_id", "speaker", "doc_order"), "acts")
    refs = in_meetings(refs, corpus.annotated_meetings(refs, settings.meeting_limit))
    return indexed(assembled(refs, corpus.words(spark, folder)))


def sequences(
    acts: DataFrame,
    speakers: DataFrame | None = None,
    provider: Callable[[str], str | None] | None = None,
    settings: Settings = DEFAULT,
    pause: float = 0.0,
    store: str | None = None,
    callers: int = 4,
) -> DataFrame:
    """Explicit sequences, and inferred ones if there is a provider of replies or a store of them.

    With a store, prompts that it has a reply to aren't asked again, and new replies are kept there.
    """
    explicit = explicit_sequences(acts, settings)
    if provider is None and store is None:
        return explicit
    timeline = unaddressed(acts, settings)
    asked = prompts(timeline, speakers if speakers is not None else acts, settings)
    if store is None:
        replies = call(asked, provider, pause=pause)
    else:
        if provider is not None:
            ask_missing(asked, provider, store, pause=pause, callers=callers)
        replies = answered(asked, store)
    return explicit.unionByName(inferred_sequences(timeline, parsed(replies).select("meeting_id", "idx", "addressee", "confidence", "reason"), settings))


def samples(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Categorised decision points of sequences."""
    return categorized(decision_points(found), settings)


def unique_keys(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Keys of the good samples of sequences, one for each signature, as a table.

    Signatures and categories look at the last turns only, so no whole context is made for a sample that may go.
    """
    looked_at = max(settings.signature_context, settings.recent_speak, settings.recent_silent)
    points = categorized(recent_points(found, looked_at), settings)
    return kept(Q.unique_keys(filtered(points, settings), settings), "unique")


def with_texts(keys: DataFrame, found: DataFrame) -> DataFrame:
    """Samples as ``samples`` makes them, of keys with decision, confidence and category (and other columns); sequences are read again."""
    rows = points_of(keys, found).withColumn("reason", reason())
    more = [c for c in keys.columns if c not in Q.KEYS]
    return rows.select(*[c for c in rows.columns if c not in {*Q.KEYS, "reason", *more} or c in POSITION], "decision", "confidence", "reason", "category", *more)


def final_samples(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Filtered, deduplicated and balanced intermediate samples. Until they are drawn, samples are keys."""
    return intermediate(with_texts(selected(unique_keys(found, settings), settings), found))


def training(found: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    return training_text(final_samples(found, settings))
