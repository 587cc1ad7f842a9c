"""Goldens and properties of the engine's stages."""

import json

import pytest
from colloq.config import DEFAULT
from colloq.operators import balance as B
from colloq.operators import decisions as D
from colloq.operators import inference as I
from colloq.operators import labels as L
from colloq.operators import quality as U
from colloq.operators import sequences as Q
from colloq.operators import stats as S
from colloq.operators import timeline as T
from colloq.plans import pipeline as P
from colloq.plans.ranking import ranked
from colloq.queries import engine
from pyspark.sql import functions as F

from conftest import SF

ACTS = "meeting_id string, speaker string, addressee array<string>, text string, starttime double, doc_order long"


def acts(spark, rows):
    df = spark.createDataFrame([("m", s, a, t, float(k), k) for k, (s, a, t) in enumerate(rows)], ACTS)
    return T.indexed(df.withColumns({"has_explicit_addressee": F.size("addressee") > 0, "dact_id": F.col("doc_order").cast("string")}))


@pytest.mark.parametrize(
    ("available", "target", "quotas"),
    [
        ({"I1": 10, "I2": 10, "I3": 10}, 9, [3, 3, 3]),
        ({"S1": 100, "S2": 1, "S3": 1}, 20, [18, 1, 1]),
        ({"I1": 5, "I2": 3}, 0, [1, 1]),
        ({"S1": 1, "S2": 2, "S3": 2, "S4": 2, "S5": 3}, 6, [1, 1, 1, 1, 2]),
        ({"S1": 50, "S3": 30, "S2": 20}, 100, [50, 30, 20]),
        ({"S1": 2, "S2": 40, "S3": 40}, 30, [2, 18, 10]),
        ({"I1": 1, "I2": 1, "I3": 1}, 2, [1, 1, 1]),
        ({}, 5, []),
    ],
)
def test_quotas(available, target, quotas):
    assert list(B.category_quotas(available, target).values()) == quotas


def test_class_targets():
    assert B.class_targets(10, 4) == (4, 4)
    assert B.class_targets(0, 4) == (0, 0)
    assert B.class_targets(10, 10, 0.5, 6) == (3, 3)


@pytest.mark.parametrize(
    ("reply", "who", "sure", "why"),
    [
        ("ADDRESSEES: A,B\nCONFIDENCE: 8\nREASON: x", ["A", "B"], 8, "x"),
        ("addressees: [b]\nconfidence: 8.5", ["B"], 8, None),
        ("ADDRESSEES: ALL\nCONFIDENCE: 99", list("ABCD"), 10, None),
        ("ADDRESSEES: NONE\nCONFIDENCE: 6", [], 6, None),
        ("ADDRESSEES: ALL.\nCONFIDENCE: 7", [], 7, None),
        ("ADDRESSEES: A and B\nCONFIDENCE: 9", [], 9, None),
        ("ADDRESSEES: B, Z, B\nCONFIDENCE: -5", ["B", "B"], 0, None),
        ("ADDRESSEES: A\nCONFIDENCE: " + "9" * 60, ["A"], 10, None),
        ("", [], 0, None),
    ],
)
def test_reply_parser(spark, reply, who, sure, why):
    df = spark.createDataFrame([(reply, list("ABCD"))], "reply string, all_speakers array<string>")
    r = I.parsed(df).first()
    assert (r.addressee, r.confidence, r.reason) == (who, sure, why or "No explanation provided")


def scan(rows, stop_at_new=True):
    """The exchange scan, act by act."""
    out, i = [], 0
    while i < len(rows):
        speaker, to, _ = rows[i]
        r = next((k for k in range(i + 1, min(i + 20, len(rows))) if rows[k][0] in to), None) if to else None
        if r is None:
            i += 1
            continue
        inside, more = {speaker, *to}, []
        for k in range(r + 1, len(rows)):
            s, a, _ = rows[k]
            if stop_at_new and a and set(a) != set(to):
                break
            if s in inside:
                more.append(k)
            elif more:
                break
        out.append((i, r, more))
        i = r + len(more) + 1
    return out


def test_sequences_follow_the_scan(spark):
    import random

    random.seed(3)
    for _ in range(4):
        rows = [(random.choice("ABCD"), random.choice([[], [], ["B"], ["A", "B"], ["B", "A", "A"], ["C"], ["A"]]), f"t{k}") for k in range(40)]
        found = Q.explicit_sequences(acts(spark, rows)).collect()
        assert [(r.addressing_turn.text, r.response.text, [t.text for t in r.continuation]) for r in sorted(found, key=lambda r: int(r.sequence_id.split("_seq")[1]))] == [
            (f"t{i}", f"t{r}", [f"t{k}" for k in more]) for i, r, more in scan(rows)
        ]


def test_response_window_and_self(spark):
    far = [("A", ["B"], "hi")] + [("C", [], "x")] * 19 + [("B", [], "late")]
    assert Q.explicit_sequences(acts(spark, far)).count() == 0
    near = [("A", ["B"], "hi")] + [("C", [], "x")] * 18 + [("B", [], "just")]
    assert Q.explicit_sequences(acts(spark, near)).first().response.text == "just"
    own = [("A", ["A", "B"], "hi"), ("A", [], "me")]
    assert Q.explicit_sequences(acts(spark, own)).first().response.text == "me"


def test_properties(spark):
    found = engine.sequences(spark, SF).persist()
    points = D.decision_points(found).persist()
    assert found.where("NOT array_contains(addressing_turn.addressees, response.speaker) OR size(context) > 10").count() == 0
    per = found.select(((F.size("context") + 2 + F.size("continuation")) * (F.size(D.sequence_speakers()) - 1)).alias("n"))
    assert per.agg(F.sum("n")).first()[0] == points.count()
    assert points.where("target_spoke_next").groupBy("sequence_id", "turn_index").count().where("count > 1").count() == 0
    samples = P.samples(found).persist()
    assert samples.where("category IN ('S5', 'I1') AND turn_type <> 'addressing'").count() == 0
    assert samples.where("category = 'I1'").count() == found.where("response.speaker <> addressing_turn.speaker").count()
    unique = U.deduplicated(U.filtered(samples)).persist()
    assert unique.count() == unique.select(U.signature()).distinct().count() == U.deduplicated(unique).count() == 342
    flat = P.final_samples(found).persist()
    assert flat.agg(F.max("sample_id"), F.countDistinct("sample_id")).first() == (flat.count(), flat.count())
    report = S.compiled(flat)
    assert sum(c["count"] for c in report["category_distribution"].values()) == report["dataset_overview"]["total_samples"] == flat.count()
    json.dumps(report)


def test_dedup_prefers_confidence(spark):
    rows = P.samples(engine.sequences(spark, SF)).limit(1)
    both = rows.withColumn("confidence", F.lit("low")).union(rows.withColumn("meeting_id", F.lit("Z")))
    assert U.deduplicated(both).first().confidence == "high"


def test_empty_and_one_class(spark):
    none = Q.explicit_sequences(acts(spark, [("A", [], "alone here")]))
    assert Q.expansion(none).first().expansion_percent is None
    assert P.final_samples(none).count() == 0
    assert L.addressed_rate(P.samples(none)).first().rate is None
    assert S.compiled(P.final_samples(none))["decision_distribution"]["silent_to_speak_ratio"] is None


def test_ranked(spark):
    df = spark.createDataFrame([("g", f"m{k:03d}", k) for k in range(50)], "g string, m string, k int")
    out = ranked(df, ["g"], [F.col("m")], F.substring("m", 1, 3), "rank")
    assert all(r["rank"] == r.k + 1 for r in out.collect())


def test_prompt_and_provider(spark):
    rows = acts(spark, [("A", [], "What do you think about this"), ("B", [], "I think that it is fine")])
    asked = I.prompts(I.unaddressed(rows), rows)
    text = {r.idx: r.prompt for r in asked.collect()}
    assert "SPEAKERS IN MEETING: A, B\n" in text[0] and "(No previous context)" in text[0] and "Speaker A: What do you think" in text[1]

    def provider(prompt):
        if "fine" in prompt.split("CURRENT UTTERANCE")[1]:
            raise RuntimeError
        return "ADDRESSEES: B\nCONFIDENCE: 9"

    found = P.sequences(rows, provider=provider).collect()
    assert [(r.sequence_id, r.addressing_turn.inference_confidence, r.source) for r in found] == [("m_inferred0", 9, "gemini_inferred")]
    with pytest.raises(ValueError):
        I.only_meeting(P.sequences(rows, provider=provider), "none")
    assert DEFAULT.min_confidence == 6
