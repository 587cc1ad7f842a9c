"""Text predicates against Python's own semantics."""

import re

import pytest
from colloq.functions import text as X
from pyspark.sql import functions as F

TEXTS = ["", "  ", "Mm-hmm.", "uh huh", "Um", "um ,", "OK", "No", "a b", "abc", "?!?! x", "...", "well um", "well um,", "so I was...", "Été d’été_1", " x y ", "one two three hmm", ".", "éa b", "٣ ٤ ٥ six"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")


def test_normalize_and_tokens(spark):
    for r in frame(spark).select("t", X.normalize(F.col("t")).alias("n"), X.tokens(F.col("t")).alias("w"), X.strip(F.col("t")).alias("s")).collect():
        assert r.n == " ".join(re.sub(r"[^\w\s]", "", r.t.lower()).split())
        assert r.w == r.t.split()
        assert r.s == r.t.strip()


def test_low_quality(spark):
    def low(t):
        kept = re.sub(r"[^\w\s]", "", t)
        filler = re.match(X.filler_pattern().replace(f"[{X.SPACE}]", r"\s"), t.strip().lower()) is not None
        return not t.strip() or filler or len(kept.strip()) < 3 or len(kept) < 0.5 * len(t)

    for r in frame(spark).select("t", X.is_low_quality(F.col("t")).alias("low")).collect():
        assert r.low == low(r.t), r.t
    assert frame(spark, [None]).select(X.is_low_quality(F.col("t"))).first()[0] is True


def test_incomplete(spark):
    def open_(t):
        t = t.strip()
        return t.endswith("...") or len(t.split()) <= 2 or any(m in t.lower().split()[-2:] for m in X.HESITATIONS)

    for r in frame(spark).select("t", X.is_incomplete(F.col("t")).alias("o")).collect():
        assert r.o == open_(r.t), r.t


@pytest.mark.parametrize(
    ("text", "target", "yes"),
    [("a cat", "A", True), ("panda said so", "A", True), ("ask about it", "A", True), ("Speaker B?", "B", True), ("don't", "T", True), ("éa b", "A", False), ("éb", "B", False), ("nobody", "A", False), ("(a)", "A", True)],
)
def test_mentions(spark, text, target, yes):
    df = spark.createDataFrame([(text, target)], "t string, s string")
    assert df.select(X.mentions(F.col("t"), F.col("s"))).first()[0] is yes
