"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Patterns propose spans. Four base kinds (email, ip, card, phone) have exact rules;
   further kinds (local_phone, national_id, secret) are proposed widely.
2. Three labelers vote on every span: a strict pattern of its kind, a gazetteer (known
   prefixes, providers, codes) and the words before it. A vote is 1, 0 or -1 (abstains).
3. Expectation maximisation over the counts of (kind, votes), a table of bounded size,
   estimates each labeler's reliability for each kind without labels, and with them how likely each pattern of votes is true.
4. These soft labels train the final classifier: naive Bayes over a span's own traits (kind,
   length, share of digits, case, marks, votes), from a table of counts that is bounded too.
   Spans of further kinds stay if it finds them more likely than not; base spans always stay.

All of it is DataFrame functions: matches and what lies between them are split off by the same
pattern, so that a running sum of lengths gives offsets in code points. Only counts of
patterns reach the driver. Texts are known by their MD5: copies are worked on once, and
what is gathered per key is one text's spans.

Defined results: a null text is empty and has no spans; a further span that overlaps a base span, or an
earlier one, is dropped; matches that fail their rule are dropped and not tried again;
repeated rows agree; of spans that begin and end alike the kind listed first wins; a very long text, or value, is
one like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloq.llm.common import DOCUMENT_COLUMNS, table, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "national_id", "secret")
LOCAL_CHARS = "A-Za-z0-9._%+-"
#: Patterns that never step back: a match begins at a run's first character or where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL_CHARS}]))[{LOCAL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+(?![A-Za-z0-9_/+-])",
}
#: Loops over groups are possessive here too: others take a stack frame for each round, and a value may be as long as its text.
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+\.)++[A-Za-z]{2,}+$",
    "ip": r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{2,7}$",
    "phone": r"^\+[1-9][0-9]{0,2}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}$",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[.-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^(?:[0-9a-f]{16,}|[A-Z]{4}[A-Z0-9]{16}|[a-z]{2,4}_[A-Za-z0-9]{20,})$",
}
GAZETTEER = {
    "email": r"(?i)(?:gmail|yahoo|hotmail|outlook|icloud|proton|gmx|web|mail[0-9]*|example)\.|\.(?:com|org|net|edu|gov|de|fr|es|io)$",
    "ip": r"^(?!0\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])(?![0-9]{13})",
    "local_phone": r"^\(?(?:201|202|203|212|213|310|312|315|404|415|503|512|602|617|646|702|718|800|818|888|917)\)?",
    "national_id": r"^[0-7]",
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk[-_]|pk_|AIza|eyJ)",
}
CUES = {
    "email": r"(?i)(?:mail|contact|write|courriel|correo|kontakt|schreib)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:\bip\b|host|server|addr|client|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|payment)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon|llame|appel)\w*\W*(?:\w+\W+)?$",
    "local_phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|telefon)\w*\W*(?:\w+\W+)?$",
    "national_id": r"(?i)(?:ssn|social|security|tax|\bid)\W*(?:\w+\W+)?$",
    "secret": r"(?i)(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_ -]?key|key|credential|bearer)\W*$",
}
AGAINST = r"(?i)(?:version|isbn|order|invoice|page|figure|section|chapter|commit|sha1|md5|uuid)\W*$"
BEFORE = 40
ROUNDS = 40


def _by_kind(values: dict[str, str], value: Column) -> Column:
    """Whether the pattern that ``values`` has for a row's kind is found in ``value``."""
    out = F.lit(False)
    for kind, pattern in values.items():
        out = F.when(F.col("kind") == kind, value.rlike(pattern)).otherwise(out)
    return out


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def content_key() -> Column:
    return F.md5(_text().cast("binary"))


def matches(docs: DataFrame) -> DataFrame:
    """(id, kind, start, end, value, before): leftmost non-overlapping matches of every kind."""
    digits = F.col("text").rlike("[0-9]")
    some = {k: F.col("text").contains("@") if k == "email" else F.col("text").contains("+") if k == "phone" else digits for k in KINDS}
    none = F.array().cast("array<string>")
    found = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.when(some[k], F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias("m"),
                F.when(some[k], F.split("text", PATTERNS[k], -1)).otherwise(none).alias("g"),
            )
            for k in KINDS
        ]
    )
    lines = docs.where(F.col("text").rlike("[0-9@]")).select(content_key().alias("id"), "text").select("id", F.explode(found).alias("f"))
    lines = lines.where(F.size("f.m") > 0).select("id", "f.kind", F.col("f.g").alias("g"), F.posexplode("f.m").alias("pos", "value"))
    gap = F.get("g", F.col("pos"))
    one = (
        lines.select("id", "kind", "pos", "value", F.length(gap).alias("gap"), F.substring(gap, -BEFORE, BEFORE).alias("before"))
        # Copies of a text bring equal rows; one stays.
        .groupBy("id", "kind", "pos")
        .agg(F.first("value").alias("value"), F.first("gap").alias("gap"), F.first("before").alias("before"))
    )
    size = F.length("value")
    end = F.sum(F.col("gap") + size).over(W.partitionBy("id", "kind").orderBy("pos"))
    return one.select("id", "kind", (end - size).alias("start"), end.alias("end"), "value", "before")


def _luhn(digits: Column) -> Column:
    """Luhn's check of a text of digits."""
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(found: DataFrame) -> DataFrame:
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    ok = (
        F.when(F.col("kind") == "ip", F.col("value").rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(True)
    )
    return found.where(ok)


def voted(spans: DataFrame) -> DataFrame:
    """Adds votes of the three labelers and the traits that the classifier sees."""
    value = F.col("value")
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    context = F.when(_by_kind(CUES, F.col("before")), 1).when(F.col("before").rlike(AGAINST), 0).otherwise(-1)
    return spans.select(
        "*",
        _by_kind(STRICT, value).cast("int").alias("v0"),
        F.when(_by_kind(GAZETTEER, value), 1).otherwise(F.when(F.col("kind").isin("email", "secret", "local_phone"), -1).otherwise(0)).alias("v1"),
        context.alias("v2"),
        F.least(F.lit(5), (F.length("value") / 8).cast("int")).alias("t_size"),
        (digits * 4 / F.length("value")).cast("int").alias("t_digits"),
        (value.rlike("[A-Z]").cast("int") + 2 * value.rlike("[a-z]").cast("int")).alias("t_case"),
        value.rlike(r"[^A-Za-z0-9]").cast("int").alias("t_marks"),
    )


VOTES = ("v0", "v1", "v2")
TRAITS = ("kind", *VOTES, "t_size", "t_digits", "t_case", "t_marks")


#: What EM believes of a labeler before it sees a vote, and the votes that this belief is worth.
FIRST_CHANCE = {1: 0.8, 0: 0.3}
BELIEF = 10.0


def reliabilities(patterns: dict[tuple, float], rounds: int = ROUNDS) -> tuple[dict[str, float], list[dict[int, float]]]:
    """EM over counts of (kind, votes): each kind's share of true spans, and P(vote 1 | truth, no abstention) of each labeler."""
    share = {k[0]: 0.5 for k in patterns}
    chance = [dict(FIRST_CHANCE) for _ in VOTES]
    for _ in range(rounds):
        ones = [{t: BELIEF * c for t, c in FIRST_CHANCE.items()} for _ in VOTES]
        votes = [dict.fromkeys(FIRST_CHANCE, BELIEF) for _ in VOTES]
        true, every = dict.fromkeys(share, 1.0), dict.fromkeys(share, 2.0)
        for key, n in patterns.items():
            p = posterior(key, share, chance)
            true[key[0]] += n * p
            every[key[0]] += n
            for j, v in enumerate(key[1:]):
                if v >= 0:
                    for t, q in ((1, p), (0, 1 - p)):
                        votes[j][t] += n * q
                        ones[j][t] += n * q * v
        share = {k: true[k] / every[k] for k in share}
        chance = [{t: ones[j][t] / votes[j][t] for t in FIRST_CHANCE} for j in range(len(VOTES))]
    return share, chance


def posterior(key: tuple, share: dict[str, float], chance: list[dict[int, float]]) -> float:
    a, b = share[key[0]], 1 - share[key[0]]
    for c, v in zip(chance, key[1:]):
        if v >= 0:
            a, b = a * (c[1] if v else 1 - c[1]), b * (c[0] if v else 1 - c[0])
    return a / (a + b) if a + b > 0 else 0.5


def train(counts: list[tuple], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[tuple[str, str, object], float]]:
    """Naive Bayes of each kind from (traits..., n): log odds of truth, and of each trait's value."""
    patterns: dict[tuple, float] = {}
    for *traits, n in counts:
        key = tuple(traits[: 1 + len(VOTES)])
        patterns[key] = patterns.get(key, 0.0) + n
    # Each kind by itself: how far a labeler is to be trusted on secrets doesn't follow from telephone numbers that all of them agree on.
    learned = {kind: reliabilities({k: n for k, n in patterns.items() if k[0] == kind}, rounds) for kind in {k[0] for k in patterns}}
    total = {k: [1.0, 1.0] for k in learned}
    seen: dict[tuple[str, str, object], list[float]] = {}
    for *traits, n in counts:
        kind = traits[0]
        p = posterior(tuple(traits[: 1 + len(VOTES)]), *learned[kind])
        for cell in (total[kind], *(seen.setdefault((kind, name, v), [0.0, 0.0]) for name, v in zip(TRAITS[1:], traits[1:]))):
            cell[1] += n * p
            cell[0] += n * (1 - p)
    # A value seen little tells little: one count is added, dealt out as the classes are.
    odds = {}
    for key, c in seen.items():
        t = total[key[0]]
        odds[key] = math.log((c[1] + t[1] / sum(t)) / t[1]) - math.log((c[0] + t[0] / sum(t)) / t[0])
    return {k: math.log(t[1] / t[0]) for k, t in total.items()}, odds


def log_odds(model: tuple[dict[str, float], dict[tuple[str, str, object], float]]) -> Column:
    """A span's log odds; a value that training did not see changes nothing."""
    first, weights = model
    if not first:
        return F.lit(0.0)
    look = lambda pairs, key: F.coalesce(F.create_map(*[F.lit(x) for p in pairs for x in p])[key], F.lit(0.0))
    out = look(sorted(first.items()), F.col("kind"))
    for name in TRAITS[1:]:
        out = out + look(sorted((f"{k}|{v}", w) for (k, n, v), w in weights.items() if n == name), F.concat_ws("|", "kind", F.col(name)))
    return out


def find_spans(docs: DataFrame) -> DataFrame:
    """(id, kind, start, end, base): all spans of distinct texts, by content key."""
    # Traits and places only: no personal data stands in the shared folder.
    cands = written(voted(valid(matches(docs))).select("id", "start", "end", *TRAITS), "spans")
    # Bounded: kinds, votes and coarse traits.
    counts = [tuple(r) for r in cands.groupBy(*TRAITS).count().collect()]
    model = train(counts)
    base = F.col("kind").isin(*BASE)
    kept = cands.where(base | (log_odds(model) > 0)).select("id", "kind", "start", "end", base.alias("base"))
    # A further span that a base span or an earlier further span overlaps goes.
    w = W.partitionBy("id").orderBy("start", F.col("base").desc(), "end", "kind")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # Read backwards: a frame that grows costs one step a row, one that shrinks is summed anew for each.
    behind = W.partitionBy("id").orderBy(F.col("start").desc(), "base", F.col("end").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, -1)
    clear = kept.select(
        "*",
        F.coalesce(F.max("end").over(before), F.lit(0)).alias("to"),
        F.min(F.when(F.col("base"), F.col("start"))).over(behind).alias("next"),
    )
    return clear.where("base OR (to <= start AND (next IS NULL OR next >= end))").select("id", "kind", "start", "end", "base")


def spans_by_text(spans: DataFrame) -> DataFrame:
    """One row per text with its spans in order."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``docs`` with the array ``name`` of (id, name), empty where there is none; a clashing column gives way."""
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], content_key().alias("__text_id"))
    out = rows.join(found.withColumnRenamed("id", "__found_id"), F.col("__text_id") == F.col("__found_id"), "left")
    none = F.array().cast(found.schema[name].dataType)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "__text_id"], F.coalesce(name, none).alias(name))


def pii(docs: DataFrame) -> DataFrame:
    """``docs`` with found: an array of spans in order, empty if there are none."""
    return with_spans(docs, spans_by_text(find_spans(docs)), "found")


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda s: s["base"])
    return docs.select(
        "doc_id",
        *[F.size(F.filter(F.transform("found", lambda s: s["kind"]), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of text replaced by a tag of its kind; spans that overlap are one hole."""
    w = W.partitionBy("id").orderBy("start", "end", "kind")
    ahead = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = find_spans(docs).withColumn("new", (F.col("start") >= F.coalesce(ahead, F.lit(0))).cast("int")).withColumn("run", F.sum("new").over(w))
    holes = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "end", "kind")).alias("first"))
    holes = holes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("first.kind").alias("kind")))).alias("holes"))
    found = with_spans(docs, holes, "holes")
    text, hole = F.col("text"), F.col("holes")

    def piece(h: Column, i: Column) -> Column:
        at = F.when(i > 0, F.get(hole, i - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.substring(text, at + 1, h["start"] - at), F.lit("<"), F.upper(h["kind"]), F.lit(">"))

    tail = F.substring(text, F.element_at(hole, -1)["end"] + 1, F.length(text))
    new = F.when(F.size(hole) > 0, F.concat(F.array_join(F.transform(hole, piece), ""), tail)).otherwise(text)
    return found.withColumn("text", new).select(*[F.col(f"`{c}`") for c in docs.columns if c != "holes"])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, redacted; n_chars follows the text."""
    return redact(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)
