"""What may not grow: pairs that are compared, memory of many languages, and what tables hold of people."""

import random
import tracemalloc

import numpy as np
from colloq.llm import common, language, near_dup, pii
from pyspark.sql import functions as F


def families(m, seed=1):
    """Two families of m near copies, each family about 0.74 like the other."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    other = list(base)
    for k in r.sample(range(200), 15):
        other[k] = f"x{r.randrange(10**6)}"
    rows = []
    for f, own in enumerate((base, other)):
        for k in range(m):
            t = list(own)
            for _ in range(4):
                t[r.randrange(200)] = f"y{r.randrange(10**6)}"
            rows.append((f * m + k, " ".join(t)))
    return rows


def test_pairs_of_two_families_are_linear(spark, monkeypatch):
    seen, original = [], near_dup.crossing

    def counted(rows):
        out = original(rows)
        seen.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "crossing", counted)
    for m in (40, 160):
        seen.append(0)
        got = near_dup.near_duplicates(spark.createDataFrame(families(m), "doc_id long, text string"))
        assert sorted(r["count"] for r in got.groupBy("component_id").count().collect()) == [m, m]
    compared = [sum(seen[: seen.index(0, 1)]), sum(seen[seen.index(0, 1) :])]
    assert compared[1] <= 8 * compared[0] + 1000


def invented(k, words=400):
    r = random.Random(k)
    letters = r.sample("abcdefghijklmnopqrstuvwxyz", 9)
    own = ["".join(r.choice(letters) for _ in range(r.randrange(3, 8))) for _ in range(40)]
    return " ".join(r.choice(own) for _ in range(words))


def test_four_hundred_languages(spark):
    known = [(1000 * c + k, invented(k), f"l{k:03d}") for k in range(400) for c in range(2)]
    model = language.fit(spark.createDataFrame(known, "doc_id long, text string, lang string"))
    assert len(model.langs) == 400 and model.log.size <= language.MODEL_CELLS
    asked = spark.createDataFrame([(k, " ".join(invented(k).split()[-60:])) for k in range(400)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()}
    assert sum(got[k] == f"l{k:03d}" for k in got) >= 396
    # One long text of 400 languages: about 160,000 words; a matrix of words and languages would take 256 MB, one of letters 1.3 GB.
    text = " ".join(invented(k) for k in range(400))
    tracemalloc.start()
    lang, score, spans = model.predict([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(spans[0]) >= 400 and 0 < score[0] < 0.02


def test_slices_make_no_difference(monkeypatch):
    rng = np.random.default_rng(3)
    model = language.Model([f"l{k}" for k in range(11)], rng.random((1 << 12, 11)) * 40, np.ones((len(language.SCRIPT_NAMES), 11)))
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) for _ in range(n)) for n in (300, 0, 1, 40, 41, 7)]
    whole = model.predict(texts)
    monkeypatch.setattr(language, "SLICE", 50)
    cut = model.predict(texts)
    assert whole[0] == cut[0] and whole[1].tolist() == cut[1].tolist() and whole[2] == cut[2]


def planted(seed=7):
    """(texts, true spans): secrets, national ids and local numbers in prose, beside digests and numbers that are none."""
    r = random.Random(seed)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    alnum = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(n))
    made = {
        "secret": lambda: r.choice([lambda: f"token = {hexes(40)}", lambda: f"api_key: ghp_{alnum(30)}1a", lambda: f"password: {alnum(24)}7b"])(),
        "national_id": lambda: f"SSN {r.randrange(100, 650)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
        "local_phone": lambda: f"call {r.choice([212, 310, 415, 617])}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
    }
    decoys = [lambda: f"commit {hexes(40)}", lambda: f"md5 {hexes(32)}", lambda: f"order {r.randrange(10**6)}", lambda: f"version {r.randrange(9)}.{r.randrange(9)}"]
    words = "the report of this month shows that many people like to read long texts about history and music".split()
    texts, truth = [], set()
    for k in range(400):
        parts, size = [], 0
        for _ in range(6):
            kind = r.choice([*made, None, None])
            for piece in (" ".join(r.choices(words, k=8)), made[kind]() if kind else r.choice(decoys)() if r.random() < 0.5 else "so"):
                parts.append(piece)
                size += len(piece) + 1
            if kind:
                value = parts[-1].split(" ")[-1]
                truth.add((k, kind, size - 1 - len(value), size - 1))
        texts.append((k, " ".join(parts)))
    return texts, truth


def test_added_kinds_on_planted_data(spark):
    texts, truth = planted()
    rows = pii.pii(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", F.explode("found").alias("s")).collect()
    got = {(r.doc_id, r.s.kind, r.s.start, r.s.end) for r in rows if r.s.kind not in pii.BASE}
    print(len(got & truth), len(got), len(truth))
    assert len(got & truth) >= 0.9 * len(got) and len(got & truth) >= 0.9 * len(truth)


def test_no_personal_data_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    docs = spark.createDataFrame([(1, "mail zoe.quux@mail.example.com or call +1 (632) 555-4827"), (2, "token = 1eb9c654e721b4f812088970e66a6345cee33dd6")], "doc_id long, text string")
    assert pii.pii(docs).select(F.explode("found")).count() >= 3
    tables = list(tmp_path.rglob("*.parquet"))
    assert tables
    for p in tables:
        held = " ".join(str(r) for r in spark.read.parquet(f"file://{p}").collect())
        assert not any(x in held for x in ("quux", "555", "1eb9c6", "mail ", "token"))
