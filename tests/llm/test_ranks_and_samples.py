"""Grouped ranks, document fingerprints and importance resampling: SQL, brute force, edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from colloq.llm import fingerprints, ranks, registry, resample
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def least(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("name", ["op11_grouped_ranking", "op13_importance_resampling"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("sale_lines", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    found = con.execute(registry.ORACLE_SQL[name])
    assert [d[0] for d in found.description] == df.columns
    got = sorted((tuple(r) for r in df.collect()), key=least)
    assert got and got == sorted(found.fetchall(), key=least)


def brute_ranks(rows):
    """(group, pair, rest) rows with pos, rank, dense, tied; a pair sorts its first downwards, nulls last everywhere."""
    key = lambda x: (x is None, x if x is not None else 0)
    down = lambda x: (x is None, -x if x is not None else 0)
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (down(r[1]), key(r[2]), key(r[3])))
        ties = Counter((r[1], r[2]) for r in own)
        pairs = list(dict.fromkeys((r[1], r[2]) for r in own))
        for k, r in enumerate(own):
            first = next(i for i, x in enumerate(own) if x[1:3] == r[1:3])
            out.append((*r, k + 1, first + 1, pairs.index(r[1:3]) + 1, ties[r[1:3]]))
    return Counter(out)


@pytest.mark.parametrize("ranges", [1, 3, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_are_brute_force(spark, seed, ranges):
    """A group of a third of all rows, pairs that many rows share, equal rows, nulls in all keys; runs of ties span ranges."""
    r = random.Random(seed)
    some = lambda *x: r.choice([None, *x])
    rows = [(7 if r.random() < 0.4 else some(*range(9)), some(1, 2), some(0, 5), some(*range(30))) for _ in range(700)]
    rows += [(7, 1, 5, 3)] * 120 + [(None, None, None, None)] * 30
    df = spark.createDataFrame(rows, "g int, a int, b int, c int").repartition(5)
    whole = ranks.grouped_ranks(df, ["g"], ["-a", "b"], ["c"], ranges=ranges)
    want = brute_ranks(rows)
    assert Counter(tuple(x) for x in whole.collect()) == want
    top = ranks.grouped_ranks(df, ["g"], ["-a", "b"], ["c"], top=3, ranges=ranges)
    assert Counter(tuple(x) for x in top.collect()) == Counter({k: n for k, n in want.items() if k[4] <= 3})


def test_ranks_of_edges(spark):
    df = spark.createDataFrame([(1.0, "a", 9), (float("nan"), "b", 9), (None, "c", 9), (float("nan"), "d", 9), (-0.0, "e", 9), (0.0, "f", 9)], "v double, name string, pos int")
    got = {r.name: (r.pos, r["rank"], r.dense, r.tied) for r in ranks.grouped_ranks(df, [], ["v"], ["name"], ranges=2).collect()}
    # A clashing pos is replaced; zeros are equal, NaN is one value after all numbers, nulls come last.
    assert got == {"e": (1, 1, 1, 2), "f": (2, 1, 1, 2), "a": (3, 3, 2, 1), "b": (4, 4, 3, 2), "d": (5, 4, 3, 2), "c": (6, 6, 4, 1)}
    assert ranks.grouped_ranks(df.limit(0), ["name"], ["v"], []).count() == 0
    one = spark.createDataFrame([("x",)] * 50, "v string").repartition(7)
    assert sorted((r.pos, r["rank"], r.dense, r.tied) for r in ranks.grouped_ranks(one, ["v"], [], [], ranges=4).collect()) == [(k, 1, 1, 50) for k in range(1, 51)]


def test_summaries_are_combined():
    s = lambda rows, dense, ties, rank, g, run, first_ties, first, last: dict(zip(("rows", "dense", "ties", "rank", "one_group", "one_run", "first_ties", "first", "last"), (rows, dense, ties, rank, g, run, first_ties, first, last)))
    a, b = [["g"], ["p"]], [["g"], ["q"]]
    got = ranks.combined([s(5, 2, 3, 3, True, False, 2, a, b), s(4, 1, 4, 1, True, True, 4, b, b), s(1, 1, 1, 1, False, False, 2, b, [["h"], ["p"]])])
    assert got == [
        {"rows": 0, "dense": 0, "ties": 0, "rank": 0, "later": 6},
        {"rows": 5, "dense": 1, "ties": 3, "rank": 3, "later": 2},
        {"rows": 9, "dense": 1, "ties": 7, "rank": 3, "later": 0},
    ]


def mixed(*values, seed=42):
    """Spark's xxhash64 of several values, as an unsigned number."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def anchors(text):
    k, s = fingerprints.K, fingerprints.S
    alone = "一-鿿぀-ヿ฀-๿"
    words = re.findall(rf"[{alone}]|[^\W_{alone}]+", text.lower())
    inner = [mixed(*words[i : i + s]) for i in range(len(words) - s + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = {}
    for i in range(len(inner) - (k - s)):
        own = inner[i : i + k - s + 1]
        if min(map(signed, own)) in (signed(own[0]), signed(own[-1])):
            found.setdefault(mixed(*own[::s]) >> (fingerprints.POSITION_BITS + 1), i)
    if not found:
        found = {mixed(" ".join(words) if words else text) >> (fingerprints.POSITION_BITS + 1): 0} if text else {}
    return sorted(found.items())[: fingerprints.SIZE]


def likeness(a, b):
    union = sorted({h for h, _ in a} | {h for h, _ in b})[: fingerprints.SIZE]
    if not union:
        return 1.0
    other = dict(b)
    both = sorted((p, other[h] - p) for h, p in a if h in other and h in union)
    near = lambda i, j: 0 <= j < len(both) and abs(both[i][1] - both[j][1]) <= fingerprints.SLACK
    c = sum(len(both) == 1 or near(i, i - 1) or near(i, i + 1) for i in range(len(both)))
    return 2 * c / (c + len(union))


def shown(a):
    return ",".join(f"{h << fingerprints.POSITION_BITS | p:x}" for h, p in a)


def brute_fingerprints(rows):
    """By (doc_id, text): falling ids, copies of a row as one; nulls last."""
    key = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(mixed(t))
    different = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), key(r[1])))
    out = {}
    for k, (i, t) in enumerate(different):
        n = different[(k + 1) % len(different)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        a, b, c = anchors(t), anchors(edited), anchors(n)
        out[i, t] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, c))
    return out


def check_fingerprints(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.lit("clash"), "key": F.lit(1), "anchors": F.lit(2)})
    want = brute_fingerprints(rows)
    got = Counter()
    for r in fingerprints.fingerprints(df).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256), fingerprints.shown("anchors"), fingerprints.shown("edited_anchors"), "near_edited", "near_next").collect():
        got[tuple(r)] += 1
    assert got == Counter((i, *want[i, t or ""]) for i, t in rows)


def test_fingerprints_are_brute_force(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)] + ["É", "ß", "naïve"]
    rows = [(k * 3 % 41, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 6, 7, 10, 11, 60, 900])))) for k in range(41)]
    rows += [(100, None), (101, ""), (None, "no id at all " * 5), (102, "?!"), (103, "一二三四五六七八九十" * 3), (104, "same line\n" * 50), (105, "x " * 3000), (106, "one"), (106, "two"), (107, "copy of this"), (107, "copy of this"), (None, None)]
    check_fingerprints(spark, rows)


def test_fingerprints_of_one_and_none(spark):
    check_fingerprints(spark, [(5, "the only document there is")])
    check_fingerprints(spark, [(5, None)])
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_of_documents(spark):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    want = brute_fingerprints(rows)
    got = fingerprints.op12_syncmer_fingerprints(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        assert tuple(r)[1:] == want[r.doc_id, text or ""]
    assert np.mean([r.near_edited for r in got]) > 0.5 > 0.1 > np.mean([r.near_next for r in got])


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n=2):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_samples(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)), Counter(bucket(f) for x in target for f in runs(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for i, x in docs:
        own = [gain(bucket(f)) for f in runs(x)]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(x))))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[: 25 * len(able) // 100]
    out = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    return out + Counter((*r[:4], None) for r in rows) - Counter((*r[:4], None) for r in drawn)


@pytest.mark.parametrize("size", [1 << 16, 64])
def test_samples_are_brute_force(spark, monkeypatch, size):
    """Long texts are cut into many chunks, in words longer than a chunk too."""
    monkeypatch.setattr(resample, "CHUNK_BYTES", size)
    r = random.Random(6)
    words = ["the", "of", "É", "naïve", "x1", "a" * 70, "b" * 200, "Word", "一二", "q" * 64]
    docs = [(k, r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.choice([0, 1, 2, 19, 20, 21, 60])))) for k in range(80)]
    docs += [(None, "no id " * 20), (3, docs[3][1]), (3, docs[3][1]), (200, None), (201, " ,;"), (202, "z" * 5000), (203, "z" * 500 + " " * 500 + "y " * 300)]
    target = ["the of the of x1", None, "", "naïve Word " * 30]
    got = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("clash")).repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_samples(docs, target)


def test_samples_of_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(none, none).count() == 0
    docs = [(k, "some words " * 12) for k in range(8)]
    got = resample.resampled(spark.createDataFrame(docs, "doc_id long, text string"), none)
    assert Counter(tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == brute_samples(docs, [])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_chunks_own_every_run_once(n):
    r = random.Random(n)
    for size in (1, 7, 30):
        for _ in range(60):
            text = "".join(r.choice(["a", "bc", "é", " ", "  ", ",", "dddddddddddd"]) for _ in range(r.randrange(0, 60))).encode()
            cut = list(resample.chunks(text, size, n))
            whole = resample.features([text], [-1], n)
            parts = resample.features([p for p, _ in cut], [o for _, o in cut], n)
            assert Counter(whole[0].tolist()) == Counter(parts[0].tolist()) and whole[2].sum() == parts[2].sum()


def test_crc_by_columns():
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 3, 63, 64, 65, 300]))) for _ in range(50)]
    raw = np.frombuffer(b"".join(texts) or b" ", "uint8")
    stop = np.cumsum([len(t) for t in texts])
    start = stop - [len(t) for t in texts]
    before = np.array([r.randrange(1 << 32) for _ in texts], "uint32")
    assert resample.extended(before, raw, start, stop).tolist() == [zlib.crc32(t, int(b)) for t, b in zip(texts, before)]
