"""Operators that compare texts: brute force, edge cases, the pipeline."""

import collections
import functools
import hashlib
import random

import duckdb
import numpy as np
import pytest
import regex
from colloq.llm import decontaminate, near_dup, registry, substrings
from colloq.llm.components import components
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def documents():
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()


def near_brute(rows, n=2):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*[w[k:] for k in range(n)])) if len(w) >= n else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return collections.Counter((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def near_rows(seed, hub=True):
    """Groups around a hub that isn't their least member, chains, copies and edges."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = [(9000, None), (9001, ""), (9002, " "), (9003, "one"), (9004, "ONE"), (9005, "one two"), (9006, "x " * 4000)]
    for g in range(4):
        base = [r.choice(words) for _ in range(r.choice([12, 40, 120]))]
        own = [list(base) for _ in range(18)]
        for t in own[:-1]:
            for _ in range(r.randrange(0, max(2, len(base) // 12))):
                t[r.randrange(len(t))] = r.choice(words)
        rows += [(100 * g + k, " ".join(t)) for k, t in enumerate(own)]
    return rows + [(777, rows[10][1]), (777, rows[10][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near_brute(rows)


def family_rows(seed):
    """Copies cut short, with words put in, left out or changed, two families with edits in common, and a passage in strange texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    base = [r.choice(words) for _ in range(90)]
    rows = [(k, " ".join(base[: 90 - k])) for k in range(0, 45)]
    other = list(base)
    for p in range(0, 90, 9):
        other[p] = r.choice(words)
    for k in range(100, 200):
        t = list(base if k % 2 else other)
        for _ in range(r.randrange(0, 8)):
            p = r.randrange(len(t))
            what = r.randrange(3)
            t[p : p + 1] = [] if what == 0 else [r.choice(words)] if what == 1 else [t[p], r.choice(words)]
        rows.append((k, " ".join(t)))
    passage = [r.choice(words) for _ in range(50)]
    rows += [(k, " ".join([*passage, *(r.choice(words) for _ in range(r.randrange(2, 60)))])) for k in range(300, 360)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_near_duplicates_in_families(spark, seed):
    rows = family_rows(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near_brute(rows)


def test_near_duplicates_of_documents(spark):
    got = near_dup.near_duplicates(spark.createDataFrame(documents(), "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == near_brute(documents())


def test_near_duplicates_null_ids_and_empty(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, None), (None, "q r s")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("None", "5", False), ("None", "None", False), ("None", "None", False)]
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000, dtype="uint64") * np.uint64(2))
    b = np.unique(np.r_[a[:900], rng.integers(0, 2**63, 100, dtype="uint64")])
    same = (near_dup.sketch(a) == near_dup.sketch(b)).mean()
    assert 0.65 < same < 0.95
    assert len(near_dup.sketch(a[:1])) == near_dup.BINS


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 31)}, 101: 100, 102: 100}


def repeats_brute(rows, size=200):
    seen = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    out = collections.Counter()
    for i, b in texts:
        runs = []
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + size
                else:
                    runs.append([p, p + size])
        left = b"".join(b[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(b)]))
        out[i, len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(left).hexdigest()] += 1
    return out


def repeat_rows(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab ") for _ in range(400)) for _ in range(4)]
    piece = lambda: r.choice(base)[r.randrange(200) :][: r.randrange(80, 260)] + r.choice(["", "x", "é" * 3, "aaaa" * 30])
    rows = [(k, "".join(piece() for _ in range(r.randrange(0, 6)))) for k in range(60)]
    return rows + [(100, None), (101, ""), (102, "a" * 1000), (103, "ab" * 500), (104, rows[3][1]), (104, rows[3][1]), (None, "z" * 199)]


@pytest.mark.parametrize("seed", [5, 6])
def test_repeats(spark, seed):
    rows = repeat_rows(seed)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_brute(rows)


def test_repeats_of_documents_and_empty(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    got = substrings.remove_repeats(df, keep_text=True).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats_brute(documents())
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    """Starts of intervals from pieces are those of the whole."""
    text = repeat_rows(5)[10][1].encode() * 3
    whole = substrings.intervals([text], 200, 32)
    monkeypatch.setattr(substrings, "BLOCK", 97)
    cut = substrings.intervals([text], 200, 32)
    starts = lambda x: {(int(g), p) for g, lo, hi in zip(x[1], x[3], x[4]) for p in range(lo, hi + 1)}
    assert starts(whole) == starts(cut)


ITEM = "Alice has 5 apples and buys 7 more apples for 12 dollars so how many apples does Alice have now in total"


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (None, None), (3, "")], "item_id long, text string").withColumn("window", F.lit(0))
    docs = [
        (1, "erly the. Bob has 9 apples and buys 11 more apples for 30 dollars so how many apples does Bob have now in total, and more"),
        (2, "Bob has 9 apples and buys 11 more apples for 30 dollars so how many apples does Tom have now in total"),
        (3, "Short one!"), (4, None), (5, ""), (6, "a short one here"), (7, ITEM), (7, ITEM), (None, "x " * 2000 + ITEM), (8, "the apples and " * 3000),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("marked", F.lit("clash"))
    want = {(1, 1), (7, 1), (3, 2), (None, 1)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()} == want
    assert decontaminate.contaminated(df.limit(0), bench).count() == decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_of_unlisted_names(spark):
    """Names that no list has, at sentence starts, after line breaks and double spaces."""
    bench = spark.createDataFrame([(1, "Zoe has 5 apples. Zoe buys 7 more. How many apples does Zoe have now?"), (2, "Hello world")], "item_id long, text string")
    docs = [
        (1, "Mia has 9 apples. Mia buys 11 more. How many apples does Mia have now?"),
        (2, "and then Mia has 9 apples.\nMia buys 11 more.\n\nHow many apples  does\n Mia have now?  The end"),
        (3, "Mia has 9 apples. Ida buys 11 more. How many apples does Eva have now?"),
        (4, "Goodbye world"), (5, "hello world"), (6, "zoe has 5 apples. zoe buys 7 more. how many pears did they have then?"),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (5, 2)} and len(got) == 3


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_decontamination(spark)


def test_decontamination_finds_passages(spark):
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    want = {(i, k) for i, t in documents() for k, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op7_template_decontamination(spark, DATA).collect()} == want


def decontamination_brute(docs, items, n=5, share=0.8):
    """(doc, item, windows found) by plain loops: both readings, all alignments."""
    names, units = "|".join(decontaminate.NAMES), "|".join(decontaminate.UNITS)

    def words(text):
        """(value, slot type or '' by reading) of every word."""
        text = regex.sub(r"(?<![0-9])[.,]|[.,](?![0-9])|[^\p{L}\p{N}.,]", " ", text or "")
        text = regex.sub(rf"(?<=(?:^|[ ])[0-9]+(?:[.,][0-9]+)*)(?i:({units}))(?= |$)", r" \1", text).split()
        out = []
        for k, w in enumerate(text):
            low, after = w.lower(), k and regex.fullmatch("[0-9]+(?:[.,][0-9]+)*", text[k - 1])
            if w[0] in "0123456789":
                kinds = ("d", "d")
            elif after and regex.fullmatch(units, low):
                kinds = ("u", "u")
            elif regex.fullmatch(names, low):
                kinds = ("n", "n")
            else:
                kinds = ("", "n" if regex.match(r"\p{Lu}\p{L}", w) else "")
            out.append((low, kinds))
        return out

    def template(ws, t):
        out = [w if not k[t] else "§" + k[t] for w, k in ws]
        return tuple(out) if sum(x[0] != "§" for x in out) >= 2 else tuple((w, k) for w, k in ws)

    def cut(ws):
        return [ws[p : p + n] for p in range(len(ws) - n + 1)] if len(ws) >= n else [ws] if ws else []

    found = set()
    for di, dt in set(docs):
        dw = cut(words(dt))
        for ii, it in items:
            iw, best = cut(words(it)), 0
            for t in (0, 1):
                hits = [(d, i) for d in range(len(dw)) for i in range(len(iw)) if len(dw[d]) == len(iw[i]) and template(dw[d], t) == template(iw[i], t)]
                ways = collections.defaultdict(list)
                for d, i in hits:
                    for way in ((0, d - i), (1, (d - i) // 16), (2, (d - i + 8) // 16)):
                        ways[way].append((d, i))
                for met in ways.values():
                    bound = {((k[t], w), (l[t], v)) for d, i in met for (w, k), (v, l) in zip(iw[i], dw[d]) if k[t]}
                    if len(bound) == len({a for a, _ in bound}) == len({b for _, b in bound}):
                        best = max(best, len({i for _, i in met}))
            if iw and best >= share * len(iw):
                found.add((di, ii, len(iw), best))
    return found


@pytest.mark.parametrize("seed", [7, 8])
def test_decontamination_is_brute_force(spark, seed):
    r = random.Random(seed)
    words = "the of and has buys more apples pears for how many does so then now in total each".split()
    names, units = ["Zoe", "Mia", "Ida", "Alice", "Bob", "Rex"], ["km", "hours", "dollars", "kg"]
    item = lambda: [r.choice(words) if x < 6 else r.choice(names) if x < 8 else str(r.randrange(40)) if x < 9 else f"{r.randrange(9)} {r.choice(units)}" for x in (r.randrange(10) for _ in range(r.randrange(3, 25)))]
    items = [item() for _ in range(12)]
    docs = []
    for k in range(60):
        body = list(r.choice(items))
        swap = {x: r.choice(names) if x in names else str(r.randrange(40)) for x in set(body) if x in names or x.isdigit()}
        body = [swap.get(x, x) if k % 3 else x for x in body]
        for _ in range(r.randrange(3)):
            body.insert(r.randrange(len(body) + 1), r.choice(words))
        docs.append((k, " ".join([*item()[: r.randrange(9)], *body, *item()[: r.randrange(9)]]) + r.choice([".", "", "?"])))
    items = [(k, " ".join(x).capitalize() if k % 4 == 0 else " ".join(x) + ".") for k, x in enumerate(items)]
    want = decontamination_brute(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id, x.n_windows, x.n_found) for x in got} == want and len(got) == len(want) > 12


def test_decontamination_needs_one_binding(spark):
    """Every window counts, the first too; contradictory bindings in two places, or two values for one, are no match."""
    bench = [(1, "what is the capital of France"), (2, "Rex sells nine red apples to each of the four boys that Rex has met"), (3, "Mia walks with Ida to the old mill by the river and back")]
    docs = [
        (1, "we saw that is the capital of France once"), (2, "we asked What is the capital of France once"), (3, "what is the capital of Peru"),
        (4, "Bob sells nine red apples to each of the four boys that Bob has met"),
        (5, "Bob sells nine red apples to each of the four boys and so on, again and again it was told, it went on and on, each of the four boys that Tom has met"),
        (6, "Bob sells nine red apples to each of the four boys that Tom has met"),
        (7, "Eva walks with Eva to the old mill by the river and back"), (8, "Eva walks with Ada to the old mill by the river and back"),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(2, 1), (3, 1), (4, 2), (8, 3)}


REPEATS = "Rex has 5 apples and Mia has 7 apples and then Rex gives Mia all of his apples so how many apples does Mia now have in her big red basket at home in the end"


@pytest.mark.parametrize("at", [0, 1, 5, 6, 12, 13, 20, 31])
def test_decontamination_where_phrases_repeat(spark, at):
    """Names and numbers changed, one word put in or left out; phrases meet on several diagonals. Numbers may become equal, names may not."""

    def changed(names, numbers, word=None):
        swap = dict(zip(["Rex", "Mia", "5", "7"], [*names, *numbers]))
        out = [swap.get(w, w) for w in REPEATS.split()]
        return " ".join([*out[:at], *([word] if word else []), *out[at:]])

    docs = [
        (1, changed(["Zoe", "Ida"], ["8", "2"], "later")), (2, changed(["Zoe", "Ida"], ["8", "2"])), (3, "so " + changed(["Zoe", "Ida"], ["4", "4"], "later")),
        (4, changed(["Zoe", "Zoe"], ["8", "2"], "later")), (5, changed(["Rex", "Mia"], ["5", "7"], "later")), (6, changed(["Mia", "Rex"], ["7", "5"], "later")),
        (7, "Zoe".join(changed(["Zoe", "Ida"], ["8", "2"], "later").rsplit("Ida", 1))),
    ]
    bench = spark.createDataFrame([(1, REPEATS)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in got} == {1, 2, 3, 5, 6} and len(got) == 5


def chain_brute(places):
    """The best choice of one (i, k) or none for each i, by going on from every choice."""
    by = collections.defaultdict(list)
    for i, k in places:
        by[i].append(k)
    order = sorted(by)

    @functools.cache
    def best(at, last):
        if at == len(order):
            return 0, 0, ()
        options = [best(at + 1, last)]
        for k in by[order[at]]:
            value, n, path = best(at + 1, k)
            options.append((value + 1 - (0 if last is None else abs(k - last)), n + 1, (order[at] * 16 + k, *path)))
        return max(options)

    return best(0, None)[2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chains_are_brute_force(spark, seed):
    r = random.Random(seed)
    cells = [sorted({(r.randrange(n), r.randrange(r.choice([2, 5, 16]))) for _ in range(r.randrange(1, 3 * n))}) for n in (r.randrange(1, 14) for _ in range(150))]
    schema = "id int, met array<struct<i:int,k:int,bound:array<struct<a:string,b:string>>>>"
    df = spark.createDataFrame([(n, [(i, k, []) for i, k in r.sample(c, len(c))]) for n, c in enumerate(cells)], schema)
    got = {row.id: tuple(sorted(h.i * 16 + h.k for h in row.chain)) for row in df.select("id", decontaminate._chain(F.col("met")).alias("chain")).collect()}
    assert got == {n: chain_brute(c) for n, c in enumerate(cells)}


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.union(docs.where("doc_id = 3")).union(spark.createDataFrame([(None, None, None, None, None, 1), (10**6, "", "en", "s", 0, 1)], docs.schema))
    counts = []
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, DATA), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    assert 202 > counts[0] > counts[1] > counts[2] == counts[3] > 100
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in docs.collect()}
    near = near_brute(documents(), 5)
    alone = {i for i, _, c, _ in near if sum(x[2] == c for x in near) == 1}
    leaks = {r.doc_id for r in decontaminate.op7_template_decontamination(spark, DATA).collect()}
    good = {i for i, q in labels.items() if q == 1 and i in alone and i not in leaks}
    assert len(good & kept) >= 0.95 * len(good)
    assert len({i for i, q in labels.items() if q == 0} & kept) <= 0.1 * len(labels)
    assert docs.where("text LIKE '%@mail%'").count() == 0
    packed = C.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert C.ORACLE_SQL is None and set(registry.ORACLE_SQL) <= set(registry.QUERIES)
