"""What has to hold at any size: searches, scans, numbers, slices, files and calls."""

import json
import os
import random

import pytest
from colloq import cli
from colloq.operators import balance as B
from colloq.operators import decisions as D
from colloq.operators import inference as I
from colloq.operators import nextevents as N
from colloq.operators import quality as U
from colloq.operators import sequences as Q
from colloq.operators import stats as S
from colloq.operators import timeline as T
from colloq.operators import words as WR
from colloq.plans import pipeline as P
from colloq.plans.ranking import in_ranges, numbered, ranked
from colloq.queries import engine
from colloq.sources import files, report, sinks
from pyspark.sql import functions as F

from conftest import SF
from test_engine import ACTS, scan

TO = [[], [], ["B"], ["A", "B"], ["B", "A", "A"], ["C"], ["A"]]


def meetings(spark, by):
    rows = [(m, s, a, t, float(k), k) for m, acts in by.items() for k, (s, a, t) in enumerate(acts)]
    return T.indexed(spark.createDataFrame(rows, ACTS).withColumns({"has_explicit_addressee": F.size("addressee") > 0, "dact_id": F.col("doc_order").cast("string")}))


def turns(found):
    return {(r.meeting_id, r.addressing_turn.text): (r.response.text, [t.text for t in r.continuation]) for r in found.collect()}


def scanned(by):
    return {(m, f"t{i}"): (f"t{r}", [f"t{k}" for k in more]) for m, rows in by.items() for i, r, more in scan(rows)}


def test_sequences_of_many_meetings_follow_the_scan(spark):
    r = random.Random(11)
    by = {f"m{m}": [(r.choice("ABCDE"), r.choice(TO), f"t{k}") for k in range(r.randrange(1, 150))] for m in range(60)}
    assert turns(Q.explicit_sequences(meetings(spark, by))) == scanned(by)


def test_sequences_of_a_long_meeting(spark):
    """100,000 acts; exchanges are short, but for one of 2,000 turns and an outsider's monologue of 3,000 acts."""
    r = random.Random(5)
    rows = [(r.choice("ABCDE"), r.choice([[], [], [], *TO]), f"t{k}") for k in range(50_000)]
    # No act before finds its response beyond so many of Z, and as no other act addresses B and Y, whatever goes on ends here.
    rows += [("Z", [], f"t{k}") for k in range(50_000, 50_030)]
    n = len(rows)
    rows += [("A", ["B", "Y"], f"t{n}"), ("B", [], f"t{n + 1}")] + [("Z", [], f"t{k}") for k in range(n + 2, n + 3002)] + [(r.choice("AB"), [], f"t{k}") for k in range(n + 3002, n + 5002)]
    rows += [("Z", [], f"t{k}") for k in range(len(rows), len(rows) + 1)]
    rows += [(r.choice("ABCDE"), r.choice([[], [], [], *TO]), f"t{k}") for k in range(len(rows), 100_000)]
    acts = spark.createDataFrame([("m", s, a, t, float(k), k) for k, (s, a, t) in enumerate(rows)], ACTS)
    acts = T.indexed(acts.withColumns({"has_explicit_addressee": F.size("addressee") > 0, "dact_id": F.col("doc_order").cast("string")}))
    got, want = turns(Q.explicit_sequences(acts)), scanned({"m": rows})
    assert len(want["m", f"t{n}"][1]) == 2000 and got == want


def test_a_search_makes_rows_for_turns_returned_only(spark):
    """Exchanges that all run to the end of their meeting: the index is asked three times at most for each, whatever follows."""
    rows = {"m": [("A" if k % 2 else "B", ["A"] if k % 2 == 0 else ["B"], f"t{k}") for k in range(400)]}
    found = Q.candidates(meetings(spark, rows)).persist()
    ends = Q.spans(found, N.index(meetings(spark, rows)))
    assert ends.count() <= found.count()
    spread = ends.select(F.sum(F.ceil((F.col("stop") - F.col("first")) / N.BLOCK) + 1)).first()[0] or 0
    assert spread <= (ends.select(F.sum(F.col("stop") - F.col("first"))).first()[0] or 0) + 2 * ends.count()


def folded(steps):
    at, out = 0, []
    for i, n in sorted(steps):
        if i >= at:
            out.append(i)
            at = n
    return out


def test_greedy_is_the_fold(spark):
    r, by = random.Random(2), {}
    for m in range(1000):
        own = sorted(r.sample(range(300), r.randrange(1, 60)))
        by[f"m{m}"] = [(i, i + r.choice([1, 2, 5, 20, 200])) for i in own]
    rows = spark.createDataFrame([(m, i, n) for m, own in by.items() for i, n in own], "meeting_id string, i int, next int")
    got = {}
    for x in Q.greedy(rows).collect():
        got.setdefault(x.meeting_id, []).append(x.idx)
    assert {m: sorted(v) for m, v in got.items()} == {m: folded(own) for m, own in by.items()}


def test_numbers_with_one_common_prefix(spark):
    df = spark.range(20_000).select(F.concat(F.lit("ES2002a"), F.lpad(((F.col("id") * 7919) % 20_000).cast("string"), 8, "0")).alias("m"), (F.col("id") % 3).alias("g"))
    rows = in_ranges(df, [F.col("m")], "spread")
    sizes = [r["count"] for r in rows.groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
    got = numbered(df, [F.col("m")], "n", 0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(20_000)) and [r.m for r in got] == sorted(r.m for r in got)
    top = ranked(df, ["g"], [F.col("m")], name="rank").groupBy("g").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("rank")).collect()
    assert all(r[1] == 1 and r[2] == r[3] == r[4] for r in top)
    same = spark.createDataFrame([("x",)] * 10, "m string")
    assert sorted(r.n for r in numbered(same, [F.col("m")], "n").collect()) == list(range(1, 11))
    assert numbered(same.limit(0), [F.col("m")], "n").count() == 0


def test_keys_until_samples_are_drawn(spark):
    """The way over keys gives what whole samples give, and neither context nor text is in what is deduplicated."""
    found = engine.sequences(spark, SF).persist()
    whole = U.deduplicated(U.filtered(P.samples(found))).persist()
    keys = P.unique_keys(found)
    assert keys.columns == list(U.KEYS)
    texts = P.with_texts(keys, found)
    assert texts.columns == whole.columns and texts.exceptAll(whole).count() == whole.exceptAll(texts).count() == 0
    drawn = B.balanced(whole).persist()
    assert drawn.select("decision_point_id", "sample_id").exceptAll(P.final_samples(found).select("decision_point_id", "sample_id")).count() == 0
    plan = {(d, c): q for d, c, _, _, q, _ in B.quotas(whole)}
    assert {(r.decision, r.category): r["count"] for r in drawn.groupBy("decision", "category").count().collect()} == plan


def test_drawn_samples_are_the_first_of_each_category(spark):
    r = random.Random(4)
    rows = [(f"m{r.randrange(9)}", f"s{k:03d}", r.randrange(5), "A", r.choice(["SPEAK", "SILENT", "SILENT"]), r.choice(["high", "low"])) for k in range(300)]
    rows = [(*x, "I1" if x[4] == "SPEAK" else r.choice(["S1", "S2"])) for x in rows]
    keys = spark.createDataFrame(rows, "meeting_id string, sequence_id string, turn_index int, target_speaker string, decision string, confidence string, category string").persist()
    want = []
    for d, c, _, _, q, _ in B.quotas(keys):
        own = sorted((x for x in rows if x[4] == d and x[6] == c), key=lambda x: (x[5] != "high", x[:4]))
        want += [x[1] for x in own[:q]]
    assert [x.sequence_id for x in B.selected(keys).orderBy("sample_id").collect()] == want


def test_reference_counts_are_those_of_words_one_by_one(spark):
    """Ranges that overlap, that cross blocks, that count down, single ids in and out of ranges, zeros before a number: as by the words themselves, with rows for blocks only."""
    r = random.Random(5)
    one = lambda: f"{r.choice(['M.A.words', 'N.A.words', 'odd', '.words'])}{r.choice(['', '', '0'])}{r.choice([r.randrange(100), r.randrange(1000), 9223372036854775800 + r.randrange(10), 99999999999999999999])}"
    near = lambda: (lambda s, k: f"f#id({s}{k})..id({s}{k + r.randrange(-9, 90)})")(r.choice(["M.A.words", "N.A.words"]), r.choice([r.randrange(400), 9223372036854775700 + r.randrange(17)]))
    alone = lambda: "f#" + " ".join(f"id({r.choice([one(), 'plain', 'M.A.wordsX', 'words3'])})" for _ in range(r.choice([0, 1, 1, 2, 3])))
    rows = [(f"M{k % 7}", r.choice("AB"), k, [r.choice([near, alone])() for _ in range(r.randrange(4))]) for k in range(300)]
    rows += [("down", "A", 0, ["f#id(M.A.words9)..id(M.A.words3)"]), ("long", "A", 0, ["f#id(M.A.words5)..id(M.A.words100004)"]), ("nothing", "A", 0, [])]
    acts = spark.createDataFrame(rows, "meeting_id string, speaker string, doc_order long, refs array<string>")
    want = WR.resolved_refs(acts).groupBy("meeting_id").agg(F.count(F.lit(1)), F.countDistinct("word_id"), F.max("word_pos"))
    got = WR.reference_counts(acts)
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} and got.count() == 8
    assert got.where("meeting_id = 'long'").first()[1:] == (100_000, 100_000, 99_999)
    assert [t for _, t in got.dtypes] == [t for _, t in want.dtypes]


def by_hand(refs, words, meeting="M", speaker="A"):
    """Text of references, word by word."""
    import re

    out = []
    for href in refs:
        ids = re.findall(r"id\(([^)]+)\)", href)
        two = [re.fullmatch(r"(.+\.words)(\d+)", i) for i in ids]
        if len(ids) == 2 and ".." in href and all(two):
            ids = [f"{two[0][1]}{k}" for k in range(int(two[0][2]), int(two[1][2]) + 1)]
            ids = [i for i in ids if i in words]
        for i in ids:
            own = f"{meeting}.{speaker}.words{i.rsplit('words', 1)[1]}" if "words" in i else i
            if own in words or i in words:
                out.append(words.get(own, words.get(i)))
    return " ".join(out).strip()


@pytest.mark.parametrize("seed", range(3))
def test_references_of_all_kinds(spark, seed):
    r = random.Random(seed)
    names = [f"{stem}{k}" for stem in ("M.A.words", "N.A.words", "odd") for k in range(40) if r.random() < 0.8] + ["M.A.words007", "plain", "M.A.wordsX", "words3"]
    words = {n: f"{n}!" for n in names}

    def ref():
        one = lambda: f"{r.choice(['M.A.words', 'N.A.words', 'X.B.words', 'odd'])}{r.choice(['', '', '0'])}{r.randrange(45)}"
        ids = [f"id({r.choice([one(), one(), 'plain', 'M.A.words007', 'M.A.wordsX', 'words3', 'none'])})" for _ in range(r.choice([1, 2, 2, 2, 3]))]
        return "f.xml#" + r.choice(["..", "..", " "]).join(ids)

    acts = [[ref() for _ in range(r.randrange(0, 4))] for _ in range(60)]
    rows = spark.createDataFrame([("M", "A", k, a) for k, a in enumerate(acts)], "meeting_id string, speaker string, doc_order long, refs array<string>")
    table = spark.createDataFrame([("M", "A", n, t, 1.0, 2.0) for n, t in words.items()], "meeting_id string, speaker string, word_id string, text string, starttime double, endtime double")
    got = {x.doc_order: x.text for x in WR.act_texts(rows, table).collect()}
    assert got == {k: t for k, a in enumerate(acts) if (t := by_hand(a, words))}


@pytest.mark.parametrize("n", [10, 10_000])
def test_a_range_is_a_slice(spark, n):
    words = spark.range(12_000).select(F.lit("M").alias("meeting_id"), F.lit("A").alias("speaker"), F.concat(F.lit("M.A.words"), "id").alias("word_id"), F.concat(F.lit("w"), "id").alias("text"), (F.col("id") * 1.0).alias("starttime"), (F.col("id") + 0.5).alias("endtime"))
    acts = spark.createDataFrame([("M", "A", 0, [f"x#id(M.A.words5)..id(M.A.words{n + 4})"])], "meeting_id string, speaker string, doc_order long, refs array<string>")
    asked = WR._asked(acts).select(F.explode(F.sequence(F.floor(F.col("first") / WR.BLOCK), F.floor(F.col("last") / WR.BLOCK))))
    assert asked.count() <= n // WR.BLOCK + 2
    got = WR.act_texts(acts, words).first()
    assert got.text == " ".join(f"w{k}" for k in range(5, n + 5)) and (got.starttime, got.endtime) == (5.0, n + 4.5)


def test_array_of_a_million_rows(spark, tmp_path):
    path = f"file://{tmp_path}/a.json"
    sinks.write_array(spark.range(1_000_000).select("id", F.lit(None).cast("string").alias("none")), path, "id")
    back = files.read_array(spark, path, "id long, none string")
    assert back.agg(F.count("id"), F.sum("id"), F.max("id")).first() == (1_000_000, 499_999_500_000, 999_999)
    with open(f"{tmp_path}/a.json") as f:
        rows = json.load(f)
    assert [r["id"] for r in rows] == list(range(1_000_000)) and rows[0] == {"id": 0, "none": None}
    assert os.listdir(tmp_path) in (["a.json"], [".a.json.crc", "a.json"], ["a.json", ".a.json.crc"])


def test_arrays_of_few_rows(spark, tmp_path):
    for n, parts in ((0, 1), (1, 3), (2, 7)):
        sinks.write_array(spark.range(n).repartition(parts), f"file://{tmp_path}/a.json")
        assert sorted(r["id"] for r in json.loads((tmp_path / "a.json").read_text())) == list(range(n))


def test_statistics_are_stitched(spark, tmp_path):
    flat = P.final_samples(engine.sequences(spark, SF)).withColumn("meeting_id", F.concat("meeting_id", F.lit(' "é\\'))).persist()
    report.write_statistics(flat, f"file://{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == S.compiled(flat)
    report.write_statistics(flat.limit(0), f"file://{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text())["samples_per_meeting"] == {}


def test_copied_trees(spark, tmp_path):
    for name in ("in/a.txt", "in/sub/b.txt", "in/sub/deep/.hidden", "in/sub/_x", "in/sub/é 1.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    source, store, manifest = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/manifest"
    keys = {k: f for f, k in sinks.object_keys(source, "/p/")}
    got = sinks.copy_tree(spark, source, store, manifest, "/p/", tasks=3)
    assert {r.key for r in got.collect()} == set(keys) and got.where("error IS NOT NULL").count() == 0
    copied = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert copied == {k: open(f).read() for k, f in keys.items()}
    # Again: nothing is copied that is there, a changed file is, and so is one that failed.
    (tmp_path / "in/a.txt").write_text("changed")
    again = sinks.copy_tree(spark, source, store, manifest, "/p/", tasks=3)
    assert again.count() == len(keys) + 1 and (tmp_path / "out/p/a.txt").read_text() == "changed"
    with pytest.raises(ValueError):
        sinks.copy_tree(spark, f"{tmp_path}/in/a.txt", store, manifest)


def provider(folder, failing=()):
    """Answers prompts, notes them in a folder, and fails on those that are named."""

    def reply(prompt):
        with open(f"{folder}/{os.getpid()}", "a") as f:
            f.write(prompt + "\n")
        if prompt in failing:
            raise RuntimeError
        return f"re {prompt}"

    return reply


def calls(folder):
    return sorted(line for p in folder.iterdir() for line in p.read_text().splitlines())


def test_calls_are_taken_up_again(spark, tmp_path):
    import time

    first, second, store = tmp_path / "1", tmp_path / "2", f"file://{tmp_path}/store"
    first.mkdir(), second.mkdir()
    asked = spark.createDataFrame([(k, f"p{k % 20}") for k in range(60)], "idx long, prompt string")
    half = provider(str(first), [f"p{k}" for k in range(10)])
    I.ask_missing(asked, half, store, per_pause=3, pause=0.0, callers=3)
    assert calls(first) == sorted(f"p{k}" for k in range(20))
    assert I.answered(asked, store).count() == 30
    began = time.perf_counter()
    I.ask_missing(asked, provider(str(second)), store, per_pause=5, pause=0.5, callers=2)
    assert time.perf_counter() - began >= 1.0 and calls(second) == sorted(f"p{k}" for k in range(10))
    assert {(r.idx, r.reply) for r in I.answered(asked, store).collect()} == {(k, f"re p{k % 20}") for k in range(60)}


def test_command_line_keeps_replies(spark, tmp_path):
    given = ["--conversations", f"{SF}/conversations.parquet", "--output", f"{tmp_path}/out", "--reply-store", f"file://{tmp_path}/replies", "--pause", "0"]
    # Where tasks find it too.
    (tmp_path / "answers.py").write_text("def answer(prompt):\n    return f\"ADDRESSEES: {'ABCD'[len(prompt) % 4]}\\nCONFIDENCE: 9\"\n")
    spark.sparkContext.addPyFile(str(tmp_path / "answers.py"))
    cli.main([*given, "--provider", "answers:answer"])
    found = spark.read.json(f"{tmp_path}/out/sequences")
    n = found.count()
    assert found.where("source <> 'explicit'").count() > 0
    # Replies that are there serve a run without a provider.
    assert P.sequences(engine.acts(spark, SF), store=f"file://{tmp_path}/replies").count() == n
    with pytest.raises(SystemExit):
        cli.main(["--conversations", "x", "--output", "y", "--provider", "a:b"])


def test_a_long_reference_is_a_text_for_each_block(spark):
    """400 words of 13 blocks are 13 items of an act and not 400, whatever else the act refers to; and blocks of words are shuffled once, even if everyone is one speaker."""
    words = spark.range(1, 501).select(F.lit("M").alias("meeting_id"), F.lit("A").alias("speaker"), F.concat(F.lit("M.A.words"), "id").alias("word_id"), F.concat(F.lit("w"), "id").alias("text"), F.col("id").cast("double").alias("starttime"), (F.col("id") + 0.5).alias("endtime"))
    # One of its ids comes twice: the one that starts last counts.
    words = words.unionByName(words.where("text = 'w7'").withColumns({"starttime": F.lit(900.0), "text": F.lit("late")}))
    acts = spark.range(3).select(F.lit("M").alias("meeting_id"), F.lit("A").alias("speaker"), F.concat(F.lit("a"), "id").alias("dact_id"), F.col("id").alias("doc_order"), F.array(F.lit("M.A.words.xml#id(M.A.words1)..id(M.A.words400)")).alias("refs"))
    assert WR._pieces(acts, words).agg(F.sum(F.size("piece"))).first()[0] == 3 * 13
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = WR.act_texts(acts, words)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = " ".join("late" if k == 7 else f"w{k}" for k in range(1, 401))
    assert [(r.text, r.starttime, r.endtime) for r in got.collect()] == [(want, 1.0, 400.5)] * 3


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    """A file that write_array made is parted where its elements end; strings that look like ends, and files of other forms, are read as they are."""
    odd = ['"', "\n}", "},{", "]\n", "\\", "", None, "\u2028\r\n\t}"]
    schema = "n long, t string, a array<struct<t:string,k:int>>, m struct<x:array<int>>"
    want = [(k, odd[k % len(odd)], [(odd[(k + 1) % len(odd)], k)] * (k % 3), ([k],) if k % 5 else None) for k in range(4000)]
    path = f"file://{tmp_path}/array.json"
    sinks.write_array(spark.createDataFrame(want, schema).repartition(7), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = files.read_array(spark, path, schema)
        assert got.rdd.getNumPartitions() > 8
        assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.createDataFrame(want, schema).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = (tmp_path / "array.json").read_text()
    # Cut short, it fails as before; in another form it is parsed whole.
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_array(spark, f"file://{tmp_path}/cut.json", schema).collect()
    (tmp_path / "other.json").write_text(json.dumps(json.loads(text)))
    assert files.read_array(spark, f"file://{tmp_path}/other.json", schema).count() == len(want)


def test_points_with_near_turns_are_those_with_all(spark):
    """What decides a sample's signature and category is the same where a row holds the last turns only and their texts were normalised once."""
    found = engine.sequences(spark, SF)
    near = P.categorized(D.recent_points(found, 3))
    assert near.agg(F.max(F.size("context_turns"))).first()[0] == 3
    kinds = ["decision_point_id", "decision", "category", "turn_type", "target_is_addressed"]
    last = F.slice("context_turns", F.greatest(F.lit(1), F.size("context_turns") - 2), F.lit(3)).alias("context_turns")
    got = near.select(*kinds, "context_turns", "current_turn", U.signature(3, True).alias("signature"))
    want = P.samples(found).select(*kinds, last, "current_turn", U.signature(3).alias("signature"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    # No row that is made for each turn or speaker has the turns of its whole sequence.
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert not any("turns#" in line.partition("[")[2].partition("]")[0] for line in plan.splitlines() if "Generate explode" in line)


def shuffled(spark):
    """Bytes that this session has written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_texts_of_references_that_overlap_are_not_shuffled(spark):
    """A word goes to its shelf once, however many acts name it."""
    r = random.Random(3)
    words = spark.createDataFrame([("M", "A", f"M.A.words{k}", "".join(r.choices("abcdefghijklmnop", k=8)), k * 0.5, k * 0.5 + 0.25) for k in range(6000)], "meeting_id string, speaker string, word_id string, text string, starttime double, endtime double").repartition(4).persist()
    text = {x.word_id: x.text for x in words.collect()}
    ids = lambda a, b: f"f#id(M.A.words{a})..id(M.A.words{b})"
    # Every tenth word begins a reference of 400, some across the border of shelves; every other act has two.
    acts = {k: [ids(k, k + 399)] + [ids(k + 450, k + 460)] * (k % 20 == 0) for k in range(0, 5500, 10)}
    rows = spark.createDataFrame([("M", "A", k, a) for k, a in acts.items()], "meeting_id string, speaker string, doc_order long, refs array<string>").persist()
    assert rows.count() and words.count()
    before = shuffled(spark)
    got = {x.doc_order: (x.text, x.starttime, x.endtime) for x in WR.act_texts(rows, words).collect()}
    moved = shuffled(spark) - before
    want = {k: (" ".join(text[f"M.A.words{x}"] for a, b in [(k, k + 399), (k + 450, k + 460)][: 1 + (k % 20 == 0)] for x in range(a, b + 1)), k * 0.5 or 0.5, (k + (460 if k % 20 == 0 else 399)) * 0.5 + 0.25) for k in acts}
    assert got == want
    # Texts are 2 MB, words 60 KB.
    assert moved < 0.15 * sum(len(t) for t, _, _ in got.values())


@pytest.mark.parametrize("seed", range(2))
def test_references_across_shelves(spark, seed):
    """Around the borders of shelves, far beyond them, with ids twice, texts that are missing or empty or begin with space, and times of 0 or none: as word by word."""
    r = random.Random(seed)
    near = [*range(12), *range(4085, 4105), *range(4600, 4615), *range(8185, 8210), *range(12280, 12295)]
    words = {}
    rows = []
    for k in near:
        for _ in range(r.choice([0, 1, 1, 1, 2])):
            w = (r.choice([f"w{k}", f"w{k}", "", " x", " é　", None]), r.choice([0.0, None, k * 0.5, k * 0.25 + 1]), r.choice([0.0, None, k + 0.5, 3.0]))
            rows.append(("M", "A", f"M.A.words{k}", *w))
            rank = lambda w: (w[1] is not None, w[1] or 0.0, w[2] is not None, w[2] or 0.0, w[0] is not None, w[0] or "")
            words[k] = max(words.get(k, w), w, key=rank)
    place = lambda: max(0, r.choice(near) + r.randrange(-2, 3))
    ref = lambda: sorted((place(), place())) if r.random() < 0.6 else (lambda k: [k, k + r.randrange(600)])(place()) if r.random() < 0.8 else [place()]
    acts = [[ref() for _ in range(r.choice([0, 1, 1, 1, 2, 3]))] for _ in range(300)]
    table = spark.createDataFrame(rows, "meeting_id string, speaker string, word_id string, text string, starttime double, endtime double").repartition(5)
    form = lambda a: "f#" + "..".join(f"id(M.A.words{k})" for k in a)
    asked = spark.createDataFrame([("M", "A", k, [form(x) for x in a]) for k, a in enumerate(acts)], "meeting_id string, speaker string, doc_order long, refs array<string>")
    want = {}
    for k, a in enumerate(acts):
        found = [words[n] for x in a for n in range(x[0], x[-1] + 1) if n in words]
        if text := " ".join(t for t, _, _ in found if t is not None).strip():
            want[k] = (text, min((s for _, s, _ in found if s), default=0.0), max((e for _, _, e in found if e), default=0.0))
    got = [(x.doc_order, (x.text, x.starttime, x.endtime)) for x in WR.act_texts(asked, table).collect()]
    assert len(got) == len(want) > 150 and dict(got) == want
    # With few rows in a batch an act's rows, and a shelf's words, come in several.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [(x.doc_order, (x.text, x.starttime, x.endtime)) for x in WR.act_texts(asked, table).collect()]
        assert len(got) == len(want) and dict(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_files_of_samples_are_not_listed_by_the_driver(spark, tmp_path):
    """A file for each sample, in subfolders that tasks list: no name of a file reaches the driver, and rows are those that were written."""
    got = engine.QUERIES["file_per_sample"](spark, SF)
    assert got.inputFiles() == []
    want = engine.balanced_samples(spark, SF)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    odd = ['"', "\n}", "\\", "", None, "\u2028\r\n\t}", "é"]
    schema = "sample_id long, t string, a array<string>"
    rows = [(k, odd[k % len(odd)], [odd[(k + 1) % len(odd)]] * (k % 3)) for k in range(1, 251)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    for _ in range(2):  # a task that is run again puts the same files in place
        sinks.write_each(df, f"file://{tmp_path}/each", per_folder=100)
    assert sorted(os.listdir(tmp_path / "each")) == ["0", "1", "2"] and len(os.listdir(tmp_path / "each/1")) == 100
    assert json.loads((tmp_path / "each/2/200.json").read_text())["sample_id"] == 200
    (tmp_path / "each/1/.hidden.json").write_text("{")
    back = lambda folder: sorted(map(repr, files.read_each(spark, f"file://{tmp_path}/{folder}", schema).collect()))
    assert back("each") == sorted(map(repr, df.collect()))
    sinks.write_each(df, f"{tmp_path}/flat")
    assert back("flat") == back("each")
    (tmp_path / "each/1/broken.json").write_text("{")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        back("each")
