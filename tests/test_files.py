"""Sources and sinks: XML, JSON, reports, the command line, a stream."""

import json
from dataclasses import replace
from pathlib import Path

import pytest
from colloq import cli
from colloq.config import DEFAULT
from colloq.operators import sequences as Q
from colloq.plans import pipeline as P
from colloq.queries import engine
from colloq.sources import corpus, files, sinks
from colloq.streaming import live
from pyspark.sql import functions as F

from conftest import SF

NS = 'xmlns:nite="http://nite.sourceforge.net/"'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    for sub in ("corpusResources", "words", "dialogueActs"):
        (d / sub).mkdir()
    (d / "corpusResources/meetings.xml").write_text(
        f'<r {NS}><meeting observation="M1"><speaker nxt_agent="A" global_name="g1" role="PM"/><speaker nxt_agent="B"/><speaker global_name="x"/></meeting>'
        '<meeting><speaker nxt_agent="Z"/></meeting></r>'
    )
    words = "".join(f'<w nite:id="M1.A.words{k}" starttime="{k * 1.5}" endtime="{k * 1.5 + 1}">w{k}</w>' for k in range(6))
    words = words.replace('<w nite:id="M1.A.words3"', '<vocalsound nite:id="M1.A.words3"').replace(">w3</w>", ">w3</vocalsound>")
    (d / "words/M1.A.words.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?><r {NS}>{words}<w nite:id="M1.A.words9">late</w></r>')
    (d / "words/M1.B.words.xml").write_text(f'<r {NS}><w nite:id="M1.B.words0" starttime="20" endtime="21">yes</w></r>')
    act = lambda k, to, ref: f'<dact nite:id="a{k}"{to}><nite:child href="{ref}"/></dact>'
    (d / "dialogueActs/M1.A.dialog-act.xml").write_text(
        f'<?xml version="1.0" encoding="UTF-8"?>\n<r {NS}>'
        + act(0, ' addressee="B"', "f#id(M1.A.words0)..id(M1.A.words4)") + act(1, "", "f#id(M1.A.words9)") + act(2, ' addressee=""', "f#id(M1.A.words4)..id(M1.A.words1)") + '<dact nite:id="a3"/>' + "</r>"
    )
    (d / "dialogueActs/M1.B.dialog-act.xml").write_text(f'<r {NS}>{act(0, "", "f#id(M1.B.words0)")}</r>')
    (d / "dialogueActs/M2.A.dialog-act.xml").write_text(f'<r {NS}>{act(0, "", "f#id(M2.A.words0)")}</r>')
    return str(d)


def test_corpus(spark, folder):
    who = {(r.meeting_id, r.speaker): (r.participant_id, r.role) for r in corpus.meeting_speakers(spark, folder).collect()}
    assert who == {("M1", "A"): ("g1", "PM"), ("M1", "B"): (None, None)}
    refs = corpus.act_refs(spark, folder)
    assert [r.meeting_id for r in corpus.annotated_meetings(refs).collect()] == ["M1"]
    rows = {(r.speaker, r.dact_id): r for r in P.corpus_acts(spark, folder).collect()}
    assert set(rows) == {("A", "a0"), ("A", "a1"), ("B", "a0")}
    first = rows["A", "a0"]
    assert (first.text, first.starttime, first.endtime, first.addressee) == ("w0 w1 w2 w4", 1.5, 7.0, ["B"])
    assert (rows["A", "a1"].text, rows["A", "a1"].starttime) == ("late", 0.0)
    assert rows["A", "a1"].idx == 0 and rows["A", "a0"].idx == 1
    found = Q.explicit_sequences(P.corpus_acts(spark, folder)).first()
    assert found.sequence_id == "M1_seq0" and found.response.text == "yes"
    with pytest.warns(UserWarning):
        assert corpus.meeting_speakers(spark, folder + "/words").count() == 0


def test_corpus_is_listed_once_and_acts_are_parsed_once(spark, tmp_path):
    """No job lists files one by one, however many they are, and only the table of acts is read again."""
    for sub, name, body in (("words", "words", '<w nite:id="M{k}.A.words1" starttime="1" endtime="2">w{k}</w>'), ("dialogueActs", "dialog-act", '<dact nite:id="a" addressee="B"><nite:child href="f#id(M{k}.A.words1)"/></dact>')):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "notes.xml").write_text("not XML")
        for k in range(40):
            (tmp_path / sub / f"M{k}.A.{name}.xml").write_text(f"<r {NS}>{body.replace('{k}', str(k))}</r>")
    spark.sparkContext.setJobGroup("listing", "listing")
    words, refs = corpus.words(spark, str(tmp_path)), corpus.act_refs(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("listing")) == 0
    assert words.count() == refs.count() == 40
    acts = P.corpus_acts(spark, str(tmp_path), replace(DEFAULT, meeting_limit=None))
    assert "binaryFile" not in acts._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.meeting_id, r.text) for r in acts.collect()} == {(f"M{k}", f"w{k}") for k in range(40)}


def test_json_round_trip(spark, tmp_path):
    found = engine.sequences(spark, SF)
    sinks.write_lines(found, f"{tmp_path}/lines", "meeting_id", "sequence_id")
    back = files.read(spark, f"{tmp_path}/lines", files.SEQUENCES)
    assert back.exceptAll(found).count() == 0 and back.count() == found.count()
    sinks.write_array(found.limit(3), f"{tmp_path}/a.json")
    assert files.read(spark, f"{tmp_path}/a.json", files.SEQUENCES).count() == 3
    Path(f"{tmp_path}/b.jsonl").write_text('\n{"sample_id": 1}\n\n')
    assert files.read(spark, f"{tmp_path}/b.jsonl", files.INTERMEDIATE).count() == 1
    flat = P.final_samples(found).persist()
    sinks.write_each(flat, f"{tmp_path}/each")
    assert len(list(Path(f"{tmp_path}/each").glob("*.json"))) == flat.count()
    assert json.loads(Path(f"{tmp_path}/each/1.json").read_text())["sample_id"] == 1
    assert sinks.size_report(spark, f"file://{tmp_path}/lines", found.count())[1] > 0
    assert sinks.size_report(spark, f"file://{tmp_path}/each", 0)[1] is None


def test_keys_and_upload(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("a")
    (tmp_path / "in/sub/b.txt").write_text("b")
    assert [k for _, k in sinks.object_keys(str(tmp_path / "in"), "/p/")] == ["p/a.txt", "p/sub/b.txt"]
    assert [k for _, k in sinks.object_keys(str(tmp_path / "in"))] == ["a.txt", "sub/b.txt"]
    with pytest.raises(ValueError):
        list(sinks.object_keys(str(tmp_path / "none")))
    assert sinks.upload(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", "p") == ["p/a.txt", "p/sub/b.txt"]
    assert (tmp_path / "out/p/sub/b.txt").read_text() == "b"


def test_command_line(spark, tmp_path):
    cli.main(["--conversations", f"{SF}/conversations.parquet", "--output", str(tmp_path)])
    report = json.loads((tmp_path / "data_statistics.json").read_text())
    assert report["dataset_overview"]["total_samples"] == json.loads((tmp_path / "filtering_summary.json").read_text())["total_samples"] == 242
    text = (tmp_path / "sample_examples.txt").read_text()
    assert "I1: Direct address" in text and "Example 1:" in text
    lines = spark.read.json(f"{tmp_path}/training_data_formatted")
    assert lines.count() == 242 and lines.where(F.col("text").startswith("<|system|>")).count() == 242


def test_calls_rest_and_use_the_options(spark):
    import time

    from colloq.operators import inference as I

    seen = spark.createDataFrame([(k, f"p{k}") for k in range(4)], "idx long, prompt string").coalesce(1)
    provider = I.client(lambda prompt, **options: None if prompt == "p3" else f"{prompt} {sorted(options.items())}")
    began = time.perf_counter()
    got = {r.idx: r.reply for r in I.call(seen, provider, per_pause=1, pause=0.5).collect()}
    assert time.perf_counter() - began >= 1.5 and set(got) == {0, 1, 2}
    assert got[0] == "p0 [('max_output_tokens', 500), ('temperature', 0), ('top_k', 20), ('top_p', 0.8)]"


def test_stream(spark, tmp_path):
    found = engine.sequences(spark, SF)
    found.union(found).write.json(f"{tmp_path}/in")
    query = live.write_samples(live.sample_stream(live.sequence_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(300)
    assert spark.read.json(f"{tmp_path}/out").count() == 342


def test_entry_without_corpus_operators(tmp_path):
    """The rest imports and lists its queries where the corpus subpackage isn't there."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "colloq", tmp_path / "colloq", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[0] == str(len(engine.QUERIES))
