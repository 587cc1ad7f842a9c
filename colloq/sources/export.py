"""The annotated corpus layout as a sink: what ``colloq.sources.corpus`` reads."""

from __future__ import annotations

import os
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloq.functions.text import tokens

ROOT = '<nite:root xmlns:nite="http://nite.sourceforge.net/">'
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
#: Seconds from word to word, and of a word.
STEP, LENGTH = 0.25, 0.125


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")


def _words(joined: str) -> list[str]:
    """An act's words come as one text, as they hold no spaces: one value is cheaper to hand to Python than one for each."""
    return joined.split(" ") if joined else []


def _word_file(name: str, acts) -> str:
    out, n = [], 0
    for idx, begin, _, words in acts:
        for k, w in enumerate(_words(escape(words))):
            n += 1
            start = begin + k * STEP
            out.append(f'<w nite:id="{name}.words{n}" starttime="{start!r}" endtime="{start + LENGTH!r}">{w}</w>')
        out.append(f'<vocalsound nite:id="{name}.sound{idx}" starttime="{begin!r}"/>')
    return HEAD + ROOT + "\n".join(out) + "</nite:root>"


def _act_file(name: str, speaker: str, acts) -> str:
    out, n = [], 0
    for k, (_, _, addressee, words) in enumerate(acts):
        first, last = n + 1, n + len(_words(words))
        n = last
        ref = f"{name}.words.xml#id({name}.words{first})" + (f"..id({name}.words{last})" if last > first else "")
        # White space around addressees, and the empty attribute, are there to be read as the corpus has them.
        to = (" " if k % 3 == 0 else "") + ",".join(addressee) if addressee else ""
        attribute = f" addressee={quoteattr(to)}" if addressee or speaker == "E" else ""
        child = f"<nite:child href={quoteattr(ref)}/>" if last >= first else ""
        out.append(f"<dact nite:id={quoteattr(f'{name}.{k}')}{attribute}>{child}</dact>")
    return HEAD + ROOT + "\n".join(out) + "</nite:root>"


def write_corpus(acts: DataFrame, folder: str) -> None:
    """Meetings, words and acts of a timeline as XML in a folder that all tasks see; one speaker of a meeting is one task's work."""
    rows = acts.select("meeting_id", "speaker", "idx", F.col("starttime").cast("double").alias("starttime"), "addressee", F.array_join(tokens(F.col("text")), " ").alias("words"))
    people = rows.groupBy("meeting_id", "speaker").agg(F.sort_array(F.collect_list(F.struct("idx", "starttime", "addressee", "words"))).alias("acts"))

    def write(part):
        store, base = _store(folder)
        for sub in ("words", "dialogueActs"):
            store.create_dir(f"{base}/{sub}", recursive=True)
        for r in part:
            name = f"{r.meeting_id}.{r.speaker}"
            for path, body in ((f"words/{name}.words.xml", _word_file(name, r.acts)), (f"dialogueActs/{name}.dialog-act.xml", _act_file(name, r.speaker, r.acts))):
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(body.encode())

    def write_meetings(part):
        store, base = _store(folder)
        store.create_dir(f"{base}/corpusResources", recursive=True)
        with store.open_output_stream(f"{base}/corpusResources/meetings.xml") as out:
            out.write((HEAD + ROOT).encode())
            for r in part:
                who = "".join(f"<speaker nxt_agent={quoteattr(s)} global_name={quoteattr(r.meeting_id + s)} role={quoteattr('role ' + s)}/>" for s in r.speakers)
                out.write(f"<meeting observation={quoteattr(r.meeting_id)}>{who}</meeting>\n".encode())
            out.write(b"</nite:root>")

    people.foreachPartition(write)
    rows.groupBy("meeting_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers")).coalesce(1).foreachPartition(write_meetings)
