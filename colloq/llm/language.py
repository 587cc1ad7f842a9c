"""Language identification: script ranges, then Viterbi over words with a switching penalty.

A word is a run of letters and their marks. Its script, by ranges of code points, leaves the languages
that use that script as candidates. Each candidate has a score for the word: the log
probability of its letter trigrams under the language's counts. Viterbi finds the
labels of all words that maximise the sum of scores less ``SWITCH`` for each change
of language, so that a text of several languages falls into spans. The text's
language is the one whose spans hold most letters (of equals, the first by name).

The counts come from a sample of at most about ``MAX_LETTERED`` documents per
language, by a hash of the id; every language is learned. Counts are summed on the executors in ``MODEL_CELLS`` cells at most for all languages together (``CELLS`` for
each of them, or as many fewer as there are more languages), which bounds what is collected and broadcast. Scores are made for
``SLICE`` words at a time and of the ways only a bit for each word and language is kept, so a very long text in many languages takes little memory.

Defined results: a null text or one without letters is ``und`` with score 0, as is every
text if nothing could be learned; words of a script that no learned language uses keep all
languages as candidates; of two ways with equal sums the one that stays in its language wins, and else the first by name;
a very long text is one sequence; spans count code points of the text as given; repeated rows agree; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import crc_mod, plus, table
from colloq.llm.shingles import blocks, mix

#: Documents to learn a language from, about: a share of each language by a hash.
MAX_LETTERED = 1500
#: Cells of trigrams for one language (a power of two), and for all together; with more than 64 languages each has fewer.
CELLS = 1 << 16
MODEL_CELLS = 1 << 22
#: Scores (words times languages) that are made at once.
SLICE = 1 << 20
SWITCH = 12.0
#: First code points of scripts' ranges and the scripts (fixed values of Unicode blocks).
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])
#: Categories of the code points of the basic plane: 1 are letters, 2 marks; those beyond it are asked one by one.
KINDS = np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(k))[0], 0) for k in range(0x10000)], "uint8")


def _letters(raw: np.ndarray) -> np.ndarray:
    """Whether code points belong to words: letters, and marks that follow a letter or its marks."""
    kind = KINDS[np.minimum(raw, 0xFFFF)]
    far = raw > 0xFFFF
    if far.any():
        some, at = np.unique(raw[far], return_inverse=True)
        kind[far] = np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in some], "uint8")[at]
    bearer = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), 0))
    return kind[bearer] == 1


def folded(text: str) -> str:
    """In lower case, code point by code point: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


class Words:
    """Words of a block of texts: their text, first and last letter, script, and trigram cells."""

    def __init__(self, texts: list[str | None]):
        low = [folded(t or "") for t in texts]
        raw = np.frombuffer(("\n" + "".join(t + "\n" for t in low)).encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters(raw)
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start, self.stop = edge[::2], edge[1::2]
        ends = np.cumsum([1, *(len(t) + 1 for t in low)])
        self.bounds = np.searchsorted(self.start, ends)
        code = np.where(letter, raw, 0).astype("uint64")
        at = np.flatnonzero(letter)
        self.cell = (mix((code[at - 1] << np.uint64(42)) + (code[at] << np.uint64(21)) + code[at + 1]) % np.uint64(CELLS)).astype("int64")
        self.size = self.stop - self.start
        self.first = np.cumsum(self.size) - self.size
        self.script = _SCRIPT[np.searchsorted(_FIRST, raw[self.start], "right") - 1]


def cells_for(languages: int) -> int:
    """Cells for each of so many languages: ``CELLS``, halved until all fit into ``MODEL_CELLS``, but 64 at least."""
    cells = CELLS
    while cells > 64 and cells * languages > MODEL_CELLS:
        cells //= 2
    return cells


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: by cell and language; scripts: words by script and language."""
        self.langs, self.cells = langs, len(counts)
        total = counts.sum(0, keepdims=True)
        self.log = np.log((counts + 0.5) / (total + 0.5 * self.cells)).astype("float32")
        share = scripts / np.maximum(1, scripts.sum(0, keepdims=True))
        self.uses = share >= 0.001
        self.uses[~self.uses.any(1)] = True

    def scores(self, words: Words, chosen: np.ndarray) -> np.ndarray:
        """Of some words by number and of every language."""
        size = words.size[chosen]
        first = np.cumsum(size) - size
        letter = np.repeat(words.first[chosen] - first, size) + np.arange(int(size.sum()))
        out = np.add.reduceat(self.log[words.cell[letter] % self.cells], first, axis=0)
        out[~self.uses[words.script[chosen]]] = -1e9
        return out

    def labels(self, words: Words) -> np.ndarray:
        """The language of every word, by number."""
        n, size = np.diff(words.bounds), len(self.langs)
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        begin, left = words.bounds[:-1][order], n[order]
        steps = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(steps), "left")  # texts with a word at this step
        best = np.zeros((len(order), size), "float32")
        stayed = np.empty((len(words.start), -(-size // 8)), "uint8")
        above = np.empty(len(words.start), "int32")
        at, most = 0, max(1, SLICE // size)
        while at < steps:
            # As many steps as have about so many words.
            to = at + max(1, int(np.searchsorted(np.cumsum(active[at : at + most]), most, "right")))
            to = min(to, steps)
            rows = [begin[: int(active[t])] + t for t in range(at, to)]
            score = self.scores(words, np.concatenate(rows))
            done = 0
            for own in rows:
                m = len(own)
                b = best[:m]
                top = b.argmax(1)
                switched = np.take_along_axis(b, top[:, None], 1) - np.float32(SWITCH)
                stay = b >= switched
                stayed[own], above[own] = np.packbits(stay, axis=1), top
                best[:m] = np.where(stay, b, switched) + score[done : done + m]
                best[:m] -= best[:m].max(1, keepdims=True)
                done += m
            at = to
        out = np.empty(len(words.start), "int64")
        now = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            m = int(active[t])
            own, label = begin[:m] + t, now[:m]
            out[own] = label
            kept = (stayed[own, label >> 3] >> (7 - (label & 7)).astype("uint8")) & 1
            now[:m] = np.where(kept, label, above[own])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Languages, scores (the share of letters in spans of that language) and spans (first, end, language) of code points."""
        words = Words(texts)
        if not len(words.start) or not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
        label = self.labels(words)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        total = np.bincount(owner, words.size, len(texts))
        # Letters of each (text, language) that occurs; the first of a text's largest has the first name.
        pair, of = np.unique(owner * len(self.langs) + label, return_inverse=True)
        letters = np.bincount(of, words.size)
        best = np.lexsort((pair, -letters, pair // len(self.langs)))
        text, head = np.unique((pair // len(self.langs))[best], return_index=True)
        pick, most = np.zeros(len(texts), "int64"), np.zeros(len(texts))
        pick[text], most[text] = (pair % len(self.langs))[best[head]], letters[best[head]]
        lang = [self.langs[k] if n else "und" for k, n in zip(pick, total)]
        score = most / np.maximum(total, 1)
        new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[new[1:], len(label)] - 1
        base = np.cumsum([1, *(len(t or "") + 1 for t in texts)])
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for a, b in zip(new.tolist(), last.tolist()):
            k = int(owner[a])
            spans[k].append((int(words.start[a] - base[k]), int(words.stop[b] - base[k]), self.langs[label[a]]))
        return lang, np.round(score, 6), spans


def fit(docs: DataFrame, most: int = MAX_LETTERED) -> Model:
    """Learns from documents (doc_id, text, lang), about ``most`` of each language."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    cells = cells_for(len(langs))
    if not langs:
        return Model([], np.zeros((cells, 0)), np.zeros((len(SCRIPT_NAMES), 0)))
    # A row for each language.
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, most / sizes[k])) for k in langs], "lang string, share double")
    known = known.join(F.broadcast(shares), "lang")
    chosen = known.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(0))), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    number = {k: i for i, k in enumerate(langs)}

    def run(batches):
        seen = np.zeros(len(langs) * cells, "int64")
        scripts = np.zeros((len(SCRIPT_NAMES), len(langs)), "int64")
        for (lang,), texts in blocks(batches):
            words = Words(texts)
            n = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
            of = np.array([number[k] for k in lang], "int64")[n] if len(n) else n
            np.add.at(scripts, (words.script, of), 1)
            seen += np.bincount(np.repeat(of, words.size) * cells + words.cell % cells, minlength=len(seen))
        for k in np.flatnonzero(scripts.any(0)).tolist():
            counts = seen[k * cells : (k + 1) * cells]
            cell, used = np.flatnonzero(counts), np.flatnonzero(scripts[:, k])
            n = len(cell) + len(used)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, k, "int32")), pa.array(np.r_[cell, cells + used].astype("int32")), pa.array(np.r_[counts[cell], scripts[used, k]])], ["k", "cell", "n"]
            )

    # As many rows as there are cells and languages, whatever the input.
    sums = chosen.select("lang", "text").mapInArrow(run, "k int, cell int, n long").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    k, cell, n = (sums[c].to_numpy() for c in ("k", "cell", "n"))
    counts, scripts = np.zeros((cells, len(langs))), np.zeros((len(SCRIPT_NAMES), len(langs)))
    word = cell >= cells
    counts[cell[~word], k[~word]] = n[~word]
    scripts[cell[word] - cells, k[word]] = n[word]
    return Model(langs, counts, scripts)


def identify(docs: DataFrame, model: Model, with_spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred and score (and spans), replacing columns of those names."""
    docs = docs.drop("lang_pred", "score", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            lang, score, spans = [], [], []
            # Texts of like length share a block, as Viterbi steps through a block's texts side by side.
            texts = batch["text"].to_pylist()
            order = sorted(range(len(texts)), key=lambda k: len(texts[k] or ""))
            for _, block in blocks([pa.RecordBatch.from_arrays([pa.array([texts[k] for k in order], pa.string())], ["text"])], 1 << 20):
                a, b, c = shared.value.predict(block)
                lang, score, spans = lang + a, [*score, *b], spans + c
            back = np.empty(len(order), "int64")
            back[order] = np.arange(len(order))
            new = [pa.array([lang[k] for k in back]), pa.array([float(score[k]) for k in back], pa.float64())]
            if with_spans:
                new.append(pa.array([[dict(zip(("first", "end", "lang"), s)) for s in spans[k]] for k in back], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "lang_pred", "score", *["spans"] * with_spans])

    fields = "lang_pred string, score double" + ", spans array<struct<first:int,end:int,lang:string>>" * with_spans
    return docs.mapInArrow(run, plus(docs, fields))


def op2_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["lang"], s["first"], s["end"])), ",")
    return identify(docs.select("doc_id", "text"), model, with_spans=True).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", joined.alias("spans")
    )
