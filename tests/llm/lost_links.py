"""python tests/llm/lost_links.py TABLES N: links of 80 % between N-word shingle sets that near_duplicates leaves between components.

Exact: every such pair shares one of the rarest fifth of its words' runs, and no other code of the operator is used.
For measuring on the check's tables (README); the tests hold the same on small ones.
"""

import re
import sys
import time

import duckdb
import numpy as np


def sets_of(texts, n):
    """Sorted distinct run numbers of each text, and how many there are."""
    seen, words, ends = {}, [], [0]
    for t in texts:
        found = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        words.extend(seen.setdefault(w, len(seen)) for w in found)
        ends.append(len(words))
    words, ends = np.array(words, "int64"), np.array(ends)
    runs = words
    for k in range(1, n):
        runs = np.unique(runs[:-1] * len(seen) + words[k:], return_inverse=True)[1]
    # Texts of fewer words than n are one run of their own, told apart by the text.
    short, own = {}, int(runs.max()) + 1
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(np.array([own + short.setdefault(tuple(words[a:b]), len(short))]))
        else:
            out.append(runs[:0])
    return out, own + len(short)


def lost(texts, component, n):
    """(distinct sets, components among them, pairs compared, lost links)."""
    sets, size = sets_of(texts, n)
    first = {}
    for k, s in enumerate(sets):
        if len(s):
            first.setdefault((s.tobytes(), component[k]), k)
    kept = list(first.values())
    sets, component = [sets[k] for k in kept], np.array([component[k] for k in kept])
    often = np.bincount(np.concatenate(sets), minlength=size)
    rare, owner = [], []
    for k, s in enumerate(sets):
        take = len(s) - -(-4 * len(s) // 5) + 1
        rare.append(s[np.argsort(often[s], kind="stable")[:take]])
        owner.append(np.full(take, k))
    rare, owner = np.concatenate(rare), np.concatenate(owner)
    order = np.argsort(rare, kind="stable")
    rare, owner = rare[order], owner[order]
    edges = np.flatnonzero(np.r_[True, rare[1:] != rare[:-1], True])
    pairs = set()
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2 or (component[owner[a:b]] == component[owner[a]]).all():
            continue
        at = owner[a:b]
        length = np.array([len(sets[k]) for k in at])
        for j in range(len(at) - 1):
            near = (component[at[j + 1 :]] != component[at[j]]) & (5 * np.minimum(length[j + 1 :], length[j]) >= 4 * np.maximum(length[j + 1 :], length[j]))
            pairs.update((int(at[j]), int(k)) for k in at[j + 1 :][near])
    links = 0
    for x, y in pairs:
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        links += 100 * shared >= 80 * (len(sets[x]) + len(sets[y]) - shared)
    return len(sets), len(set(component.tolist())), len(pairs), links


def main(folder, n):
    from colloq.llm.common import table
    from colloq.llm.near_dup import near_duplicates
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    started = time.time()
    got = dict(near_duplicates(table(spark, folder, "documents"), n).select("doc_id", "component_id").toPandas().itertuples(index=False))
    spark.stop()
    print(f"{len(got)} documents in {len(set(got.values()))} components, {time.time() - started:.0f} s", flush=True)
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet{'/*.parquet' if not folder.split('/')[-1].startswith('sf') else ''}'").fetchall()
    print(folder, n, "distinct sets, components, pairs compared, lost links:", lost([t for _, t in rows], [got[i] for i, _ in rows], n))


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]))
