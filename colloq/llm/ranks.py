"""Ranks with ties in groups of any size: one global sort, summaries of its ranges, and what earlier ranges hold.

Rows are range-partitioned and sorted by group and full key, so neither a group nor a
run of ties has to fit into one task. Every range is scanned once: rows get their place, rank, dense rank and number of
ties as far as their range knows, and the range leaves a summary of fixed size (first and last key, rows, ties and distinct
pairs at its ends). The driver combines the summaries, one row for each range, from left to right, and from right to left for ties that go on; the second
pass adds to a row of a group or run that began in an earlier range, or goes on in a later one, what its neighbours hold.
The number of ranges is a setting (``ranges``, else ``spark.sql.shuffle.partitions``), not a function of the input.

Nulls come last in every key and equal each other. Equal rows are ranked separately. They are told apart by a
number of the input row, so that copies of one row are split between ranges as other rows are.

Defined results: an empty table gives no rows; without groups all rows are one; columns named pos, rank,
dense or tied are replaced, columns with other names are returned as they are; NaN equals NaN and follows all other numbers.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloq.llm.common import crc_mod, lean, plus, table, written

ADDED = "pos long, rank long, dense long, tied long, __range int, __first_group boolean, __first_run boolean, __last_run boolean, __summary string"
PLACES = ("pos", "rank", "dense", "tied")
ADDED_FIELDS = [*(pa.field(k, pa.int64()) for k in PLACES), pa.field("__range", pa.int32()), *(pa.field(k, pa.bool_()) for k in ("__first_group", "__first_run", "__last_run")), pa.field("__summary", pa.string())]


def _order(key: str) -> Column:
    """``name`` sorts upwards, ``-name`` downwards, nulls last."""
    return F.col(f"`{key[1:]}`").desc_nulls_last() if key[0] == "-" else F.col(f"`{key}`").asc_nulls_last()


def _changes(columns: list[pa.Array], last: list | None) -> np.ndarray:
    """For every row whether it differs from the row before; ``last`` is that of the first (None: there is none)."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[0] = last is None or any(_plain(c[0]) != x for c, x in zip(columns, last))
    for c in columns:
        a, b = c[:-1], c[1:]
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        same |= (pc.is_null(a).to_numpy(zero_copy_only=False)) & (pc.is_null(b).to_numpy(zero_copy_only=False))
        if pa.types.is_floating(c.type):
            nan = lambda x: pc.fill_null(pc.is_nan(x), False).to_numpy(zero_copy_only=False)
            same |= nan(a) & nan(b)
        out[1:] |= ~same
    return out


def _plain(value: pa.Scalar) -> str | None:
    """A key's value as text; equal values of one column have equal texts."""
    v = value.as_py()
    return None if v is None else "0.0" if v == 0.0 and isinstance(v, float) else str(v)


def _filled(marks: np.ndarray, values: np.ndarray, before: int) -> np.ndarray:
    """The value at the last mark up to each row, ``before`` where there is none yet. Values don't fall."""
    return np.maximum.accumulate(np.where(marks, values, before))


class _Scan:
    """One range, batch after batch. Only rows of the open run wait: those with a place up to ``top``, or, without it, all of them."""

    def __init__(self, part: int, groups: int, pairs: int, columns: list[int], top: int | None):
        self.part, self.groups, self.pairs, self.columns, self.top = part, groups, pairs, columns, top
        self.schema: pa.Schema | None = None
        self.n = self.group_start = self.run_start = 0
        self.run = self.group = self.group_run = -1
        self.first = self.last = None
        self.first_run = 0
        self.waiting: list[pa.RecordBatch] = []

    def feed(self, batch: pa.RecordBatch):
        own = [pa.field(batch.schema.names[c], batch.schema.types[c]) for c in self.columns]
        self.schema = self.schema or pa.schema([*own, *ADDED_FIELDS])
        keys = batch.columns[: self.groups + self.pairs]
        at = self.n + np.arange(batch.num_rows)
        began = self.last is None
        new_group = _changes(keys[: self.groups], self.last and self.last[: self.groups]) if self.groups else (at == 0)
        new_run = new_group | _changes(keys, self.last)
        if began:
            self.first = [_plain(k[0]) for k in keys]
        self.last = [_plain(k[-1]) for k in keys]
        run, group = self.run + np.cumsum(new_run), self.group + np.cumsum(new_group)
        group_start, run_start = _filled(new_group, at, self.group_start), _filled(new_run, at, self.run_start)
        group_run = _filled(new_group, run, self.group_run)
        # Runs that end within the batch: the open one first, if any.
        starts = at[new_run] if began else np.r_[self.run_start, at[new_run]]
        sizes, open_run = np.diff(starts), max(self.run, 0)
        if open_run == 0 and len(sizes):
            self.first_run = int(sizes[0])
        if self.waiting and len(sizes):
            yield from self.released(int(sizes[0]), False)
        pos = at - group_start + 1
        kept = np.ones(len(at), bool) if self.top is None else pos <= self.top
        closed = run - open_run < len(sizes)
        tied = np.append(sizes, 0)[np.minimum(run - open_run, len(sizes))]
        added = {"pos": pos, "rank": run_start - group_start + 1, "dense": run - group_run + 1, "tied": tied}
        rows = pa.RecordBatch.from_arrays(
            [*(batch.columns[c] for c in self.columns), *(pa.array(added[k], "int64") for k in PLACES), pa.array(np.full(len(at), self.part, "int32")),
             pa.array(group == 0), pa.array(run == 0), pa.array(np.zeros(len(at), bool)), pa.nulls(len(at), pa.string())],
            schema=self.schema,
        )
        if (now := kept & closed).any():
            yield rows.filter(pa.array(now))
        if (later := kept & ~closed).any():
            self.waiting.append(rows.filter(pa.array(later)))
        self.n += len(at)
        self.run, self.group, self.group_run = int(run[-1]), int(group[-1]), int(group_run[-1])
        self.group_start, self.run_start = int(group_start[-1]), int(run_start[-1])

    def released(self, tied: int, last: bool):
        """The rows that wait, now that their run has ended (in this range, if ``last``)."""
        for b in self.waiting:
            given = {"tied": pa.array(np.full(b.num_rows, tied), "int64"), "__last_run": pa.array(np.full(b.num_rows, last))}
            yield pa.RecordBatch.from_arrays([*b.columns[: len(self.columns)], *(given.get(f.name, c) for f, c in zip(ADDED_FIELDS, b.columns[len(self.columns) :]))], schema=self.schema)
        self.waiting = []

    def end(self):
        yield from self.released(self.n - self.run_start, True)
        if self.run == 0:
            self.first_run = self.n
        g = self.groups
        summary = {
            "rows": self.n - self.group_start, "dense": self.run - self.group_run + 1, "ties": self.n - self.run_start, "rank": self.run_start - self.group_start + 1,
            "one_group": self.group == 0, "one_run": self.run == 0, "first_ties": self.first_run,
            "first": [self.first[:g], self.first[g:]], "last": [self.last[:g], self.last[g:]],
        }
        given = {"__range": pa.array([self.part], "int32"), "__summary": pa.array([json.dumps(summary)])}
        yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(1, f.type)) for f in self.schema], schema=self.schema)


def combined(summaries: list[dict]) -> list[dict]:
    """For every range in order what earlier ranges hold of its first group and run, and later ones of its last run."""
    out, group, pair, rows, dense, ties, rank = [], None, None, 0, 0, 0, 0
    for s in summaries:
        goes_on = group is not None and group == s["first"][0]
        tied = goes_on and pair == s["first"][1]
        c = {"rows": rows if goes_on else 0, "dense": dense - tied if goes_on else 0, "ties": ties if tied else 0, "rank": rank if tied else 0, "later": 0}
        out.append(c)
        group, pair = s["last"]
        more = c["rows"] if s["one_group"] else 0
        rows, dense = s["rows"] + more, s["dense"] + (c["dense"] if s["one_group"] else 0)
        ties = s["ties"] + (c["ties"] if s["one_run"] else 0)
        rank = c["rank"] if s["one_run"] and tied else s["rank"] + more
    for k in range(len(out) - 2, -1, -1):
        nxt = summaries[k + 1]
        if summaries[k]["last"] == nxt["first"]:
            out[k]["later"] = nxt["first_ties"] + (out[k + 1]["later"] if nxt["one_run"] else 0)
    return out


def grouped_ranks(df: DataFrame, groups: list[str], pair: list[str], rest: list[str], top: int | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with pos, rank, dense and tied within ``groups``: those with a pos up to ``top`` (None: all).

    Rows of a group are in the order of ``pair``, then of ``rest`` (names, ``-name`` for downwards). pos counts rows,
    rank is that of the first row with an equal pair, dense counts pairs, and tied is how many rows of the group have the pair.
    """
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in df.columns if c not in PLACES]
    bare = [k.lstrip("-") for k in pair]
    keys = [F.col(f"`{c}`").alias(f"__key{i}") for i, c in enumerate([*groups, *bare])]
    rows = df.select(*keys, "*", F.monotonically_increasing_id().alias("__row"))
    order = [*(_order(f"__key{i}") for i in range(len(groups)))]
    order += [_order(("-" if k[0] == "-" else "") + f"__key{len(groups) + i}") for i, k in enumerate(pair)]
    order += [*map(_order, rest), F.col("__row").asc()]
    names = rows.columns
    places, sizes = [names.index(c) for c in columns], (len(groups), len(bare))
    schema = plus(df.select(*[f"`{c}`" for c in columns]), ADDED)
    schema = type(schema)([f.__class__(f.name, f.dataType, True) for f in schema.fields])

    def run(batches):
        from pyspark import TaskContext

        scan = _Scan(TaskContext.get().partitionId(), *sizes, places, top)
        for batch in batches:
            if batch.num_rows:
                yield from scan.feed(batch)
        if scan.schema:
            yield from scan.end()

    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = written(sorted_rows.mapInArrow(lean(run), schema), "ranges")
    # A row for each range; their number is a setting.
    found = sorted((r["__range"], json.loads(r["__summary"])) for r in seen.where("__summary IS NOT NULL").select("__range", "__summary").collect())
    carried = [(p, *c.values()) for (p, _), c in zip(found, combined([s for _, s in found]))]
    carry = spark.createDataFrame(carried, "__range int, __rows long, __dense long, __ties long, __rank long, __later long")
    rows = seen.where("__summary IS NULL").join(F.broadcast(carry), "__range")
    more = lambda c, flag: F.when(F.col(flag), F.col(c)).otherwise(0)
    rank = F.when(F.col("__first_run") & (F.col("__rank") > 0), F.col("__rank")).otherwise(F.col("rank") + more("__rows", "__first_group"))
    places = {
        "pos": F.col("pos") + more("__rows", "__first_group"),
        "rank": rank,
        "dense": F.col("dense") + more("__dense", "__first_group"),
        "tied": F.col("tied") + more("__ties", "__first_run") + more("__later", "__last_run"),
    }
    out = rows.select(*[f"`{c}`" for c in columns], *[c.alias(k) for k, c in places.items()])
    return out if top is None else out.where(F.col("pos") <= top)


def ranked_lines(lines: DataFrame) -> DataFrame:
    """sale_lines with their groups and keys as whole numbers."""
    month = 100 * F.year("shipped_at") + F.month("shipped_at")
    one = F.col("sale_id").isNotNull() & (crc_mod(F.col("sale_id"), 5) == 0)
    least = lambda c: F.when(one, -1).otherwise(c).cast("long")
    return lines.select(
        least(F.col("vendor_id")).alias("vendor_id"),
        least(F.coalesce(F.col("item_id") % 5, F.lit(-1))).alias("part"),
        least(F.coalesce(month, F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).alias("tens"),
        F.floor(100 * F.col("discount") + 0.5).alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"),
        F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"),
        F.floor(100 * F.col("amount") + 0.5).alias("amount_cents"),
    )


def op11_grouped_ranking(spark: SparkSession, sf_dir: str, top: int = 2) -> DataFrame:
    rows = ranked_lines(table(spark, sf_dir, "sale_lines"))
    found = grouped_ranks(rows, ["vendor_id", "part", "month"], ["-tens", "percent"], ["sale_id", "line_no", "quantity", "amount_cents"], top)
    return found.select("vendor_id", "part", "month", "pos", F.col("pos").alias("place"), "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


#: crc32 in DuckDB: the table follows from the polynomial, and texts are folded byte by byte.
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i] || repeat([0::BIGINT], 8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT range::BIGINT AS i FROM range(256)))"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text, with crc_table.t in scope."""
    byte = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {byte}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH {CRC_TABLE},
one AS (SELECT sale_id FROM (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL), crc_table WHERE {crc_sql("sale_id::VARCHAR")} % 5 = 0),
r AS (
  SELECT CASE WHEN o.sale_id IS NOT NULL THEN -1 ELSE vendor_id END AS vendor_id,
    CASE WHEN o.sale_id IS NOT NULL THEN -1 ELSE coalesce(item_id % 5, -1) END AS part,
    CASE WHEN o.sale_id IS NOT NULL THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS month,
    floor(quantity / 10)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent,
    l.sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines l LEFT JOIN one o ON l.sale_id = o.sale_id),
p AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST,
      line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
  FROM r)
SELECT vendor_id::BIGINT AS vendor_id, part::BIGINT AS part, month::BIGINT AS month, pos, pos AS place, sale_id, line_no, quantity, percent, amount_cents, tied
FROM p WHERE pos <= 2
"""
