"""Top N of every group from sorted runs: bucketed runs, a loser-tree merge, and a seek past each finished group.

Every task sorts its rows by bucket, group and rank order and keeps of each group what can still be
among its N (a run); the runs of one bucket are merged by a loser tree whose leaves are group
blocks, and once a group has its N the rest of its rows are skipped in every run by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows sorted into one run; rows of a run that the merge reads at once.
RUN_ROWS, READ_ROWS = 250_000, 2_000

RUNS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("run", T.BinaryType())])


class LoserTree:
    """Tournament over k sorted runs: winner() is the run with the least head, replay(i) after run i moved on."""

    def __init__(self, heads: list):
        self.k = max(1, len(heads))
        self.heads = heads  # None: the run is exhausted
        self.losers = [-1] * self.k
        self.best = self._build(1) if heads else -1

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def winner(self) -> int:
        return self.best if self.best >= 0 and self.heads[self.best] is not None else -1

    def replay(self, i: int, head) -> None:
        self.heads[i] = head
        node, win = (i + self.k) // 2, i
        while node >= 1:
            if self._less(self.losers[node], win):
                self.losers[node], win = win, self.losers[node]
            node //= 2
        self.best = win


class Run:
    """A sorted run that is read batch by batch: the head row, the next one, and the first of a later group.

    batches gives lists of rows (group, rank order, ..).
    """

    def __init__(self, batches: Iterator[list[tuple]]):
        self.batches, self.rows, self.at = iter(batches), [], 0
        self._fill()

    def _fill(self) -> None:
        while self.rows is not None and self.at >= len(self.rows):
            self.rows, self.at = next(self.batches, None), 0

    @property
    def head(self) -> tuple | None:
        return None if self.rows is None else self.rows[self.at]

    def advance(self) -> None:
        self.at += 1
        self._fill()

    def seek(self, group) -> None:
        """Past all rows of the group: whole batches first, then by binary search."""
        while self.rows is not None and self.rows[-1][0] <= group:
            self.at = len(self.rows)
            self._fill()
        if self.rows is None:
            return
        lo, hi = self.at, len(self.rows)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.rows[mid][0] <= group:
                lo = mid + 1
            else:
                hi = mid
        self.at = lo


def merge_runs(runs: list[Run], n: int) -> Iterator[tuple]:
    """Rows (group, rank order, ..) of sorted runs, the first n different items of every group."""
    tree = LoserTree([r.head for r in runs])
    group, given, last = None, 0, None
    while (i := tree.winner()) >= 0:
        row = runs[i].head
        if row[0] != group:
            group, given, last = row[0], 0, None
        if given < n and row[1] != last:
            given, last = given + 1, row[1]
            yield row
        if given >= n:
            runs[i].seek(group)
        else:
            runs[i].advance()
        tree.replay(i, runs[i].head)


def _descending(text: pd.Series) -> np.ndarray:
    """Codes that order strings from greatest to least by code point, as Spark and SQL do for UTF-8."""
    raw = text.map(lambda s: s.encode("utf-8", "surrogatepass"))
    return -np.unique(raw.to_numpy(dtype=object), return_inverse=True)[1]


def sorted_run(t: pa.Table, n_keys: int, n: int) -> pd.DataFrame:
    """A run: rows sorted by bucket, group, score, label and id, each group cut to its first n different ids."""
    df = t.to_pandas()
    names = list(df.columns)
    groups = df.groupby(names[1 : 1 + n_keys], sort=True, dropna=False).ngroup().to_numpy()
    score, label, item = df["score"].to_numpy(), df["label"], df["item"].to_numpy()
    tie = _descending(label)
    order = np.lexsort((-item, tie, -score, groups, df["bucket"].to_numpy()))
    g, s, i, e = groups[order], score[order], item[order], tie[order]
    same = np.append(False, (g[1:] == g[:-1]) & (s[1:] == s[:-1]) & (i[1:] == i[:-1]) & (e[1:] == e[:-1]))  # a row sent again
    order, g = order[~same], g[~same]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    place = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return df.iloc[order[place < n]]


#: Bytes that order UTF-8 texts from greatest to least: each byte's complement, the lowest two by an escape below the end mark.
_DOWN = [bytes([255 - b]) for b in range(256)]
_DOWN[0], _DOWN[1], _END = b"\xfe\x01", b"\xfe\x00", b"\xff"


def _down(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return b"".join(_DOWN[b] for b in raw) + _END


def top_n(df: DataFrame, keys: list[str], score: str, label: str, item: str, n: int, buckets: int | None = None, version: str | None = None) -> DataFrame:
    """keys, item, score, label, place: the n rows of each group with the highest score.

    Equal scores are ordered by the greater label (by code point), then by the greater item. Rows
    whose score is null or NaN, or whose item is null, are left out; a null label counts as empty
    text; null keys form a group of their own; a row sent again (same group, score, label and item)
    counts once. With version (a column) an item counts once whatever it was sent with before: of its
    rows the one of the greatest version is taken, null being the least. An empty table gives an empty
    result. However large a group, a task sends at most n rows of it for each run of RUN_ROWS rows;
    the merge holds the compressed runs of one bucket and a batch of rows of each.
    """
    if version:
        cols = list(dict.fromkeys([*keys, score, label]))
        newest = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])).alias("_row")
        df = df.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("_item")).agg(newest).select(F.col("_item").alias(item), *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(cols) if c != item])
    n_keys = len(keys)
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    kinds = {f.name: f.dataType for f in df.schema}
    names = [f"k{i}" for i in range(n_keys)]
    rows = df.select(
        F.pmod(F.hash(*keys), F.lit(buckets)).alias("bucket"), *[F.col(k).alias(m) for k, m in zip(keys, names)], F.col(score).cast("double").alias("score"), F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label"), F.col(item).cast("long").alias("item")
    ).filter("score is not null and not isnan(score) and item is not null")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            run = sorted_run(pa.Table.from_batches(held), n_keys, n)
            table = pa.Table.from_pandas(run, schema=held[0].schema, preserve_index=False)
            codes = run["bucket"].to_numpy()
            begin = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, int)
            blobs = []
            for s, e in zip(begin, np.append(begin[1:], len(codes))):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table.slice(s, e - s), max_chunksize=READ_ROWS)
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(codes[begin].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "run"])

        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= RUN_ROWS:
                yield runs(held)
                held, count = [], 0
        if held:
            yield runs(held)

    out_type = T.StructType([*[T.StructField(m, kinds[k]) for m, k in zip(names, keys)], T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("place", T.IntegerType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(blob: bytes) -> Iterator[list[tuple]]:
            for part in pa.ipc.open_stream(blob):
                cols = [c.to_pylist() for c in part.columns]
                group = [tuple((v is None, 0 if v is None else v) for v in g) for g in zip(*cols[1 : 1 + n_keys])]
                yield list(zip(group, zip([-x for x in cols[-3]], map(_down, cols[-2]), [-x for x in cols[-1]]), cols[-2]))

        def done(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows, place, last = [], 0, None
            for group, (s, _, i), label in merge_runs([Run(rows_of(b)) for b in blobs], n):
                place = place + 1 if group == last else 1
                last = group
                rows.append((*[None if missing else v for missing, v in group], -i, -s + 0.0, label, place))
                if len(rows) >= 50_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], schema.field(j).type) for j in range(len(schema))], schema=schema)

        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield from done(held)
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield from done(held)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out_type)
    merged = rows.mapInArrow(write, RUNS).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, out_type)
    return merged.select(*[F.col(m).alias(k) for m, k in zip(names, keys)], F.col("item").alias("item"), "score", "label", "place")
