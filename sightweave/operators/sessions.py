"""Sessions of activity: secondary sort by key and time, then one linear scan per partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema


def _key_changes(batch: pa.RecordBatch, n_keys: int, last: tuple | None) -> np.ndarray:
    """True where a row's key differs from the row before it; last is the key before the batch."""
    n = batch.num_rows
    changed = np.zeros(n, dtype=bool)
    for i in range(n_keys):
        col = batch.column(i)
        if n > 1:
            changed[1:] |= pc.not_equal(col.slice(1), col.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    changed[0] = last is None or last != tuple(batch.column(i)[0].as_py() for i in range(n_keys))
    return changed


def _scanner(n_keys: int, gap: int, out_schema: pa.Schema):
    """The scan: holds one open session and one Arrow batch, whatever the size of the partition."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_start, open_end, open_n = None, 0, 0, 0
        first = True

        def emit(keys: list[pa.Array], start, end, n, edge) -> pa.RecordBatch:
            cols = [*keys, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int64()), pa.array(edge)]
            return pa.RecordBatch.from_arrays(cols, schema=out_schema)

        def emit_open(edge: bool) -> pa.RecordBatch:
            keys = [pa.array([v], out_schema.field(i).type) for i, v in enumerate(open_key)]
            return emit(keys, [open_start], [open_end], [open_n], [edge])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ts = batch.column(n_keys).to_numpy(zero_copy_only=False)
            begins = _key_changes(batch, n_keys, open_key)
            before = np.empty(n, dtype=np.int64)
            before[1:] = ts[:-1]
            before[0] = open_end if not begins[0] else ts[0]
            begins |= (ts - before) > gap
            at = np.flatnonzero(begins)
            head = int(at[0]) if len(at) else n
            if head and open_key is not None:  # rows that continue the open session
                open_end, open_n = int(ts[head - 1]), open_n + head
            if not len(at):
                continue
            if open_key is not None:
                yield emit_open(first)
                first = False
            stop = np.append(at[1:], n)
            if len(at) > 1:  # all but the last are complete
                keys = [batch.column(i).take(pa.array(at[:-1])).cast(out_schema.field(i).type) for i in range(n_keys)]
                edge = np.zeros(len(at) - 1, dtype=bool)
                edge[0] = first
                first = False
                yield emit(keys, ts[at[:-1]], ts[stop[:-1] - 1], stop[:-1] - at[:-1], edge)
            k = int(at[-1])
            open_key = tuple(batch.column(i)[k].as_py() for i in range(n_keys))
            open_start, open_end, open_n = int(ts[k]), int(ts[n - 1]), n - k
        if open_key is not None:
            yield emit_open(True)

    return scan


def sessionize(events: DataFrame, keys: list[str], ts: str, gap: int) -> DataFrame:
    """Sessions per key: keys, start, end, duration, n_events. A new one starts when more than gap lies between neighbours.

    ts and gap are integers of one unit. The rows are range-partitioned by key and time, so one key
    may spread over many tasks; each task scans its sorted rows once, and only the first and last
    session of each task (two rows a task) are joined across tasks afterwards. Rows with a null key
    or time are left out; equal times belong together; a lone event is a session of duration 0; an
    empty table gives an empty result. Columns other than keys and ts are ignored, so none can clash.
    """
    kinds = {f.name: f.dataType for f in events.schema}
    narrow = events.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(ts).cast("long").alias("t")).dropna()
    names = [f"k{i}" for i in range(len(keys))]
    schema = T.StructType([T.StructField(n, kinds[k]) for n, k in zip(names, keys)] + [T.StructField(c, T.LongType()) for c in ("start", "end", "n_events")] + [T.StructField("edge", T.BooleanType())])
    scan = _scanner(len(keys), gap, to_arrow_schema(schema))
    pieces = narrow.repartitionByRange(*names, "t").sortWithinPartitions(*names, "t").mapInArrow(scan, schema)
    # A piece that isn't at the edge of its task is complete; the edges, two a task, are joined by the same rule.
    order = W.Window.partitionBy(*names).orderBy("start", "end")
    before = F.lag("end").over(order)
    fresh = before.isNull() | (F.col("start") - before > gap)
    inner = pieces.filter(~F.col("edge")).select(*names, "start", "end", "n_events")
    edges = pieces.filter("edge").withColumn("fresh", fresh.cast("int"))
    run = order.rowsBetween(W.Window.unboundedPreceding, 0)
    joined = (
        edges.withColumn("run", F.sum("fresh").over(run))
        .groupBy(*names, "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_events").alias("n_events"))
        .drop("run")
    )
    both = inner.unionByName(joined)
    return both.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "start", "end", (F.col("end") - F.col("start")).alias("duration"), "n_events")
