"""Vector arithmetic as column expressions; vectors are cast to doubles first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column) -> Column:
    """The vector at length one; null if it is zero, not finite, or null."""
    return _once(norm(doubles(v)), lambda n: F.when((n > 0) & (n < float("inf")), F.transform(doubles(v), lambda x: x / n)))


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has dim finite numbers that aren't all zero."""
    return v.isNotNull() & (F.size(v) == dim) & _once(norm(doubles(v)), lambda n: F.coalesce((n > 0) & (n < float("inf")), F.lit(False)))


def unrolled_dot(a: str, b: str, dim: int) -> Column:
    """Dot product as one sum of products, which stays in generated code."""
    out = F.col(a)[0] * F.col(b)[0]
    for i in range(1, dim):
        out = out + F.col(a)[i] * F.col(b)[i]
    return out


def prototypes(df: DataFrame, keys: list[str], vector: str, dim: int, out: str = "prototype") -> DataFrame:
    """keys, out: the mean of each group's vectors at length one, null where it is zero.

    The vectors should be of length one; null vectors and keys are left out. Each task adds up its
    rows by group, so a group of any size costs one row a task; the sums are then joined.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    schema = T.StructType([*[T.StructField(k, kinds[k]) for k in keys], T.StructField(out, T.ArrayType(T.DoubleType()))])
    arrow, n_keys = to_arrow_schema(schema), len(keys)

    def sums(finish: bool):
        def add(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = np.zeros(t.num_rows, np.int64)
            for i in range(n_keys):
                d = t.column(i).combine_chunks().dictionary_encode()
                codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            v = t.column(n_keys).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            order = np.argsort(codes, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            total = np.add.reduceat(v[order], at, axis=0)
            valid = np.ones(len(total), bool)
            if finish:
                length = np.linalg.norm(total, axis=1)
                valid = (length > 0) & np.isfinite(length)
                total = total / np.where(valid, length, 1)[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * dim), pa.array(total.ravel()), mask=pa.array(~valid))
            return pa.RecordBatch.from_arrays([*[t.column(i).combine_chunks().take(pa.array(order[at])).cast(arrow.field(i).type) for i in range(n_keys)], lists], schema=arrow)

        def run(batches):
            held, rows = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                held.append(batch)
                rows += batch.num_rows
                if rows > 20_000:
                    held = [add(held)] if not finish else held
                    rows = held[0].num_rows if not finish else rows
            if held:
                yield add(held)

        return run

    clean = df.select(*keys, F.col(vector).cast("array<double>").alias(out)).dropna()
    partial = clean.mapInArrow(sums(False), schema)
    return partial.repartition(*keys).mapInArrow(sums(True), schema)
