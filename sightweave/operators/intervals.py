"""Continuous periods and gaps of overlapping intervals per key, by a mergeable aggregate.

The aggregate's state is a list of disjoint intervals sorted by start. Every task folds its rows
into such lists, lists of one key are combined by linear merges in a reduction tree, and the final
list gives the periods and, as its complement, the gaps. A key with more periods than one task
should hold is first divided into ranges of its starts; ranges are stitched by the latest end
before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Intervals of one list row, rows folded at once, and periods of a key that one task holds.
CHUNK, FOLD_ROWS, KEY_LIMIT = 4096, 500_000, 200_000


def fold(lo: np.ndarray, hi: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray]:
    """The disjoint list of intervals sorted by start; neighbours at most tol apart become one."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > reach[:-1] + tol)
    at = np.flatnonzero(new)
    return lo[at], reach[np.append(at[1:], len(lo)) - 1]


def fold_many(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, tol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fold() of many lists at once: rows sorted by code and start; gives codes, starts, ends."""
    if not len(lo):
        return codes, lo, hi
    head = np.append(True, codes[1:] != codes[:-1])
    rank = np.cumsum(head) - 1
    base, span = int(lo.min()), int(hi.max()) - int(lo.min()) + abs(int(tol)) + 2
    if int(rank[-1] + 1) * span >= 2**62:  # too wide for one running maximum: list by list
        bounds = np.append(np.flatnonzero(head), len(lo))
        parts = [fold(lo[s:e], hi[s:e], tol) for s, e in zip(bounds[:-1], bounds[1:])]
        return np.repeat(codes[head], [len(p[0]) for p in parts]), np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    shift = rank * span - base  # a later list starts above all of the lists before it
    reach = np.maximum.accumulate(hi + shift)
    new = head.copy()
    new[1:] |= lo[1:] + shift[1:] > reach[:-1] + tol
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(lo)) - 1
    return codes[at], lo[at], reach[last] - shift[last]


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], tol: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of two disjoint lists (the stable sort of two runs is one merge pass)."""
    lo, hi = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(lo, kind="stable")
    return fold(lo[order], hi[order], tol)


def merge_tree(lists: list[tuple[np.ndarray, np.ndarray]], tol: int) -> tuple[np.ndarray, np.ndarray]:
    """Combine lists pairwise, level by level."""
    while len(lists) > 1:
        lists = [merge(*pair, tol) if len(pair) == 2 else pair[0] for pair in (lists[i : i + 2] for i in range(0, len(lists), 2))]
    return lists[0]


def _partial(n_keys: int, tol: int, schema: pa.Schema):
    """Rows of one task to list rows: keys, los, his."""

    def lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(table.num_rows, dtype=np.int64)
        for i in range(n_keys):
            d = table.column(i).combine_chunks().dictionary_encode()
            codes = codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes, return_inverse=True)[1]
        lo, hi = (table.column(n_keys + i).to_numpy() for i in (0, 1))
        order = np.lexsort((lo, codes))
        first_row = np.zeros(codes.max() + 1, dtype=np.int64)
        first_row[codes[order[::-1]]] = order[::-1]
        codes, lo, hi = fold_many(codes[order], lo[order], hi[order], tol)
        head = np.append(True, codes[1:] != codes[:-1])
        begin = np.flatnonzero(head)
        within = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes))))
        cut_at = np.flatnonzero(within % CHUNK == 0)  # a list row holds at most CHUNK intervals
        where = first_row[codes[cut_at]]
        offsets = np.append(cut_at, len(codes)).astype(np.int32)
        keys = [table.column(i).combine_chunks().take(pa.array(where, pa.int64())).cast(schema.field(i).type) for i in range(n_keys)]
        cols = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (lo, hi)]
        src = pa.array(np.full(len(cut_at), TaskContext.get().partitionId(), dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*keys, *[c.cast(schema.field(n_keys + i).type) for i, c in enumerate(cols)], src], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= FOLD_ROWS:
                yield from lists(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield from lists(pa.Table.from_batches(held))

    return run


def _flat(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[s:e] for s, e in zip(at[:-1], at[1:])]
    return out


def _by_range(n_keys: int, schema: pa.Schema):
    """Divide list rows at the bounds of their key: adds the number of the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rows = []
            for i, (lo, hi, src, cuts) in enumerate(zip(_flat(t.column(n_keys)), _flat(t.column(n_keys + 1)), t.column(n_keys + 2).to_pylist(), t.column(n_keys + 3).to_pylist())):
                if cuts is None:
                    rows.append((i, lo, hi, 0, 1, src))
                    continue
                cuts = np.unique(np.asarray(cuts, dtype=np.int64))
                part = np.searchsorted(cuts, lo, side="right")
                for p in np.unique(part):
                    rows.append((i, lo[part == p], hi[part == p], int(p), len(cuts) + 1, src))
            at = pa.array([r[0] for r in rows], pa.int64())
            keys = [batch.column(i).take(at) for i in range(n_keys)]
            rest = [pa.array([r[j] for r in rows], schema.field(n_keys + j - 1).type) for j in range(1, 6)]
            yield pa.RecordBatch.from_arrays([*keys, *rest], schema=schema)

    return run


def _combine(n_keys: int, tol: int, schema: pa.Schema):
    """Join neighbouring list rows of one key and range; the rows come sorted by them."""

    def join(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        same = np.ones(max(n - 1, 0), dtype=bool)
        for i in [*range(n_keys), n_keys + 2]:
            codes = t.column(i).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            same &= codes[1:] == codes[:-1]
        group = np.cumsum(np.append(0, ~same))
        los, his = _flat(t.column(n_keys)), _flat(t.column(n_keys + 1))
        size = np.array([len(x) for x in los])
        count, total = np.bincount(group), np.bincount(group, weights=size)
        big = (count > 1) & (total > CHUNK)  # long lists: linear merges, pairwise; the short ones of many keys: together
        few = ~big[group]
        codes, lo, hi = np.repeat(group[few], size[few]), *(np.concatenate([np.zeros(0, np.int64), *[x for x, f in zip(xs, few) if f]]) for xs in (los, his))
        order = np.lexsort((lo, codes))
        codes, lo, hi = fold_many(codes[order], lo[order], hi[order], tol)
        merged = {g: merge_tree([(los[i], his[i]) for i in np.flatnonzero(group == g)], tol) for g in np.flatnonzero(big)}
        bounds = np.searchsorted(codes, np.arange(len(count) + 1))
        out = [merged.get(g) or (lo[bounds[g] : bounds[g + 1]], hi[bounds[g] : bounds[g + 1]]) for g in range(len(count))]
        head = pa.array(np.flatnonzero(np.append(True, ~same)))
        offsets = pa.array(np.cumsum([0, *[len(x[0]) for x in out]]).astype(np.int32))
        cols = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[j] for x in out]))).cast(schema.field(n_keys + j).type) for j in (0, 1)]
        keys = [t.column(i).combine_chunks().take(head).cast(schema.field(i).type) for i in range(n_keys)]
        rest = [t.column(n_keys + j).combine_chunks().take(head) for j in (2, 3, 4)]
        return pa.RecordBatch.from_arrays([*keys, *cols, *rest], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 2000:
                continue
            # All but the last key are complete.
            tail = held.num_rows - 1
            last = [held.column(i)[tail].as_py() for i in [*range(n_keys), n_keys + 2]]
            while tail and [held.column(i)[tail - 1].as_py() for i in [*range(n_keys), n_keys + 2]] == last:
                tail -= 1
            if tail:
                yield join(held.slice(0, tail))
                held = held.slice(tail)
        if held is not None and held.num_rows:
            yield join(held)

    return run


def merged_lists(df: DataFrame, keys: list[str], lo: str, hi: str, tol: int, key_limit: int = KEY_LIMIT) -> DataFrame:
    """The final list of each key, as rows k0.., part, parts, los, his; parts is over 1 only for keys beyond key_limit."""
    names = [f"k{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType for f in df.schema}
    narrow = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.least(lo, hi).cast("long").alias("lo"), F.greatest(lo, hi).cast("long").alias("hi"), F.col(lo).isNotNull().alias("a"), F.col(hi).isNotNull().alias("b"))
    narrow = narrow.filter("a and b").drop("a", "b")
    key_fields = [T.StructField(n, kinds[k]) for n, k in zip(names, keys)]
    two = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("los", "his")]
    held = T.StructType(key_fields + two + [T.StructField("src", T.IntegerType())])
    partial = narrow.mapInArrow(_partial(len(keys), tol, to_arrow_schema(held)), held)

    # Bounds only for keys with more partial periods than key_limit; list rows hold at most CHUNK, so their first starts sample the key evenly.
    size = partial.groupBy(*names).agg(F.sum(F.size("los")).alias("n"), F.percentile_approx(F.element_at("los", 1), [i / 64 for i in range(1, 64)], 1000).alias("cuts"))
    large = size.filter(F.col("n") > key_limit).select(*[F.col(n).alias(f"_{n}") for n in names], "cuts")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    on = same[0]
    for x in same[1:]:
        on &= x
    ranged_type = T.StructType(key_fields + two + [T.StructField(c, T.IntegerType()) for c in ("part", "parts", "src")])
    ranged = partial.join(large, on, "left").select(*names, "los", "his", "src", "cuts").mapInArrow(_by_range(len(keys), to_arrow_schema(ranged_type)), ranged_type)

    # Level one of the tree joins the lists of neighbouring tasks, level two all lists of the key's range.
    combine = _combine(len(keys), tol, to_arrow_schema(ranged_type))
    near = F.floor(F.col("src") / 16)
    level = ranged.repartition(*names, "part", near).sortWithinPartitions(*names, "part", near).mapInArrow(combine, ranged_type)
    level = level.repartition(*names, "part").sortWithinPartitions(*names, "part").mapInArrow(combine, ranged_type)
    return level.drop("src")


def interval_gaps(df: DataFrame, keys: list[str], lo: str, hi: str, tol: int, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Gaps between the continuous periods of each key: keys, gap_from, gap_to.

    lo and hi are whole numbers in either order; a period goes on if the next start is at most tol
    after the latest end so far, else that end is gap_from and the next start gap_to. Rows with a
    null bound are left out; null keys form a key of their own; nested, equal and repeated intervals
    change nothing; a key with one period and an empty table give no row. Other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    out = _starts(df, keys, lo, hi, tol, key_limit).filter("gap_from is not null")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "gap_from", F.col("since").alias("gap_to"))


def _on(names: list[str], *more: str) -> Column:
    """Equality (null being equal to null) with the columns of the same names after an underscore."""
    on = F.lit(True)
    for n in [*names, *more]:
        on &= F.col(n).eqNullSafe(F.col(f"_{n}"))
    return on


def _starts(df: DataFrame, keys: list[str], lo: str, hi: str, tol: int, key_limit: int, ends: bool = False) -> DataFrame:
    """k0.., part, since, gap_from, and with ends top: where periods start, the end of the one before (null: the first), and the key's last end."""
    names = [f"k{i}" for i in range(len(keys))]
    lists = merged_lists(df, keys, lo, hi, tol, key_limit)
    # The latest end in the ranges before; only rows of divided keys have any, a row for each range.
    over = Window.partitionBy(*names)
    before = over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = lists.filter("parts = 1").select(*names, "part", "los", "his", F.lit(None).cast("long").alias("reach"), *([F.array_max("his").alias("top")] if ends else []))
    divided = lists.filter("parts > 1")
    tops = divided.select(*names, "part", F.array_max("his").alias("top"))
    reach = tops.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("part").alias("_part"), F.max("top").over(before).alias("reach"), F.max("top").over(over).alias("top"))
    stitched = divided.join(reach, _on(names, "part")).select(*names, "part", "los", "his", "reach", *(["top"] if ends else []))
    # Leading periods that the reach covers: within a disjoint list those are the ones not over the reach, unless one of them carries on.
    pairs = F.arrays_zip(F.col("los").alias("lo"), F.col("his").alias("hi"))
    exploded = whole.unionByName(stitched).select(*names, "part", "reach", F.posexplode(pairs).alias("pos", "p"), "his", *(["top"] if ends else []))
    prior = F.greatest(F.when(F.col("pos") > 0, F.col("his")[F.col("pos") - 1]), F.col("reach"))
    begun = exploded.select(*names, "part", prior.alias("gap_from"), F.col("p.lo").alias("since"), *(["top"] if ends else []))
    return begun.filter(F.col("gap_from").isNull() | (F.col("since") > F.col("gap_from") + tol))


def interval_periods(df: DataFrame, keys: list[str], lo: str, hi: str, tol: int, key_limit: int = KEY_LIMIT) -> DataFrame:
    """Continuous periods of each key: keys, period_from, period_to; the complement of interval_gaps, with its rules.

    A period ends where the next gap begins: in its own range of the key, or at the first start of a
    later range (ranges are few), or at the key's last end.
    """
    names = [f"k{i}" for i in range(len(keys))]
    starts = _starts(df, keys, lo, hi, tol, key_limit, ends=True)
    within = Window.partitionBy(*names, "part").orderBy("since")
    heads = starts.groupBy(*names, "part").agg(F.min_by("gap_from", "since").alias("first"))
    after = Window.partitionBy(*names).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    later = heads.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("part").alias("_part"), F.first("first", ignorenulls=True).over(after).alias("later"))
    ended = starts.withColumn("next", F.lead("gap_from").over(within)).join(later, _on(names, "part"))
    return ended.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col("since").alias("period_from"), F.coalesce("next", "later", "top").alias("period_to"))
