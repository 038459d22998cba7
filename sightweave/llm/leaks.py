"""Evaluation passages inside documents, by spaced-seed hashing and a check around the hits.

Fixed masks select positions of a window of words and ignore the others, so a window hashes equal
although a word at an ignored position was changed. Document windows are joined with passage windows
on these hashes; a filter of fixed size over the passages' hashes keeps back nearly all document
windows before the join. Of every pair of document and passage that meets there, each diagonal that
was hit is compared word by word, allowing one changed word in ten.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightweave.session import cut

#: The masks. Any ten words with one changed have six unchanged ones in a row or match the second.
MASKS = ("111111", "1111001111")
#: Words in a row that make a partial case; words of which one may be changed.
RUN_WORDS, ONE_IN = 20, 10
#: Bits of the filter: at least so many for each window of the passages, and between these powers of two (the filter is broadcast: 16 MB at most; beyond that it lets more windows pass).
BITS_EACH, LEAST_BITS, MOST_BITS = 256, 20, 27

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_NOT_WORD = re.compile(r"[^\w\s]|_")
_INVISIBLE = dict.fromkeys([0xAD, 0x034F, 0x061C, 0x180E, 0xFEFF, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)])


def words(text: str) -> list[str]:
    """Words without case, punctuation, markup, line prefixes and invisible characters."""
    text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _TARGET.sub("]", text)
    return _NOT_WORD.sub("", text).casefold().split()


@functools.lru_cache(maxsize=64)
def _odd(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.random.RandomState(23).randint(1, 2**62, size=n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's selected words."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k, i in zip(_odd(len(mask)), (i for i in range(len(mask)) if mask[i] == "1")):
            h = (h + ids[i : i + n] * k) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class Hashes(dict):
    """64-bit hashes of words, none of them 0; forgets all when it has grown large."""

    LIMIT = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1
        return h

    def of(self, text: str) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.uint64)


def masks_of(n: int) -> list[str]:
    """The masks that find a passage of n words: one shorter than the first mask is looked for as a whole."""
    return list(MASKS) if n >= len(MASKS[0]) else ["1" * n]


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of a text's windows under a mask, told apart by the mask."""
    return window_hashes(ids, mask) ^ np.uint64(len(mask) * 0x9E3779B97F4A7C15 % 2**64)


def carries(ids: np.ndarray, passage: np.ndarray, shift: int) -> bool:
    """Whether the words at this shift are the whole passage or a run of it, with one in ONE_IN changed at most. Linear."""
    lo, hi = max(0, -shift), min(len(passage), len(ids) - shift)
    same = ids[lo + shift : hi + shift] == passage[lo:hi]
    n = len(same)
    if n == len(passage) and n - same.sum() <= n // ONE_IN:
        return True
    if n < RUN_WORDS:
        return False
    # A run from s to e is good if ONE_IN * wrong <= e - s: the greatest excess at a start at least RUN_WORDS before e decides.
    excess = ONE_IN * np.append(0, np.cumsum(~same)) - np.arange(n + 1)
    start = np.maximum.accumulate(np.where(same, excess[:-1], -(2**62)))
    stop = np.flatnonzero(same[RUN_WORDS - 1 :]) + RUN_WORDS
    return bool((start[stop - RUN_WORDS] >= excess[stop]).any())


def carried(ids: np.ndarray, passage: np.ndarray) -> bool:
    """Whether a text carries a passage, on any diagonal that a mask hits."""
    done: set[int] = set()
    for mask in masks_of(len(passage)):
        mine, theirs = seeds(ids, mask), seeds(passage, mask)
        order = np.argsort(theirs, kind="stable")
        sorted_ = theirs[order]
        lo, hi = np.searchsorted(sorted_, mine, side="left"), np.searchsorted(sorted_, mine, side="right")
        at = np.flatnonzero(hi > lo)
        for k in range(int((hi - lo).max(initial=0))):  # a window that the passage repeats
            at = at[hi[at] > lo[at] + k]
            for shift in np.unique(at - order[lo[at] + k]).tolist():
                if shift not in done:
                    done.add(shift)
                    if carries(ids, passage, shift):
                        return True
    return False


ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.LongType()))])


def _read(keep):
    """id, number of words, their hashes, and the distinct window hashes that keep() lets stay; texts with none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = known.of(text)
                hit = keep(ids)
                if len(hit):
                    out.append((i, len(ids), ids.tobytes(), hit.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=ROWS.names)

    return run


def _all_seeds(ids: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate([seeds(ids, m) for m in masks_of(len(ids))])) if len(ids) else np.zeros(0, np.uint64)


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """doc_id, item_id: documents that carry a passage wholly, or RUN_WORDS words of it in a row.

    One word in ONE_IN may be changed; case, punctuation, white space, markup, line prefixes and
    invisible characters don't count. Null and blank texts and passages, and null ids, give no row;
    an item or document that comes twice counts once; passages under six words count only if carried
    whole and unchanged; equal passages all count. Passages stay distributed; only a filter over
    their hashes, of bounded size, goes to every task. Documents are read once.
    """
    listed = items.select(F.col(item_id).cast("long").alias("id"), F.col(passage).cast("string").alias("text")).filter("id is not null and length(trim(text)) > 0").distinct()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).filter("id is not null and text is not null")
    held = cut(listed.mapInArrow(_read(_all_seeds), ROWS).select(F.monotonically_increasing_id().alias("passage"), "id", "n", "words", "hashes"))
    short = [r[0] for r in held.filter(F.col("n") < len(MASKS[0])).select("n").distinct().collect()]
    windows = held.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, int(windows * BITS_EACH).bit_length()))
    # Two bits of each hash, gathered by the built-in bitmap aggregate into blocks of 32,768.
    low, high = F.col("h").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("h", 32).bitwiseAND((1 << bits) - 1)
    places = held.select(F.explode("hashes").alias("h")).select(F.explode(F.array(low, high)).alias("at"))
    blocks = places.groupBy(F.floor(F.col("at") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.pmod("at", F.lit(32768))).alias("map")).collect()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for block, bitmap in blocks:
        table[block * 4096 : block * 4096 + len(bitmap)] = np.frombuffer(bytes(bitmap), np.uint8)
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    mask = np.uint64((1 << bits) - 1)

    def passing(ids: np.ndarray) -> np.ndarray:
        found = []
        for m in masks:
            h = seeds(ids, m)
            for shift in (0, 32):
                at = (h >> np.uint64(shift)) & mask
                h = h[(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            found.append(h)
        return np.unique(np.concatenate(found))

    hit = cut(rows.mapInArrow(_read(passing), ROWS).select(F.monotonically_increasing_id().alias("text"), "id", "words", "hashes"))
    pairs = hit.select("text", F.explode("hashes").alias("h")).join(held.select("passage", F.explode("hashes").alias("h")), "h").select("text", "passage").distinct()
    met = pairs.join(held.select("passage", F.col("id").alias("item_id"), F.col("words").alias("theirs")), "passage").join(hit.select("text", F.col("id").alias("doc_id"), "words"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [i for i in range(batch.num_rows) if carried(*(np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3)))]
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in (0, 1)], names=schema.names)

    return met.select("doc_id", "item_id", "words", "theirs").mapInArrow(verify, schema).distinct()


def leak_report(leaks: DataFrame) -> DataFrame:
    """item_id, n_documents, first_doc_id of the items that leaked."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc_id"))
