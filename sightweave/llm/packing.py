"""Packing of texts into windows of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import base64
import functools
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder and file of the public tokenizer; texts of a packing shard.
TOKENIZERS, VOCABULARY, SHARD_TEXTS = "/opt/tokenizers", "byte_bpe_50k.tiktoken", 50_000
#: Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def token_counter(path: str):
    """A function from texts to token counts, for a rank file, a tokenizer file or a piece model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in model.encode(texts, num_threads=1)]


def token_counts(df: DataFrame, text_id: str, text: str, vocabulary: str) -> DataFrame:
    """text_id, n_tokens of whole texts; a null or empty text has 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counter(texts), pa.int64())], names=["text_id", "n_tokens"])

    return df.select(F.col(text_id).cast("long").alias("text_id"), F.col(text).cast("string").alias("text")).filter("text_id is not null").mapInArrow(count, "text_id long, n_tokens long")


class Packer:
    """Windows of one capacity. level[h] counts the open windows filled to h; sizes come one by one."""

    def __init__(self, capacity: int):
        self.capacity, self.windows = capacity, 0
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, deque[int]] = {}

    def place(self, size: int) -> int:
        """The window that takes the item: the level that leaves the least sum of squared counts (ties: the fullest)."""
        c, n = self.capacity, self.level
        # From level h to h + size: N[h] falls and N[h + size] grows by one; full windows and new ones don't count.
        h, best = 0, 2 * int(n[size]) + 1 if size < c else 0
        at = np.flatnonzero(n[1 : c - size + 1]) + 1
        if len(at):
            change = 2 * (n[at + size] - n[at] + 1)
            if at[-1] == c - size:
                change[-1] = 1 - 2 * n[at[-1]]
            i = len(at) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                h = int(at[i])
        if h == 0:
            window, self.windows = self.windows, self.windows + 1
        else:
            window = self.open[h].popleft()
            n[h] -= 1
        if h + size < c:
            n[h + size] += 1
            self.open.setdefault(h + size, deque()).append(window)
        return window


def _placed(rows: list[tuple[int, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.int32()) for i in range(6)], names=PLACED.names)


#: Rows given out at once.
OUT_ROWS = 50_000
PLACED = T.StructType([T.StructField("capacity", T.IntegerType()), T.StructField("pack", T.LongType()), T.StructField("text_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("piece", "first_token", "n_tokens")]])


def shards_for(texts: DataFrame) -> int:
    """Packing shards of a table of texts (or sizes), from its number of rows alone; no text is read for it."""
    return max(1, -(-texts.count() // SHARD_TEXTS))


def pack_texts(sizes: DataFrame, capacities: list[int], shards: int | None = None) -> DataFrame:
    """capacity, pack, text_id, piece, first_token, n_tokens: every text in one window of each capacity.

    Only a text longer than the capacity is split: into full windows and a rest that is packed like
    a text. Texts without tokens take no room and give no row; a null size counts as none; a text_id
    that comes twice is packed twice; an empty table gives an empty result. Texts are packed in the
    order of their ids within hash shards of about SHARD_TEXTS texts, so a shard leaves at most a
    few windows partly filled and the result doesn't depend on the order of rows. pack holds the
    shard in its upper half. Where counting the rows of sizes is dear, pass shards_for() of the table
    they come from.
    """
    rows = sizes.select(F.col("text_id").cast("long"), F.col("n_tokens").cast("long")).filter("n_tokens > 0 and text_id is not null")
    shards = shards or shards_for(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[int, Packer] = {}
        now = -1
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for shard, text_id, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if shard != now:
                    now, packers = shard, {c: Packer(c) for c in capacities}
                for c, packer in packers.items():
                    for piece, first in enumerate(range(0, size, c)):
                        n = min(c, size - first)
                        out.append((c, (shard << 32) + packer.place(n), text_id, piece, first, n))
                        if len(out) >= OUT_ROWS:  # a very long text has many pieces
                            yield _placed(out)
                            out = []
            yield _placed(out)

    shard = F.pmod(F.xxhash64("text_id"), F.lit(shards)).cast("long").alias("shard")
    return rows.select(shard, "text_id", "n_tokens").repartition(shards, "shard").sortWithinPartitions("shard", "text_id", "n_tokens").mapInArrow(run, PLACED)
