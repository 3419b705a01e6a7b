"""Best-two-fit packing of token sequences.

Each document becomes its token ids and one end id.  A document longer than the
capacity is cut into full pieces, the first of which may be shorter, so every
document has at most one piece that needs company.

Piece lengths are whole numbers below the capacity, so packing needs only their
histogram: at most ``capacity - 1`` counts, however many documents there are.  On
it the driver fills a sequence greedily, longest fitting piece first, and then
tries two-fit: the smallest piece comes out again if two other pieces fit its
expanded gap more tightly.  The pattern found is used as often as the counts
allow at once, so the number of patterns follows the number of lengths.

Pieces find their sequence in parallel: a piece's rank among those of its length
(a row number within one of many hash shares of that length, plus the sizes of
the shares before) falls into one run of a pattern, which gives the sequence and
the offset.  No task sees more than one share of one length.

Defined cases: null and empty texts are one piece with the end id alone; repeated
rows are packed each on their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, join_checked

CAPACITY = 1024
END_ID = 2

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache
def encoding(ranks: str) -> tiktoken.Encoding:
    """Byte-level BPE from a rank file; its ids are those of the tokenizers file with the same vocabulary, added tokens included."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(Path(ranks).with_suffix(".json"), encoding="utf-8") as file:
        added = {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of a document of n ids."""
    head = n % capacity or capacity
    return [(0, head), *((start, capacity) for start in range(head, n, capacity))]


def _pieces(batches: Iterator[pa.RecordBatch], ranks: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    tokens = encoding(ranks)
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.array([*tokens.encode(text.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
            raw = memoryview(ids).cast("B")
            rows += ((doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])) for k, (start, length) in enumerate(cut(len(ids), capacity)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])


def _below(free: np.ndarray) -> np.ndarray:
    """For each size, the largest free length up to it (0: none)."""
    return np.maximum.accumulate(np.where(free > 0, np.arange(len(free)), 0))


def two_fit(free: np.ndarray, gap: int) -> tuple[int, int]:
    """The two free lengths with the largest sum up to gap, or (0, 0)."""
    below = _below(free)
    first = np.flatnonzero(free[: gap + 1] > 0)
    first = first[first < gap]
    if not len(first):
        return 0, 0
    second = below[np.minimum(gap - first, first)]
    alone = (second == first) & (free[first] < 2)
    second[alone] = below[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of a sequence, how many such sequences)."""
    left = counts.astype(np.int64).copy()
    found = []
    while left.any():
        free, gap, bin_ = left.copy(), capacity, []
        while gap and (top := int(_below(free)[min(gap, len(free) - 1)])):
            bin_.append(top)
            free[top] -= 1
            gap -= top
        while gap and len(bin_) > 1:
            smallest = bin_[-1]
            free[smallest] += 1
            a, b = two_fit(free, min(gap + smallest, len(free) - 1))
            if a + b <= smallest:
                free[smallest] -= 1
                break
            bin_[-1:] = [a, b]
            bin_.sort(reverse=True)
            free[a] -= 1
            free[b] -= 1
            gap += smallest - a - b
        lengths, times = np.unique(bin_, return_counts=True)
        many = int((left[lengths] // times).min())
        left[lengths] -= many * times
        found.append((bin_, many))
    return found


def runs(found: list[tuple[list[int], int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length, first rank) keys with the sequence of that rank and the offset in it."""
    used, rows, sequence = np.zeros(size, np.int64), [], 0
    for bin_, many in found:
        offset = 0
        for length in bin_:
            rows.append(((length << 44) + int(used[length]), sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    keys, sequences, offsets = np.array(sorted(rows), np.int64).reshape(-1, 3).T
    return keys, sequences, offsets


def pieces(documents: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece, before packing."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pieces, ranks=path, capacity=capacity, end_id=end_id), _PIECES)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece a sequence and an offset there; sequences of one full piece have negative numbers."""
    rows = checkpointed(cut_pieces)
    full = rows.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = rows.where(F.col("length") < capacity)
    shares = int(min(max(64, part.count() // 1_000_000), 1 << 16))
    part = part.withColumn("share", F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(shares)).cast("int"))
    sizes = part.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = checkpointed(sizes.select("length", "share", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    counts = np.zeros(capacity, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():  # fewer than capacity rows
        counts[length] = n
    if not counts.any():
        return full
    keys, sequences, offsets = runs(patterns(counts, capacity), capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + rank.to_numpy() - (keys[at] & ((1 << 44) - 1)), "offset": offsets[at]})

    order = Window.partitionBy("length", "share").orderBy("doc_id", "piece")
    key = F.col("length") * F.lit(1 << 17) + F.col("share")
    ranked = part.withColumns({"number": F.row_number().over(order) - 1, "key": key})
    ranked = join_checked(ranked, sizes.select(key.alias("key"), "earlier"), "key", "inner")
    ranked = ranked.withColumn("at", placed("length", F.col("number") + F.col("earlier")))
    return full.unionByName(ranked.select(*cut_pieces.columns, "at.sequence_id", "at.offset"))


def apply(documents: DataFrame, capacity: int = CAPACITY, ranks: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents; one row per piece."""
    return pack(pieces(documents, capacity, ranks, end_id), capacity)
