"""Substring dedup with difference-cover anchors.

A word is removed when some window of ``window`` consecutive words covers it
whose word sequence also starts anywhere else in the table.

Two equal windows at word positions i and j always contain, at the same offset
d below the period v, positions i + d and j + d that both lie in a difference
cover modulo v.  So only the ``window - v + 1`` words from cover positions are
hashed as anchors (5 of 21 positions at the defaults), and any long match
shares one.  Matches are then extended: around each repeated anchor every full
window is looked up again by 96 bits of hash, which decides which windows repeat.

Both look-ups use a packed exchange.  A slice of whole documents sends each hash
bucket one row with its distinct hashes, so a passage that sits in a third of
all documents costs one entry per slice, not one per occurrence; occurrences that
already repeat inside the slice travel by document instead.  No pair of
documents is ever formed, so the work follows the input and not group sizes.

The answers (merged word intervals, a few per document with repeats) return to
the text through :func:`shared.join_checked`: broadcast while they are small by
bytes, a shuffle join beyond.

Defined cases: null text has no words and is kept as an empty text; documents
shorter than a window lose nothing; rows that repeat a ``doc_id`` are separate
documents, told apart by their texts, and repeat each other where the texts agree; a
null ``doc_id`` is told apart by its text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bucket_count, covered, join_checked, merge_runs, pack, per_document
from .words import Words, buffers, mix, rolling, slices

WINDOW = 35
PERIOD = 21

_SENT = "bucket int, keys binary, checks binary, documents binary, places binary"
_FOUND = "part int, documents binary, places binary"
_SPANS = "row_key long, row_tag int, starts binary, ends binary"
_ROW = ["row_key", "row_tag"]

#: A place is the tag of a text above its word's number.
_TAG = np.int64(32)


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences give every residue."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    raise ValueError(period)


def _row_key() -> dict[str, Column]:
    """Tells rows with other texts apart: the id, or a hash of the text where it is null, and 31 bits of the text's hash."""
    return {
        "row_key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")),
        "row_tag": F.xxhash64(F.lit(3), "text").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"),
    }


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(c.alias(n) for n, c in _row_key().items()))


def _grouped(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts labels, the distinct labels, and where each begins and ends."""
    order = np.argsort(labels, kind="stable")
    found, first = np.unique(labels[order], return_index=True)
    return order, found, np.append(first, len(labels))


def send(keys: np.ndarray, checks: np.ndarray, documents: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Rows for one slice: per bucket its distinct keys, each with the one place that asks about it.

    A key that repeats inside the slice asks for nothing (place -1): its places
    are known to repeat and go, without keys, to buckets dealt by document.
    """
    if not len(keys):
        return
    order = np.lexsort((checks, keys))
    keys, checks, documents, places = keys[order], checks[order], documents[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    first = np.flatnonzero(new)
    repeats = np.repeat(np.diff(np.append(first, len(keys))) > 1, np.diff(np.append(first, len(keys))))
    asked_documents, asked_places = documents[first], np.where(repeats[first], -1, places[first])
    asked_documents = np.where(repeats[first], 0, asked_documents)
    order, found, bounds = _grouped((keys[first] % np.uint64(buckets)).astype(np.int64))
    # within a bucket, by document: the ids then compress to almost nothing
    order = order[np.lexsort((asked_places[order], asked_documents[order], np.repeat(found, np.diff(bounds))))]
    for k, bucket in enumerate(found):
        at = order[bounds[k] : bounds[k + 1]]
        yield int(bucket), pack(keys[first][at]), pack(checks[first][at]), pack(asked_documents[at]), pack(asked_places[at])
    known = np.flatnonzero(repeats)
    if len(known):
        known = known[np.lexsort((places[known], documents[known]))]
        order, found, bounds = _grouped((mix(documents[known].view(np.uint64)) % np.uint64(buckets)).astype(np.int64))
        for k, bucket in enumerate(found):
            at = known[order[bounds[k] : bounds[k + 1]]]
            yield int(bucket), b"", b"", pack(documents[at]), pack(places[at])


def _sent_batch(rows: list[tuple[int, bytes, bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3, 4))],
        ["bucket", "keys", "checks", "documents", "places"],
    )


def anchors_of(words: Words, hashes: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and hashes of all anchors of a slice."""
    width = window - period + 1
    place = np.arange(len(hashes)) - np.repeat(words.bounds[:-1], words.counts)
    chosen = np.zeros(period, bool)
    chosen[list(difference_cover(period))] = True
    long_enough = np.repeat(words.counts >= window, words.counts)
    at = np.flatnonzero(chosen[place % period] & (words.room() >= width) & long_enough)
    return at, rolling(hashes, width)[at]


def _rows(part: pa.RecordBatch, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and place of some words of a slice; columns are doc_id, text, row_key, row_tag."""
    ids, tags = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
    document = words.documents()[at]
    return ids[document], (at - words.bounds[document]) + (tags[document] << _TAG)


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int, window: int, period: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(*buffers(part.column(1)))
            at, keys = anchors_of(words, words.hashes(), window, period)
            rows = list(send(keys, np.zeros(len(keys), np.uint32), *_rows(part, words, at), buckets))
            if rows:
                yield _sent_batch(rows)


def _intervals(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All int32 values of a binary column, and how many each row has."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(x or b"" for x in raw), np.int32).astype(np.int64), np.array([len(x or b"") // 4 for x in raw], np.int64)


def _within(words: Words, starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Words of a slice that their documents' intervals cover."""
    base, stop = np.repeat(words.bounds[:-1], per), np.repeat(words.bounds[1:], per)
    return covered(np.minimum(starts + base, stop), np.minimum(ends + base, stop), len(words.starts))


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of hash of the window that starts at each word."""
    again = rolling(mix(hashes ^ np.uint64(window)), window)
    return mix(rolling(hashes, window) + np.uint64(window)), (again >> np.uint64(32)).astype(np.uint32)


def _send_windows(batches: Iterator[pa.RecordBatch], buckets: int, window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(*buffers(part.column(1)))
            starts, per = _intervals(part.column(4))
            ends, _ = _intervals(part.column(5))
            wanted = _within(words, starts, ends, per)
            at = np.flatnonzero(wanted & (words.room() >= window))
            keys, checks = window_hashes(words.hashes(), window)
            rows = list(send(keys[at], checks[at], *_rows(part, words, at), buckets))
            if rows:
                yield _sent_batch(rows)


def _joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def repeated(key: tuple, table: pa.Table, parts: int) -> pa.Table:
    """Places of one bucket whose key came from several slices or was known to repeat."""
    keys, checks = _joined(table.column("keys"), np.uint64), _joined(table.column("checks"), np.uint32)
    asked = np.array([len(x) > 0 for x in table.column("keys").to_pylist()], bool)
    sizes = np.array([len(x) // 8 for x in table.column("places").to_pylist()], np.int64)
    documents, places = _joined(table.column("documents"), np.int64), _joined(table.column("places"), np.int64)
    told = np.repeat(asked, sizes)
    hit = ~told
    order = np.lexsort((checks, keys))
    same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit[np.flatnonzero(told)] = twice & (places[told] >= 0)
    documents, places = documents[hit], places[hit]
    order, found, bounds = _grouped((mix(documents.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % parts)
    rows = [order[bounds[k] : bounds[k + 1]] for k in range(len(found))]
    return pa.table({
        "part": pa.array(found.astype(np.int32)),
        "documents": pa.array([pack(documents[at]) for at in rows], pa.binary()),
        "places": pa.array([pack(places[at]) for at in rows], pa.binary()),
    })


def spans(key: tuple, table: pa.Table, low: int, high: int) -> pa.Table:
    """Per document, the union of ``[place + low, place + high)`` over its places."""
    documents, places = _joined(table.column("documents"), np.int64), _joined(table.column("places"), np.int64)
    order = np.lexsort((places, documents))
    documents, tags, places = documents[order], places[order] >> _TAG, places[order] & np.int64((1 << 32) - 1)
    new = np.ones(len(documents), bool)
    new[1:] = (documents[1:] != documents[:-1]) | (tags[1:] != tags[:-1])
    first = np.flatnonzero(new)
    # one merge over all documents: each is moved past the reach of the one before
    shift = np.repeat(np.arange(len(first)) * (np.int64(1) << 33), np.diff(np.append(first, len(documents))))
    starts, ends = merge_runs(np.maximum(places + low, 0) + shift, places + high + shift)
    owner = starts >> 33
    at = np.searchsorted(owner, np.arange(len(first) + 1))
    back = owner << 33
    starts, ends = (starts - back).astype(np.int32), (ends - back).astype(np.int32)
    return pa.table({
        "row_key": pa.array(documents[first]),
        "row_tag": pa.array(tags[first].astype(np.int32)),
        "starts": pa.array([pack(starts[at[k] : at[k + 1]]) for k in range(len(first))], pa.binary()),
        "ends": pa.array([pack(ends[at[k] : at[k + 1]]) for k in range(len(first))], pa.binary()),
    })


def _looked_up(sent: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    def places(key: tuple, table: pa.Table) -> pa.Table:
        return repeated(key, table, parts)

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        return spans(key, table, low, high)

    return sent.groupBy("bucket").applyInArrow(places, _FOUND).groupBy("part").applyInArrow(merged, _SPANS)


def removals(rows: DataFrame, window: int, period: int) -> DataFrame:
    """Word intervals to remove, one row for each document that has any; ``rows`` as from :func:`keyed`."""
    buckets = bucket_count(rows)
    parts = buckets // 2  # at least the shuffle partitions, and growing with the table
    sent = rows.mapInArrow(partial(_send_anchors, buckets=buckets, window=window, period=period), _SENT)
    around = _looked_up(sent, parts, 1 - period, 1)
    again = join_checked(rows, around, _ROW, "inner", payload=("starts", "ends")).select("doc_id", "text", *_ROW, "starts", "ends")
    sent = again.mapInArrow(partial(_send_windows, buckets=buckets, window=window), _SENT)
    return _looked_up(sent, parts, 0, window)


def kept_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept words of each document joined by single spaces: bytes and offsets, words and removed words."""
    words = Words(data, offsets)
    gone = _within(words, starts, ends, per)
    kept = np.flatnonzero(~gone)
    document = words.documents()[kept]
    inside = covered(words.starts[kept], words.ends[kept], len(data))
    follows = np.zeros(len(kept), bool)
    follows[:-1] = document[1:] == document[:-1]
    gap = words.ends[kept[follows]]
    inside[gap] = True
    out = data.copy()
    out[gap] = 32
    lengths = per_document(inside, offsets)
    return out[inside], np.concatenate([[0], np.cumsum(lengths)]), words.counts, per_document(gone, words.bounds)


def _digest(column: np.ndarray, offsets: np.ndarray) -> list[str]:
    view = memoryview(np.ascontiguousarray(column))
    return [hashlib.sha256(view[offsets[k] : offsets[k + 1]]).hexdigest() for k in range(len(offsets) - 1)]


def _finish(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        for part in slices(batch):
            starts, per = _intervals(part.column(2))
            ends, _ = _intervals(part.column(3))
            data, offsets, n_words, n_removed = kept_texts(*buffers(part.column(1)), starts, ends, per)
            if digest:
                told = pa.array(_digest(data, offsets))
            else:
                told = pa.LargeStringArray.from_buffers(len(n_words), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words), pa.array(n_removed), told, *part.columns[4:]],
                ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text", *names[4:]],
            )


def apply(documents: DataFrame, window: int = WINDOW, period: int = PERIOD, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and the kept text, or its SHA-256, then the columns to carry."""
    if not 0 < period <= window:
        raise ValueError("the period must lie within the window")
    rows = keyed(documents)
    carried = {f"carried{k}": documents[name] for k, name in enumerate(carry)}
    wide = documents.select(*(c.alias(n) for n, c in _row_key().items()), F.col("doc_id").cast("long").alias("doc_id"), "text", *(x.alias(k) for k, x in carried.items()))
    joined = join_checked(wide, removals(rows, window, period), _ROW, "left", payload=("starts", "ends"))
    name = "kept_sha256" if digest else "kept_text"
    kinds = "".join(f", {k} {joined.schema[k].dataType.simpleString()}" for k in carried)
    told = joined.select("doc_id", "text", "starts", "ends", *carried).mapInArrow(partial(_finish, digest=digest), f"doc_id long, n_words long, n_removed long, {name} string{kinds}")
    return told.withColumnsRenamed(dict(zip(carried, carry, strict=True)))
