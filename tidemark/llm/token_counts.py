"""Token counts with offset-mapped attribution.

A whole document is encoded once.  Byte-level tokens tile its UTF-8 bytes, so the
running sum of token lengths gives every token's span, and an interval join by binary
search against the sorted sections tells which sections a token touches.

A token inside one section belongs to it.  A token that crosses a boundary goes, whole,
to the section with most of its bytes, ties to the earliest; so counts of sections that
tile a text add up to its tokens.  A token that touches no section is unassigned.

Sections are the lines of a text, each with its line break (:func:`by_lines`), or the
columns of a record rendered as one text (:func:`by_fields`).

Defined cases: null and empty texts have no tokens and one empty line; a null field is
an empty field; repeated rows are counted each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import encoding


def token_lengths(ranks: str) -> np.ndarray:
    """Bytes of every id of a byte-level vocabulary."""
    tokens = encoding(ranks)
    return np.array([len(tokens.decode_single_token_bytes(k)) for k in range(tokens.n_vocab)], np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens crossed a boundary.

    ``ends`` are the token ends in bytes (tokens tile from 0); sections are sorted and
    disjoint half-open intervals.
    """
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(stops, begins, side="right")
    last = np.searchsorted(starts, ends, side="left") - 1
    counts = np.bincount(first[first == last], minlength=len(stops)).astype(np.int64)
    crossing = 0
    for k in np.flatnonzero(last > first):
        touched = np.arange(first[k], last[k] + 1)
        shares = np.minimum(stops[touched], ends[k]) - np.maximum(starts[touched], begins[k])
        counts[touched[shares.argmax()]] += 1
        crossing += 1
    return counts, crossing + int((_cut(begins, ends, starts, stops) & (first == last)).sum())


def _cut(begins: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Tokens in one section only that still reach out of it."""
    section = np.minimum(np.searchsorted(stops, begins, side="right"), max(len(stops) - 1, 0))
    if not len(stops):
        return np.zeros(len(ends), bool)
    return (begins < starts[section]) & (ends > starts[section]) | (begins < stops[section]) & (begins >= starts[section]) & (ends > stops[section])


def _lines(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    tokens, lengths = encoding(ranks), token_lengths(ranks)
    for batch in batches:
        rows = []
        for value in batch.column(1):
            text = value.as_py() or ""
            raw = np.frombuffer(text.encode(), np.uint8)
            stops = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
            if len(stops) > 1 and stops[-1] == stops[-2]:
                stops = stops[:-1]  # no line after a final break
            starts = np.concatenate([[0], stops[:-1]])
            ends = np.cumsum(lengths[np.array(tokens.encode_ordinary(text), np.int64)])
            counts, crossing = attribute(ends, starts, stops)
            rows.append((len(ends), len(stops), crossing, int(counts.max()), counts))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["doc_id", "n_tokens", "n_sections", "n_crossing", "most_tokens", "section_tokens"])


def by_lines(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """One row per document: its tokens, lines, crossing tokens, and the tokens of each line."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_lines, ranks=path), "doc_id long, n_tokens long, n_sections long, n_crossing long, most_tokens long, section_tokens array<long>")


def _fields(batches: Iterator[pa.RecordBatch], ranks: str, between: bytes) -> Iterator[pa.RecordBatch]:
    tokens, lengths = encoding(ranks), token_lengths(ranks)
    for batch in batches:
        rows = []
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for k in range(batch.num_rows):
            parts = [(c[k] or "").encode() for c in columns]
            sizes = np.array([len(p) for p in parts], np.int64)
            starts = np.cumsum(sizes + len(between)) - sizes - len(between)
            ends = np.cumsum(lengths[np.array(tokens.encode_ordinary(between.join(parts).decode()), np.int64)])
            full = np.flatnonzero(sizes)
            counts = np.zeros(len(parts), np.int64)
            counts[full], _ = attribute(ends, starts[full], (starts + sizes)[full])
            rows.append((len(ends), counts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["doc_id", "n_tokens", "field_tokens"])


def by_fields(records: DataFrame, key: str, columns: list[str], between: str = "\n", ranks: str | None = None) -> DataFrame:
    """One row per record: tokens of its rendered text, and the tokens of each column in order; the rest are separators."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = records.select(F.col(key).cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(f"field{k}") for k, c in enumerate(columns)))
    told = rows.mapInArrow(partial(_fields, ranks=path, between=between.encode()), "doc_id long, n_tokens long, field_tokens array<long>")
    return told.withColumnRenamed("doc_id", key)
