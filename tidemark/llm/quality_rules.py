"""Quality rules with cross-document line frequency.

Two layers decide over a document.  The base rules look at the document alone:
too few words, or too large a share of its words inside five-word windows that
the text repeats.  The second layer looks across documents: lines are
normalised and hashed, their distinct documents are counted per host, lines in
more than ``max_documents`` of them are taken away, and a document that is left
depleted goes.

Distinct documents are distinct texts of a host, so exact copies and repeated
rows count once.  Near copies would still turn their own text into boilerplate:
documents that would be depleted by the lines seen in many texts alone count as
one document for each longest such line (the earliest of equal ones), which near
copies share.

Plan: one Arrow pass over the texts gives counts and distinct lines, which are
checkpointed; no later step reads a text.  Copies of a text fall together before
its lines are counted, counts use partial aggregation, and the lines above the
limits are joined back by :func:`shared.join_checked`.

Defined cases: null or wordless text has zero counts and fails the base rules;
a null host is one host of its own; rows are judged each by its own text, so a
repeated or null ``doc_id`` changes nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, covered, join_checked, per_document
from .words import LOWER, Words, buffers, hash_spans, mix, rolling, run_hashes, slices

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

WINDOW = 5
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UNIT = ["unit_a", "unit_b"]


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    max_repeat_percent: int = 20
    max_documents: int = 20
    min_left_words: int = 5
    min_left_share: float = 0.1


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, and the first line of each document."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(per)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    starts[first[:-1]] = offsets[:-1]
    starts[~opens] = breaks + 1
    closes = np.zeros(first[-1], bool)
    closes[first[1:] - 1] = True
    ends[first[1:] - 1] = offsets[1:]
    ends[~closes] = breaks
    assert len(breaks) == first[-1] - n
    return starts, ends, first


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def _later(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def base_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The per-document counts of one slice."""
    words = Words(data, offsets)
    own = mix(words.documents().astype(np.uint64) + np.uint64(1))
    valid = np.flatnonzero(words.room() >= WINDOW)
    keys = (rolling(words.hashes(), WINDOW) ^ own)[valid]
    hit = valid[_repeats(keys)]
    repeat = covered(hit, hit + WINDOW, len(words.starts))

    starts, ends, first = _line_spans(data, offsets)
    filled = np.flatnonzero(np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends))
    document = np.searchsorted(first, filled, side="right") - 1
    again = _later(hash_spans(data, starts[filled], ends[filled]) ^ mix(document.astype(np.uint64) + np.uint64(1)))

    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.subtract.at(inside, words.ends, 1)
    letters = (np.cumsum(inside, dtype=np.int8)[: len(data)] > 0) & ((data & 0xC0) != 0x80)
    return {
        "n_words": words.counts,
        "word_chars": per_document(letters, offsets),
        "n_symbols": per_document(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(document[again], minlength=len(offsets) - 1),
        "n_repeat_words": per_document(repeat, words.bounds),
    }


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, words and document of every line with a word, in order, and the number of the line.

    A line is normalised by lower-casing ASCII letters and collapsing white space.
    """
    words = Words(LOWER[data], offsets)
    starts, _, first = _line_spans(data, offsets)
    bounds = np.append(np.searchsorted(words.starts, starts), len(words.starts))
    filled = np.flatnonzero(np.diff(bounds))
    return run_hashes(words.hashes(), bounds)[filled], np.diff(bounds)[filled], np.searchsorted(first, filled, side="right") - 1, filled


def document_lines(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct normalised lines of each document, in the order of documents: key, words over all occurrences, first place."""
    key, size, document, _ = line_keys(data, offsets)
    _, at, which = np.unique(key ^ mix(document.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=size, minlength=len(at)).astype(np.int64)
    order = np.argsort(at)
    at = at[order]
    return {"document": document[at], "line": key[at], "words": total[order], "place": at}


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            text = buffers(part.column(1))
            counts, lines = base_features(*text), document_lines(*text)
            bounds = np.searchsorted(lines["document"], np.arange(part.num_rows + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(lines[x].view(np.int64)) for x in ("line", "words", "place")], ["line", "words", "place"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *part.columns[2:], *(pa.array(counts[x].astype(np.int64)) for x in _COUNTS), pa.ListArray.from_arrays(bounds, rows)],
                ["doc_id", *part.schema.names[2:], *_COUNTS, "lines"],
            )


def _units(documents: DataFrame, host: str) -> DataFrame:
    """doc_id, text, and a 128-bit key of host and text with the hash of the host."""
    name = F.col(host).cast("string")
    keys = [F.xxhash64(F.lit(k), name.isNull(), name, F.lit("\0"), "text").alias(unit) for k, unit in enumerate(_UNIT)]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys, F.xxhash64(name.isNull(), name).alias("host"))


def _depleted(gone: Column, limits: Limits) -> Column:
    left = F.col("n_words") - gone
    return (gone > 0) & ((left < limits.min_left_words) | (left < limits.min_left_share * F.col("n_words")))


def removed_lines(rows: DataFrame, limits: Limits) -> DataFrame:
    """Lines above the limits of every text that has any: unit key, line and words; ``rows`` as :func:`_told` makes them."""
    texts = rows.select(*_UNIT, "host", "n_words", "lines").dropDuplicates(_UNIT)
    lines = texts.select(*_UNIT, "n_words", "host", F.inline("lines")).withColumn("key", F.xxhash64("host", "line")).drop("host")
    many = F.col("n") > limits.max_documents
    counts = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(many).select("key")
    found = checkpointed(join_checked(lines, counts, "key", "left_semi"))
    longest = F.max(F.struct("words", (-F.col("place")).alias("place"), "key"))["key"]
    classes = found.groupBy(*_UNIT).agg(F.sum("words").alias("gone"), longest.alias("longest"), F.first("n_words").alias("n_words"))
    kind = _depleted(F.col("gone"), limits)
    classes = classes.select(*_UNIT, kind.alias("kind"), F.when(kind, F.col("longest")).otherwise(F.col("unit_a")).alias("class"))
    counted = found.select(*_UNIT, "key").join(classes.hint("merge"), _UNIT).groupBy("key", "kind", "class").agg(F.lit(1).alias("one"))
    above = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(many).select("key")
    return join_checked(found, above, "key", "left_semi").select(*_UNIT, "line", "words")


def apply(documents: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """One row per document: base counts, words and number of the distinct lines above the limits, and the verdict."""
    kinds = "".join(f", {x} long" for x in (*_UNIT, "host", *_COUNTS))
    rows = checkpointed(_units(documents, host).mapInArrow(_told, f"doc_id long{kinds}, lines array<struct<line:long,words:long,place:long>>"))
    removed = removed_lines(rows, limits).groupBy(*_UNIT).agg(F.sum("words").alias("n_line_words"), F.count(F.lit(1)).alias("n_lines_removed"))
    none = F.lit(0).cast("long")
    return (
        join_checked(rows.drop("lines", "host"), removed, _UNIT, "left").drop(*_UNIT)
        .withColumns({x: F.coalesce(x, none) for x in ("n_line_words", "n_lines_removed")})
        .withColumn("base_failed", (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")))
        .withColumn("depleted", _depleted(F.col("n_line_words"), limits))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = buffers(part.column(1))
            gone = part.column(2).to_pylist()
            key, _, document, number = line_keys(data, offsets)
            starts, ends, first = _line_spans(data, offsets)
            stays = np.ones(len(starts), bool)
            for k in np.flatnonzero([bool(x) for x in gone]):
                own = document == k
                stays[number[own]] = ~np.isin(key[own].view(np.int64), gone[k])
            raw, texts = data.tobytes(), part.column(1).to_pylist()
            for k in np.flatnonzero([bool(x) for x in gone]):
                kept = np.flatnonzero(stays[first[k] : first[k + 1]]) + first[k]
                texts[k] = b"\n".join(raw[starts[x] : ends[x]] for x in kept).decode()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "kept_text"])


def cleaned(documents: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """doc_id and kept_text, the text without its lines above the limits, of every document; a null text stays null."""
    units = _units(documents, host)
    kinds = "".join(f", {x} long" for x in (*_UNIT, "host", *_COUNTS))
    rows = checkpointed(units.mapInArrow(_told, f"doc_id long{kinds}, lines array<struct<line:long,words:long,place:long>>"))
    gone = removed_lines(rows, limits).groupBy(*_UNIT).agg(F.collect_list("line").alias("gone"))  # lines of one text
    return units.join(gone, _UNIT, "left").select("doc_id", "text", "gone").mapInArrow(_cleaned, "doc_id long, kept_text string")
