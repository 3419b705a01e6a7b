"""SentencePiece encoding and decoding by streaming Viterbi.

A text becomes the sequence of vocabulary pieces with the largest sum of scores.
The search runs left to right.  A piece can only reach back ``longest`` bytes, so
boundaries further back than that are settled through their descendants alone:
:class:`Stream` keeps that window of scores, and after every block of at most ``BLOCK``
bytes it follows the surviving backpointer paths to the boundary where they all meet,
commits the ids up to there and forgets them.  Memory is the window, a block and the
span not yet agreed on, whatever the length of the text.

All texts take this way.  Pieces that lie in a block are found for all its positions at
once, length by length, as long as some piece goes on; the search itself then visits only
these.  Where no piece has a space inside, all paths meet at the start of each space-led
unit, and equal units have equal ids, so the distinct units of a slice of whole documents
are streamed once, one after the other, and their ids dealt out to the documents.

The model file may be of any SentencePiece type; its pieces and scores are used as a
unigram lattice.  The shipped vocabulary was trained by merging, and merging does not
maximise a sum, so ids are those of a unigram segmentation (the best path of the
library's own lattice), not those of its merge order.  Decoding is the same for both.
Sums are kept in double precision from the start of each unit, in which the large penalty
of an unknown character does not blur later choices.

Defined cases: null and empty texts have no ids; characters outside the vocabulary
become byte pieces (or the unknown id where there are none); a literal space mark
decodes to a space; of equal sums the path whose last piece is longest wins; repeated
rows get equal ids; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffers, hash_spans, slices

MARK = "▁".encode()
SLICE = 4 << 20
#: Bytes after which a stream commits what its paths agree on.
BLOCK = 16 << 10

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_NEVER = float("-inf")


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class Vocabulary:
    """Pieces and scores of a model file, with the tables that encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            raw = file.read()
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.unknown, self.byte_ids, self.prefix = 0, np.full(256, -1, np.int32), True
        self.texts: list[bytes] = []
        normal = {}
        for field, value in _fields(raw):
            if field == 1:
                told = dict(_fields(value))
                piece, score, kind = told[1], struct.unpack("<f", told.get(2, bytes(4)))[0], told.get(3, 1)
                number = len(self.pieces)
                text = piece.replace(MARK, b" ")
                if kind in (1, 4):
                    normal.setdefault(text, (number, score))
                elif kind == 6:
                    text = bytes([int(piece[3:5], 16)])
                    self.byte_ids[text[0]] = number
                elif kind == 2:
                    self.unknown, text = number, " ⁇ ".encode()
                else:
                    text = b""
                self.pieces.append(piece)
                self.scores.append(score)
                self.texts.append(text)
            elif field == 3:
                self.prefix = bool(dict(_fields(value)).get(3, 1))
        self.longest = max(map(len, normal))
        self.penalty = min(score for _, score in normal.values()) - 10.0
        #: No piece goes on past a space that follows something else.
        self.parted = not any(b" " in text.lstrip(b" ") for text in normal)
        table = {}
        for text, (number, score) in normal.items():
            value = 0
            for k, byte in enumerate(text):
                value = (value * _BASE + byte + 1) & ((1 << 64) - 1)
                table.setdefault((value, k + 1), (-1, 0.0))
            table[value, len(text)] = (number, score)
        values, lengths = (np.array(x, kind) for x, kind in zip(zip(*table, strict=True), (np.uint64, np.int64), strict=True))
        keys = _finish(values, lengths.astype(np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.numbers = np.array([n for n, _ in table.values()], np.int64)[order]
        self.values = np.array([x for _, x in table.values()])[order]
        #: First place of the keys with equal leading bits (beyond the end: none), and the most that share them.
        lead = (self.keys >> np.uint64(42)).astype(np.int64)
        self.first = np.full(1 << 22, len(self.keys), np.int32)
        self.first[lead[::-1]] = np.arange(len(lead), dtype=np.int32)[::-1]
        self.run = int(np.unique(lead, return_counts=True)[1].max())
        self.padded = np.append(self.keys, np.zeros(self.run, np.uint64))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that are pieces or begin one, and their places in the tables."""
        at = self.first[(keys >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(at < len(self.keys))
        at, keys = at[maybe], keys[maybe]
        hit = self.padded[at] == keys
        for k in range(1, self.run):
            more = ~hit & (self.padded[at + k] == keys)
            at, hit = np.where(more, at + k, at), hit | more
        return maybe[hit], at[hit]

    def spelled(self, character: bytes) -> list[int]:
        """Ids of a character outside the vocabulary."""
        ids = [int(self.byte_ids[b]) for b in character]
        return [self.unknown] if min(ids) < 0 else ids


def _finish(values: np.ndarray, length: np.ndarray | np.uint64) -> np.ndarray:
    values = (values + length) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29)) ^ (values << np.uint64(17))


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    return tuple(np.cumprod(np.array([1] + [x] * (n - 1), np.uint64), dtype=np.uint64) for x in (_BASE, _INVERSE))


def arcs(text: np.ndarray, after: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, score and id of all pieces in whole characters that end beyond ``after``, by end, the longest first.

    A character outside the vocabulary is an arc with the id -1 - its bytes as a number.
    """
    n = len(text)
    heads = np.append((text & 0xC0) != 0x80, True)
    power, inverse = _powers(1 << (n + 1).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * inverse[:n], dtype=np.uint64)])
    live, found = np.flatnonzero(heads[:n]), []
    known = np.zeros(n + 1, bool)
    next_head = np.append(live[1:], n)
    width = np.zeros(n + 1, np.int64)
    width[live] = next_head - live
    characters = live
    for length in range(1, min(vocab.longest, n) + 1):
        live = live[live + length <= n]
        if not len(live):
            break
        end = live + length
        hit, at = vocab.find(_finish((total[end] - total[live]) * power[end - 1], np.uint64(length)))
        live, end = live[hit], end[hit]
        whole = (vocab.numbers[at] >= 0) & heads[end]
        known[live[whole & (width[live] == length)]] = True
        told = whole & (end > after)
        found.append((live[told], end[told], vocab.values[at[told]], vocab.numbers[at[told]]))
    lone = characters[~known[characters] & (characters + width[characters] > after)]
    code = np.zeros(len(lone), np.int64)
    for k in range(4):
        more = width[lone] > k
        code[more] = code[more] * 256 + text[lone[more] + k]
    found.append((lone, lone + width[lone], np.full(len(lone), vocab.penalty), -1 - code))
    start, end, score, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(end * (n + 1) + start)
    return start[order], end[order], score[order], number[order]


class Stream:
    """Streaming encoder; feed it UTF-8 bytes and take the ids that are certain, each with the place where its piece ends."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.tail = np.zeros(0, np.uint8)  # the bytes that a later piece may still hold
        self.opens = np.zeros(0, bool)  # which of them begin a unit
        self.rest = np.zeros(0, np.uint8)  # a character that is not whole yet
        self.best = [0.0]  # score of each boundary in the window
        self.end = self.root = 0  # bytes taken, and committed
        self.origin, self.piece = [0], [0]  # for each boundary from the root on, where its last piece starts, and its id

    def feed(self, data: bytes | np.ndarray, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids that are certain now.  ``opens`` tells which bytes no piece may reach over to; by default they follow from the spaces."""
        data = np.concatenate([self.rest, np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data])
        first = np.flatnonzero((data[-4:] & 0xC0) != 0x80)
        whole = len(data)
        if len(first):
            at = max(len(data) - 4, 0) + int(first[-1])
            lead = data[at]
            if at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) > len(data):
                whole = at
        self.rest, data = data[whole:], data[:whole]
        if opens is None:
            space = data == 32
            before = np.concatenate([self.tail[-1:] == 32, space[:-1]])[: len(data)] if len(self.tail) else np.concatenate([[True], space[:-1]])[: len(data)]
            opens = space & ~before if self.vocab.parted else np.zeros(len(data), bool)
        heads = np.append((data & 0xC0) != 0x80, True)
        told, at = [], 0
        while at < len(data):
            to = min(at + BLOCK, len(data))
            while not heads[to]:
                to += 1
            self._block(data[at:to], opens[at:to])
            told.append(self._commit())
            at = to
        return _joined(told)

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best path to the end."""
        return self._path(self.end)

    def _block(self, data: np.ndarray, opens: np.ndarray) -> None:
        text, opens = np.concatenate([self.tail, data]), np.concatenate([self.opens, opens])
        old, n = len(self.tail), len(text)
        start, end, score, number = arcs(text, old, self.vocab)
        units = np.flatnonzero(opens)
        if len(units):
            beyond = np.append(units, n)[np.cumsum(opens)]
            inside = end <= beyond[start]
            start, end, score, number = start[inside], end[inside], score[inside], number[inside]
        # the start of a unit counts from 0 anew, at a place of its own
        source = np.where(np.append(opens, False)[start], start + n + 1, start)
        best = [*self.best, *[_NEVER] * (n - old), *[0.0] * (n + 1)]
        chosen = [0] * (n + 1)
        for k, (a, b, x) in enumerate(zip(source.tolist(), end.tolist(), score.tolist(), strict=True)):
            total = best[a] + x
            if total > best[b]:
                best[b] = total
                chosen[b] = k
        arc = np.array(chosen[old + 1 :], np.int64)
        self.origin += (start[arc] + (self.end - old)).tolist()
        self.piece += number[arc].tolist()
        self.end += n - old
        keep = min(n, self.vocab.longest)
        self.tail, self.opens, self.best = text[n - keep :], opens[n - keep :], best[n - keep : n + 1]

    def _commit(self) -> tuple[np.ndarray, np.ndarray]:
        low = self.end - len(self.tail)
        reached = {low + k for k, x in enumerate(self.best) if x > _NEVER and (low + k > self.end - self.vocab.longest or low == 0)}
        while len(reached) > 1:
            latest = max(reached)
            reached.remove(latest)
            reached.add(self.origin[latest - self.root])
        (meeting,) = reached
        if meeting <= self.root:
            return _joined([])
        told = self._path(meeting)
        self.origin, self.piece = self.origin[meeting - self.root :], self.piece[meeting - self.root :]
        self.root = meeting
        return told

    def _path(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        ends, origin, root = [], self.origin, self.root
        while at != root:
            ends.append(at)
            at = origin[at - root]
        ends = np.array(ends[::-1], np.int64)
        ids = np.array([self.piece[k] for k in (ends - root).tolist()], np.int64)
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            spelled = [self.vocab.spelled((-1 - int(k)).to_bytes(4, "big").lstrip(b"\0") or b"\0") for k in ids[lost]]
            each = np.ones(len(ids), np.int64)
            each[lost] = [len(x) for x in spelled]
            own = np.repeat(ids < 0, each)
            ids, ends = np.repeat(ids, each), np.repeat(ends, each)
            ids[own] = [k for x in spelled for k in x]
        return ids.astype(np.int32), ends


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *(x for x, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(x for _, x in parts)])


def encode_slice(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a slice, and their bounds."""
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths)
    if vocab.prefix:
        data = np.insert(data, offsets[:-1][full], 32)
        lengths = lengths + (lengths > 0)
    raw = data.tobytes()
    if MARK in raw:  # a literal mark is a space
        bounds = np.cumsum(lengths) - lengths
        texts = [raw[a : a + b].replace(MARK, b" ") for a, b in zip(bounds, lengths, strict=True)]
        lengths = np.array([len(x) for x in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    space = data == 32
    opens = space.copy() if vocab.parted else np.zeros(len(data), bool)
    opens[1:] &= ~space[:-1]
    opens[bounds[:-1][lengths > 0]] = True
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(data))
    per = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(lengths) + 1, np.int64)
    _, first, which = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
    begin, size = starts[first], (ends - starts)[first]
    at = np.concatenate([[0], np.cumsum(size)])
    units = data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
    fresh = np.zeros(len(units), bool)
    fresh[at[:-1]] = True
    stream = Stream(vocab)
    ids, places = _joined([stream.feed(units, fresh), stream.close()])
    at = np.searchsorted(places, at, side="right")
    size = np.diff(at)[which]
    total = np.concatenate([[0], np.cumsum(size)])
    return ids[np.arange(total[-1]) - np.repeat(total[:-1], size) + np.repeat(at[:-1][which], size)], total[per]


def decode(ids: np.ndarray, vocab: Vocabulary) -> str:
    """Text of a sequence of ids."""
    text = b"".join(vocab.texts[k] for k in ids)
    return (text[1:] if vocab.prefix and text[:1] == b" " else text).decode("utf-8", "replace")


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            ids, bounds = encode_slice(*buffers(part.column(1)), vocab)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        texts = [None if ids is None else decode(ids, vocab) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(documents: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_encoded, path=model or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every sequence of ids."""
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(partial(_decoded, path=model or public_tokenizers.path("piece_bpe_32k.model")), "doc_id long, text string")


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    table = np.array([len(x) for x in vocab.texts], np.int64)
    start, letters = np.cumsum(table) - table, np.frombuffer(b"".join(vocab.texts), np.uint8)
    byte_piece = np.zeros(len(vocab.texts), bool)
    byte_piece[vocab.byte_ids[vocab.byte_ids >= 0]] = True
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            data, offsets = buffers(part.column(1))
            ids, bounds = encode_slice(data, offsets, vocab)
            size = table[ids]
            total = np.concatenate([[0], np.cumsum(size)])
            text = letters[np.repeat(start[ids], size) + np.arange(total[-1]) - np.repeat(total[:-1], size)]
            raw, back, source = memoryview(ids.astype("<u4")).cast("B"), text.tobytes(), data.tobytes()
            low, high = total[bounds[:-1]], total[bounds[1:]]
            same = [back[a + (b > a and vocab.prefix) : b] == source[c:d] for a, b, c, d in zip(low, high, offsets[:-1], offsets[1:], strict=True)]
            marks = np.concatenate([[0], np.cumsum(byte_piece[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(np.diff(bounds)), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64()),
                    pa.array(marks[bounds[1:]] - marks[bounds[:-1]]), pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "round_trip"],
            )


def apply(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Per document: ids counted and digested, byte pieces, and whether decoding gives the text back."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return rows.mapInArrow(partial(_digests, path=path), "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean")
