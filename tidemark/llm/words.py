"""Vectorised word handling for the corpus operators.

Everything here works on one *slice* of an Arrow string column: the UTF-8 bytes
of a few megabytes of whole documents plus their offsets.  A word is a maximal
run of bytes other than space and ``\\t\\n\\v\\f\\r``, which on valid UTF-8 is the
same as the character class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Whole documents are handled in slices of about this many bytes, whatever the
#: size of the Arrow batch that brought them; one longer document is one slice.
SLICE_BYTES = 2 << 20

#: Words longer than this are hashed one by one instead of lane by lane.
LONG_WORD = 256

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, 3 modulo 8: differences of its powers keep their low bits


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a bijection with full avalanche)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, dtype=np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` text bytes each."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of one slice: byte spans, and per document a range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = ~SPACE[data]
        n = len(data)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def room(self) -> np.ndarray:
        """For each word, how many words its document still has from there on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))

    def documents(self) -> np.ndarray:
        """For each word, the row of its document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes of all spans at a time."""
    length = ends - starts
    out = length.astype(np.uint64) * _GOLDEN
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    live, at, rest = None, starts, length
    while len(at):
        value = lanes[at] & _LANE_MASK[np.minimum(rest, 8)]
        if live is None:
            out = mix(out ^ value)
            live = np.flatnonzero((length > 8) & (length <= LONG_WORD))
            at, rest = starts[live] + 8, length[live] - 8
        else:
            out[live] = mix((out[live] + _GOLDEN) ^ value)
            keep = rest > 8
            live, at, rest = live[keep], at[keep] + 8, rest[keep] - 8
    for k in np.flatnonzero(length > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent hash of ``values[i : i + width]`` for every i.

    The result is as long as the input; the last ``width - 1`` entries run past
    its end and mean nothing.  Widths are built by doubling, so the cost is
    logarithmic in ``width``.
    """
    n = len(values)
    power = np.concatenate([values, np.zeros(width, np.uint64)])
    size, done, out = 1, 0, None
    while True:
        if width & size:
            if out is None:
                out = power.copy()
            else:
                shifted = np.zeros_like(power)
                shifted[: len(power) - done] = power[done:]
                out *= np.uint64(pow(_BASE, size, 1 << 64))
                out += shifted
            done += size
        if done == width:
            return mix(out[:n])
        shifted = np.zeros_like(power)
        shifted[: len(power) - size] = power[size:]
        power = power * np.uint64(pow(_BASE, size, 1 << 64)) + shifted
        size *= 2


def run_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Order-dependent hash of each run ``values[bounds[k] : bounds[k + 1]]``; 0 where a run is empty."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    if len(values):
        place = np.arange(len(values)) - np.repeat(bounds[:-1], n)
        terms = mix(values + (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN)
        full = np.flatnonzero(n)
        out[full] = mix(np.add.reduceat(terms, bounds[:-1][full]) + n[full].astype(np.uint64))
    return out
