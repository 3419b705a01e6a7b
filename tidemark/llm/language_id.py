"""Language ID with a byte convolutional network.

Text is cut into windows of a fixed number of UTF-8 bytes.  Bytes are embedded,
filters of several widths slide over each window, max pooling keeps the best
response of every filter, and a softmax layer turns them into language
probabilities.  A document's probabilities are those of its windows, weighted by
their bytes; every byte of the text is in one window.

The network is trained in numpy on the driver, on all windows of at most ``max_rows``
labelled documents, taken in the order of a hash of their id.  Only text and the
language label are learned from.

At prediction time a filter over bytes is a sum of table look-ups (one entry per
pair of bytes), so whole slices of documents are scored with three gathers a byte.

Defined cases: null text, or text without a letter, is ``und`` with score 0; rows
with a null label or id are not learned from, and of rows that repeat an id the smallest
label and text is; with no labelled rows at all every document is ``und``; of equal
probabilities the language that sorts first is predicted; repeated rows get equal rows;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, one_row_an_id
from .words import buffers, slices

WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    window: int = 256
    embed: int = 8
    filters: int = 8
    max_rows: int = 1500
    epochs: int = 8
    batch: int = 64
    rate: float = 0.01
    folds: int = 5
    seed: int = 11


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, d)
    filters: list[np.ndarray]  # per width: (width, d, f)
    bias: np.ndarray  # (widths * f,)
    dense: np.ndarray  # (widths * f, classes)
    offset: np.ndarray  # (classes,)


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zero-padded windows of all documents, the bytes in each, and the windows of each document."""
    lengths = np.diff(offsets)
    per = -(-lengths // size)
    bounds = np.concatenate([[0], np.cumsum(per)])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)
    filled = np.minimum(np.repeat(lengths, per) - number * size, size)
    out = np.zeros((int(bounds[-1]), size), np.uint8)
    out[np.arange(size) < filled[:, None]] = data[: offsets[-1]]
    return out, filled, bounds


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings) -> Network:
    """Adam on the cross entropy of single windows, classes weighted equally."""
    rng = np.random.default_rng(settings.seed)
    d, f, c = settings.embed, settings.filters, len(languages)
    values = {"embed": rng.normal(0, 0.5, (256, d)), "bias": np.zeros(len(WIDTHS) * f), "dense": rng.normal(0, 0.3, (len(WIDTHS) * f, c)), "offset": np.zeros(c)}
    values |= {w: rng.normal(0, (w * d) ** -0.5, (w, d, f)) for w in WIDTHS}
    first = {k: np.zeros_like(v) for k, v in values.items()}
    second = {k: np.zeros_like(v) for k, v in values.items()}
    weight = (len(labels) / (c * np.maximum(np.bincount(labels, minlength=c), 1)))[labels]
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            x, n = windows[rows], len(rows)
            shown = values["embed"][x]
            pooled, places = [], []
            for w in WIDTHS:
                span = x.shape[1] - w + 1
                response = sum(shown[:, k : k + span] @ values[w][k] for k in range(w))
                places.append(response.argmax(axis=1))
                pooled.append(np.take_along_axis(response, places[-1][:, None], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + values["bias"]
            hidden = np.maximum(raw, 0)
            slope = _softmax(hidden @ values["dense"] + values["offset"])
            slope[np.arange(n), labels[rows]] -= 1
            slope *= weight[rows][:, None] / n
            grad = {"dense": hidden.T @ slope, "offset": slope.sum(axis=0), "embed": np.zeros_like(values["embed"])}
            back = (slope @ values["dense"].T) * (raw > 0)
            grad["bias"] = back.sum(axis=0)
            for j, w in enumerate(WIDTHS):
                part, grad[w] = back[:, j * f : (j + 1) * f], np.zeros_like(values[w])
                for k in range(w):
                    byte = np.take_along_axis(x, places[j] + k, axis=1)  # (n, f)
                    grad[w][k] = np.einsum("nfd,nf->df", values["embed"][byte], part)
                    np.add.at(grad["embed"], byte, part[:, :, None] * values[w][k].T[None])
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                values[k] -= settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, values["embed"], [values[w] for w in WIDTHS], values["bias"], values["dense"], values["offset"])


class Scorer:
    """A network with its filters laid out as tables over bytes and pairs of bytes."""

    def __init__(self, net: Network):
        taps = [[(net.embed @ w[k]).astype(np.float32) for k in range(len(w))] for w in net.filters]
        pair = [(t[0][:, None] + t[1][None]).reshape(65536, -1) for t in taps]
        self.first = np.concatenate(pair, axis=1)
        self.third = taps[1][2]
        self.last = (taps[2][2][:, None] + taps[2][3][None]).reshape(65536, -1)
        self.net, self.f = net, net.filters[0].shape[2]

    def windows(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """Language probabilities of each window."""
        out, f = np.empty((len(x), len(self.net.languages))), self.f
        for at in range(0, len(x), block):
            part = x[at : at + block]
            pairs = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            first = self.first[pairs]
            pooled = np.concatenate([
                first[:, :, :f].max(axis=1),
                (first[:, :-1, f : 2 * f] + self.third[part[:, 2:]]).max(axis=1),
                (first[:, :-2, 2 * f :] + self.last[pairs[:, 2:]]).max(axis=1),
            ], axis=1)
            out[at : at + block] = _softmax(np.maximum(pooled + self.net.bias, 0) @ self.net.dense + self.net.offset)
        return out


def _sampled(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """All windows of each document."""
    for batch in batches:
        for part in slices(batch):
            windows, _, bounds = cut_windows(*buffers(part.column(2)), settings.window)
            rows = pa.array(np.repeat(np.arange(part.num_rows), np.diff(bounds)))
            number = pa.array(np.arange(len(rows)) - np.repeat(bounds[:-1], np.diff(bounds)))
            raw = pa.Array.from_buffers(pa.binary(settings.window), len(rows), [None, pa.py_buffer(windows)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), number, raw], ["doc_id", "lang", "number", "window"])


def fit(documents: DataFrame, settings: Settings = Settings()) -> Network | None:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", settings.folds) != 0))
    chosen = labelled.groupBy("doc_id").agg(F.lit(1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows).select("doc_id")
    sample = one_row_an_id(labelled.join(F.broadcast(chosen), "doc_id", "left_semi"))  # at most max_rows ids
    found = sample.mapInArrow(partial(_sampled, settings=settings), "doc_id long, lang string, number long, window binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["doc_id", "number"], kind="stable")
    languages = sorted(set(found["lang"]))
    labels = np.searchsorted(languages, found["lang"].to_numpy(dtype=str))
    windows = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(len(found), -1)
    return train(windows, labels, languages, settings)


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None, window: int) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(net) if net else None
    for batch in batches:
        for part in slices(batch):
            lettered = part.column(2).to_numpy(zero_copy_only=False)
            names, scores = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
            if scorer:
                windows, filled, bounds = cut_windows(*buffers(part.column(1)), window)
                mean, full = np.zeros((part.num_rows, len(net.languages))), np.flatnonzero(np.diff(bounds))
                if len(full):
                    starts = bounds[:-1][full]
                    mean[full] = np.add.reduceat(scorer.windows(windows) * filled[:, None], starts, axis=0) / np.add.reduceat(filled, starts)[:, None]
                best = mean.argmax(axis=1)
                names[lettered] = np.array(net.languages, dtype=object)[best[lettered]]
                scores[lettered] = np.clip(mean[np.arange(len(best)), best][lettered], 0, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])


def predict(documents: DataFrame, net: Network | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered.alias("lettered"))
    return rows.mapInArrow(partial(_predict, net=net, window=settings.window), "doc_id long, lang_pred string, score double")


def apply(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Learn from the labelled documents and predict all; one row per document."""
    held_out = F.coalesce(fold("doc_id", settings.folds) == 0, F.lit(False))
    return predict(documents, fit(documents, settings), settings).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
