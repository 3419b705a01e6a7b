"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``passage`` words.  Each passage is encoded
(surface statistics, then a learned tanh layer), a gated attention unit weighs the
passages of the bag, and a logistic layer scores the weighted representation.
Attention and encoder are learned together from document labels alone.

Training runs in numpy on the driver, on every passage of at most ``max_rows`` labelled
documents, taken in the order of a hash of their id; scoring encodes every passage of
every whole text.

Defined cases: null, empty and wordless texts are one passage of zeros, so they
score like nothing; of several labels or texts of an id the smallest is learned from;
without labels every score is 0.5; repeated rows get equal rows; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, one_row_an_id, pack
from .words import LOWER, Words, buffers, hash_spans, mix, rolling, slices

#: Byte classes whose share of a passage is a feature.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "pause": b".,;:", "loud": b"!?", "symbol": b"#*$%&", "table": b"|<>{}[]\\/=_~^",
    "other": bytes(range(128, 256)), "quote": b"'\"()-@+`", "newline": b"\n",
}


@dataclass(frozen=True)
class Settings:
    passage: int = 64
    hidden: int = 16
    gates: int = 8
    max_rows: int = 4000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    folds: int = 5
    seed: int = 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]


def _total(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values, dtype=np.float64)])


def _seen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are not the first of their kind, and how often each occurs."""
    _, first, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    return again, n[which]


def encode(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of all passages of a slice, and the passages of each document."""
    words = Words(data, offsets)
    per = np.maximum(-(-words.counts // size), 1)
    bounds = np.concatenate([[0], np.cumsum(per)])
    number = np.arange(bounds[-1]) - np.repeat(bounds[:-1], per)
    low = np.repeat(words.bounds[:-1], per) + number * size
    high = np.minimum(low + size, np.repeat(words.bounds[1:], per))
    n = np.maximum(high - low, 1)
    columns = []
    if len(words.starts):
        last = len(words.starts) - 1
        from_, to = words.starts[np.minimum(low, last)], np.where(high > low, words.ends[np.maximum(high - 1, 0)], words.starts[np.minimum(low, last)])
        span = np.maximum(to - from_, 1)
        for members in _CLASSES.values():
            table = np.zeros(256, np.int8)
            table[list(members)] = 1
            total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
            columns.append((total[to] - total[from_]) / span)
        length = words.ends - words.starts
        hashes = hash_spans(LOWER[data], words.starts, words.ends)
        document = mix(words.documents().astype(np.uint64) + np.uint64(1))
        passage = mix(np.repeat(np.arange(bounds[-1]), high - low).astype(np.uint64) + np.uint64(77))
        in_passage, _ = _seen(hashes ^ passage)
        in_document, often = _seen(rolling(hashes, 3) ^ document)
        edge = np.zeros(256, bool)
        edge[list(b"!#*$%&|")] = True
        ends_odd = edge[data[words.ends - 1]]
        for value in (length, np.minimum(length, 40) ** 2, length <= 3, length >= 12, in_passage, in_document, np.log1p(often), ends_odd):
            total = _total(value)
            columns.append((total[high] - total[low]) / n)
    else:
        columns = [np.zeros(bounds[-1])] * (len(_CLASSES) + 8)
    columns += [np.log1p(high - low), np.log1p(np.repeat(words.counts, per))]
    return np.stack(columns, axis=1), bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(x: np.ndarray, bounds: np.ndarray, layers: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Scores of bags, and what the backward pass needs; attention is the ``attention`` entry."""
    h = np.tanh(x @ layers["encode"] + layers["shift"])
    tanh, gate = np.tanh(h @ layers["value"]), _sigmoid(h @ layers["gate"])
    energy = (tanh * gate) @ layers["focus"]
    starts, per = bounds[:-1], np.diff(bounds)
    energy = np.exp(energy - np.repeat(np.maximum.reduceat(energy, starts), per))
    attention = energy / np.repeat(np.add.reduceat(energy, starts), per)
    bag = np.add.reduceat(attention[:, None] * h, starts)
    return _sigmoid(bag @ layers["score"] + layers["base"][0]), {"h": h, "tanh": tanh, "gate": gate, "attention": attention, "bag": bag}


def _gradient(x: np.ndarray, bounds: np.ndarray, layers: dict[str, np.ndarray], slope: np.ndarray, kept: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    per = np.diff(bounds)
    h, tanh, gate, attention, bag = (kept[k] for k in ("h", "tanh", "gate", "attention", "bag"))
    of_bag = np.repeat(slope[:, None] * layers["score"], per, axis=0)
    of_energy = attention * ((h - np.repeat(bag, per, axis=0)) * of_bag).sum(axis=1)
    of_tanh = of_energy[:, None] * layers["focus"] * gate * (1 - tanh**2)
    of_gate = of_energy[:, None] * layers["focus"] * tanh * gate * (1 - gate)
    of_h = (attention[:, None] * of_bag + of_tanh @ layers["value"].T + of_gate @ layers["gate"].T) * (1 - h**2)
    return {
        "score": bag.T @ slope, "base": np.array([slope.sum()]), "focus": (tanh * gate).T @ of_energy, "value": h.T @ of_tanh,
        "gate": h.T @ of_gate, "encode": x.T @ of_h, "shift": of_h.sum(axis=0),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """Adam on the cross entropy of whole bags."""
    rng = np.random.default_rng(settings.seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    bags = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    d, h, g = every.shape[1], settings.hidden, settings.gates
    layers = {"encode": rng.normal(0, d**-0.5, (d, h)), "shift": np.zeros(h), "value": rng.normal(0, h**-0.5, (h, g)), "gate": rng.normal(0, h**-0.5, (h, g)), "focus": rng.normal(0, g**-0.5, g), "score": rng.normal(0, h**-0.5, h), "base": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in layers.items()} for _ in range(2))
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            x = np.concatenate([bags[k] for k in rows])
            bounds = np.concatenate([[0], np.cumsum([len(bags[k]) for k in rows])])
            scores, kept = forward(x, bounds, layers)
            grad = _gradient(x, bounds, layers, (scores - labels[rows]) / len(rows), kept)
            step += 1
            for k, v in grad.items():
                v = v + settings.decay * layers[k]
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                layers[k] = layers[k] - settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, layers)


def _bags(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, bounds = encode(*buffers(part.column(2)), settings.passage)
            told = [pack(x[a:b].astype(np.float32)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(told, pa.binary())], ["doc_id", "quality", "bag"])


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Train on a bounded sample of labelled documents outside the held-out fold."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = one_row_an_id(marks.where(F.col("quality").isNotNull() & (fold("doc_id", settings.folds) != 0)))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id")  # at most max_rows ids
    rows = one_row_an_id(rows.select("doc_id", "quality", "text"))
    found = rows.mapInArrow(partial(_bags, settings=settings), "doc_id long, quality int, bag binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values("doc_id", kind="stable")
    width = len(_CLASSES) + 10
    bags = [np.frombuffer(b, np.float32).reshape(-1, width).astype(float) for b in found["bag"]]
    return train(bags, found["quality"].to_numpy(float), settings)


def _scored(batches: Iterator[pa.RecordBatch], model: Model | None, settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            x, bounds = encode(*buffers(part.column(1)), settings.passage)
            if model is None:
                scores = np.full(part.num_rows, 0.5)
            else:
                scores, _ = forward(np.clip((x - model.mean) / model.scale, -8, 8), bounds, model.layers)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(np.diff(bounds))], ["doc_id", "score", "n_passages"])


def predict(documents: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_scored, model=model, settings=settings), "doc_id long, score double, n_passages long")


def apply(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.3) -> DataFrame:
    """Learn from labels and score every document; one row per document."""
    held_out = F.coalesce(fold("doc_id", settings.folds) == 0, F.lit(False))
    scored = predict(documents, fit(documents, labels, settings), settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
