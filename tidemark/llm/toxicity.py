"""Toxicity by noisy-channel deobfuscation.

Writers hide words with leetspeak (``1d10t``), spacing (``i d i o t``, ``i-d iot``)
and repetition (``idiooot``).  Every run of tokens that could hide one becomes a
character lattice: a leet character may stand for a letter, a run of equal letters for
one or two, and a separator or space either ends a word or was put in and goes.  A
Viterbi pass under a character trigram model, with a cost for each undone trick,
restores the most likely words.  The restored text is then scored.

A run is a token with a trick or a separator beside letters, or neighbouring one-letter
tokens; where it begins or ends with a fragment of up to ``FRAGMENT`` letters the token
beside it belongs to it too.  Runs have any length: whenever all surviving paths share
a state the text up to there is settled.

A text is scored by evidence words.  A feature is a word, or its first 4, 5 or 6
bytes (which carries inflected languages); its evidence is the shrunk share of toxic
documents among the labelled documents with it, provided that a likelihood ratio
against the usual share is large.  A word counts with its strongest feature.  The sum
and the largest of the evidence log odds over a document's distinct words, their
number and the length of the text go through a logistic calibration, fitted on
evidence from the other half of the labelled documents.

Copies are no evidence of their own: a labelled document that is similar to one with a
smaller id, confirmed on full shingle sets, is not counted.

Both models are fitted on all labelled documents outside the held-out fold, unless a
caller asks for ``max_rows`` of them, in the order of a hash of their id.  Counts and
the sums of each Newton step are added up where the documents are; trigram counts over
28 character classes, the strong features and those sums are what reaches the driver.
Scoring tests all words of a slice at once against a bit table, so only likely hits are
looked up.

Defined cases: null, empty and wordless texts score as texts without evidence; of
several labels or texts of an id the smallest is learned from; without labels every
document scores 0; of equally cheap readings the one with the first listed alternative
wins; repeated rows get equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import Banding, full_sets, shingle_sets, sketch, verify
from .shared import checkpointed, fold, join_checked, one_row_an_id
from .words import LOWER, Words, buffers, hash_spans, mix, slices

#: What a leet character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*~"
PREFIXES = (4, 5, 6)
#: Letters of a fragment that may belong to the token beside it.
FRAGMENT = 2

_CLASSES = 28  # a to z, anything else, and the word edge
_EDGE, _OTHER = 27, 26
#: Calibration of a model without documents, and the fineness of the sums that one is fitted on.
BLANK = np.array([-30.0, 0, 0, 0, 0])
STEPS = float(1 << 28)
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TRICK = np.zeros(256, bool)
_TRICK[[ord(c) for c in LEET]] = True
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[97:123] = np.arange(26)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_SUMS = ("toxic_0", "toxic_1", "n_0", "n_1")


@dataclass(frozen=True)
class Settings:
    max_rows: int | None = None  # of labelled documents; none: all
    copy_percent: int = 80
    min_toxic: int = 2
    shrink: float = 2.0
    ratio: float = 9.0
    ridge: float = 0.5
    trick_cost: float = 1.0
    folds: int = 3
    held_out: int = 1


@dataclass
class Model:
    trigrams: np.ndarray  # (28, 28, 28) costs
    features: np.ndarray  # sorted hashes
    weights: np.ndarray  # evidence log odds of each
    calibration: np.ndarray  # of the document statistics


class Tokens:
    """Lower-cased tokens of a slice without the punctuation around them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        words = Words(self.data, offsets)
        n = len(data)
        solid = _ALNUM[self.data] if n else np.zeros(0, bool)
        place = np.arange(n)
        ahead = np.minimum.accumulate(np.where(solid, place, n)[::-1])[::-1] if n else place
        behind = np.maximum.accumulate(np.where(solid, place, -1)) if n else place
        starts = np.minimum(ahead[words.starts], words.ends) if n else words.starts
        ends = np.maximum(behind[words.ends - 1] + 1, starts) if n else words.ends
        self.raw_starts, self.raw_ends = words.starts, words.ends
        self.starts, self.ends, self.bounds, self.counts = starts, ends, words.bounds, words.counts
        self.document = words.documents()

    def features(self) -> list[np.ndarray]:
        """Per kind of feature, the hash of every token (0: it has none)."""
        length = self.ends - self.starts
        out = [np.where(length >= 3, hash_spans(self.data, self.starts, self.ends), 0)]
        for k, size in enumerate(PREFIXES):
            own = hash_spans(self.data, self.starts, np.minimum(self.starts + size, self.ends))
            out.append(np.where(length > size, mix(own + np.uint64(k + 1)), 0))
        return out

    def runs(self) -> list[tuple[int, int]]:
        """Half-open ranges of neighbouring tokens that could hide words."""
        data, n = self.data, len(self.data)
        if not len(self.starts):
            return []
        letter = _LETTER[data]
        again = np.zeros(n, bool)
        again[1:] = letter[1:] & (data[1:] == data[:-1])
        triple = np.zeros(n, bool)
        triple[2:] = again[2:] & again[1:-1]

        def within(flags: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return total[self.ends] - total[self.starts]

        size = self.ends - self.starts
        leading = (self.starts > self.raw_starts) & _TRICK[data[np.maximum(self.starts - 1, 0)]]
        repeats = (within(triple) > 0) | (within(again) >= 3)
        suspect = (within(letter) > 0) & (leading | repeats | (within(~letter) > 0))
        single = size == 1
        follows = np.zeros(len(size), bool)
        follows[1:] = self.document[1:] == self.document[:-1]
        beside = np.zeros(len(size), bool)
        beside[1:] |= single[:-1] & follows[1:]
        beside[:-1] |= single[1:] & follows[1:]
        part = suspect | (single & beside)
        if not part.any():
            return []
        # letters up to the first, and after the last, separator of a token
        place = np.arange(n)
        mark = _SEPARATOR[data]
        ahead = np.minimum.accumulate(np.where(mark, place, n)[::-1])[::-1]
        behind = np.maximum.accumulate(np.where(mark, place, -1))
        head = np.minimum(ahead[np.minimum(self.starts, n - 1)], self.ends) - self.starts
        tail = self.ends - np.maximum(behind[np.maximum(self.ends - 1, 0)] + 1, self.starts)
        at = np.flatnonzero(part)
        opens = np.concatenate([[True], (np.diff(at) > 1) | ~follows[at[1:]]])
        out: list[tuple[int, int]] = []
        for low, high in zip(at[opens], at[np.append(opens[1:], True)] + 1, strict=True):
            if head[low] <= FRAGMENT and follows[low]:
                low -= 1
            if high < len(size) and tail[high - 1] <= FRAGMENT and follows[high]:
                high += 1
            if out and low < out[-1][1]:  # two runs claim the token between them
                out[-1] = (out[-1][0], int(high))
            else:
                out.append((int(low), int(high)))
        return out

    def span(self, low: int, high: int) -> str:
        """Text of a run of tokens, a trick before the first one included."""
        parts = []
        for k in range(low, high):
            start = self.starts[k]
            if start > self.raw_starts[k] and _TRICK[self.data[start - 1]]:
                start -= 1
            parts.append(self.data[start : self.ends[k]].tobytes().decode("utf-8", "ignore"))
        return " ".join(parts)


def lattice(text: str) -> Iterator[list[tuple[str, int]]]:
    """Alternatives with the number of tricks each undoes, for every segment of a text; a space ends a word."""
    for run in re.finditer(r"(.)\1*", text, re.S):
        char, times = run[1], len(run[0])
        if char in SEPARATORS:
            yield [(" ", 0), ("", 1)]
            continue
        meanings = [(c, 1) for c in LEET.get(char, "")]
        if char.isalpha() or not meanings:
            meanings.append((char, 0))
        options = [(c * min(times, 2), cost * min(times, 2)) for c, cost in meanings]
        if times > 1:
            options += [(c, cost + 1) for c, cost in meanings]
        yield options


def _class(char: str) -> int:
    return ord(char) - 97 if "a" <= char <= "z" else _EDGE if char == " " else _OTHER


class Decoder:
    """Cheapest paths through lattices under a trigram model; distinct texts are decoded once."""

    def __init__(self, trigrams: np.ndarray, cost: float):
        self.table, self.cost, self.known = trigrams.tolist(), cost, {}

    def __call__(self, text: str) -> str:
        """The restored words, or the text itself where no trick is undone."""
        if text not in self.known:
            self.known[text] = self.restore(text)
        return self.known[text]

    def restore(self, text: str) -> str:
        told, tricks = self.best(text)
        return told if tricks else text

    def best(self, text: str) -> tuple[str, int]:
        """Words of the cheapest path and the tricks that it undoes."""
        table, cost, settled, undone = self.table, self.cost, [], 0
        paths: dict[tuple[int, int], tuple] = {(_EDGE, _EDGE): (0.0, 0, None, "")}
        for options in itertools.chain(lattice(text), [[(" ", 0)]]):
            after: dict[tuple[int, int], tuple] = {}
            for (a, b), path in paths.items():
                for piece, tricks in options:
                    x, y, total = a, b, path[0] + cost * tricks
                    for char in piece:
                        c = _class(char)
                        if c != _EDGE:
                            total += table[x][y][c]
                            x, y = y, c
                        elif y != _EDGE:
                            total += table[x][y][c]
                            x = y = _EDGE
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, path[1] + tricks, path, piece)
            paths = after
            if len(paths) == 1:  # all paths agree up to here
                ((state, path),) = paths.items()
                undone += path[1]
                back = []
                while path[2] is not None:
                    back.append(path[3])
                    path = path[2]
                settled += reversed(back)
                paths = {state: (0.0, 0, None, "")}
        return " ".join("".join(settled).split(" ")).strip(), undone


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of trigrams, backed off to bigrams."""
    three = counts.reshape(_CLASSES, _CLASSES, _CLASSES).astype(float)
    two = three.sum(axis=0) + 0.5
    base = two / two.sum(axis=1, keepdims=True)
    mixed = (three + 5 * base[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(mixed)


def restored(tokens: Tokens, decoder: Decoder) -> tuple[np.ndarray, list[str]]:
    """Documents and restored texts of all runs of tokens that hid something."""
    document, told = [], []
    for low, high in tokens.runs():
        raw = tokens.span(low, high)
        found = decoder(raw)
        if found != raw:
            document.append(tokens.document[low])
            told.append(found)
    return np.array(document, np.int64), told


def _restored_tokens(told: list[str]) -> Tokens:
    raw = [x.encode() for x in told]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return Tokens(np.frombuffer(b"".join(raw), np.uint8), offsets)


def evidence(features: list[np.ndarray], model: Model) -> np.ndarray:
    """The strongest evidence of each token over its features."""
    out = np.zeros(len(features[0]))
    if not len(model.features):
        return out
    bits = np.zeros(1 << 20, bool)
    bits[(model.features >> np.uint64(44)).astype(np.int64)] = True
    for values in features:
        at = np.flatnonzero(bits[(values >> np.uint64(44)).astype(np.int64)])
        where = np.minimum(np.searchsorted(model.features, values[at]), len(model.features) - 1)
        hit = model.features[where] == values[at]
        out[at[hit]] = np.maximum(out[at[hit]], model.weights[where[hit]])
    return out


def statistics(data: np.ndarray, offsets: np.ndarray, model: Model, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a slice: the statistics to calibrate, and its restored runs."""
    tokens = Tokens(data, offsets)
    n = len(offsets) - 1
    found = tokens.features()
    weight, document, word = evidence(found, model), tokens.document, found[0]
    from_document, told = restored(tokens, decoder)
    if told:
        again = _restored_tokens(told)
        more = again.features()
        weight = np.concatenate([weight, evidence(more, model)])
        document = np.concatenate([document, from_document[again.document]])
        word = np.concatenate([word, more[0]])
    hit = np.flatnonzero(weight > 0)
    _, first = np.unique(mix(word[hit] ^ mix(document[hit].astype(np.uint64) + np.uint64(1))), return_index=True)
    hit = hit[first]
    most = np.zeros(n)
    np.maximum.at(most, document[hit], weight[hit])
    total = np.bincount(document[hit], weights=weight[hit], minlength=n)
    number = np.bincount(document[hit], minlength=n)
    columns = [np.ones(n), np.log1p(total), most, np.log1p(number), (number > 0) * np.log1p(tokens.counts)]
    return np.stack(columns, axis=1), np.bincount(from_document, minlength=n)


def _sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Gradient and curvature of the log likelihood, in whole steps of 1 / ``STEPS`` so that no order of adding matters."""
    for batch in batches:
        if batch.num_rows:
            y, n = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 2))
            x = batch.column(1).flatten().to_numpy().reshape(len(y), -1)
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            each = np.concatenate([x * (y - p)[:, None], (x[:, :, None] * x[:, None, :] * (p * (1 - p))[:, None, None]).reshape(len(y), -1)], axis=1)
            told = np.rint(each * n[:, None] * STEPS).astype(np.int64).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(told))), pa.array(told)], ["at", "v"])


def calibrate(rows: DataFrame, ridge: float) -> np.ndarray:
    """Logistic regression of (toxic, x, n) rows by Newton steps over all of them; the ridge spares the intercept."""
    size = len(BLANK)
    beta, penalty = np.zeros(size), np.diag([1e-6] + [ridge] * (size - 1))
    for _ in range(50):
        told = rows.mapInArrow(partial(_sums, beta=beta), "at long, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("double").alias("v")).collect()
        sums = np.array([r.v for r in sorted(told)]) / STEPS  # size and size ** 2 rows
        step = np.linalg.solve(sums[size:].reshape(size, size) + penalty, sums[:size] - penalty @ beta)
        beta += step * min(1, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:  # steps shrink quadratically
            break
    return beta


def score(data: np.ndarray, offsets: np.ndarray, model: Model, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Scores and restored runs of each document of a slice."""
    x, n_restored = statistics(data, offsets, model, decoder)
    return 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30))), n_restored


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams (kind 0) and features (kind 1) of labelled documents, with toxic and all documents of each half."""
    trigrams = np.zeros(_CLASSES**3, np.int64)
    for batch in batches:
        for part in slices(batch):
            tokens = Tokens(*buffers(part.column(1)))
            toxic, half = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            inside = np.flatnonzero(tokens.ends > tokens.starts)
            trigrams += _trigram_counts(tokens.data, tokens.starts[inside], tokens.ends[inside])
            values = np.concatenate(tokens.features())
            document = np.tile(tokens.document, 1 + len(PREFIXES))
            real = np.flatnonzero(values)
            _, first = np.unique(mix(values[real] ^ mix(document[real].astype(np.uint64) + np.uint64(1))), return_index=True)
            own = real[first]
            found, which = np.unique(values[own], return_inverse=True)
            groups = np.bincount(4 * which + 2 * half[document[own]] + toxic[document[own]], minlength=4 * len(found)).reshape(-1, 2, 2)
            yield _counts(1, found, groups[:, :, 1], groups.sum(axis=2))
    seen = np.flatnonzero(trigrams)
    yield _counts(0, seen.astype(np.uint64), np.zeros((len(seen), 2), np.int64), np.stack([trigrams[seen], 0 * seen], axis=1))


def _trigram_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of class trigrams of words, each with two edges before and one after."""
    size = ends - starts + 3
    at = np.concatenate([[0], np.cumsum(size)])
    classes = np.full(at[-1] + 2, _EDGE, np.int64)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    body = (place >= 2) & (place < np.repeat(size, size) - 1)
    classes[: at[-1]][body] = _CLASS[data[(np.repeat(starts, size) + place - 2)[body]]]
    code = (classes[:-2] * _CLASSES + classes[1:-1]) * _CLASSES + classes[2:]
    return np.bincount(code[: at[-1]][place < np.repeat(size, size) - 2], minlength=_CLASSES**3)


def _counts(kind: int, keys: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    columns = [x.astype(np.int64) for x in (toxic[:, 0], toxic[:, 1], n[:, 0], n[:, 1])]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), *map(pa.array, columns)], ["kind", "key", *_SUMS])


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = shingle_sets(*buffers(part.column(1)), 4)
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                halves = np.concatenate(sketch(values, bounds, Banding(bands=2, rows=1)), axis=1)
                told = pa.ListArray.from_arrays(np.arange(0, halves.size + 1, 4, dtype=np.int32), pa.array(np.ascontiguousarray(halves).view(np.int64).ravel()))
                equal = [pa.array(np.add.reduceat(mix(values + np.uint64(seed)), bounds[:-1][full]).view(np.int64)) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(full)), *equal, told], ["doc_id", "set_a", "set_b", "keys"])


def copies(rows: DataFrame, percent: int) -> DataFrame:
    """Ids of rows, one an id, that are similar to a row of smaller id.

    Of equal sets, by a 128-bit hash, all but the smallest id are copies.  Among the rest a
    candidate is the smallest id under each of four minhashes; pairs are confirmed on full sets.
    """
    told = checkpointed(rows.select("doc_id", "text").mapInArrow(_copy_keys, "doc_id long, set_a long, set_b long, keys array<long>"))
    # checkpointed apart, so that a large group meets its smallest id in a join that adaptive execution can split
    owners = checkpointed(told.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    equal = told.select("doc_id").join(owners.hint("merge"), "doc_id", "left_anti")
    keys = checkpointed(told.join(owners.hint("merge"), "doc_id", "left_semi").select("doc_id", F.posexplode("keys")))
    first = checkpointed(keys.groupBy("pos", "col").agg(F.min("doc_id").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    pairs = keys.join(first.hint("merge"), ["pos", "col"]).where("other < doc_id").select(F.col("doc_id").alias("node"), "other")
    pairs = checkpointed(pairs.distinct())
    nodes = pairs.select(F.explode(F.array("node", "other")).alias("doc_id")).distinct()
    sets = full_sets(join_checked(rows.select("doc_id", "text"), nodes, "doc_id", "left_semi"), 4)
    return equal.union(verify(pairs, sets, percent).select(F.col("a").alias("doc_id")).distinct())


def _odds(base: float, settings: Settings, toxic: Column, n: Column) -> Column:
    """Log odds of a feature with a share of toxic documents well above the usual one; null for others."""
    usual = min(max(base, 1e-4), 0.5)
    share = (toxic + settings.shrink * usual) / (n + settings.shrink)
    ratio = toxic * F.log(share / usual) + (n - toxic) * F.log((1 - share) / (1 - usual))
    odds = F.log(share / (1 - share)) - math.log(usual / (1 - usual))
    return F.when((toxic >= settings.min_toxic) & (share > 2 * usual) & (ratio > settings.ratio), odds)


def _stated(batches: Iterator[pa.RecordBatch], models: list[Model], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Document statistics of labelled documents, each half under the evidence of the other."""
    decoder = Decoder(models[0].trigrams, settings.trick_cost)
    for batch in batches:
        for part in slices(batch):
            decoder.known.clear()
            half = part.column(3).to_numpy(zero_copy_only=False)
            for k, model in enumerate(models):
                own = part.take(pa.array(np.flatnonzero(half != k)))
                if own.num_rows:
                    x, _ = statistics(*buffers(own.column(1)), model, decoder)
                    yield pa.RecordBatch.from_arrays([own.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])


def learned(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, toxic and text of all labelled documents outside the held-out fold, one row an id, without copies."""
    outside = fold("doc_id", settings.folds) != settings.held_out
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic"))
    marks = one_row_an_id(marks.where(F.col("toxic").isNotNull() & outside))
    if settings.max_rows is not None:
        marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(outside)
    rows = checkpointed(join_checked(texts, marks, "doc_id", "inner").select("doc_id", "toxic", "text"))
    # only texts of repeated ids have to meet
    repeated = checkpointed(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    once = join_checked(rows, repeated, "doc_id", "left_anti")
    rows = once.union(checkpointed(one_row_an_id(join_checked(rows, repeated, "doc_id", "left_semi"))))
    return join_checked(rows, copies(rows, settings.copy_percent), "doc_id", "left_anti")


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit the models on all labelled documents outside the held-out fold."""
    rows = learned(documents, labels, settings)
    base = rows.agg(F.avg("toxic")).first()[0]
    rows = rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int").alias("half"))
    counts = rows.mapInArrow(_counted, "kind int, key long, " + ", ".join(f"{c} long" for c in _SUMS)).groupBy("kind", "key").agg(*(F.sum(c).alias(c) for c in _SUMS))
    toxic, n = (F.col("toxic_0"), F.col("toxic_1")), (F.col("n_0"), F.col("n_1"))
    odds = [_odds(base or 0.0, settings, *x).alias(name) for name, x in (("whole", (sum(toxic), sum(n))), ("first", (toxic[0], n[0])), ("second", (toxic[1], n[1])))]
    told = counts.select("kind", "key", "n_0", *odds).where("kind = 0 or whole is not null or first is not null or second is not null")
    told = told.toArrow()  # at most 28 ** 3 trigrams, and the strong features: what a model consists of
    kind, key = told["kind"].to_numpy(), told["key"].to_numpy()
    trigrams = np.zeros(_CLASSES**3, np.int64)
    trigrams[key[kind == 0]] = told["n_0"].to_numpy()[kind == 0]
    models = []
    for name in ("whole", "first", "second"):
        weights = told[name].to_numpy().astype(float)  # null: not a number
        strong = np.flatnonzero((kind == 1) & ~np.isnan(weights))
        strong = strong[np.argsort(key[strong].view(np.uint64))]
        models.append(Model(costs(trigrams), key[strong].view(np.uint64), weights[strong], BLANK))
    whole, *halves = models
    if base is not None:
        stated = rows.mapInArrow(partial(_stated, models=halves, settings=settings), "toxic int, x array<double>")
        whole.calibration = calibrate(checkpointed(stated.groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n"))), settings.ridge)
    return whole


def _scored(batches: Iterator[pa.RecordBatch], model: Model, settings: Settings) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(model.trigrams, settings.trick_cost)
    for batch in batches:
        for part in slices(batch):
            decoder.known.clear()
            scores, n_restored = score(*buffers(part.column(1)), model, decoder)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(n_restored.astype(np.int64))], ["doc_id", "score", "n_restored"])


def predict(documents: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_scored, model=model, settings=settings), "doc_id long, score double, n_restored long")


def apply(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """Learn from labels and score every document; one row per document."""
    held_out = F.coalesce(fold("doc_id", settings.folds) == settings.held_out, F.lit(False))
    scored = predict(documents, fit(documents, labels, settings), settings)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_restored")
