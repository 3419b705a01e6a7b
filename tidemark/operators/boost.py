"""Boosted trees on an offset margin, grown from histograms that Spark aggregates.

Features are binned once, by quantiles of a sample of training rows that a hash of their
key picks.  For each level of a tree a task sums gradients and curvatures of its rows by
(node, feature, bin) in one array, so what moves is bounded by tasks x nodes x features x
bins however many rows there are; the best split is picked from the summed table on the
driver.  Rows are sampled by a hash of (user, review, round, seed), so a fit does not depend
on partitioning but for the last bits of sums.

Margins are checkpointed every few rounds; between these the trees grown since are applied
on the fly.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import checkpointed


@dataclass(frozen=True)
class Settings:
    depth: int = 6
    eta: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 20.0
    reg_lambda: float = 1.0
    rounds: int = 600
    patience: int = 30
    bins: int = 64
    seed: int = 0
    checkpoint_every: int = 10


@dataclass
class Model:
    """Trees as lists of nodes (feature, cut, left, right, value); a leaf has feature -1."""

    features: list[str]
    cuts: list[list[float]]
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)
    best_round: int = -1
    best_score: float | None = None
    identity: str = ""

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"))

    @staticmethod
    def loads(text: str) -> Model:
        told = json.loads(text)
        told["trees"] = [[tuple(n) for n in tree] for tree in told["trees"]]
        return Model(**told)


def bin_cuts(train: DataFrame, features: list[str], bins: int, sample: int = 100_000) -> list[list[float]]:
    """Inner quantile cuts of each feature, over about ``sample`` training rows picked by a hash of user and review."""
    share = min(1.0, sample / max(train.count(), 1))
    picked = F.pmod(F.xxhash64(F.lit(11), F.col("user"), F.col("review_th")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = train.where(picked).select(*(F.col(f).cast("double") for f in features)).toPandas()  # about ``sample`` rows
    shares = [k / bins for k in range(1, bins)]
    return [sorted({float(x) for x in np.quantile(rows[f], shares, method="inverted_cdf")}) if len(rows) else [] for f in features]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]], name: str = "bins") -> DataFrame:
    """Bin numbers of all features: how many cuts lie below or at the value."""
    columns = [c for c in rows.columns if c not in features]

    @F.pandas_udf("array<short>")
    def numbers(values: pd.DataFrame) -> pd.Series:
        out = np.stack([np.searchsorted(c, values.iloc[:, k].to_numpy(float), side="right") for k, c in enumerate(cuts)], axis=1).astype(np.int16)
        return pd.Series(list(out))

    return rows.select(*columns, numbers(F.struct(*(F.col(f).cast("double").alias(f) for f in features))).alias(name))


_CELLS = "node int, feature int, bin int, g double, h double, n long"


def histograms(rows: DataFrame, chosen: list[int], node: Column) -> DataFrame:
    """Gradient, curvature and rows by node, feature and bin."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for batch in batches:
            nodes, g, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            bins = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(nodes), -1)
            for one in np.unique(nodes):
                own = np.flatnonzero(nodes == one)
                for f in chosen:
                    at = bins[own, f]
                    told = np.stack([np.bincount(at, weights=w) for w in (g[own], h[own], np.ones(len(own)))])
                    have = cells.get((int(one), f))
                    if have is not None:
                        wide = np.zeros((3, max(told.shape[1], have.shape[1])))
                        wide[:, : told.shape[1]] += told
                        wide[:, : have.shape[1]] += have
                        told = wide
                    cells[int(one), f] = told
        for (one, f), told in cells.items():
            at = np.flatnonzero(told[2])
            whole = [np.full(len(at), x, np.int32) for x in (one, f)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, whole), pa.array(at.astype(np.int32)), pa.array(told[0, at]), pa.array(told[1, at]), pa.array(told[2, at].astype(np.int64))], ["node", "feature", "bin", "g", "h", "n"])

    spread = rows.select(node.cast("int").alias("node"), "bins", F.col("g").cast("double").alias("g"), F.col("h").cast("double").alias("h"))
    parts = spread.mapInArrow(sums, _CELLS)
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(table: pd.DataFrame, settings: Settings) -> dict[int, tuple[float, int, int, float, float, float, float]]:
    """Per node, the split of largest gain: gain, feature, last left bin, and sums of both sides."""
    found: dict[int, tuple] = {}
    lam = settings.reg_lambda
    for (node, feature), part in table.sort_values(["node", "feature", "bin"]).groupby(["node", "feature"], sort=True):
        g, h = part["g"].to_numpy().cumsum(), part["h"].to_numpy().cumsum()
        if len(g) < 2:
            continue
        left_g, left_h = g[:-1], h[:-1]
        right_g, right_h = g[-1] - left_g, h[-1] - left_h
        gain = left_g**2 / (left_h + lam) + right_g**2 / (right_h + lam) - g[-1] ** 2 / (h[-1] + lam)
        gain[(left_h < settings.min_child_weight) | (right_h < settings.min_child_weight)] = -np.inf
        gain = np.round(gain, 9)  # the order of sums may change the last bits
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (node not in found or gain[k] > found[node][0]):
            found[node] = (float(gain[k]), int(feature), int(part["bin"].iloc[k]), float(left_g[k]), float(left_h[k]), float(right_g[k]), float(right_h[k]))
    return found


def _leaf_values(tree: list[tuple], bins: np.ndarray, cuts: list[list[float]] | None, values: np.ndarray | None) -> np.ndarray:
    """Values of a tree's leaves for rows given as bin numbers, or as raw values where there are no bins."""
    at = np.zeros(len(bins if values is None else values), np.int64)
    feature, cut, left, right, value = (np.array(x) for x in zip(*tree, strict=True))
    for _ in range(64):
        inner = feature[at] >= 0
        if not inner.any():
            break
        rows = np.flatnonzero(inner)
        node = at[rows]
        if values is None:
            low = bins[rows, feature[node]] < np.array([np.searchsorted(cuts[f], c, side="right") for f, c in zip(feature, cut, strict=True)])[node]
        else:
            low = values[rows, feature[node]] < cut[node]
        at[rows] = np.where(low, left[node], right[node])
    return value[at]


def add_trees(rows: DataFrame, model: Model, trees: list[list[tuple]]) -> DataFrame:
    """Margins after more trees, from bins."""
    if not trees:
        return rows
    cuts = model.cuts

    @F.pandas_udf("double")
    def leaves(bins: pd.Series) -> pd.Series:
        x = np.stack(bins.to_numpy())
        return pd.Series(sum(_leaf_values(tree, x, cuts, None) for tree in trees))

    return rows.withColumn("margin", F.col("margin") + leaves("bins"))


def grow(sample: DataFrame, model: Model, settings: Settings, chosen: list[int]) -> list[tuple]:
    """One tree over rows with bins, g and h; ``sample`` should be cached."""
    tree: list[tuple] = [(-1, 0.0, -1, -1, 0.0)]
    live = {0}
    node = F.lit(0)
    rows = sample.withColumn("node", node)
    for _ in range(settings.depth):
        table = histograms(rows.where(F.col("node").isin(sorted(live))), chosen, F.col("node")).toPandas()  # nodes x features x bins
        splits = best_splits(table, settings)
        if not splits:
            break
        moves = F.col("node")
        live = set()
        for number, (_, feature, last, lg, lh, rg, rh) in sorted(splits.items()):
            left = len(tree)
            tree += [(-1, 0.0, -1, -1, -settings.eta * lg / (lh + settings.reg_lambda)), (-1, 0.0, -1, -1, -settings.eta * rg / (rh + settings.reg_lambda))]
            tree[number] = (feature, model.cuts[feature][last], left, left + 1, 0.0)
            goes = F.when(F.col("bins")[feature] <= last, left).otherwise(left + 1)
            moves = F.when(F.col("node") == number, goes).otherwise(moves)
            live |= {left, left + 1}
        rows = rows.withColumn("node", moves)
    return tree


def _loss(rows: DataFrame) -> float:
    """Weighted log loss of the margins."""
    soft = F.greatest(F.col("margin"), F.lit(0.0)) + F.log1p(F.exp(-F.abs(F.col("margin")))) - F.col("y") * F.col("margin")
    return float(rows.agg(F.sum(F.col("weight") * soft) / F.sum("weight")).first()[0])


def fit(
    train: DataFrame, val: DataFrame, features: list[str], settings: Settings = Settings(), cut_lineage: Callable[[DataFrame], DataFrame] | None = None,
    start: Model | None = None, save: Callable[[Model], None] | None = None, identity: str = "",
) -> Model:
    """Boost until the validation loss has not strictly improved for ``patience`` rounds.

    Both tables need user, review_th, y, weight, margin and the features.  ``cut_lineage``
    checkpoints a table, every ``checkpoint_every`` rounds; ``save`` gets the model then and
    at the end, and ``start`` resumes one, which must carry the same identity.
    """
    if start is not None and start.identity != identity:
        raise ValueError("the saved model belongs to other inputs")
    if start is not None and start.trees and start.best_score is None:
        raise ValueError("the saved model lacks its early-stopping state")
    cut_lineage = cut_lineage or checkpointed
    model = start or Model(features, bin_cuts(train, features, settings.bins), identity=identity)
    bases = [cut_lineage(binned(t.select("user", "review_th", "y", "weight", "margin", *features), features, model.cuts)) for t in (train, val)]
    pending = list(model.trees)
    for number in range(len(model.trees), settings.rounds):
        if number - model.best_round > settings.patience:
            break
        rng = np.random.default_rng([settings.seed, number])
        chosen = sorted(rng.choice(len(features), max(1, round(settings.colsample * len(features))), replace=False).tolist())
        share = (F.pmod(F.xxhash64(F.lit(settings.seed), F.lit(number), F.col("user"), F.col("review_th")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        p = scalars.expit(F.col("margin"))
        now = add_trees(bases[0].where(share < settings.subsample), model, pending)
        sample = now.select("bins", (F.col("weight") * (p - F.col("y"))).alias("g"), (F.col("weight") * p * (1 - p)).alias("h")).persist()
        tree = grow(sample, model, settings, chosen)
        sample.unpersist()
        model.trees.append(tree)
        pending.append(tree)
        score = _loss(add_trees(bases[1], model, pending))
        if model.best_score is None or score < model.best_score:
            model.best_score, model.best_round = score, number
        if (number + 1) % settings.checkpoint_every == 0:
            bases, pending = [cut_lineage(add_trees(t, model, pending)) for t in bases], []
            if save:
                save(model)
    if save:
        save(model)
    return model


def predict(rows: DataFrame, model: Model, margin: str = "margin", name: str = "p_hat") -> DataFrame:
    """Probabilities from the trees up to the best round, on raw features."""
    trees = model.trees[: model.best_round + 1]

    @F.pandas_udf("double")
    def total(values: pd.DataFrame) -> pd.Series:
        x = values.to_numpy(float)
        return pd.Series(sum((_leaf_values(tree, None, None, x) for tree in trees), np.zeros(len(x))))

    features = F.struct(*(F.col(f).cast("double").alias(f) for f in model.features))
    return rows.withColumn(name, scalars.expit(F.col(margin) + total(features)))


def predict_family(rows: DataFrame, models: dict[str, Model], margins: dict[str, str]) -> DataFrame:
    """One probability column for each of a family of models."""
    for name, model in models.items():
        rows = predict(rows, model, margins[name], name)
    return rows
