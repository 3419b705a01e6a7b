"""Nested evaluation: leakage-free calibration and boosting by outer folds, then per-user metrics and a report."""

from __future__ import annotations

import hashlib
from dataclasses import asdict
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boost, calibrate, features, metrics, splits, validate
from ..session import checkpointed

METRICS = ["log_loss", "rmse_bins", "auc"]


def fit_identity(split: dict[str, list[int]], seed: int, settings: boost.Settings, source: str = "") -> str:
    """What a saved model of a fold depends on."""
    return validate.identity_digest({"split": split, "seed": seed, "settings": asdict(settings), "features": features.FEATURES, "source": source})


class Store:
    """Models of one folder, each state a table of its own, so that a lost write leaves the one before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, model: boost.Model) -> None:
        state = self.spark.createDataFrame([(model.dumps(),)], "value string").coalesce(1)
        state.write.mode("overwrite").text(f"{self.path}/rounds={len(model.trees)}")

    def clear(self) -> None:
        """Drop all states, so that a longer old fit cannot outlive a new one."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def load(self) -> boost.Model | None:
        """The latest state, or None."""
        try:
            states = self.spark.read.option("basePath", self.path).text(f"{self.path}/rounds=*", wholetext=True)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        latest = states.orderBy(F.desc("rounds")).first()
        return boost.Model.loads(latest.value) if latest else None


def prepared(reviews: DataFrame, split: dict[str, list[int]], seed: int) -> DataFrame:
    """Features, margins and roles of an outer fold's users.

    Training users get coefficients from the other inner groups, validation and held
    users those of all training users.
    """
    roles = splits.split_table(reviews.sparkSession, [split])
    rows = checkpointed(features.with_spine(reviews))
    betas, _ = calibrate.cross_fit(rows, split["train"], seed)
    joined = rows.drop("r_f", "x16", "x256").join(betas, "user").join(roles.select("user", "role"), "user")
    built = checkpointed(features.build(joined, (F.col("b0"), F.col("b1"), F.col("b2"))).withColumn("margin", scalars.logit(F.col("p_b"))))
    if not (odd := features.not_finite(built, ["p_b", *features.FEATURES])).isEmpty():
        raise ValueError(f"features that are not finite, first of user {odd.first().user}")
    return built


def fit_fold(reviews: DataFrame, split: dict[str, list[int]], seed: int, settings: boost.Settings = boost.Settings(), store: Store | None = None, source: str = "", force: bool = False) -> tuple[boost.Model, DataFrame]:
    """Booster of one outer fold, and the scored rows of its held users; held users are not read before scoring.

    With a store a fit goes on from the latest saved state, which must be of the same inputs and settings; by force it begins anew.
    """
    built, identity = prepared(reviews, split, seed), fit_identity(split, seed, settings, source)
    train, val = (metrics.row_weights(built.where(F.col("role") == role)) for role in ("train", "val"))
    if store and force:
        store.clear()
    start = store.load() if store else None
    model = boost.fit(train, val, features.FEATURES, settings, checkpointed, start, store.save if store else None, identity)
    return model, boost.predict(built.where("role = 'held'"), model)


def score_fold(reviews: DataFrame, split: dict[str, list[int]], seed: int, settings: boost.Settings, store: Store, source: str = "") -> DataFrame:
    """Scored rows of a fold's held users under its saved model, each with the digest of that model."""
    model = store.load()
    if model is None or model.identity != fit_identity(split, seed, settings, source):
        raise ValueError("no model of these inputs is saved")
    held = prepared(reviews, split, seed).where("role = 'held'")
    return boost.predict(held, model).withColumn("fit_sha256", F.lit(model_digest(model)))


def model_digest(model: boost.Model) -> str:
    return hashlib.sha256(model.dumps().encode()).hexdigest()


def score(held: DataFrame, models: dict[str, str]) -> DataFrame:
    """Per-user metrics of each model's probability column."""
    parts = [metrics.per_user(held, p).select(F.lit(name).alias("model"), "user", "size", *METRICS) for name, p in models.items()]
    return reduce(DataFrame.unionByName, parts)


def report(records: DataFrame) -> DataFrame:
    """Equal-user mean, users with a defined value, and half the 99 % interval, by model and metric.

    Log loss and binned error must be defined for all users.  Values per user and metric
    reach the driver, as one number each, for the bootstrap.
    """
    told = []
    for name, values in records.select("model", *METRICS).toPandas().groupby("model"):
        for metric in METRICS:
            known = values[metric].to_numpy(float)
            known = known[np.isfinite(known)]
            if metric != "auc" and len(known) != len(values):
                raise ValueError(f"{metric} of {name} is undefined for some users")
            if len(known):
                told.append((name, metric, float(known.mean()), len(known), metrics.bca_half_width(known) if len(known) > 1 else None))
    return records.sparkSession.createDataFrame(told, "model string, metric string, mean double, n_users long, ci99_half_width double")


def evaluate(reviews: DataFrame, seed: int = 20, folds: list[int] | None = None, settings: boost.Settings = boost.Settings()) -> DataFrame:
    """The whole evaluation; one row per model and metric."""
    users = [r.user for r in reviews.select("user").distinct().collect()]  # users, whose splits are drawn on the driver
    outer = splits.nested_splits(users, seed)
    held = [fit_fold(reviews, outer[k], seed, settings)[1] for k in (folds if folds is not None else range(len(outer)))]
    return report(score(checkpointed(reduce(DataFrame.unionByName, held)), {"base": "p_fsrs", "calibrated": "p_b", "boosted": "p_hat"}))
