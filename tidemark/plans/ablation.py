"""Model-set ablation, and models applied to a panel they were not fitted on."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import boost, calibrate, features, joins, metrics, splits
from ..session import checkpointed
from .nested import METRICS


def with_roles(rows: DataFrame) -> DataFrame:
    """Rows with the role that the volume split gives their user."""
    sizes = rows.groupBy("user").agg(F.count(F.lit(1)).alias("size"))
    return rows.join(splits.volume_split(sizes).select("user", "role"), "user")


def ridge_probability(rows: DataFrame, names: list[str], l2: float = 1e-3, name: str = "p_hat") -> DataFrame:
    """Penalised correction of the calibrated margin, fitted on users to fit, for all rows."""
    fit_rows = rows.where("role = 'fit'")
    moved = calibrate.standardized(rows, fit_rows, names)
    weighted = metrics.row_weights(moved.where("role = 'fit'"))
    beta = calibrate.offset_regression(weighted, names, "y", "margin", "weight", l2)
    z = reduce(lambda total, pair: total + F.lit(float(pair[1])) * F.col(pair[0]), zip(names, beta, strict=True), F.col("margin"))
    return rows.join(moved.select("user", "review_th", scalars.expit(z).alias(name)), ["user", "review_th"])


def boosted_probability(rows: DataFrame, names: list[str], settings: boost.Settings, name: str = "p_hat") -> DataFrame:
    train, val = (metrics.row_weights(rows.where(F.col("role") == role)) for role in ("fit", "val"))
    return boost.predict(rows, boost.fit(train, val, names, settings, checkpointed), name=name)


def ablation(reviews: DataFrame, beta: tuple[float, float, float], settings: boost.Settings | None = None, families: list[str] | None = None) -> DataFrame:
    """Calibrated margin, then one feature family more at a time: equal-user metrics on evaluation users, and the paired change of log loss.

    Ridge corrections by default; boosted trees where settings are given.
    """
    built = features.build(with_roles(reviews), beta).withColumn("margin", scalars.logit(F.col("p_b")))
    rows = checkpointed(built)
    names: list[str] = []
    found, before = [], None
    for step in ["calibrated", *(families or features.FAMILIES)]:
        names += features.FAMILIES.get(step, [])
        if not names:
            told = rows.withColumn("p_hat", F.col("p_b"))
        elif settings is None:
            told = ridge_probability(rows, names)
        else:
            told = boosted_probability(rows, names, settings)
        scores = checkpointed(metrics.per_user(told.where("role = 'eval'"), "p_hat"))
        means = metrics.equal_user(scores, METRICS).first()
        change = {"mean": None, "ci_low": None, "ci_high": None}
        if before is not None:
            deltas = joins.paired(scores, before, "log_loss").select("delta").toPandas()["delta"].to_numpy()  # one number per user
            change = metrics.paired_bootstrap(np.asarray(deltas, float))
        found.append((step, len(names), *(means[f"mean_{m}"] for m in METRICS), change["mean"], change["ci_low"], change["ci_high"]))
        before = scores
    return reviews.sparkSession.createDataFrame(found, "step string, n_features long, log_loss double, rmse_bins double, auc double, delta double, delta_low double, delta_high double")


def external(panel: DataFrame, models: dict[str, boost.Model], beta: tuple[float, float, float], clip_metrics: bool = True) -> DataFrame:
    """Per-user metrics of fitted models on another panel; nothing is fitted.

    With ``clip_metrics`` probabilities are clipped before the metrics, as panels from elsewhere may hold certainties.
    """
    rows = features.build(panel, beta).withColumn("margin", scalars.logit(F.col("p_b")))
    told = checkpointed(boost.predict_family(rows, models, dict.fromkeys(models, "margin")))
    parts = []
    for name in ["p_fsrs", "p_b", *models]:
        one = told.withColumn("_p", scalars.clip(F.col(name)) if clip_metrics else F.col(name))
        parts.append(metrics.per_user(one, "_p").select(F.lit(name).alias("model"), "user", "size", *METRICS))
    return reduce(DataFrame.unionByName, parts)
