"""Calibration: equal-user logistic regression with a fixed offset, cross-fitting, and a ridge-penalised form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import splits as S


#: Largest gradient of the mean loss at which a fit counts as converged.
GRADIENT = 1e-6


@dataclass(frozen=True)
class Calibration:
    beta: tuple[float, float, float]
    objective: float
    users: int
    rows: int
    iterations: int = 0


def design(rows: DataFrame) -> DataFrame:
    """Label, offset and window columns with the weight that gives each user the same say; needs the spine."""
    mine = F.count(F.lit(1)).over(Window.partitionBy("user"))
    return rows.select("user", "y", scalars.logit(F.col("p_fsrs")).alias("z"), "x16", "x256", (1.0 / mine).alias("weight"))


def objective(table: DataFrame, beta: tuple[float, float, float]) -> DataFrame:
    """One row: the weighted log loss at ``beta`` and its gradient."""
    z = F.col("z") + F.lit(beta[0]) + F.lit(beta[1]) * F.col("x16") + F.lit(beta[2]) * F.col("x256")
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    slope, total = F.col("weight") * (scalars.expit(z) - F.col("y")), F.sum("weight")
    return table.agg(
        (F.sum(F.col("weight") * (soft - F.col("y") * z)) / total).alias("loss"), (F.sum(slope) / total).alias("g0"),
        (F.sum(slope * F.col("x16")) / total).alias("g1"), (F.sum(slope * F.col("x256")) / total).alias("g2"),
    )


def fit(rows: DataFrame, max_iter: int = 100, tol: float = 1e-12) -> Calibration:
    """Maximum likelihood by iteratively reweighted least squares, one aggregate per step.

    A fit whose gradient is not close to zero has not converged, and is an error.
    """
    table = design(rows).persist()
    try:
        n, users = table.agg(F.count(F.lit(1)), F.countDistinct("user")).first()
        if not n:
            raise ValueError("nothing to calibrate on")
        data = VectorAssembler(inputCols=["x16", "x256"], outputCol="features").transform(table)
        learner = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="y", offsetCol="z", weightCol="weight", maxIter=max_iter, tol=tol, regParam=0.0)
        model = learner.fit(data)
        beta = (float(model.intercept), *(float(x) for x in model.coefficients))
        at = objective(table, beta).first() if np.isfinite(beta).all() else None
        if at is None or not max(abs(at.g0), abs(at.g1), abs(at.g2)) <= GRADIENT:
            raise ValueError(f"calibration did not converge in {max_iter} iterations")
        return Calibration(beta, float(at.loss), int(users), int(n), int(model.summary.numIterations))
    finally:
        table.unpersist()


def cross_fit(rows: DataFrame, train: list[int], seed: int, parts: int = 3) -> tuple[DataFrame, Calibration]:
    """Coefficients for every user: those of the other groups for training users, of all training users for the rest."""
    spark = rows.sparkSession
    groups = S.inner_groups(train, seed, parts)
    everyone = rows.join(spark.createDataFrame([(u,) for u in train], "user long"), "user", "left_semi")
    whole = fit(everyone)
    told = []
    for group in groups:
        members = spark.createDataFrame([(u,) for u in group], "user long")
        told.append((group, *fit(everyone.join(members, "user", "left_anti")).beta))
    table = spark.createDataFrame(told, "users array<long>, b0 double, b1 double, b2 double")
    listed = table.select(F.explode("users").alias("user"), "b0", "b1", "b2")
    betas = rows.select("user").distinct().join(listed, "user", "left")
    filled = {f"b{k}": F.coalesce(F.col(f"b{k}"), F.lit(whole.beta[k])) for k in range(3)}
    return betas.withColumns(filled), whole


def offset_regression(rows: DataFrame, features: list[str], label: str, offset: str, weight: str, l2: float = 1e-3, max_iter: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Logistic coefficients without intercept under ``sum of weighted losses + l2/2 |beta|^2``, by Newton steps.

    Each step sums gradients and Gram matrices per batch in the executors; a partition
    hands the driver one small matrix.
    """
    d = len(features)
    names = [*features, label, offset, weight]
    table = rows.select(*(F.col(c).cast("double").alias(c) for c in names)).persist()

    def step(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            gradient, gram, loss = np.zeros(d), np.zeros((d, d)), 0.0
            for batch in batches:
                x, y, z, w = batch[features].to_numpy(), batch[label].to_numpy(), batch[offset].to_numpy(), batch[weight].to_numpy()
                at = z + x @ beta
                p = 1 / (1 + np.exp(-at))
                gradient += x.T @ (w * (p - y))
                gram += (x * (w * p * (1 - p))[:, None]).T @ x
                loss += float((w * (np.logaddexp(0, at) - y * at)).sum())
            yield pd.DataFrame({"g": [gradient.tolist()], "h": [gram.ravel().tolist()], "loss": [loss]})

        parts = table.mapInPandas(partial_sums, "g array<double>, h array<double>, loss double").collect()  # one row per partition
        return sum(np.array(r.g) for r in parts), sum(np.array(r.h) for r in parts).reshape(d, d), sum(r.loss for r in parts)

    try:
        beta = np.zeros(d)
        for _ in range(max_iter):
            gradient, gram, _ = step(beta)
            move = np.linalg.solve(gram + l2 * np.eye(d), gradient + l2 * beta)
            beta = beta - move
            if np.abs(move).max() < tol:
                return beta
        raise ValueError(f"no convergence in {max_iter} steps")
    finally:
        table.unpersist()


def standardized(rows: DataFrame, train: DataFrame, features: list[str]) -> DataFrame:
    """Features moved and scaled by the training rows' mean and population deviation."""
    told = train.agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in features for n, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first()
    return rows.withColumns({c: (F.col(c) - told[f"{c}_mean"]) / (told[f"{c}_sd"] + 1e-9) for c in features})
