"""User lists, metric records and other small files, and JSON-safe values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_safe(column: Column) -> Column:
    """A number that JSON can hold: null where it is not finite."""
    return F.when(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), F.lit(None)).otherwise(column)


def json_safe_columns(df: DataFrame) -> DataFrame:
    """Every floating point column of a table made JSON-safe."""
    return df.withColumns({name: json_safe(F.col(name)) for name, kind in df.dtypes if kind in ("double", "float")})


def user_ids(value: Any) -> list[int]:
    """Sorted users from a JSON list, or from an object with ``user_ids``; text is converted, repeats are refused."""
    if isinstance(value, dict):
        value = value["user_ids"]
    if not isinstance(value, list):
        raise ValueError("users must be a list")
    users = [int(x) for x in value]
    if len(set(users)) != len(users):
        raise ValueError("a user is listed twice")
    return sorted(users)


def read_user_ids(spark: SparkSession, path: str) -> list[int]:
    """A user list from any store that Spark reads."""
    return user_ids(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def discovered_users(spark: SparkSession, root: str, column: str = "user") -> DataFrame:
    """Users of a table partitioned by user, from its directories alone."""
    return spark.read.parquet(root).select(F.col(column).cast("long").alias("user")).distinct()


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, with undefined numbers as null."""
    json_safe_columns(records).write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions in the order of user and row."""
    predictions.orderBy("user", "row_index").write.option("compression", "zstd").mode("overwrite").parquet(path)
