"""Splits of users: by volume, nested folds, inner groups, shards, and the set checks on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed

_SPLIT = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("user", T.LongType()), T.StructField("role", T.StringType())])


def placed(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """0-based places in a total order: ranges are sorted each on its own, and start where the smaller ranges end."""
    ranges = checkpointed(rows.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    sizes = {r["_range"]: r["n"] for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a range
    starts, total = [], 0
    for number in sorted(sizes):
        starts.append((number, total))
        total += sizes[number]
    before = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(name, own + F.col("_start") - 1).drop("_range", "_start")


def volume_split(sizes: DataFrame) -> DataFrame:
    """Users in order of size, even places fit and odd ones evaluate; every fourth fitting user validates."""
    rows = placed(sizes, "size", "user")
    role = F.when(F.col("place") % 2 == 1, "eval").when(F.floor(F.col("place") / 2) % 4 == 3, "val").otherwise("fit")
    return rows.select("user", "size", role.alias("role"))


def nested_splits(users: list[int], seed: int, share: float = 0.15) -> list[dict[str, list[int]]]:
    """Two outer folds: each half is held once, and the other half is cut into train and validation users."""
    ordered = np.array(sorted(set(users)))
    rng = np.random.default_rng(seed)
    halves = np.array_split(rng.permutation(ordered), 2)
    found = []
    for held, rest in ((halves[0], halves[1]), (halves[1], halves[0])):
        if len(rest) < 4:
            raise ValueError("too few users to cut into train and validation")
        shuffled = rng.permutation(rest)
        n = min(max(1, round(share * len(rest))), len(rest) - 3)
        found.append({"train": sorted(map(int, shuffled[n:])), "val": sorted(map(int, shuffled[:n])), "held": sorted(map(int, held))})
    return found


def inner_groups(users: list[int], seed: int, parts: int = 3) -> list[list[int]]:
    """Near-equal groups of permuted users; the first ones take the extra."""
    shuffled = np.random.default_rng(seed).permutation(np.array(sorted(set(users))))
    return [sorted(map(int, part)) for part in np.array_split(shuffled, parts)]


def split_table(spark: SparkSession, splits: list[dict[str, list[int]]]) -> DataFrame:
    rows = [(k, user, role) for k, split in enumerate(splits) for role, users in split.items() for user in users]
    return spark.createDataFrame(rows, _SPLIT)


def members(rows: DataFrame, splits: DataFrame, fold: int, role: str) -> DataFrame:
    """Rows of the users that play a role in a fold."""
    return rows.join(splits.where((F.col("fold") == fold) & (F.col("role") == role)).select("user"), "user", "left_semi")


def selected_folds(text: str | None, folds: int = 2) -> list[int]:
    """Requested folds, sorted and without repeats."""
    if text is None:
        return list(range(folds))
    chosen = sorted({int(x) for x in text.split(",")})
    if not chosen or min(chosen) < 0 or max(chosen) >= folds:
        raise ValueError(f"folds go from 0 to {folds - 1}")
    return chosen


def parse_shard(text: str) -> tuple[int, int]:
    """``I/N`` as a shard number and a count."""
    number, count = (int(x) for x in text.split("/"))
    if not 0 <= number < count:
        raise ValueError("a shard is I/N with 0 <= I < N")
    return number, count


def shard(users: DataFrame, number: int, count: int) -> DataFrame:
    """Every count-th user in order, from place ``number`` on."""
    return placed(users, "user").where(F.pmod(F.col("place"), F.lit(count)) == number).drop("place")


def head(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of every user."""
    place = F.row_number().over(Window.partitionBy("user").orderBy("review_th")) - 1
    return rows.withColumn("place", place).where(F.col("place") < limit).drop("place")


def spaced_users(users: DataFrame, n: int) -> DataFrame:
    """n users at evenly spaced places of their order."""
    rows = placed(users, "user")
    step = max(rows.count() // n, 1)
    return rows.where((F.col("place") % step == 0) & (F.floor(F.col("place") / step) < n)).select("user")


def without_deferred(users: DataFrame, deferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users to process, and deferred users that are no users at all (must be empty)."""
    return users.join(deferred, "user", "left_anti"), deferred.join(users, "user", "left_anti")


def split_faults(splits: DataFrame, users: DataFrame) -> DataFrame:
    """Per fold, users in two roles, users in none, and strangers; a sound split gives zeros."""
    roles = splits.groupBy("fold", "user").agg(F.count(F.lit(1)).alias("roles"))
    folds = splits.select("fold").distinct()
    wanted = users.select("user").distinct().crossJoin(F.broadcast(folds)).withColumn("known", F.lit(1))  # two folds
    both = wanted.join(roles, ["fold", "user"], "full")
    return both.groupBy("fold").agg(
        F.count_if(F.col("roles") > 1).alias("doubled"), F.count_if(F.col("roles").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("strange")
    )


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side has; empty for equal multisets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
