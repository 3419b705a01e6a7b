"""Joins of the review stream with its dimensions, folds, coefficients and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_cards(cards: DataFrame, order: str = "deck_id") -> DataFrame:
    """One row per user and card: the first in the stated order."""
    rank = F.row_number().over(Window.partitionBy("user", "card_id").orderBy(order, "note_id"))
    return cards.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def with_card_groups(reviews: DataFrame, cards: DataFrame) -> DataFrame:
    """Left join on the card; a card without deck or note gets the key -(card_id + 1) for both.

    The size of the card table grows with the users, so the join strategy is left to
    adaptive execution rather than hinted.
    """
    joined = reviews.drop("deck_id", "note_id").join(first_cards(cards), ["user", "card_id"], "left")
    unknown, own = F.col("deck_id").isNull() | F.col("note_id").isNull(), -(F.col("card_id") + 1)
    return joined.withColumns({"deck_id": F.when(unknown, own).otherwise(F.col("deck_id")), "note_id": F.when(unknown, own).otherwise(F.col("note_id"))})


def in_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows whose review is in some test fold, tagged with it; ``folds`` has unique (user, review_th)."""
    return rows.join(folds.select("user", "review_th", "fold"), ["user", "review_th"])


def misaligned(left: DataFrame, right: DataFrame, columns: list[str], key: tuple[str, ...] = ("user", "row_index")) -> DataFrame:
    """Rows of two tables that must agree and do not: missing on a side, or different in a column."""
    a = left.select(*key, *(F.col(c).alias(f"{c}_left") for c in columns), F.lit(True).alias("_l"))
    b = right.select(*key, *(F.col(c).alias(f"{c}_right") for c in columns), F.lit(True).alias("_r"))
    differs = F.col("_l").isNull() | F.col("_r").isNull()
    for c in columns:
        differs = differs | ~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right"))
    return a.join(b, list(key), "full").where(differs).drop("_l", "_r")


def with_group_betas(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Coefficients of the group that lists the user; ``groups`` has users array, b0, b1, b2. Unlisted users stay null."""
    return rows.join(groups.select(F.explode("users").alias("user"), "b0", "b1", "b2"), "user", "left")


def without_betas(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Users that no group lists; must be empty."""
    listed = groups.select(F.explode("users").alias("user"))
    return rows.select("user").distinct().join(listed, "user", "left_anti")


def with_stored(rows: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Stored predictions by user and row; ``complete`` tells whether all of them were there."""
    found = rows.join(stored.select("user", "row_index", *columns), ["user", "row_index"], "left")
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return found.withColumn("complete", complete)


def size_mismatches(sizes: DataFrame, expected: DataFrame) -> DataFrame:
    """Users whose size is not the expected one, or that have none."""
    return expected.withColumnRenamed("size", "expected").join(sizes, "user", "left").where(~F.col("size").eqNullSafe(F.col("expected")))


def paired(model: DataFrame, base: DataFrame, metric: str) -> DataFrame:
    """Per user, the metric of both models and its difference."""
    both = model.select("user", F.col(metric).alias("model")).join(base.select("user", F.col(metric).alias("base")), "user")
    return both.withColumn("delta", F.col("model") - F.col("base"))


def held_twice(splits: DataFrame) -> DataFrame:
    """Users that more than one fold holds out; must be empty."""
    return splits.where("role = 'held'").groupBy("user").count().where("count > 1")


def still_to_do(users: DataFrame, done: DataFrame) -> DataFrame:
    """Users without a finished result under the same identity."""
    return users.join(done.select("user", "identity").distinct(), ["user", "identity"], "left_anti")
