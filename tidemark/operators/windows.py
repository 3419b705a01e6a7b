"""Ordered-sequence features: for every row, a function of the strictly earlier rows of its user.

All windows are keyed by the user or by the user and a group, so they share one
exchange on the user as long as one of them is keyed by the user alone.  Frames end at
the row before the current one; a row without history gets 0 unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars

ORDER = "review_th"


def stream(*keys: str) -> WindowSpec:
    return Window.partitionBy("user", *keys).orderBy(ORDER)


def before(*keys: str) -> WindowSpec:
    return stream(*keys).rowsBetween(Window.unboundedPreceding, -1)


def previous(width: int, *keys: str) -> WindowSpec:
    return stream(*keys).rowsBetween(-width, -1)


def or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def position() -> Column:
    """0-based place in the user's stream."""
    return F.row_number().over(stream()) - 1


def prefix_sum(x: Column, *keys: str) -> Column:
    return or_zero(F.sum(x).over(before(*keys)))


def rolling_sum(x: Column, width: int) -> Column:
    return or_zero(F.sum(x).over(previous(width)))


def rolling_max(x: Column, width: int) -> Column:
    """May be negative; 0 only without history."""
    return or_zero(F.max(x).over(previous(width)))


def rolling_mean(x: Column, width: int) -> Column:
    return or_zero(F.avg(x).over(previous(width)))


def rolling_deviation(x: Column, width: int) -> Column:
    """Population standard deviation."""
    return or_zero(F.stddev_pop(x).over(previous(width)))


def shrunk_mean(x: Column, width: int, shrink: int = scalars.SHRINK) -> Column:
    return rolling_sum(x, width) / (F.least(position(), F.lit(width)) + shrink)


def running_mean(x: Column) -> Column:
    return or_zero(F.avg(x).over(before()))


def last_value(x: Column) -> Column:
    return F.lag(x, 1).over(stream())


def count_before(*keys: str) -> Column:
    return F.count(F.lit(1)).over(before(*keys))


def group_count(key: str) -> Column:
    return count_before(key)


def group_accuracy(r: Column, key: str, shrink: int = scalars.SHRINK) -> Column:
    return prefix_sum(r, key) / (count_before(key) + shrink)


def other_count(key: str, own: str = "card_id") -> Column:
    """Earlier rows of the group that belong to other cards."""
    return count_before(key) - count_before(key, own)


def other_accuracy(r: Column, key: str, own: str = "card_id", shrink: int = scalars.SHRINK) -> Column:
    """The card's own history is taken within the group, so a card that moves between groups cannot make counts negative."""
    return (prefix_sum(r, key) - prefix_sum(r, key, own)) / (other_count(key, own) + shrink)


def frozen_other_count(key: str, own: str = "card_id") -> Column:
    """The earlier form: minus the card's whole history, wherever it was."""
    return count_before(key) - count_before(own)


def frozen_other_accuracy(r: Column, key: str, own: str = "card_id", shrink: int = scalars.SHRINK) -> Column:
    return (prefix_sum(r, key) - prefix_sum(r, own)) / (frozen_other_count(key, own) + shrink)


def with_days_since_other(rows: DataFrame, name: str = "dk_since_other", key: str = "deck_id", own: str = "card_id", day: str = "day_offset") -> DataFrame:
    """Days since the last earlier row of the group with a different card; -1 without one.

    A change of card inside the group ends an island; the last island's final day is
    what the rows after the change look back to.
    """
    changed = F.lag(own).over(stream(key)) != F.col(own)
    marked = rows.withColumn("_ended", F.when(changed, F.lag(day).over(stream(key))))
    seen = F.last("_ended", ignorenulls=True).over(stream(key).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn(name, F.coalesce(F.col(day) - seen, F.lit(-1)).cast("double")).drop("_ended")


def with_cards_seen(rows: DataFrame, name: str = "dk_cards_seen", key: str = "deck_id", own: str = "card_id") -> DataFrame:
    """Distinct cards of the group before the row."""
    marked = rows.withColumn("_first", (F.row_number().over(stream(key, own)) == 1).cast("long"))
    return marked.withColumn(name, prefix_sum(F.col("_first"), key)).drop("_first")


def streak(flag: Column) -> Column:
    """Length of the run of true flags that ends at the row before; needs the place in ``_t``."""
    broken = F.max(F.when(~flag, F.col("_t"))).over(before())
    return (F.col("_t") - 1 - F.coalesce(broken, F.lit(-1))).cast("double")


def with_fold(rows: DataFrame, parts: int = 5) -> DataFrame:
    """Chronological test folds: the last ``parts`` blocks of n // (parts + 1) rows; earlier rows have none."""
    size = Window.partitionBy("user")
    told = rows.withColumns({"_t": position(), "_n": F.count(F.lit(1)).over(size)}).withColumn("_block", F.floor(F.col("_n") / (parts + 1)))
    start = F.col("_n") - parts * F.col("_block")
    fold = F.when((F.col("_block") > 0) & (F.col("_t") >= start), F.floor((F.col("_t") - start) / F.col("_block"))).cast("long")
    return told.withColumn("chrono_fold", fold).drop("_t", "_n", "_block")


def fold_from_masks(masks: list[str]) -> tuple[Column, Column]:
    """The fold that boolean masks name, and whether exactly one is set."""
    ones = [F.col(m).cast("int") for m in masks]
    return sum((k * m for k, m in enumerate(ones)), F.lit(0)), sum(ones, F.lit(0)) == 1


def codes(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Ids of a user numbered in the order in which they first appear."""
    first = rows.withColumn("_first", F.min(ORDER).over(Window.partitionBy("user", key)))
    return first.withColumn(name, F.dense_rank().over(Window.partitionBy("user").orderBy("_first")) - 1).drop("_first")
