"""Assembly of the 42 causal features, for all users in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import windows as W

# The feature names of the data contract, in the order of the design matrix.
SPINE = ["x16", "x256"]
SURPRISE = [
    "sF_mean16", "sF_max16", "sB_mean16", "sB_max16",
    "sF_mean64", "sF_max64", "sB_mean64", "sB_max64",
    "sF_last", "sB_last", "sF_all", "sB_all",
]
STATE = ["st_i", "st_elapsed_days", "st_lapse", "st_t", "st_card_seq", "st_age_days", "st_nth_today", "st_log_elapsed", "st_log_i", "st_log_t"]
GROUPS = ["dk_acc_other", "dk_n_other", "dk_acc_all", "dk_n_all", "dk_cards_seen", "dk_since_other", "nt_acc_other", "nt_n_other"]
STREAM = ["rt_mean8", "rt_mean32", "rt_sd32", "rt_last", "rt_fail32", "rt_good_streak", "rt_lapse_streak", "sg_log_secs", "sg_same_session", "sg_prev_dur_log"]
FEATURES = SPINE + SURPRISE + STATE + GROUPS + STREAM
#: Feature families that an ablation adds one after the other.
FAMILIES = {"spine": SPINE, "surprise": SURPRISE, "state": STATE, "deck": GROUPS, "stream": STREAM}


def with_spine(rows: DataFrame) -> DataFrame:
    """Base residual and its shrunk windows."""
    rows = rows.withColumn("r_f", F.col("y") - F.col("p_fsrs"))
    return rows.withColumns({"x16": W.shrunk_mean(F.col("r_f"), 16), "x256": W.shrunk_mean(F.col("r_f"), 256)})


def with_calibrated(rows: DataFrame, beta: tuple[float, float, float] | tuple[Column, Column, Column]) -> DataFrame:
    """Calibrated probability and its residual; needs the spine."""
    rows = rows.withColumn("p_b", scalars.calibrated(F.col("p_fsrs"), F.col("x16"), F.col("x256"), beta))
    return rows.withColumn("r_b", F.col("y") - F.col("p_b"))


def with_surprise(rows: DataFrame, residuals: dict[str, str] | None = None) -> DataFrame:
    columns = {}
    for tag, name in (residuals or {"F": "r_f", "B": "r_b"}).items():
        r = F.col(name)
        columns |= {
            f"s{tag}_mean16": W.rolling_mean(r, 16), f"s{tag}_mean64": W.rolling_mean(r, 64), f"s{tag}_max16": W.rolling_max(r, 16),
            f"s{tag}_max64": W.rolling_max(r, 64), f"s{tag}_last": W.or_zero(W.last_value(r)), f"s{tag}_all": W.running_mean(r),
        }
    return rows.withColumns(columns)


def with_state(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_t", W.position())
    days, i, t = F.col("elapsed_days"), F.col("i"), F.col("_t")
    return rows.withColumns({
        "st_i": i.cast("double"), "st_elapsed_days": days, "st_lapse": F.col("lapse").cast("double"), "st_t": t.cast("double"),
        "st_nth_today": F.col("nth_today").cast("double"), "st_log_elapsed": F.log1p(days), "st_log_i": F.log1p(i.cast("double")), "st_log_t": F.log1p(t.cast("double")),
        "st_card_seq": W.count_before("card_id").cast("double"), "st_age_days": W.prefix_sum(days, "card_id"),
    }).drop("_t")


def with_groups(rows: DataFrame, frozen: bool = False) -> DataFrame:
    """Deck and note history; windows of one key follow each other, so each key is sorted once.

    The frozen form takes away a card's whole history, and counts a card in the group where the user first met it.
    """
    r = F.col("r_b")
    kept = rows.columns
    for short, key in (("nt", "note_id"), ("dk", "deck_id")):
        own = ("card_id",) if frozen else (key, "card_id")
        rows = rows.withColumns({"_own_n": W.count_before(*own), "_own_sum": W.prefix_sum(r, *own)})
        if short == "dk":
            rows = rows.withColumn("_first", (F.row_number().over(W.stream("card_id") if frozen else W.stream(key, "card_id")) == 1).cast("long"))
        told = {"_n": W.count_before(key), "_sum": W.prefix_sum(r, key)}
        if short == "dk":
            changed = F.lag("card_id").over(W.stream(key)) != F.col("card_id")
            told |= {"dk_cards_seen": W.prefix_sum(F.col("_first"), key), "_ended": F.when(changed, F.lag("day_offset").over(W.stream(key)))}
        rows = rows.withColumns(told)
        other = F.col("_n") - F.col("_own_n")
        features = {f"{short}_n_other": other.cast("double"), f"{short}_acc_other": (F.col("_sum") - F.col("_own_sum")) / (other + scalars.SHRINK)}
        if short == "dk":
            seen = F.last("_ended", ignorenulls=True).over(W.stream(key).rowsBetween(Window.unboundedPreceding, 0))
            features |= {"dk_n_all": F.col("_n").cast("double"), "dk_acc_all": F.col("_sum") / (F.col("_n") + scalars.SHRINK)}
            features["dk_since_other"] = F.coalesce(F.col("day_offset") - seen, F.lit(-1)).cast("double")
        rows = rows.withColumns(features)
    return rows.select(*kept, *GROUPS)


def with_stream(rows: DataFrame) -> DataFrame:
    rating = F.col("rating")
    rows = rows.withColumn("_t", W.position())
    return rows.withColumns({
        "rt_last": W.or_zero(W.last_value(rating)), "rt_mean8": W.rolling_mean(rating, 8), "rt_mean32": W.rolling_mean(rating, 32),
        "rt_fail32": W.rolling_mean((rating < 3).cast("double"), 32), "rt_sd32": W.rolling_deviation(rating, 32),
        "rt_good_streak": W.streak(rating >= 3), "rt_lapse_streak": W.streak(rating == 1),
        "sg_log_secs": scalars.log_seconds(F.col("elapsed_seconds")), "sg_same_session": scalars.same_session(F.col("elapsed_seconds")),
        "sg_prev_dur_log": F.log1p(scalars.finite_or_zero(W.last_value(F.col("duration")))),
    }).drop("_t")


def build(rows: DataFrame, beta: tuple[float, float, float] | tuple[Column, Column, Column], frozen: bool = False, narrow: bool = True) -> DataFrame:
    """All features of all rows, the calibrated probability, and float32 features if ``narrow``."""
    told = with_groups(with_state(with_stream(with_surprise(with_calibrated(with_spine(rows), beta)))), frozen)
    kept = [c for c in rows.columns if c not in FEATURES]
    features = [F.col(f).cast("float" if narrow else "double").alias(f) for f in FEATURES]
    return told.select(*kept, "p_b", *features)


def not_finite(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Rows with a feature that is null or not finite; must be empty."""
    bad = F.lit(False)
    for name in names:
        x = F.col(name)
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return features.where(bad)
