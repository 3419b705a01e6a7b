"""Contract checks as queries: each returns the rows, or counts, that break a rule."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars

RULES = ("probability", "label", "order", "fold_order", "fold_cover", "day_order", "lapse", "elapsed")


def schema_faults(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns that are missing, or have another type than the contract's."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: {have.get(f.name, 'missing')} for {f.dataType}" for f in schema if have.get(f.name) != f.dataType]


def violations(reviews: DataFrame, folds: int = 5) -> DataFrame:
    """Number of violations of each rule: one row a rule, zeros in a sound table.

    One window pass and one aggregate; fold cover is counted per user.
    """
    order = Window.partitionBy("user").orderBy("review_th")
    seen = reviews.withColumns({
        "_th": F.lag("review_th").over(order), "_fold": F.lag("fold").over(order), "_day": F.lag("day_offset").over(order),
    })
    per_user = seen.groupBy("user").agg(
        F.count_if(~scalars.in_domain(F.col("p_fsrs"))).alias("probability"),
        F.count_if(F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)).alias("label"),
        F.count_if(F.col("review_th").isNull() | (F.col("review_th") <= F.col("_th"))).alias("order"),
        F.count_if(F.col("fold").isNull() | ~F.col("fold").between(0, folds - 1) | (F.col("fold") < F.col("_fold"))).alias("fold_order"),
        (F.countDistinct("fold") != folds).cast("long").alias("fold_cover"),
        F.count_if(F.col("day_offset").isNull() | (F.col("day_offset") < F.col("_day"))).alias("day_order"),
        F.count_if(F.col("lapse").isNull() | (F.col("lapse") < 0)).alias("lapse"),
        F.count_if(F.col("elapsed_days").isNull() | F.isnan("elapsed_days") | (F.col("elapsed_days") < 0)).alias("elapsed"),
    )
    totals = per_user.agg(*(F.coalesce(F.sum(rule), F.lit(0)).alias(rule) for rule in RULES))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in RULES))).alias("x")).select("x.*")


def row_index_faults(rows: DataFrame, index: str = "row_index") -> DataFrame:
    """Per user, the range and count of row numbers, and whether they run 0 .. n - 1."""
    told = rows.groupBy("user").agg(F.min(index).alias("low"), F.max(index).alias("high"), F.countDistinct(index).alias("n"), F.count(F.lit(1)).alias("_rows"))
    return told.withColumn("contiguous", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("n") == F.col("_rows"))).drop("_rows")


def mask_faults(rows: DataFrame, masks: list[str]) -> DataFrame:
    """Rows that are not in exactly one of the masks."""
    return rows.where(sum((F.col(m).cast("int") for m in masks), F.lit(0)) != 1)


def unmapped(reviews: DataFrame) -> DataFrame:
    """Rows and cards that have a made-up group key, and the share of rows."""
    made_up = F.col("deck_id") < 0
    return reviews.agg(
        F.count_if(made_up).alias("unmapped_rows"), F.countDistinct(F.when(made_up, F.struct("user", "card_id"))).alias("unmapped_cards"),
        (F.count_if(made_up) / F.count(F.lit(1))).alias("share"),
    )


def perturbed(reviews: DataFrame, late: Column) -> DataFrame:
    """Outcomes of the late rows turned over: label, probability, rating, duration."""
    return reviews.withColumns({
        "y": F.when(late, 1 - F.col("y")).otherwise(F.col("y")), "p_fsrs": F.when(late, 1 - F.col("p_fsrs")).otherwise(F.col("p_fsrs")),
        "rating": F.when(late, F.lit(1.0)).otherwise(F.col("rating")), "duration": F.when(late, F.lit(999_999.0)).otherwise(F.col("duration")),
    })


#: The places of a history after which outcomes are turned over, as shares of its rows; the last row too.
CUTS = (7, 3, 2)


def causality(reviews: DataFrame, build: Callable[[DataFrame], DataFrame], features: list[str], places: list[Column] | None = None) -> DataFrame:
    """How many of the features' rows up to a place change when later outcomes do; none may.

    ``places`` are columns over the rows ``n`` of a user, by default n/7, n/3, n/2 and n - 1.
    Features of the row at a place come before its outcome, so they are checked too.  The
    table and its turned copies are one table whose users are pairs of user and copy, so
    features are built once, and copies of a row meet in one aggregate.
    """
    places = places or [*(F.floor(F.col("_n") / k) for k in CUTS), F.col("_n") - 1]
    numbered = reviews.withColumns({"_place": F.row_number().over(Window.partitionBy("user").orderBy("review_th")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("user"))})
    copies = numbered.withColumn("_copy", F.explode(F.array(F.struct(F.lit(-1).alias("k"), F.lit(-1).cast("long").alias("place")), *(F.struct(F.lit(k).alias("k"), p.cast("long").alias("place")) for k, p in enumerate(places)))))
    late = (F.col("_copy.k") >= 0) & (F.col("_place") >= F.col("_copy.place"))
    both = build(perturbed(copies, late).withColumn("user", F.struct("user", "_copy.k")))
    checked = F.when((F.col("_copy.k") >= 0) & (F.col("_place") <= F.col("_copy.place")), F.xxhash64(*features))
    told = both.groupBy(F.col("user.user"), "review_th").agg(F.max(F.when(F.col("_copy.k") < 0, F.xxhash64(*features))).alias("own"), F.collect_list(checked).alias("others"))  # one a place
    changed = F.size(F.filter("others", lambda x: x != F.col("own")))
    return told.agg(F.sum(F.size("others")).cast("long").alias("rows_checked"), F.sum(changed).cast("long").alias("rows_changed"))


def file_digests(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """SHA-256 and size of every file below a path, hashed where the blocks are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def unit_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest of an input unit, from its files' relative names, digests and sizes in order."""
    name = F.substring_index("path", root.rstrip("/") + "/", -1)
    line = F.concat_ws("\0", name, "sha256", F.col("size").cast("string"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256"))


def identity_digest(fields: dict[str, Any]) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def dependency_digest(sources: DataFrame) -> DataFrame:
    """One digest over (user, identity, sha256) of all users that a fit depends on."""
    line = F.concat_ws("\0", F.col("user").cast("string"), "identity", "sha256")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("user", line.alias("line")))), lambda x: x["line"])
    return sources.agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("sha256"))


def resume_decision(wanted: dict[str, Any], saved: dict[str, Any] | None, data_sha256: str | None) -> tuple[str, list[str]]:
    """``run``, ``skip`` or ``refuse`` for a user, with the identity fields that differ."""
    if saved is None:
        return ("refuse", ["data without a sidecar"]) if data_sha256 else ("run", [])
    if saved.get("status") == "excluded" and saved.get("identity") == identity_digest(wanted):
        return "skip", []
    if saved.get("identity") != identity_digest(wanted):
        have = saved.get("identity_fields", {})
        return "refuse", sorted(k for k in wanted.keys() | have.keys() if wanted.get(k) != have.get(k))
    return ("skip", []) if data_sha256 == saved.get("cache_sha256") else ("refuse", ["cache_sha256"])


def failure_kind(message: str, exclusions: set[str]) -> str:
    """A failure is an exclusion only if its last line is exactly one that is known."""
    lines = message.strip().splitlines()
    return "excluded" if lines and lines[-1].strip() in exclusions else "failed"


def report_faults(scores: DataFrame, splits: DataFrame, sizes: DataFrame, models: list[str], fit_digests: DataFrame) -> DataFrame:
    """Everything that must be empty before a report: (fault, user).

    ``scores`` has user, fold, model, size, fit_sha256; ``sizes`` has user, size;
    ``fit_digests`` has fold, sha256.
    """
    held = splits.where("role = 'held'").select("user", F.col("fold").alias("held_fold"))
    parts = [
        ("held twice", held.groupBy("user").count().where("count > 1").select("user")),
        ("not scored", held.select("user").join(scores, "user", "left_anti")),
        ("not held", scores.select("user").distinct().join(held, "user", "left_anti")),
        ("wrong fold", scores.join(held, "user").where("fold != held_fold").select("user")),
        ("stale fit", scores.join(fit_digests, "fold", "left").where("sha256 is null or sha256 != fit_sha256").select("user")),
        ("wrong size", scores.join(sizes.withColumnRenamed("size", "expected"), "user", "left").where("expected is null or expected != size").select("user")),
        ("models", scores.groupBy("user").agg(F.array_sort(F.collect_list("model")).alias("m")).where(F.col("m") != F.array(*map(F.lit, sorted(models)))).select("user")),
    ]
    faults = [rows.distinct().select(F.lit(name).alias("fault"), "user") for name, rows in parts]
    found = faults[0]
    for rows in faults[1:]:
        found = found.unionByName(rows)
    return found


def reconciled(metrics: DataFrame, report: dict[str, float], tolerance: float = 1e-12) -> list[str]:
    """Names of report means that differ from the equal-user means of the metric records."""
    told = metrics.agg(*(F.avg(name).alias(name) for name in report)).first()
    return sorted(name for name, value in report.items() if told[name] is None or abs(told[name] - value) > tolerance)
