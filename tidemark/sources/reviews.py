"""The scored review stream: its schema, its derivation from ``events``, and the card dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The contract of the core table, in order.
REVIEW_SCHEMA = T.StructType([
    T.StructField("user", T.LongType(), False),
    T.StructField("review_th", T.LongType(), False),
    T.StructField("y", T.DoubleType(), False),
    T.StructField("p_fsrs", T.DoubleType(), False),
    T.StructField("fold", T.ByteType(), False),
    T.StructField("i", T.LongType(), False),
    T.StructField("elapsed_days", T.DoubleType(), False),
    T.StructField("lapse", T.LongType(), False),
    T.StructField("nth_today", T.LongType(), False),
    T.StructField("day_offset", T.LongType(), False),
    T.StructField("card_id", T.LongType(), False),
    T.StructField("deck_id", T.LongType(), False),
    T.StructField("note_id", T.LongType(), False),
    T.StructField("rating", T.DoubleType(), False),
    T.StructField("elapsed_seconds", T.DoubleType(), False),
    T.StructField("duration", T.DoubleType(), False),
])


def read_reviews(spark: SparkSession, root: str) -> DataFrame:
    """A review table with the fixed schema; files may be partitioned by ``user``, whose filters then prune directories."""
    return spark.read.schema(REVIEW_SCHEMA).parquet(root)


def write_reviews(reviews: DataFrame, root: str) -> None:
    """Partitioned by user, one sorted run per user, committed as a whole by the output committer."""
    ordered = reviews.repartition("user").sortWithinPartitions("user", "review_th")
    ordered.write.option("compression", "zstd").partitionBy("user").mode("overwrite").parquet(root)


def reviews_from_events(events: DataFrame) -> DataFrame:
    """The review stream that an event log stands for; adds ``p_milli``, the base probability in thousandths."""
    k = F.get_json_object("props", "$.k").cast("int")
    rating = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(3)
    base = events.select(
        F.col("user_id").alias("user"), "event_id", "ts", "value", rating.alias("rating"),
        (k % 12).cast("long").alias("card_id"), (k % 4).cast("long").alias("deck_id"), (k % 6).cast("long").alias("note_id"),
        (50 + (F.col("event_id") * 7919) % 900).alias("p_milli"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("day_offset"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
    )
    order = Window.partitionBy("user").orderBy("ts", "event_id")
    base = base.withColumn("review_th", F.row_number().over(order).cast("long")).withColumn("y", (F.col("rating") > 1).cast("double"))
    stream = Window.partitionBy("user").orderBy("review_th")
    card = Window.partitionBy("user", "card_id").orderBy("review_th")
    day = Window.partitionBy("user", "day_offset").orderBy("review_th")
    before = card.rowsBetween(Window.unboundedPreceding, -1)
    columns = {
        "p_fsrs": F.col("p_milli") / F.lit(1000.0),
        "fold": F.ntile(5).over(stream) - 1,
        "i": F.row_number().over(card),
        "elapsed_days": F.coalesce(F.col("day_offset") - F.lag("day_offset").over(card), F.lit(0)),
        "elapsed_seconds": F.coalesce(F.col("micros") - F.lag("micros").over(card), F.lit(0)) / F.lit(1e6),
        "lapse": F.coalesce(F.sum((F.col("rating") == 1).cast("long")).over(before), F.lit(0)),
        "nth_today": F.row_number().over(day),
        "duration": (F.col("value") * 100).cast("long"),
    }
    told = base.withColumns(columns)
    return told.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in REVIEW_SCHEMA), F.col("p_milli").cast("long").alias("p_milli"))


def cards_from_reviews(reviews: DataFrame, missing_card: int = 11) -> DataFrame:
    """The card dimension of the stand-in stream, without one card so that the missing-card rule has work."""
    return reviews.where(F.col("card_id") != missing_card).select("user", "card_id", "deck_id", "note_id").distinct()
