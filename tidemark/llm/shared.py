"""Plan-level helpers that the corpus operators share."""

from __future__ import annotations

import gc
import re
import tempfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured bytes stay below this; beyond it
#: the join shuffles both sides.  A row counts with its bytes in a hash relation.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 48

#: Text handled by one hash bucket of a packed exchange.
BUCKET_BYTES = 32 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that the session names.

    Tasks are those of the last stage: a scan keeps its own, and after an exchange
    adaptive execution sizes them by bytes.  Only a session in one process, such as a
    test, may go without a named folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and checkpoints that no table refers to any more.

    The cleaner follows the driver's garbage collection, which a driver that only plans seldom needs.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str, payload: tuple[str, ...] = ()) -> DataFrame:
    """Join ``big`` with a side that is usually small.

    ``small`` is checkpointed and measured first, ``ROW_BYTES`` a row and the bytes of its
    ``payload`` columns: it is broadcast up to ``BROADCAST_BYTES``, and shuffled like any
    other side beyond that.
    """
    small = checkpointed(small)
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in payload), F.lit(ROW_BYTES)).cast("long")
    fits = (small.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(df: DataFrame, per_bucket: int = BUCKET_BYTES) -> int:
    """Hash buckets for a packed exchange over ``df``: they grow with its size, and fill every shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(2 * shuffle_partitions(df.sparkSession), size // per_bucket), 1 << 24))


def fold(column: str = "doc_id", modulo: int = 5) -> Column:
    """crc32 of the id as text, modulo a number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulo


def crc_fold(doc_id: int, modulo: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulo


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def merge_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals whose starts are sorted."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return starts[first], np.maximum.reduceat(ends, first)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions any half-open interval covers."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each run of ``bounds``, empty runs included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """The smallest row of every id, so that a sample of n ids is n rows however often an id repeats.

    ``rows`` starts with doc_id; repeats are combined in the tasks that read them.
    """
    first = F.min(F.struct(*rows.columns[1:])).alias("first")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "first.*")
