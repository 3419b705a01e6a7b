"""MinHash near-dedup with tensored banding.

A document's set is its distinct ``shingle``-word shingles.  Two families of
``bands`` half-keys are computed, each half-key from ``rows`` minhashes; the table
keys are all ``bands * bands`` pairs of one half-key from each family.  So
``2 * bands * rows`` minhashes serve a banding that would take
``bands * bands * 2 * rows`` on its own, roughly the square root per table.

Documents with equal sets fall together first, by a 128-bit set hash, so a group
of exact copies enters the tables once.

Within a bucket links are found by ever dearer ways.
First every member is verified against a few pivots, the members with the most company
over all tables (in a family of edited copies these are closest to the original); they
are found by a rank limit that Spark applies before the shuffle too.  Then, in buckets that still hold several components, the members are laid out by further
half-keys, which puts the most similar ones side by side, and neighbours of different
components are verified (a large bucket in random blocks); this is repeated with other
half-keys.  Last, what still lies in
different components of a bucket is verified pair by pair, so no pair that shares a bucket
is left out: members outside a bucket's largest component meet all its members, each pair
in the first bucket it shares, and large buckets in blocks.  Of these pairs only such are
verified as can be links by an upper bound of the intersection: a bit map of ``BITS`` hash
bins shows shingles that the other set cannot have.

All links are confirmed on full sets: 100 * intersection >= threshold * union.

Defined cases: a text without words, or null, has the empty set and is linked
with nothing; a text shorter than a shingle is one shingle; repeated rows of one
``doc_id`` are one document, which has the larger set and the smaller component if
their texts differ; a null ``doc_id`` takes no part and has a null
component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components, joined
from .shared import checkpointed, join_checked, release
from .words import LOWER, Words, buffers, mix, rolling, run_hashes, slices

_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, firsts array<long>, seconds array<long>"
#: Members of a bucket that one block of a chain has, and that one block of the last pass has on its smaller side.
CHAIN = 1024
BLOCK = 8192
BITS = 1024
_SHORT = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Banding:
    shingle: int = 4
    percent: int = 80
    bands: int = 8
    rows: int = 2
    pivots: int = 3
    chains: int = 2
    seed: int = 20240917


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice, and their bounds."""
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    windows = rolling(hashes, shingle)
    whole = mix(run_hashes(hashes, words.bounds) ^ _SHORT)
    sets = []
    for k, n in enumerate(words.counts):
        start = words.bounds[k]
        if n >= shingle:
            found = np.sort(windows[start : start + n - shingle + 1])
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            sets.append(found[new])
        else:
            sets.append(whole[k : k + 1] if n else whole[:0])
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketch(values: np.ndarray, bounds: np.ndarray, banding: Banding) -> tuple[np.ndarray, np.ndarray]:
    """Half-keys of both families, one row per non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    starts = bounds[:-1][full]
    many = 2 * banding.bands * banding.rows
    factors = np.random.default_rng(banding.seed).integers(0, 1 << 62, many, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((2 * banding.bands, len(full)), np.uint64)
    for k, factor in enumerate(factors):
        scaled = values * factor
        scaled >>= np.uint64(16)
        lowest = np.minimum.reduceat(scaled, starts) if len(full) else np.zeros(0, np.uint64)
        band = k // banding.rows
        out[band] = mix(out[band] ^ lowest ^ np.uint64(band + 1))
    return out[: banding.bands].T, out[banding.bands :].T


def _sketches(batches: Iterator[pa.RecordBatch], banding: Banding) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = shingle_sets(*buffers(part.column(1)), banding.shingle)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            firsts, seconds = sketch(values, bounds, banding)
            hashes = [np.add.reduceat(mix(values + np.uint64(seed)), bounds[:-1][full]).view(np.int64) for seed in (1, 2)]
            halves = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, banding.bands, dtype=np.int32), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())) for x in (firsts, seconds)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(full)), pa.array(sizes[full]), *(pa.array(x) for x in hashes), *halves],
                ["doc_id", "n_shingles", "set_a", "set_b", "firsts", "seconds"],
            )


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = shingle_sets(*buffers(part.column(1)), shingle)
            bits = np.zeros((len(bounds) - 1, BITS // 64), np.uint64)
            bins = mix(values ^ np.uint64(BITS)) % np.uint64(BITS)
            document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            np.bitwise_or.at(bits, (document, (bins >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bins & np.uint64(63)))
            lists = [(bounds, values), (np.arange(0, bits.size + 1, BITS // 64), bits.ravel())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.ListArray.from_arrays(at.astype(np.int32), pa.array(x.view(np.int64))) for at, x in lists)], ["doc_id", "shingles", "bits"]
            )


def full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, its sorted shingles and their bit map; ``rows`` has doc_id and text."""
    return rows.select("doc_id", "text").mapInArrow(partial(_sets, shingle=shingle), "doc_id long, shingles array<long>, bits array<long>")


def table_members(classes: DataFrame) -> DataFrame:
    """(bucket, slot, node) for every table key that two or more sets share; a slot numbers the pair of half-keys."""
    pairs = F.transform("firsts", lambda a: F.transform("seconds", lambda b: F.xxhash64(a, b)))
    keys = classes.select("node", F.posexplode(F.flatten(pairs)).alias("slot", "bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return keys.join(shared.hint("merge"), "bucket")


def star(members: DataFrame, pivots: int) -> DataFrame:
    """(node, other) for every member of a bucket and each of its pivots, the members with most company."""
    company = members.groupBy("node").agg(F.count(F.lit(1)).alias("company"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("company"), "node"))
    chosen = members.select("bucket", "node").join(company.hint("merge"), "node").withColumn("rank", rank).where(F.col("rank") <= pivots)
    chosen = chosen.select("bucket", F.col("node").alias("other"))
    pairs = members.select("bucket", "node").join(chosen.hint("merge"), "bucket").where("node != other")
    return pairs.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def chain(members: DataFrame, labels: DataFrame, halves: DataFrame, bands: int, turn: int) -> DataFrame:
    """(node, other) for neighbours of different components in buckets laid out by half-keys other than their own."""
    rows = members.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low != high")
    mixed = mixed.select("bucket", F.ceil(F.col("n") / CHAIN).alias("blocks"))
    rows = rows.join(mixed.hint("merge"), "bucket").join(halves.hint("merge"), "node")
    i, j = F.floor(F.col("slot") / bands), F.col("slot") % bands
    keys = [F.get(half, ((at + 2 * turn + k) % bands).cast("int")) for k in (1, 2) for half, at in (("firsts", i), ("seconds", j))]
    rows = rows.select("bucket", "blocks", "node", "component", *(key.alias(f"key{k}") for k, key in enumerate(keys)))
    order = Window.partitionBy("bucket", F.pmod(F.xxhash64("node"), "blocks")).orderBy(*(f"key{k}" for k in range(len(keys))), "node")
    rows = rows.select("node", "component", F.lag("node").over(order).alias("other"), F.lag("component").over(order).alias("beside"))
    return rows.where("component != beside").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def _ones(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda n, x: n + F.bit_count(x))


def remaining(members: DataFrame, labels: DataFrame, halves: DataFrame, bands: int, percent: int) -> DataFrame:
    """(node, other) for all pairs of different components that share a bucket and can be links by sizes and bits."""
    rows = members.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("n", "component")).alias("most"))
    mixed = mixed.where("parts > 1").select("bucket", "most", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = checkpointed(rows.join(mixed.hint("merge"), "bucket").join(halves.hint("merge"), "node"))
    few = rows.where("component != most").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")
    few = few.select("bucket", "block", *(F.col(c).alias(f"few_{c}") for c in ("node", "component", "n_shingles", "firsts", "seconds", "bits", "n_bits")))
    every = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = every.join(few.hint("merge"), ["bucket", "block"])
    # once only: of two small components from the smaller node, and in the first bucket of the pair
    once = (F.col("component") == F.col("most")) | (F.col("few_node") < F.col("node"))
    for half, at in (("firsts", F.floor(F.col("slot") / bands)), ("seconds", F.col("slot") % bands)):
        for k in range(bands - 1):
            once &= (at <= k) | (F.get(half, F.lit(k)) != F.get(f"few_{half}", F.lit(k)))
    sizes = 100 * F.least("n_shingles", "few_n_shingles") >= percent * F.greatest("n_shingles", "few_n_shingles")
    # bits that the other set lacks are as many shingles at least that it lacks
    shared = _ones(F.zip_with("bits", "few_bits", lambda a, b: a.bitwiseAND(b)))
    most = F.least(F.col("n_shingles") - F.col("n_bits"), F.col("few_n_shingles") - F.col("few_n_bits")) + shared
    able = (100 + percent) * most >= percent * (F.col("n_shingles") + F.col("few_n_shingles"))
    both = both.where((F.col("component") != F.col("few_component")) & sizes & once & able)
    return both.select(F.greatest("node", "few_node").alias("node"), F.least("node", "few_node").alias("other"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are similar on full sets."""
    own, theirs = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("node", "other"))
    both = pairs.join(theirs.hint("merge"), "other").join(own.hint("merge"), "node")
    common, total = F.size(F.array_intersect("of_node", "of_other")), F.size("of_node") + F.size("of_other")
    return both.where(100 * common >= percent * (total - common)).select(F.col("node").alias("a"), F.col("other").alias("b"))


def link_classes(documents: DataFrame, classes: DataFrame, banding: Banding) -> DataFrame:
    """(node, component) of all set classes that have a link."""
    members = checkpointed(table_members(classes))
    nodes = members.select("node").distinct()
    halves = checkpointed(classes.select("node", "n_shingles", "firsts", "seconds").join(nodes.hint("merge"), "node", "left_semi"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = join_checked(rows, nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")
    sets = checkpointed(full_sets(wanted, banding.shingle))
    links = checkpointed(verify(checkpointed(star(members, banding.pivots)), sets, banding.percent))
    labels = components(links)
    for turn in range(banding.chains):
        release(documents.sparkSession)
        pairs = checkpointed(chain(members, labels, halves, banding.bands, turn))
        if pairs.isEmpty():
            return labels
        labels = joined(labels, checkpointed(verify(pairs, sets, banding.percent)))
    release(documents.sparkSession)
    halves = halves.join(sets.select(F.col("doc_id").alias("node"), "bits", _ones(F.col("bits")).alias("n_bits")).hint("merge"), "node")
    pairs = checkpointed(remaining(members, labels, halves, banding.bands, banding.percent))
    release(documents.sparkSession)
    more = checkpointed(verify(pairs, sets, banding.percent))
    return labels if more.isEmpty() else joined(labels, more)


def apply(documents: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = checkpointed(ids.where("doc_id is not null").mapInArrow(partial(_sketches, banding=banding), _SKETCH))
    # checkpointed apart, so that a large group of copies meets it in a join that adaptive execution can split
    merged = checkpointed(sketches.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")))
    owners = checkpointed(sketches.select("doc_id", "n_shingles", "set_a", "set_b").join(merged.hint("merge"), ["set_a", "set_b"]).select("doc_id", "n_shingles", "node"))
    classes = sketches.join(owners.where("doc_id = node").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    labels = link_classes(documents, classes.withColumnRenamed("doc_id", "node"), banding)
    told = owners.join(labels.hint("merge"), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    told = told.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    return (
        ids.select("doc_id").join(told, "doc_id", "left")
        .select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
