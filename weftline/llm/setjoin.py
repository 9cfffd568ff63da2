"""Problem 3: all similar pairs of set-valued records (banded minwise hashing)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrowkit import flat, global_codes, grams, mix, row_ids
from weftline.llm.classes import copy_classes, representatives
from weftline.session import cut, grows


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` hashes so that a pair at the threshold is missed with
    probability ``miss`` at most."""
    if threshold >= 1:
        return 1
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(sequences: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(id, items): the distinct runs of ``k`` tokens as sorted 64-bit hashes.
    Sequences shorter than ``k`` have no items and give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = flat(batch.column(1))
            hashes, start = grams(global_codes(values), offsets, k)
            row = row_ids(offsets)[start]
            yield _as_sets(batch.column(0).to_numpy(zero_copy_only=False), row, hashes)

    rows = sequences.select(F.col(key).cast("bigint").alias("id"), F.col(seq).alias("seq")).dropna()
    return rows.mapInArrow(run, "id bigint, items array<bigint>")


def hashed_sets(records: DataFrame, key: str, items: str) -> DataFrame:
    """(id, items) of records that hold string values; null values are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = flat(batch.column(1))
            yield _as_sets(batch.column(0).to_numpy(zero_copy_only=False), row_ids(offsets), global_codes(values))

    rows = records.select(F.col(key).cast("bigint").alias("id"), F.filter(F.col(items), lambda x: x.isNotNull()).alias("v")).dropna()
    return rows.mapInArrow(run, "id bigint, items array<bigint>")


def _as_sets(ids: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[keep], hashes[keep]
    counts = np.bincount(row, minlength=len(ids))
    offsets = np.concatenate([[0], np.cumsum(counts[counts > 0])])
    items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
    return pa.record_batch([pa.array(ids[counts > 0], pa.int64()), items], names=["id", "items"])


def _band_keys(bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, bands * rows, np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                offsets, values = flat(batch.column(1))
                h = values.to_numpy(zero_copy_only=False).view(np.uint64)
                ids, n = batch.column(0).to_numpy(zero_copy_only=False), np.diff(offsets)
                keys = np.empty((bands, len(ids)), np.uint64)
                with np.errstate(over="ignore"):
                    for band in range(bands):
                        acc = np.full(len(ids), band + 1, np.uint64)
                        for i in range(band * rows, (band + 1) * rows):
                            acc = mix(acc + np.minimum.reduceat((h * a[i] + b[i]) >> np.uint64(24), offsets[:-1]))
                        keys[band] = acc
                yield pa.record_batch([pa.array(np.tile(ids, bands)), pa.array(np.tile(n, bands).astype(np.int32)), pa.array(keys.ravel().view(np.int64))], names=["id", "n", "key"])

    return run


def similar_pairs(sets: DataFrame, threshold: float, other: DataFrame | None = None, rows: int = 3, miss: float = 1e-5, seed: int = 7) -> DataFrame:
    """(id1, id2, jaccard) of all pairs of (id, items) rows, within ``sets`` or
    between ``sets`` and ``other``, whose Jaccard similarity is at least
    ``threshold``.

    Signatures of minwise hashes are split into bands; records that share the
    bucket of any band and whose sizes allow the threshold become candidates
    once, and the exact similarity of their sets decides. A pair at the
    threshold is missed with probability ``miss`` at most, one above it with
    less; no bucket is capped. Within one table id1 < id2, and an id must be
    there once. Empty sets are similar to nothing. Records with equal sets
    should be reduced to a representative before (``classes``): their pairs
    come out here as any others do.

    Buckets travel as (id, size, key); a bucket with a third of all rows is
    split by the skew join, and only pairs of sets with much in common share
    one often.
    """
    count = bands_for(threshold, rows, miss)
    keyed = sets.filter(F.size("items") > 0).mapInArrow(_band_keys(count, rows, seed), "id bigint, n int, key bigint")
    left = keyed.select("key", F.col("id").alias("id1"), F.col("n").alias("n1"))
    second = sets if other is None else other
    keyed2 = keyed if other is None else other.filter(F.size("items") > 0).mapInArrow(_band_keys(count, rows, seed), "id bigint, n int, key bigint")
    right = keyed2.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"))
    sizes = (F.col("n1") >= F.lit(threshold) * F.col("n2")) & (F.col("n2") >= F.lit(threshold) * F.col("n1"))
    cond = sizes & (F.col("id1") < F.col("id2")) if other is None else sizes
    candidates = left.join(grows(right), "key").filter(cond).select("id1", "id2").distinct()
    a = sets.select(F.col("id").alias("id1"), F.col("items").alias("s1"))
    b = second.select(F.col("id").alias("id2"), F.col("items").alias("s2"))
    both = candidates.join(grows(a), "id1").join(grows(b), "id2")
    shared = F.size(F.array_intersect("s1", "s2"))
    scored = both.select("id1", "id2", shared.alias("c"), (F.size("s1") + F.size("s2")).alias("t"))
    return scored.select("id1", "id2", (F.col("c") / (F.col("t") - F.col("c"))).alias("jaccard")).filter(F.col("jaccard") >= threshold)


def similar_sequences(records: DataFrame, key: str, seq: str, k: int, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, rep) and (id1, id2, jaccard): the classes of identical sequences of
    at least ``least`` tokens, and the similar pairs of their representatives.
    Together they hold every similar pair of records; copies are never paired
    with each other or compared twice."""
    rows = records.filter(F.size(seq) >= least)
    classes = cut(copy_classes(rows, key, seq, least))
    sets = cut(shingle_sets(representatives(rows, key, seq, classes), "rep", "seq", k))
    return classes, similar_pairs(sets, threshold)


def similar_classes(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep, links): every record with its class and the number of other
    classes that are similar to it: one row a record, however many copies."""
    ends = pairs.select(F.explode(F.array("id1", "id2")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return classes.join(grows(ends), "rep", "left").select("id", "rep", F.coalesce("links", F.lit(0)).alias("links"))
