"""Problem 4: long exact spans shared between records (fixed-block anchors)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.arrowkit import flat, global_codes, grams, lists, row_ids
from weftline.llm.classes import copy_classes, representatives
from weftline.session import cut, grows


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, values = flat(batch.column(1))
        yield pa.record_batch([batch.column(0).cast(pa.int64()), lists(global_codes(values).view(np.int64), offsets, pa.int64())], names=["rep", "codes"])


def _windows(k: int):
    """All rolling windows of ``k`` codes: (key, rep, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = flat(batch.column(1))
            hashes, start = grams(values.to_numpy(zero_copy_only=False).view(np.uint64), offsets, k)
            row = row_ids(offsets)[start]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array((start - offsets[row]).astype(np.int32))], names=["key", "rep", "pos"])

    return run


def _extend(least: int):
    """(g, d, codes of f, codes of g): maximal equal stretches of the diagonal
    g = f + d, as intervals of g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fo, fv = flat(batch.column(2))
            go, gv = flat(batch.column(3))
            fv, gv = fv.to_numpy(zero_copy_only=False), gv.to_numpy(zero_copy_only=False)
            d = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            # the part of g that has a counterpart in f, for all rows at once
            lo = np.maximum(0, d)
            hi = np.minimum(np.diff(go), np.diff(fo) + d)
            n = np.maximum(hi - lo, 0)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            same = gv[go[row] + at] == fv[fo[row] + at - d[row]]
            row, at = row[same], at[same]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(row)) - 1
            keep = at[tails] - at[heads] + 1 >= least
            heads, tails = heads[keep], tails[keep]
            yield pa.record_batch([pa.array(ids[row[heads]], pa.int64()), pa.array(at[heads].astype(np.int32)), pa.array(at[tails].astype(np.int32))], names=["rep", "a", "b"])

    return run


def _refine(block: int, least: int):
    """(rep, hot positions, codes): hashes of all spans of ``least`` codes that hold a hot block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            po, pv = flat(batch.column(1))
            offsets, values = flat(batch.column(2))
            hashes, start = grams(values.to_numpy(zero_copy_only=False).view(np.uint64), offsets, least)
            row = row_ids(offsets)[start]
            mark = np.zeros(offsets[-1] + 1, np.int64)
            prow = row_ids(po)
            np.add.at(mark, offsets[prow] + pv.to_numpy(zero_copy_only=False), 1)
            held = np.concatenate([[0], np.cumsum(mark)])
            hot = held[start + least - block + 1] > held[start]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(hashes[hot].view(np.int64)), pa.array(ids[row[hot]], pa.int64()), pa.array((start - offsets[row])[hot].astype(np.int32))], names=["key", "rep", "a"])

    return run


def merge_intervals(spans: DataFrame, key: str) -> DataFrame:
    """(key, start_pos, end_pos): unions of the inclusive intervals (a, b) of
    each key; intervals that touch become one."""
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(reach >= F.col("a") - 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "island").agg(F.min("a").alias("start_pos"), F.max("b").alias("end_pos")).drop("island")


def shared_spans(records: DataFrame, key: str, seq: str, least: int = 32, postings: int = 64) -> DataFrame:
    """(id, start_pos, end_pos): the longest unbroken stretches of positions of a
    record that lie in a span of ``least`` tokens that occurs verbatim in at
    least one other record.

    Fixed-block anchors: of each record the blocks of ``least // 2`` tokens at
    multiples of that length are indexed, one in ``least // 2`` positions; any
    span of ``least`` tokens holds one of them whole. Every rolling window of
    all records probes the index, and hits are extended on their diagonal to
    maximal repeats. A block with more than ``postings`` index entries is hot;
    its hits are not paired. Instead the spans around its occurrences are
    hashed whole, and those found in two records are shared: as exact, and
    linear however many records hold the block.

    Identical records are shared over their whole length and go through the
    index once. ``key`` is a bigint, once in the table; rows with a null key or
    sequence, and records shorter than ``least``, give no rows. Tokens compare
    by 64-bit hashes.
    """
    block = least // 2
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.col(seq).alias("seq")).filter(F.size("seq") >= least).filter("id is not null")
    classes = cut(copy_classes(rows, "id", "seq", least))
    copied = classes.groupBy("rep").count().filter("count > 1").select("rep")
    codes = cut(representatives(rows, "id", "seq", classes).mapInArrow(_codes, "rep bigint, codes array<bigint>"))
    probes = codes.mapInArrow(_windows(block), "key bigint, rep bigint, pos int")
    index = probes.filter(F.col("pos") % block == 0).select("key", F.col("rep").alias("f"), F.col("pos").alias("p"))
    hot = cut(index.groupBy("key").count().filter(F.col("count") > postings).select("key"))
    some_hot = not hot.isEmpty()
    cold = index.join(grows(hot), "key", "left_anti") if some_hot else index
    hits = probes.join(grows(cold), "key").filter("rep <> f").select("f", F.col("rep").alias("g"), (F.col("pos") - F.col("p")).alias("d")).distinct()
    seqs = codes.select(F.col("rep").alias("f"), F.col("codes").alias("cf")), codes.select(F.col("rep").alias("g"), F.col("codes").alias("cg"))
    paired = hits.join(grows(seqs[0]), "f").join(grows(seqs[1]), "g").select("g", "d", "cf", "cg")
    spans = paired.mapInArrow(_extend(least), "rep bigint, a int, b int").distinct()
    if some_hot:
        at = probes.join(grows(hot), "key", "left_semi").groupBy("rep").agg(F.collect_list("pos").alias("at"))
        wide = at.join(grows(codes), "rep").select("rep", "at", "codes").mapInArrow(_refine(block, least), "key bigint, rep bigint, a int")
        wide = cut(wide)
        twice = wide.groupBy("key").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select("key")
        spans = spans.unionByName(wide.join(grows(twice), "key", "left_semi").select("rep", "a", (F.col("a") + least - 1).cast("int").alias("b")))
    own = merge_intervals(spans.join(grows(copied), "rep", "left_anti"), "rep").withColumnRenamed("rep", "id")
    whole = classes.join(grows(copied), "rep", "left_semi").select("id").join(grows(rows), "id")
    return own.unionByName(whole.select("id", F.lit(0).alias("start_pos"), (F.size("seq") - 1).alias("end_pos")))


def shared_cover(records: DataFrame, key: str, seq: str, spans: DataFrame) -> DataFrame:
    """(id, spans, covered, share): how much of each record its shared spans
    cover; every record comes out, one without tokens with a null share."""
    sums = spans.groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end_pos") - F.col("start_pos") + 1).alias("covered"))
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.size(seq), F.lit(0)).alias("n")).filter("id is not null")
    out = rows.join(grows(sums), "id", "left").fillna(0, ["spans", "covered"])
    return out.select("id", "spans", "covered", F.when(F.col("n") > 0, F.col("covered") / F.col("n")).alias("share"))
