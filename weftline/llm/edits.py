"""Problem 6: near-duplicate records with small edits (prefix filtering)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrowkit import flat, global_codes, grams, lists, mix, row_ids
from weftline.llm.classes import copy_classes, representatives
from weftline.llm.linking import connected_groups
from weftline.session import cut, grows

#: Cells of the sketch that orders grams by rarity: a fixed 2 MB, however much is counted.
CELLS = 1 << 18
#: Grams that two similar sequences must share among the first of both.
SHARED = 4
#: Levels of the counts of 32 parts of the tokens in the outline of a sequence, two in a 64-bit word.
LEVELS = (1, 2, 3, 4, 5, 7, 9, 12)


WORDS = [f"o{i}" for i in range(len(LEVELS) // 2)]


def _count_cells(q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            offsets, values = flat(batch.column(1))
            hashes, _ = grams(values.to_numpy(zero_copy_only=False).view(np.uint64), offsets, q)
            total += np.bincount((hashes % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    return run


def prefix_length(n: np.ndarray, q: int, percent: int) -> np.ndarray:
    """How many of the rarest q-grams of a sequence of ``n`` tokens must be
    looked at so that any partner at least as long shares SHARED of them; the
    partner needs no more than its own prefix."""
    longest = n * 100 // (100 - percent)
    best = np.ones_like(n)
    for extra in range(int((longest - n).max(initial=0)) + 1):
        fits = n + extra <= longest
        best = np.where(fits, np.maximum(best, q * ((n + extra) * percent // 100) - extra + 1), best)
    return np.minimum(best + SHARED - 1, np.maximum(n - q + 1, 0))


def parts_of(codes: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """Tokens in each of 2 ** depth parts of the order of token hashes, a row a sequence."""
    part = (mix(codes) >> np.uint64(64 - depth)).astype(np.int64)
    rows = len(offsets) - 1
    return np.bincount((row_ids(offsets) << depth) + part, minlength=rows << depth).reshape(rows, 1 << depth)


def outline(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """256 bits a row, as four words: for each level and each of 32 parts of
    the tokens, whether the count reaches the level. An insertion or deletion
    changes one bit at most, a substitution two."""
    counts = parts_of(codes, offsets, 5)
    place = np.uint64(1) << np.arange(32, dtype=np.uint64)
    halves = [np.where(counts >= level, place, np.uint64(0)).sum(axis=1, dtype=np.uint64) for level in LEVELS]
    return [(a | b << np.uint64(32)).view(np.int64) for a, b in zip(halves[::2], halves[1::2])]


def suffix_filter(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray, most: np.ndarray, depths: tuple[int, ...] = (6, 8)) -> np.ndarray:
    """Which pairs may be within ``most`` edits: tokens are parted around the
    same pivots of one order, deeper each time, and differences of the parts'
    sizes add up to 2 * most - (difference of lengths) at most."""
    keep = np.ones(len(most), bool)
    allowed = 2 * most - np.abs(np.diff(ao) - np.diff(bo))
    for depth in depths:
        keep &= np.abs(parts_of(a, ao, depth) - parts_of(b, bo, depth)).sum(axis=1) <= allowed
    return keep


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, values = flat(batch.column(1))
        columns = outline(values.to_numpy(zero_copy_only=False).view(np.uint64), offsets)
        yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets).astype(np.int32)), *map(pa.array, columns)], names=["id", "n", *WORDS])


def _prefixes(q: int, percent: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = rarity.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offsets, values = flat(batch.column(1))
            codes = values.to_numpy(zero_copy_only=False).view(np.uint64)
            hashes, start = grams(codes, offsets, q)
            row = row_ids(offsets)[start]
            order = np.lexsort((start, hashes, frequency[(hashes % np.uint64(CELLS)).astype(np.int64)], row))
            row, hashes, start = row[order], hashes[order], start[order]
            n = np.diff(offsets)
            first = np.concatenate([[0], np.cumsum(np.maximum(n - q + 1, 0))])[:-1]
            keep = np.arange(len(row)) - first[row] < prefix_length(n, q, percent)[row]
            row, hashes, start = row[keep], hashes[keep], start[keep]
            columns = [pa.array(hashes.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array(n[row].astype(np.int32)), pa.array((start - offsets[row]).astype(np.int32))]
            yield pa.record_batch(columns, names=["gram", "id", "n", "pos"])

    return run


def banded_distances(a: np.ndarray, ao: np.ndarray, b: np.ndarray, bo: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of code sequences, many at once, exact up to
    ``most`` and greater than ``most`` beyond. Only the diagonals within the
    largest ``most`` are filled in; one step fills a row of every pair's table."""
    na, nb = np.diff(ao), np.diff(bo)
    pairs, k = len(na), int(most.max(initial=0))
    if not pairs:
        return np.zeros(0, np.int64)
    width, big = 2 * k + 1, np.int32(1 << 20)
    rows = int(na.max(initial=0))
    pad = np.full((pairs, max(rows, int(nb.max(initial=0))) + 2 * k + 2), -1, np.int64)
    pad[row_ids(bo), k + np.arange(len(b)) - bo[row_ids(bo)]] = b
    left = np.full((pairs, rows + 1), -2, np.int64)
    left[row_ids(ao), np.arange(len(a)) - ao[row_ids(ao)]] = a
    shift = np.arange(width, dtype=np.int32)
    # cell c of row i stands for column j = i + c - k
    state = np.where(shift[None, :] >= k, shift[None, :] - k, big).astype(np.int32) * np.ones((pairs, 1), np.int32)
    out = np.full(pairs, big, np.int64)
    at = nb - na + k
    inside = (at >= 0) & (at < width)
    done = inside & (na == 0)
    out[done] = state[done, at[done]]
    for i in range(1, rows + 1):
        same = pad[:, i - 1 : i - 1 + width] == left[:, i - 1 : i]
        step = state + ~same
        step[:, :-1] = np.minimum(step[:, :-1], state[:, 1:] + 1)
        outside = shift < k - i  # columns before the first
        step[:, outside] = big
        if i <= k:
            step[:, k - i] = i
        state = (np.minimum.accumulate(step - shift, axis=1) + shift).astype(np.int32)
        done = inside & (na == i)
        if done.any():
            out[done] = state[done, at[done]]
    return out


#: Cells of the tables of distances filled in at once, some 100 MB.
TABLES = 4_000_000


def _slices(longest: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Ranges of pairs, sorted by length, whose tables have TABLES cells in all, or one pair."""
    at = 0
    while at < len(longest):
        cells = longest[at:] * (100 + 4 * percent) // 100 + 1
        n = max(1, int(np.searchsorted(np.arange(1, len(cells) + 1) * cells > TABLES, True)))
        yield at, at + n
        at += n


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ao, a = flat(whole.column(2))
            bo, b = flat(whole.column(3))
            longest = np.maximum(np.diff(ao), np.diff(bo))
            likely = suffix_filter(a.to_numpy(zero_copy_only=False).view(np.uint64), ao, b.to_numpy(zero_copy_only=False).view(np.uint64), bo, longest * percent // 100)
            rows = np.flatnonzero(likely)
            rows = rows[np.argsort(longest[rows], kind="stable")]
            for i, j in _slices(longest[rows], percent):
                batch = whole.take(pa.array(rows[i:j]))
                ao, a = flat(batch.column(2))
                bo, b = flat(batch.column(3))
                most = np.maximum(np.diff(ao), np.diff(bo)) * percent // 100
                d = banded_distances(a.to_numpy(zero_copy_only=False), ao, b.to_numpy(zero_copy_only=False), bo, most)
                keep = pa.array(d <= most)
                yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(d[d <= most].astype(np.int32))], names=["id1", "id2", "distance"])

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, values = flat(batch.column(1))
        yield pa.record_batch([batch.column(0).cast(pa.int64()), lists(global_codes(values).view(np.int64), offsets, pa.int64())], names=["rep", "codes"])


def edit_candidates(codes: DataFrame, least: int = 40, percent: int = 15, q: int = 5) -> DataFrame:
    """(id1, id2, shared), id1 < id2: all pairs of (rep, codes) rows that may be
    within ``percent`` % edits of the longer length, once each.

    Rare-first prefix filtering: q-grams are ordered by how rare they are in
    the whole table (a sketch of fixed size; any common order is right), and
    two sequences within t edits share SHARED grams, at positions at most t
    apart, among the first of both. Rows of gram, id, length and position meet
    on those grams; lengths and positions must allow t edits, as must 256-bit
    outlines of the tokens, the first step of the suffix filter. No sequence
    may be shorter than ``least``, which must be so long that similar ones
    share SHARED grams at all.
    """
    shared = [n - q + 1 - q * (n * percent // 100) for n in range(least, least + 200)]
    if min(shared) < SHARED:
        raise ValueError(f"sequences of {least} tokens may share fewer than {SHARED} {q}-grams within {percent} % edits")
    spark = codes.sparkSession
    cells = codes.mapInArrow(_count_cells(q), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    frequency = np.zeros(CELLS, np.int64)
    counted = cells.toPandas()  # at most CELLS rows
    frequency[counted["cell"].to_numpy(np.int64)] = counted["n"]
    rarity = spark.sparkContext.broadcast(frequency)
    prefix = codes.mapInArrow(_prefixes(q, percent, rarity), "gram bigint, id bigint, n int, pos int")
    x = prefix.select("gram", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "pos")])
    y = prefix.select("gram", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "pos")])
    most = F.floor(F.greatest("n1", "n2") * percent / 100)
    cond = (F.col("id1") < F.col("id2")) & (F.abs(F.col("n1") - F.col("n2")) <= most) & (F.abs(F.col("pos1") - F.col("pos2")) <= most)
    pairs = x.join(grows(y), "gram").filter(cond).groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= SHARED)
    outlines = codes.mapInArrow(_outlines, ", ".join(["id bigint, n int", *[f"{w} bigint" for w in WORDS]]))
    one, two = (outlines.select(*[F.col(c).alias(f"{c}{i}") for c in ("id", "n", *WORDS)]) for i in (1, 2))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{w}1").bitwiseXOR(F.col(f"{w}2"))) for w in WORDS])
    return pairs.join(grows(one), "id1").join(grows(two), "id2").filter(differ <= 2 * most).select("id1", "id2", "shared")


def verified_pairs(candidates: DataFrame, codes: DataFrame, percent: int = 15) -> DataFrame:
    """(id1, id2, distance) of the candidates within ``percent`` % edits: the
    deeper steps of the suffix filter, then one banded distance a pair."""
    a = codes.select(F.col("rep").alias("id1"), F.col("codes").alias("c1"))
    b = codes.select(F.col("rep").alias("id2"), F.col("codes").alias("c2"))
    return candidates.join(grows(a), "id1").join(grows(b), "id2").select("id1", "id2", "c1", "c2").mapInArrow(_verify(percent), "id1 bigint, id2 bigint, distance int")


def edit_pairs(codes: DataFrame, least: int = 40, percent: int = 15, q: int = 5) -> DataFrame:
    """(id1, id2, distance) of all pairs of (rep, codes) rows, id1 < id2, whose
    edit distance is at most ``percent`` % of the longer length."""
    return verified_pairs(edit_candidates(codes, least, percent, q), codes, percent)


def near_copy_groups(records: DataFrame, key: str, seq: str, least: int = 40, percent: int = 15, q: int = 5) -> DataFrame:
    """(id, group_id): groups of two or more records whose sequences of at least
    ``least`` tokens are linked, directly or through others, by edit distances
    of at most ``percent`` % of the longer length; group_id is the smallest id.

    Identical sequences are one class that goes through the join once. Of every
    record the candidate that shares most with it is verified first; of the
    others only those between different groups of these links, as a pair inside
    a group adds nothing. ``key`` is a bigint, once in the table; rows with a
    null key or sequence and shorter sequences give no rows, as does an empty
    table. No bucket, partner list or candidate list is capped.
    """
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.col(seq).alias("seq")).filter(F.size("seq") >= least)
    classes = cut(copy_classes(rows, "id", "seq", least))
    codes = cut(representatives(rows, "id", "seq", classes).mapInArrow(_codes, "rep bigint, codes array<bigint>"))
    candidates = cut(edit_candidates(codes, least, percent, q))
    ends = candidates.select(F.explode(F.array(F.struct(F.col("id1").alias("id"), F.col("id2").alias("other"), "shared"), F.struct(F.col("id2").alias("id"), F.col("id1").alias("other"), "shared"))).alias("e")).select("e.*")
    best = ends.groupBy("id").agg(F.max_by("other", F.struct("shared", -F.col("other"))).alias("other"))
    first = best.select(F.least("id", "other").alias("id1"), F.greatest("id", "other").alias("id2")).distinct()
    links = cut(verified_pairs(first, codes, percent).select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    groups = cut(connected_groups(links.unionByName(classes.select(F.col("rep").alias("a"), F.col("id").alias("b")))))
    g1, g2 = groups.select(F.col("id").alias("id1"), F.col("group_id").alias("a")), groups.select(F.col("id").alias("id2"), F.col("group_id").alias("b"))
    rest = candidates.join(grows(g1), "id1").join(grows(g2), "id2").filter("a <> b")
    more = verified_pairs(rest.select("id1", "id2"), codes, percent).join(grows(g1), "id1").join(grows(g2), "id2").select("a", "b")
    merged = connected_groups(cut(more.distinct())).select(F.col("id").alias("group_id"), F.col("group_id").alias("top"))
    found = cut(groups.join(grows(merged), "group_id", "left").select("id", F.coalesce("top", "group_id").alias("group_id")))
    several = found.groupBy("group_id").count().filter("count > 1").select("group_id")
    return found.join(grows(several), "group_id", "left_semi").select("id", "group_id")
