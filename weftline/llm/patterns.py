"""Problem 2: frequent subsequences with gaps (position-coded pattern tree)."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrowkit import flat, local_codes, row_ids
from weftline.session import cut

FOUND = "pattern string, n bigint"


class PatternTree:
    """Paths merged into a prefix tree, for mining without rebuilding.

    A node is an item and its distance from the step before; it counts the
    paths through it. Its position code is its number in pre-order and the
    number behind its last descendant, so ``a`` is an ancestor of ``b`` if
    ``a < b < end[a]``. Header links lead from every node to the descendants
    that may be the next step of a pattern, sorted by code.
    """

    def __init__(self, paths: list[tuple], reach: int):
        paths.sort()
        item, gap, count, up, end = [-1], [0], [len(paths)], [0], [0]
        spine: list[int] = []  # node of each step of the path before
        before: tuple = ()
        for path in paths:
            same = 0
            for x, y in zip(path, before):
                if x != y:
                    break
                same += 1
            for node in spine[same:]:
                end[node] = len(item)
            del spine[same:]
            for node in spine:
                count[node] += 1
            for i, g in path[same:]:
                item.append(i)
                gap.append(g)
                count.append(1)
                up.append(spine[-1] if spine else 0)
                end.append(0)
                spine.append(len(item) - 1)
            before = path
        for node in [0, *spine]:
            end[node] = len(item)
        self.item, self.count, self.end = np.array(item), np.array(count), np.array(end)
        source, target = [], []
        for node in range(1, len(item)):
            far, at = 0, node
            while gap[at]:  # 0: nothing before it is within reach
                far += gap[at]
                at = up[at]
                if far > reach:
                    break
                source.append(at)
                target.append(node)
        source, target = np.array(source, np.int64), np.array(target, np.int64)
        order = np.lexsort((target, source))
        self.links = target[order]
        self.first = np.searchsorted(source[order], np.arange(len(item) + 1))

    def support(self, nodes: np.ndarray) -> int:
        """Paths through any of ``nodes`` (in pre-order): only those below no
        other count, as the paths of the others are among theirs."""
        reach = np.maximum.accumulate(self.end[nodes])
        top = np.ones(len(nodes), bool)
        top[1:] = nodes[1:] >= reach[:-1]
        return int(self.count[nodes[top]].sum())

    def by_item(self, nodes: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(self.item[nodes], kind="stable")
        nodes = nodes[order]
        cuts = np.flatnonzero(np.diff(self.item[nodes])) + 1
        return [(int(self.item[part[0]]), part) for part in np.split(nodes, cuts) if len(part)]

    def following(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes at which a next step can be, given where the last one is."""
        spread = [self.links[self.first[n] : self.first[n + 1]] for n in nodes.tolist()]
        return np.unique(np.concatenate(spread)) if spread else nodes[:0]

    def mine(self, least: int, shortest: int, longest: int, wanted: set[tuple] | None = None) -> Iterator[tuple[tuple, int]]:
        """(pattern, support) of at least ``least`` paths; or, with ``wanted``
        prefixes, of those patterns however few hold them."""

        def grow(prefix: tuple, nodes: np.ndarray) -> Iterator[tuple[tuple, int]]:
            for item, at in self.by_item(nodes):
                pattern = (*prefix, item)
                if wanted is not None and pattern not in wanted:
                    continue
                n = self.support(at)
                if n < least:
                    continue
                if len(pattern) >= shortest:
                    yield pattern, n
                if len(pattern) < longest:
                    yield from grow(pattern, self.following(at))

        yield from grow((), np.arange(1, len(self.item)))


def _paths(alphabet: frozenset[str], reach: int, shortest: int):
    """Sequences -> paths of items and distances. A stretch ends where the next
    item is out of reach; those too short for a pattern are left out, and the
    order of the others doesn't matter, so they are sorted and share prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, values = flat(batch.column(1))
            code, tokens = local_codes(values)
            wanted = np.array([t in alphabet for t in tokens] or [False])
            at = np.flatnonzero(wanted[code]) if len(code) else np.zeros(0, np.int64)
            row = row_ids(offsets)[at]
            far = np.diff(at, prepend=-1)
            far[np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else slice(0)] = 0
            far[far > reach] = 0
            heads = np.append(np.flatnonzero(far == 0), len(at))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            stretches: dict[int, set] = {}
            for a, b in zip(heads[:-1], heads[1:]):
                if b - a >= shortest:
                    stretch = tuple((tokens[c], g) for c, g in zip(code[at[a:b]].tolist(), far[a:b].tolist()))
                    stretches.setdefault(int(row[a]), set()).add(stretch)
            rows = [(int(ids[r]), [step for s in sorted(found) for step in s]) for r, found in stretches.items()]
            yield pa.record_batch(
                [pa.array([r for r, _ in rows], pa.int64()), pa.array([[i for i, _ in p] for _, p in rows], pa.list_(pa.string())), pa.array([[g for _, g in p] for _, p in rows], pa.list_(pa.int32()))],
                names=["id", "items", "gaps"],
            )

    return run


def _grow_tree(reach: int):
    """All paths of a partition -> one row (records, names of the items, the tree's arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        paths, records = [], 0
        for batch in batches:
            for p, q in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                paths.append(tuple((code.setdefault(i, len(code)), g) for i, g in zip(p, q)))
            records += batch.num_rows
        if records:
            tree = pickle.dumps(vars(PatternTree(paths, reach)))
            yield pa.record_batch([pa.array([records], pa.int64()), pa.array([list(code)], pa.list_(pa.string())), pa.array([tree], pa.binary())], names=["records", "names", "tree"])

    return run


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[PatternTree, list[str], int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            records, names, data = (c[i].as_py() for c in batch.columns)
            tree = PatternTree.__new__(PatternTree)
            vars(tree).update(pickle.loads(data))
            yield tree, names, records


def _result(found: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["pattern", "n"])


def frequent_patterns(records: DataFrame, key: str, seq: str, alphabet: frozenset[str], least: int, shortest: int = 3, longest: int = 5, between: int = 3, part_rows: int = 20_000, block: int = 200_000, part_steps: int = 400_000) -> DataFrame:
    """(pattern, support): every ordered pattern of ``shortest`` to ``longest``
    tokens of ``alphabet`` (repeats allowed) whose steps follow each other with
    at most ``between`` other tokens between neighbours, in at least ``least``
    of the records. A pattern is its tokens joined by one space.

    Each partition of about ``part_rows`` records, or fewer if they have over
    ``part_steps`` tokens of ``alphabet``, merges its sequences into one
    position-coded tree, which is written once and mined. A pattern with the
    support wanted over all partitions reaches its share of it in at least one
    of them, so the patterns that do are all candidates there can be; a second
    pass over the same trees counts just these everywhere. Counts are exact.
    Candidates go to the executors in blocks of at most ``block``; their number
    depends on the share asked for, not on the rows.

    ``alphabet`` must be a fixed reference list. A record with a null key or
    sequence holds nothing; ``key`` is a bigint, once in the table; an empty
    table or alphabet gives no rows.
    """
    spark, reach = records.sparkSession, between + 1
    rows = records.select(F.col(key).cast("bigint").alias("id"), F.col(seq).alias("seq")).dropna()
    paths = rows.mapInArrow(_paths(alphabet, reach, shortest), "id bigint, items array<string>, gaps array<int>")
    paths = cut(paths)
    total, steps = paths.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first()
    parts = max(1, math.ceil(total / part_rows), math.ceil((steps or 0) / part_steps))
    trees = cut(paths.repartition(parts, "id").mapInArrow(_grow_tree(reach), "records bigint, names array<string>, tree binary"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, names, n in _trees(batches):
            share = max(1, -(-least * n // total))
            yield _result([(" ".join(names[i] for i in p), n) for p, n in tree.mine(share, shortest, longest)])

    candidates = cut(trees.mapInArrow(local, FOUND).groupBy("pattern").agg(F.sum("n").alias("n")))
    blocks = max(1, math.ceil(candidates.count() / block))
    asked = []
    for b in range(blocks):
        mine = candidates.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).select("pattern")
        asked.append(spark.sparkContext.broadcast([r[0] for r in mine.collect()]))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, names, _ in _trees(batches):
            code = {x: i for i, x in enumerate(names)}
            for wanted in asked:
                prefixes, whole = set(), set()
                for text in wanted.value:
                    steps = tuple(code.get(x, -1) for x in text.split(" "))
                    if -1 not in steps:
                        whole.add(steps)
                        prefixes.update(steps[: i + 1] for i in range(len(steps)))
                found = [(p, n) for p, n in tree.mine(1, shortest, longest, prefixes) if p in whole]
                yield _result([(" ".join(names[i] for i in p), n) for p, n in found])

    return trees.mapInArrow(exact, FOUND).groupBy("pattern").agg(F.sum("n").alias("support")).filter(F.col("support") >= least)
