"""Problem 7: repeated consecutive events (adjacent agglomeration)."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

RUNS = "entity bigint, part int, seg int, nr bigint, event string, n bigint, first bigint, last bigint"
#: Most different events of which the driver compares every pair to tell those apart that no chain of likeness joins.
KINDS = 1000


def likeness(a: str, b: str) -> float:
    """Dice similarity of the character pairs of two events; 1 only for equal ones."""
    if a == b:
        return 1.0
    p, q = Counter(zip(f"^{a}", f"{a}$")), Counter(zip(f"^{b}", f"{b}$"))
    return min(2 * sum((p & q).values()) / max(1, len(a) + len(b) + 2), 0.999)


def agglomerate(runs: list[tuple[str, int, int, int]], least: float, max_gap: int | None) -> list[tuple[str, int, int, int]]:
    """Neighbouring runs (event, n, first, last) of one entity, the most similar
    pair first, until no pair of neighbours reaches ``least`` within ``max_gap``.

    A doubly linked list keeps the neighbours, a priority queue the pairs; a
    pair whose runs have changed since is skipped. The event of a merged run is
    that of its larger part, of equal ones the smaller text. Of equally similar
    pairs the earliest merges first.
    """
    event, n = [r[0] for r in runs], [r[1] for r in runs]
    first, last = [r[2] for r in runs], [r[3] for r in runs]
    size = len(runs)
    after, before = [*range(1, size), -1], [-1, *range(size - 1)]
    version, queue = [0] * size, []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (max_gap is None or first[j] - last[i] <= max_gap):
            s = likeness(event[i], event[j])
            if s >= least:
                heapq.heappush(queue, (-s, first[i], i, j, version[i], version[j]))

    for i in range(size):
        offer(i)
    alive = [True] * size
    while queue:
        _, _, i, j, vi, vj = heapq.heappop(queue)
        if not (alive[i] and alive[j]) or (version[i], version[j]) != (vi, vj):
            continue
        event[i] = min((-n[i], event[i]), (-n[j], event[j]))[1]
        n[i], last[i] = n[i] + n[j], last[j]
        alive[j], after[i] = False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        version[i] += 1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [(event[i], n[i], first[i], last[i]) for i in range(size) if alive[i]]


def chains(events: list[str], least: float) -> dict[str, str]:
    """The smallest event of all that a chain of pairs with likeness of at least
    ``least`` joins. The event of a merged run is always one of its parts', so
    neighbours of different chains never merge, whatever merges first."""
    top = {e: e for e in events}

    def find(e: str) -> str:
        while top[e] != e:
            top[e] = top[top[e]]
            e = top[e]
        return e

    for i, a in enumerate(events):
        for b in events[:i]:
            if likeness(a, b) >= least:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {e: find(e) for e in events}


def _events(batch: pa.RecordBatch) -> tuple:
    """Sorted rows (entity, at, row, event) as runs of one event. A redelivered
    row repeats its id and so sorts next to itself."""
    entity, at, row = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    events = batch.column(3).dictionary_encode()
    none = np.zeros(len(at), np.int32)
    return entity, events.indices.to_numpy(zero_copy_only=False), events.dictionary.to_pylist(), np.ones(len(at), np.int64), at, at, none, none, row


def _cut_runs(batch: pa.RecordBatch) -> tuple:
    """Sorted rows of RUNS; none repeats another."""
    entity, part, seg, nr = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    n, first, last = (batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
    events = batch.column(4).dictionary_encode()
    return entity, events.indices.to_numpy(zero_copy_only=False), events.dictionary.to_pylist(), n, first, last, part, seg, nr


def _merge(read: Callable, least: float, max_gap: int | None, span: int | None, chain: dict[str, str] | None, edges: bool):
    """Sorted rows -> runs. Rows are parted wherever entity, gap, span or chain
    forbids a merge for good, and every stretch between goes through
    ``agglomerate``. With ``edges`` the first and the last stretch of a
    partition, which a border may have cut, come out with their equal
    neighbours merged only (these merge first anyway) and a ``seg``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, numbers = TaskContext.get().partitionId(), {}
        held: list[tuple] = []  # runs of the stretch that may still grow
        owner, number, first_stretch, nr = None, 0, True, 0
        out: list[tuple] = []

        def number_of(event: str) -> int:
            key = event if least >= 1 else chain[event] if chain is not None else ""
            return numbers.setdefault(key, len(numbers))

        def close(at_end: bool) -> None:
            nonlocal held, first_stretch, number, nr
            if held:
                edge = edges and (first_stretch or at_end)
                runs = held if len(held) == 1 else agglomerate(held, 1.0 if edge else least, max_gap)
                seg = number if edge else None
                for r in runs:
                    out.append((owner[0], part, seg, nr, *r))
                    nr += 1
                first_stretch, number = False, number + 1
            held = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RUNS.split(", ")])

        before = None  # entity, class, last, span block, part, seg and row id of the row before
        for batch in batches:
            entity, index, texts, n, first, last, piece, seg, row = read(batch)
            if not len(entity):
                continue
            if edges:
                again = np.concatenate([[before is not None and before[0] == entity[0] and before[6] == row[0]], (entity[1:] == entity[:-1]) & (row[1:] == row[:-1])])
                keep = ~again
                entity, index, n, first, last, piece, seg, row = (c[keep] for c in (entity, index, n, first, last, piece, seg, row))
                if not len(entity):
                    continue
            label = np.array([number_of(t) for t in texts])[index]
            block = first // span if span else np.zeros(len(first), np.int64)
            join = lambda c, x: np.concatenate([[x], c])
            columns = (entity, label, last, block, piece, seg)
            e, c, l, k, p, s = (join(col, x) for col, x in zip(columns, before[:6] if before else (entity[0], label[0], last[0], block[0], piece[0], seg[0])))
            new = (e[1:] != e[:-1]) | (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | ((p[1:] == p[:-1]) & (s[1:] != s[:-1]))
            if max_gap is not None:
                new |= first - l[:-1] > max_gap
            before = tuple(col[-1] for col in (*columns, row))
            heads = np.flatnonzero(new)
            bounds = np.concatenate([[0], heads[heads > 0], [len(entity)]])
            alone = np.diff(bounds) == 1
            # stretches of one row inside the batch are runs as they are
            alone[[0, -1]] = False
            if alone.any():
                at = bounds[:-1][alone]
                m = len(at)
                yield pa.record_batch(
                    [pa.array(entity[at], pa.int64()), pa.array(np.full(m, part), pa.int32()), pa.nulls(m, pa.int32()), pa.array(np.zeros(m, np.int64)), pa.array(texts, pa.string()).take(pa.array(index[at])), pa.array(n[at]), pa.array(first[at]), pa.array(last[at])],
                    names=[c.split()[0] for c in RUNS.split(", ")],
                )
            if new[0]:
                close(False)
            for a, b in zip(bounds[:-1][~alone].tolist(), bounds[1:][~alone].tolist()):
                if a:
                    close(False)
                owner = (int(entity[a]),)
                held += [(texts[i], *r) for i, r in zip(index[a:b].tolist(), zip(n[a:b].tolist(), first[a:b].tolist(), last[a:b].tolist()))]
            if len(held) > 1000:
                held = agglomerate(held, 1.0, max_gap)
            if out:
                yield batch_of(out)
                out.clear()
        close(True)
        if out:
            yield batch_of(out)

    return run


def collapse_runs(events: DataFrame, entity: str, at: str, event: str, row: str, max_gap: int | None = None, similarity: float = 1.0, span: int | None = None) -> DataFrame:
    """(entity, event, n, first, last): every run of consecutive like events of an
    entity in order of ``at`` (then ``row``) with its number of events and the
    places it extends over; its duration is ``last - first``.

    Adjacent agglomeration: every event starts as a run of one; the most
    similar neighbours merge first until none reaches ``similarity`` (Dice
    similarity of character pairs; 1 merges equal events only) within
    ``max_gap``. Below 1 ``max_gap`` or ``span`` must be set; where ``span`` is
    set a run does not extend over a multiple of it. Rows with a null entity,
    place or event are left out before anything is computed; rows that repeat a
    ``row`` id at the same place count once. Empty input gives no rows.

    Rows are range-partitioned by entity *and* place, so an entity with a third
    of all rows is spread over many tasks. A task parts its rows wherever a
    merge is ruled out for good (entity, gap, span, or events that no chain of
    likeness joins) and queues each stretch on its own, which gives the same
    runs as one queue. Stretches that touch the border of a partition, at most
    two of each, are merged again over all partitions; at similarity 1 they are
    one run each, below 1 as many as they have changes of event. Chains of
    likeness are told apart for at most KINDS different events; beyond that
    only entity, gap and span part rows.
    """
    if similarity < 1 and not span and max_gap is None:
        raise ValueError("similarity below 1 needs max_gap or span, which bound the merging")
    rows = events.select(F.col(entity).cast("bigint").alias("entity"), F.col(at).cast("bigint").alias("at"), F.col(row).cast("bigint").alias("row"), F.col(event).alias("event"))
    rows = rows.dropna(subset=["entity", "at", "event"])
    chain = None
    if similarity < 1:
        kinds = [r[0] for r in rows.select("event").distinct().limit(KINDS + 1).collect()]
        chain = chains(sorted(kinds), similarity) if len(kinds) <= KINDS else None
    rows = rows.repartitionByRange("entity", "at").sortWithinPartitions("entity", "at", "row", "event")
    runs = cut(rows.mapInArrow(_merge(_events, similarity, max_gap, span, chain, True), RUNS))
    edge = runs.filter("seg is not null").repartition("entity").sortWithinPartitions("entity", "part", "seg", "nr")
    edge = edge.mapInArrow(_merge(_cut_runs, similarity, max_gap, span, chain, False), RUNS)
    return runs.filter("seg is null").union(edge).select("entity", "event", "n", "first", "last")
