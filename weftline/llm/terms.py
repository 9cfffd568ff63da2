"""Problem 5: frequency of every distinct term (vertical layout of bitmaps)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrowkit import flat, local_codes, row_ids
from weftline.session import cut

#: Ids in one container, and the cardinality from which a container is a bitmap.
BITS, DENSE = 16, 4096
CONTAINERS = pa.schema([("term", pa.string()), ("bucket", pa.int64()), ("ids", pa.binary()), ("card", pa.int64()), ("occ", pa.int64())])


def pack(low: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit ids: two bytes each, or one bitmap
    of 8 KB once that is shorter."""
    if len(low) < DENSE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < 2 * DENSE:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a run of equal pairs starts."""
    return np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record number, terms) -> one container for each term and bucket of a batch."""
    for batch in batches:
        offsets, values = flat(batch.column(1))
        if not len(values):
            continue
        code, terms = local_codes(values)
        record = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row_ids(offsets)]
        order = np.lexsort((record, code))
        code, record = code[order], record[order]
        starts = _changes(code, record)
        occ = np.diff(np.append(starts, len(code)))
        code, record = code[starts], record[starts]
        bucket = record >> BITS
        heads = _changes(code, bucket)
        ends = np.append(heads[1:], len(code))
        low = record & ((1 << BITS) - 1)
        data = [pack(low[a:b]) for a, b in zip(heads, ends)]
        yield pa.record_batch(
            [pa.array([terms[c] for c in code[heads]], pa.string()), pa.array(bucket[heads]), pa.array(data, pa.binary()), pa.array(ends - heads), pa.array(np.add.reduceat(occ, heads))],
            schema=CONTAINERS,
        )


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by term and bucket -> their unions. The state is one
    container, at most 65 536 ids, however many rows hold the term."""
    key, parts, occ = None, [], 0

    def united() -> tuple:
        if len(parts) == 1:
            ids = unpack(parts[0])
        else:
            ids = np.unique(np.concatenate([unpack(p) for p in parts]))
        return (*key, parts[0] if len(parts) == 1 else pack(ids), len(ids), occ)

    for batch in batches:
        done = []
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist())
        for term, bucket, data, n in rows:
            if key != (term, bucket):
                if key is not None:
                    done.append(united())
                key, parts, occ = (term, bucket), [], 0
            parts.append(data)
            occ += n
            if len(parts) > 64:
                parts = [pack(np.unique(np.concatenate([unpack(p) for p in parts])))]
        if done:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), CONTAINERS)], schema=CONTAINERS)
    if key is not None:
        yield pa.record_batch([pa.array([x], f.type) for x, f in zip(united(), CONTAINERS)], schema=CONTAINERS)


def numbered(records: DataFrame, key: str) -> DataFrame:
    """Records with a non-null key and ``_nr``, their number: dense within a
    partition, whatever the keys look like, so that containers fill up. Rows are
    written before, as numbers must be the same if a task runs again."""
    return cut(records.filter(F.col(key).isNotNull())).withColumn("_nr", F.monotonically_increasing_id())


def term_bitmaps(records: DataFrame, key: str, terms: str) -> DataFrame:
    """(term, bucket, ids, card, occ): for each term the compressed bitmap of the
    records that hold it, in containers of 65 536 record numbers, with the
    number of records and of occurrences. ``key`` is a bigint unique to a
    record; the denser its values, the fuller the containers (``numbered``).
    Records with a null key or array and null terms count nothing."""
    kind = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'string' if f.name == 'term' else 'bigint'}" for f in CONTAINERS)
    rows = records.select(F.col(key).cast("bigint").alias("key"), F.filter(F.col(terms), lambda x: x.isNotNull()).alias("terms")).filter("key is not null")
    partial = rows.mapInArrow(_build, kind)
    return partial.repartition("term", "bucket").sortWithinPartitions("term", "bucket").mapInArrow(_unite, kind)


def term_frequencies(records: DataFrame, key: str, terms: str, rare: int = 2, common: float = 0.5) -> DataFrame:
    """(term, occurrences, relative_frequency, records, mark) of every distinct term.

    ``mark`` is ``rare`` if at most ``rare`` records hold the term, else
    ``common`` if at least the share ``common`` of all records does, else null.
    Records without terms count as records. Each row of the input is one
    record: rows of a record delivered twice must be dropped before. An empty
    table gives no rows.
    """
    rows = numbered(records.select(F.col(key).alias("_key"), F.col(terms).alias("_terms")), "_key")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    sums = cut(term_bitmaps(rows, "_nr", "_terms").groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("card").alias("records")))
    tokens = sums.agg(F.sum("occurrences").alias("_t"))
    # both have one row
    both = sums.join(F.broadcast(total)).join(F.broadcast(tokens))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= common * F.col("_n"), "common")
    return both.select("term", "occurrences", (F.col("occurrences") / F.col("_t")).alias("relative_frequency"), "records", mark.alias("mark"))
