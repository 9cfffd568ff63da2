"""NumPy kernels over Arrow list columns: whole batches at a time, no row loops.

A batch of token lists becomes one flat array of 64-bit token codes plus row
offsets. Codes depend on the token alone, so they agree between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * STEP
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row offsets (from 0) and the flat values of a list column; null lists are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return offsets, column.flatten()


def local_codes(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Dense codes within the batch and the tokens they stand for."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def global_codes(values: pa.Array) -> np.ndarray:
    """64-bit codes of tokens that are the same in every task."""
    index, tokens = local_codes(values)
    table = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens] or [0], np.uint64)
    return table[index] if len(index) else np.zeros(0, np.uint64)


def row_ids(offsets: np.ndarray) -> np.ndarray:
    """The row of every flat value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of ``k`` tokens inside rows, and the flat
    position of the first token of each."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = mix(acc * MIX + codes[j : j + n])
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    start = np.flatnonzero(np.arange(n) + k <= ends)
    return acc[start], start


def group_starts(sorted_rows: np.ndarray) -> np.ndarray:
    """Start index of each run of equal values."""
    if not len(sorted_rows):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as compressed Arrow IPC."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(column: pa.Array) -> Iterator[pa.RecordBatch]:
    """The batches of a column of packs."""
    for x in column:
        yield from pa.ipc.open_stream(x.as_buffer())


def whole_runs(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that no run of equal values of a bigint column is parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = int(group_starts(batch.column(column).to_numpy(zero_copy_only=False))[-1])
        if held and at == 0 and batch.column(column)[0] == held[-1].column(column)[-1]:
            held.append(batch)
            continue
        if at or held:
            yield from pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()
        held = [batch.slice(at)]
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
