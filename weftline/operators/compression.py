"""Compression ratios and Lempel-Ziv complexity; compressors need Python, so
sequences go to them in Arrow batches."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def phrases(tokens: list) -> int:
    """Phrases of the greedy LZ78 parse, an unfinished last one included."""
    trie: dict = {}
    node, count = trie, 0
    for t in tokens:
        if t in node:
            node = node[t]
        else:
            node[t] = {}
            node, count = trie, count + 1
    return count + (node is not trie)


def coded(tokens: list, wide: bool = True) -> bytes:
    """Dense ids of a sequence's tokens in order of first use: two bytes each,
    or one if not ``wide``."""
    _, first, index = np.unique(np.array(tokens, object).astype(str), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))[index]
    return rank.astype("<u2" if wide else "u1").tobytes()


def compression(sequences: DataFrame, seq: str = "seq", tokens: str = "tokens", shuffles: int = 0, seed: int = 42) -> DataFrame:
    """(seq, n, zlib, lzma, lz78, lz78_norm[, shuffled_zlib]) of every non-empty
    sequence: sizes against the coded sequence (one byte a token if it has at
    most 256 different ones), LZ78 phrases, and phrases * log2(n) / n. With
    ``shuffles`` the mean ratio of that many seeded permutations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t in zip(b[seq], b[tokens]):
                t = list(t)
                if not t:
                    continue
                data = coded(t, len(set(t)) > 256)
                base = []
                for r in range(shuffles):
                    rng = np.random.default_rng([seed, r, zlib.crc32(str(key).encode())])
                    unit = 2 if len(data) > len(t) else 1
                    base.append(len(zlib.compress(rng.permutation(np.frombuffer(data, f"<u{unit}")).tobytes())) / len(data))
                c = phrases(t)
                rows.append((key, len(t), len(zlib.compress(data)) / len(data), len(lzma.compress(data)) / len(data), c, c * np.log2(max(2, len(t))) / len(t), float(np.mean(base)) if base else None))
            yield pd.DataFrame(rows, columns=["seq", "n", "zlib", "lzma", "lz78", "lz78_norm", "shuffled_zlib"])

    kind = sequences.schema[seq].dataType.simpleString()
    return sequences.select(seq, tokens).dropna().mapInPandas(run, f"seq {kind}, n bigint, zlib double, lzma double, lz78 bigint, lz78_norm double, shuffled_zlib double")


def random_baseline(sizes: DataFrame, samples: int = 10, seed: int = 42) -> DataFrame:
    """(vocabulary, n, zlib, lzma): mean ratios of uniform random sequences of
    stated sizes, seeded by size and sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v, n in zip(b["vocabulary"], b["n"]):
                draws = [np.random.default_rng([seed, int(v), int(n), s]).integers(0, v, n).astype("<u2" if v > 256 else "u1").tobytes() for s in range(samples)]
                rows.append((v, n, float(np.mean([len(zlib.compress(d)) / len(d) for d in draws])), float(np.mean([len(lzma.compress(d)) / len(d) for d in draws]))))
            yield pd.DataFrame(rows, columns=["vocabulary", "n", "zlib", "lzma"])

    return sizes.select("vocabulary", "n").mapInPandas(run, "vocabulary bigint, n bigint, zlib double, lzma double")


def ncd(pairs: DataFrame, compressor: str = "zlib") -> DataFrame:
    """(a, b, ncd) of rows (a, b, x, y) with token arrays x and y: normalized
    compression distance, clamped to [0, 1], with two bytes a token throughout."""
    squeeze = zlib.compress if compressor == "zlib" else lzma.compress

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, y in zip(b["x"], b["y"]):
                both = coded([*x, *y])
                cut = 2 * len(x)
                cx, cy, cxy = (len(squeeze(d)) for d in (both[:cut], both[cut:], both))
                out.append(min(1.0, max(0.0, (cxy - min(cx, cy)) / max(cx, cy))))
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "ncd": out})

    a, b = (pairs.schema[c].dataType.simpleString() for c in ("a", "b"))
    return pairs.select("a", "b", "x", "y").dropna().mapInPandas(run, f"a {a}, b {b}, ncd double")


def ratio_statistics(values: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return values.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"), F.percentile(c, F.lit(0.5)).alias("median"))
