"""Entropy rates, mutual information, sliding windows, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entropy(counts: DataFrame, by: list[str], c: str = "c") -> DataFrame:
    """(by..., h, distinct, total): Shannon entropy in bits of each group of counts."""
    n = F.sum(c)
    h = F.log2(n) - F.sum(F.col(c) * F.log2(c)) / n
    return counts.groupBy(*by).agg(h.alias("h"), F.count(F.lit(1)).alias("distinct"), n.alias("total"))


def entropy_rates(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, h, rate, conditional): H_n, H_n / n and H_n - H_(n-1)."""
    by = by or []
    h = entropy(counts, [*by, "n"])
    w = Window.partitionBy(*by).orderBy("n") if by else Window.partitionBy(F.lit(0)).orderBy("n")  # a row for each n
    step = F.col("h") - F.coalesce(F.lag("h").over(w), F.lit(0.0))
    return h.select(*by, "n", "h", (F.col("h") / F.col("n")).alias("rate"), step.alias("conditional"), "distinct", "total")


def mutual_information(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., mi) of (x, y) pairs with the marginals of those same pairs."""
    joint = pairs.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    xs = joint.groupBy(*by, "x").agg(F.sum("c").alias("cx"))
    ys = joint.groupBy(*by, "y").agg(F.sum("c").alias("cy"))
    part = lambda df, c: df.groupBy(*by).agg(F.sum(F.col(c) * F.log2(c)).alias(f"s_{c}"))
    total = joint.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s_c"))
    rows = total.join(part(xs, "cx"), by).join(part(ys, "cy"), by)
    mi = F.log2("n") + (F.col("s_c") - F.col("s_cx") - F.col("s_cy")) / F.col("n")
    return rows.select(*by, mi.alias("mi"), "n")


def window_entropy(tokens: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """(seq, start, centre, h) of all windows of ``width`` tokens that start at
    multiples of ``step`` (a quarter of the width) and end inside the sequence."""
    step = step or max(1, width // 4)
    length = tokens.groupBy("seq").agg((F.max("gpos") + 1).alias("len"))
    last = F.floor(F.col("gpos") / step)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col("gpos") - width + 1) / F.lit(step)))
    held = tokens.select("seq", "tok", F.explode(F.when(first <= last, F.sequence(first, last))).alias("k"))
    counts = held.groupBy("seq", "k", "tok").agg(F.count(F.lit(1)).alias("c"))
    h = entropy(counts, ["seq", "k"]).join(length, "seq").filter(F.col("k") * step + width <= F.col("len"))
    return h.select("seq", (F.col("k") * step).alias("start"), (F.col("k") * step + width // 2).alias("centre"), "h")


def space_coverage(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(n, unique, total, possible, coverage, redundancy) of n-gram counts."""
    v = vocab.agg(F.count(F.lit(1)).cast("double").alias("v"))
    rows = counts.groupBy("n").agg(F.count(F.lit(1)).alias("unique"), F.sum("c").alias("total")).join(F.broadcast(v))
    possible = F.pow("v", F.col("n").cast("double"))
    return rows.select("n", "unique", "total", possible.alias("possible"), (F.col("unique") / possible).alias("coverage"), ((F.col("total") - F.col("unique")) / F.greatest("total", F.lit(1))).alias("redundancy"))


def participation_ratio(vectors: DataFrame, vector: str) -> DataFrame:
    """(trace^2 / |C|_F^2) of the covariance of vectors: the effective number of
    dimensions, without an eigendecomposition. The covariance has as many
    entries as the square of the dimension, however many vectors there are."""
    long = vectors.select(F.monotonically_increasing_id().alias("_r"), F.col(vector).alias("_v"))
    d = F.size("_v")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.transform(F.sequence(F.lit(0), d - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), (F.get("_v", i).cast("double") * F.get("_v", j).cast("double")).alias("p"), F.get("_v", i).cast("double").alias("a"), F.get("_v", j).cast("double").alias("b")))))
    cov = long.select(F.explode(pairs).alias("x")).groupBy("x.i", "x.j").agg((F.avg("x.p") - F.avg("x.a") * F.avg("x.b")).alias("c"))
    return cov.agg((F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)), F.lit(2.0)) / F.sum(F.col("c") * F.col("c"))).alias("participation_ratio"))


def components_for(vectors: DataFrame, vector: str, share: float = 0.95) -> DataFrame:
    """Principal components needed for ``share`` of the variance. The Gram sums
    are distributed; the eigenvalues of one d x d matrix are found in one task."""
    import numpy as np
    import pandas as pd

    def partial(batches):
        n, s, g = 0, None, None
        for b in batches:
            x = np.array(b["v"].tolist(), float)
            if not len(x):
                continue
            n, s, g = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    def merge(parts):
        n, s, g = parts["n"].sum(), np.sum(parts["s"].tolist(), 0), np.sum(parts["g"].tolist(), 0)
        d = len(s)
        values = np.clip(np.sort(np.linalg.eigvalsh(np.reshape(g, (d, d)) / n - np.outer(s / n, s / n)))[::-1], 0, None)
        k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12) + 1)
        return pd.DataFrame({"components": [min(k, d)], "dimensions": [d]})

    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInPandas(partial, "n bigint, s array<double>, g array<double>")
    return rows.groupBy(F.lit(0).alias("_k")).applyInPandas(merge, "components int, dimensions int")  # one row a partition


def nearest_distances(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """(id, ranked): the ``k`` smallest non-zero distances of every row of a
    stated ``queries`` table to all rows. Blocks of queries are broadcast, each
    task keeps its k best for each query, and one exchange merges them."""
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    asked = queries.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    parts = max(1, -(-asked.count() // block))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    out = None
    for p in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).toPandas()
        if not len(mine):
            continue
        shared = spark.sparkContext.broadcast((mine["id"].to_numpy(), np.array(mine["v"].tolist(), float)))

        def near(batches, shared=shared):
            ids, q = shared.value
            best = np.full((len(ids), k), np.inf)
            for b in batches:
                x = np.array(b["v"].tolist(), float)
                if not len(x):
                    continue
                d = np.sqrt(np.clip((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0, None))
                d[(ids[:, None] == b["id"].to_numpy()[None]) | (d < 1e-9)] = np.inf
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
            yield pd.DataFrame({"id": np.repeat(ids, k), "d": best.ravel()})

        hits = rows.mapInPandas(near, "id bigint, d double").filter(F.col("d") < F.lit(float("inf")))
        out = hits if out is None else out.union(hits)
    w = Window.partitionBy("id").orderBy("d")
    return out.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)


def intrinsic_dimension(near: DataFrame, k: int = 5) -> DataFrame:
    """Maximum-likelihood intrinsic dimension from neighbour distances: mean and
    population deviation of (m - 1) / sum ln(r_m / r_j)."""
    each = near.groupBy("id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("m"), F.sum(F.log("d")).alias("s"))
    gap = F.col("m") * F.log("far") - F.col("s")
    local = each.filter("m >= 2").select(F.when(gap > 0, (F.col("m") - 1) / gap).alias("x")).filter("x is not null")
    return local.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.count(F.lit(1)).alias("points"))
