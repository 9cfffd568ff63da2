"""Clusterings of small item sets and the measures that compare them.

Linkage works on the distances of a stated, small set of items: it is not a
distributed algorithm, so its input is checked. Everything that grows with the
data (components, silhouettes, contingency tables) stays in DataFrames.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, grows


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(id, component): the smallest id reachable over the links. Alternates
    large stars (larger neighbours are linked to the neighbourhood's minimum)
    and small stars (smaller ones and the vertex itself are) until the edges
    are stars around the smallest ids; the number of rounds grows with the
    logarithm of the vertices. Null ids link nothing; an id linked with itself
    only is its own component."""
    rows = cut(links.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna())
    edges, seen = rows.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(grows(least), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(grows(low), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    alone = rows.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(grows(edges.select(F.col("a").alias("id"))), "id", "left_anti")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(alone.select("id", F.col("id").alias("component")))


def linkage_labels(distances: DataFrame, at: float, method: str = "average", most: int = 2000) -> DataFrame:
    """(id, cluster) of items with distance rows (a, b, d), merged while the
    average (or complete) linkage is at most ``at``. Refuses more than ``most``
    items: their matrix lives in one task."""
    items = distances.select(F.col("a").alias("x")).union(distances.select("b")).distinct().count()
    if items > most:
        raise ValueError(f"{items} items; linkage takes at most {most}")
    kind = distances.schema["a"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {x: i for i, x in enumerate(ids)}
        d = np.full((len(ids), len(ids)), 1.0)
        i, j = pdf["a"].map(place).to_numpy(), pdf["b"].map(place).to_numpy()
        d[i, j] = d[j, i] = pdf["d"].to_numpy()
        np.fill_diagonal(d, np.inf)
        size, owner = np.ones(len(ids)), np.arange(len(ids))
        while len(ids) > 1:
            i, j = divmod(int(d.argmin()), len(ids))
            if not d[i, j] <= at:
                break
            i, j = min(i, j), max(i, j)
            row = np.maximum(d[i], d[j]) if method == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            row[[i, j]] = np.inf
            d[i], d[:, i] = row, row
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            owner[owner == j] = i
        return pd.DataFrame({"id": ids, "cluster": [ids[o] for o in owner]})

    return distances.select("a", "b", "d").groupBy(F.lit(0).alias("_one")).applyInPandas(run, f"id {kind}, cluster {kind}")


def silhouette(distances: DataFrame, labels: DataFrame) -> DataFrame:
    """(silhouette, items): mean over items of (b - a) / max(a, b) from pair rows
    (a, b, d) in both directions; singletons count 0."""
    both = distances.select("a", "b", "d").union(distances.select(F.col("b"), F.col("a"), F.col("d")))
    l1, l2 = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    means = both.join(l1, "a").join(l2, "b").groupBy("a", "la", "lb").agg(F.avg("d").alias("m"))
    each = means.groupBy("a").agg(F.max(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("x"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("y"))
    s = F.coalesce(F.try_divide(F.col("y") - F.col("x"), F.greatest("x", "y")), F.lit(0.0))
    return each.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("items"))


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings and the purity of ``a`` in ``b``."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    rows = cells.groupBy("a").agg(F.sum("c").alias("c"), F.max("c").alias("m"))
    cols = cells.groupBy("b").agg(F.sum("c").alias("c"))
    one = cells.agg(F.sum(pairs("c")).alias("s"), F.sum("c").alias("n"))
    two = rows.agg(F.sum(pairs("c")).alias("sa"), F.avg(F.col("m") / F.col("c")).alias("purity"))
    three = cols.agg(F.sum(pairs("c")).alias("sb"))
    x = one.join(F.broadcast(two)).join(F.broadcast(three))
    expected = F.try_divide(F.col("sa") * F.col("sb"), pairs("n"))
    return x.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"), "purity")


def pca_scores(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """(id, scores) of the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v")).dropna()
    mean = vectors.select(F.posexplode(F.col(vector).cast("array<double>"))).groupBy("pos").agg(F.avg("col").alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centre"))  # one row of the vectors' length
    loads = PCA(k=k, inputCol="v", outputCol="s").fit(rows)
    shifted = rows.join(F.broadcast(centre)).select("id", array_to_vector(F.zip_with(vector_to_array("v"), "centre", lambda a, b: a - b)).alias("v"))
    return loads.transform(shifted).select("id", vector_to_array("s").alias("scores"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
