"""Problem 1: consolidating pairwise matches into groups (seed-tree pruning)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, grows


def _scatter(x: Column) -> Column:
    """A bijection of 64-bit values (xorshift, three rounds): vertices are
    compared in an order that has nothing to do with their names, so chains of
    increasing ids shrink as fast as any other graph."""
    for _ in range(3):
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def links_of(pairs: DataFrame | None, left: str = "", right: str = "", sets: DataFrame | None = None, members: str = "") -> DataFrame:
    """(a, b) links of pair rows and of member arrays, ids trimmed, no row twice.

    A pair row with a null id links nothing and adds no id. A member array
    becomes a star around its first id, as long as the array and not its
    square; null members are skipped, a null or empty array adds nothing.
    """
    parts = []
    if pairs is not None:
        ab = pairs.select(F.trim(F.col(left).cast("string")).alias("a"), F.trim(F.col(right).cast("string")).alias("b"))
        parts.append(ab.filter("a is not null and b is not null"))
    if sets is not None:
        ids = F.filter(F.transform(F.col(members), lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull())
        stars = sets.select(F.array_distinct(ids).alias("m")).filter(F.size("m") > 0)
        parts.append(stars.select(F.col("m")[0].alias("a"), F.explode("m").alias("b")))
    return reduce(DataFrame.unionByName, parts).distinct()


def _both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    ends = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    return df.filter(F.col(a) != F.col(b)).select(F.explode(ends).alias("e")).select("e.u", "e.v").distinct()


def connected_groups(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, group_id): every id that a link names with the smallest id of its group.

    Seed-tree pruning. In each round every vertex points its neighbourhood to
    the smallest vertex in it (itself included). A vertex that nobody points
    to, not even itself, can't be the seed: it drops out into the propagation
    forest below the smallest vertex it was pointed to, and those it was
    pointed to are linked with that one instead, so the graph shrinks and stays
    connected. When no edges are left, each remaining vertex is the seed of one
    group, and the seeds flow down the forest, last round first.

    Null ids link nothing. A link of an id with itself only names it. Repeated
    and reversed links don't matter; an empty table gives no rows. Other
    columns are not looked at. All steps are equi-joins and aggregations with
    map-side combining; a hub's edges meet one row a vertex, which the skew
    join splits. Nothing but the number of edges left reaches the driver.
    """
    named = links.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null")
    names = named.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # monotonically_increasing_id is only stable once written
    vertex = cut(names.select("id", _scatter(F.monotonically_increasing_id() + 1).alias("vid")))
    va, vb = vertex.select(F.col("id").alias("a"), F.col("vid").alias("va")), vertex.select(F.col("id").alias("b"), F.col("vid").alias("vb"))
    edges = cut(_both_ways(named.filter("a <> b").join(grows(va), "a").join(grows(vb), "b"), "va", "vb"))
    forest: list[DataFrame] = []
    while not edges.isEmpty():
        least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        pointed = edges.join(grows(least), "u").select(F.col("v").alias("u"), "m").union(least)
        pointed = cut(pointed.distinct())
        parent = pointed.groupBy("u").agg(F.min("m").alias("p"), F.max((F.col("m") == F.col("u"))).alias("own"))
        forest.append(parent.filter(~F.col("own")).select(F.col("u").alias("vid"), F.col("p").alias("up")))
        edges = cut(_both_ways(pointed.join(grows(parent.select("u", "p")), "u").select("p", "m"), "p", "m"))
    pruned = reduce(DataFrame.union, [f.select("vid") for f in forest]) if forest else vertex.select("vid").limit(0)
    labels = vertex.select("vid").join(grows(pruned), "vid", "left_anti").select("vid", F.col("vid").alias("seed"))
    for level in reversed(forest):
        # the vertices still active when this level was pruned: a geometric series in all
        below = level.join(grows(labels.select(F.col("vid").alias("up"), "seed")), "up").select("vid", "seed")
        labels = cut(labels.union(below))
    named = vertex.join(grows(labels), "vid").select("id", "seed")
    smallest = named.groupBy("seed").agg(F.min("id").alias("group_id"))
    return named.join(grows(smallest), "seed").select("id", "group_id")
