"""Classes of identical sequences: one representative goes through a join, the
copies come back through membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import grows


def copy_classes(sequences: DataFrame, key: str, seq: str, least: int = 1) -> DataFrame:
    """(id, rep): the smallest id with the same sequence, for sequences of at
    least ``least`` tokens. Rows with a null key or sequence are left out. Keys
    of the exchange are 16-byte digests, and the smallest id of each is found
    with map-side combining, so a third of all rows being copies costs nothing."""
    rows = sequences.select(F.col(key).alias("id"), F.md5(F.array_join(seq, "\x1f", "\x1e")).alias("h"), F.size(seq).alias("n"))
    rows = rows.filter((F.col("n") >= least) & F.col("id").isNotNull())
    reps = rows.groupBy("h").agg(F.min("id").alias("rep"))
    return rows.join(grows(reps), "h").select("id", "rep")


def representatives(sequences: DataFrame, key: str, seq: str, classes: DataFrame) -> DataFrame:
    """(rep, seq): the sequences of the representatives."""
    reps = classes.filter("id = rep").select("rep")
    return sequences.select(F.col(key).alias("rep"), F.col(seq).alias("seq")).join(grows(reps), "rep", "left_semi")


def expand(pairs: DataFrame, classes: DataFrame, carried: list[str]) -> DataFrame:
    """(id1, id2, ...) with id1 < id2 for pairs (rep1, rep2, ...) of representatives."""
    one = classes.select(F.col("rep").alias("rep1"), F.col("id").alias("x"))
    two = classes.select(F.col("rep").alias("rep2"), F.col("id").alias("y"))
    both = pairs.join(grows(one), "rep1").join(grows(two), "rep2")
    return both.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), *carried)
