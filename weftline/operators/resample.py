"""Resampling by re-aggregation: counts of sequences are taken once and
reweighted, as corpus counts are sums of sequence counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import portable_hash


def poisson_weights(seqs: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, seq, w): how often a sequence is drawn in each replicate, by a hash."""
    u = portable_hash(F.concat_ws("|", F.col("seq").cast("string"), F.col("rep").cast("string"), F.lit(str(seed)))) % 1000000
    w = F.lit(5)
    # cumulative Poisson(1) probabilities in millionths
    for k, edge in reversed(list(enumerate([367879, 735759, 919699, 981012, 996340]))):
        w = F.when(u < edge, k).otherwise(w)
    return seqs.select("seq", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")).select("rep", "seq", w.alias("w")).filter("w > 0")


def entropy_of(counts: DataFrame, by: list[str]) -> DataFrame:
    n = F.sum("c")
    return counts.filter("c > 0").groupBy(*by).agg((F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("h"), n.alias("n"))


def bootstrap_entropy(seq_counts: DataFrame, replicates: int = 20, seed: int = 42) -> DataFrame:
    """(rep, h, n): unigram entropy of each Poisson bootstrap of the sequences."""
    weights = poisson_weights(seq_counts.select("seq").distinct(), replicates, seed)
    counts = seq_counts.join(weights, "seq").groupBy("rep", "tok").agg(F.sum(F.col("c") * F.col("w")).alias("c"))
    return entropy_of(counts, ["rep"])


def leave_one_out(seq_counts: DataFrame) -> DataFrame:
    """(seq, h): entropy of the corpus without a sequence, from totals and the
    sequence's own counts; tokens it does not hold need no row: the sum over
    them is the corpus sum less that of the tokens it does hold."""
    total = seq_counts.groupBy("tok").agg(F.sum("c").alias("t"))
    corpus = total.agg(F.sum("t").alias("all_n"), F.sum(F.col("t") * F.log2("t")).alias("all_s"))
    x = seq_counts.join(total, "tok")
    left = F.col("t") - F.col("c")
    s = x.groupBy("seq").agg(F.sum("c").alias("n"), F.sum(F.col("t") * F.log2("t")).alias("old"), F.sum(F.when(left > 0, left * F.log2(left)).otherwise(0.0)).alias("new"))
    m = F.col("all_n") - F.col("n")
    return s.join(F.broadcast(corpus)).select("seq", F.when(m > 0, F.log2(m) - (F.col("all_s") - F.col("old") + F.col("new")) / m).otherwise(0.0).alias("h"))


def anova_r2(rows: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, r2, n) of one-way analyses, all factors in one pass of grouping
    sets; null below four rows or without variance."""
    v = F.col(value)
    long = rows.filter(v.isNotNull()).select(v.alias("v"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f")).select("v", "f.*").dropna()
    groups = long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("k"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    out = groups.groupBy("factor").agg(F.sum("k").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("k")).alias("b"))
    centre = F.col("s") * F.col("s") / F.col("n")
    spread = F.col("q") - centre
    return out.select("factor", F.when((F.col("n") >= 4) & (spread > 1e-12), (F.col("b") - centre) / spread).alias("r2"), "n")


def subsample(seqs: DataFrame, shares: list[float], draws: int, seed: int) -> DataFrame:
    """(share, draw, seq): in each draw the sequences first in order of a hash,
    at least two."""
    w = Window.partitionBy("draw")
    each = seqs.select("seq", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    h = portable_hash(F.concat_ws("|", F.col("seq").cast("string"), F.col("draw").cast("string"), F.lit(str(seed))))
    ranked = each.withColumn("k", F.row_number().over(w.orderBy(h, "seq"))).withColumn("n", F.count(F.lit(1)).over(w))
    wide = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return wide.filter(F.col("k") <= F.greatest(F.lit(2), F.round(F.col("n") * F.col("share")))).select("share", "draw", "seq")


def percent_change(new: Column, old: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise(100 * (new - old) / F.abs(old))
