"""Pairwise similarity through shared features, pair groups and rank tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def feature_counts(grams: DataFrame, most: int) -> DataFrame:
    """(seq, gram, c) restricted to the ``most`` commonest features overall."""
    counts = grams.groupBy("seq", "gram").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("gram").agg(F.sum("c").alias("t")).orderBy(F.desc("t"), "gram").limit(most).select("gram")
    return counts.join(top, "gram", "left_semi").select("seq", "gram", "c")


def cosine_pairs(counts: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine) of sequences that share a feature, a < b: an equi-join on
    features, so pairs without one are never formed. With ``queries`` (seq) the
    pairs of those with all others."""
    norms = counts.groupBy("seq").agg(F.sqrt(F.sum((F.col("c") * F.col("c")).cast("double"))).alias("norm"))
    unit = counts.join(norms, "seq").select("seq", "gram", (F.col("c") / F.col("norm")).alias("w"))
    left = unit if queries is None else unit.join(queries, "seq", "left_semi")
    x = left.select(F.col("seq").alias("a"), "gram", F.col("w").alias("wa"))
    y = unit.select(F.col("seq").alias("b"), "gram", F.col("w").alias("wb"))
    cond = F.col("a") < F.col("b") if queries is None else F.col("a") != F.col("b")
    return x.join(y, "gram").filter(cond).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))


def tfidf(counts: DataFrame) -> DataFrame:
    """(seq, gram, w) of counts (seq, gram, c): sublinear tf, smooth idf, L2 norm."""
    n = counts.select("seq").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = counts.join(df, "gram").join(F.broadcast(n)).select("seq", "gram", ((1 + F.log("c")) * idf).alias("w"))
    norm = raw.groupBy("seq").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "seq").select("seq", "gram", (F.col("w") / F.col("norm")).alias("w"))


def rank_sum(values: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Mann-Whitney U of the group ``first`` against ``second`` with mid-ranks,
    r = 1 - 2U / (n1 n2), and the one-sided normal p-value (less) with ties and
    continuity corrected. Ranks come from counts of distinct values."""
    rows = values.filter(F.col(group).isin(first, second)).select(F.col(group).alias("g"), F.col(value).alias("v")).dropna()
    counts = rows.groupBy("v").agg(F.sum((F.col("g") == first).cast("long")).alias("c1"), F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # over distinct values
    ranked = counts.withColumn("rank", F.sum("c").over(w) - (F.col("c") - 1) / 2)
    s = ranked.agg(F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum("c1").alias("n1"), F.sum("c").alias("n"), F.sum(F.pow(F.col("c").cast("double"), F.lit(3.0)) - F.col("c")).alias("ties"))
    s = s.withColumn("n2", F.col("n") - F.col("n1")).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((F.col("n") + 1) - F.coalesce(F.try_divide(F.col("ties"), F.col("n") * (F.col("n") - 1)), F.lit(0.0))))
    z = F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2 + 0.5, sd)
    # error function by a polynomial good to 1.5e-7
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    p = F.when(z < 0, (1 - erf) / 2).otherwise((1 + erf) / 2)
    some = (F.col("n1") > 0) & (F.col("n2") > 0)  # with an empty group nothing is defined
    r = 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))
    return s.select("n1", "n2", F.when(some, F.col("u")).alias("u"), F.when(some, r).alias("r"), F.when(some & (sd > 0), p).alias("p"))


def permutation_p(pairs: DataFrame, labels: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(observed, p): is the mean of pairs with equal labels smaller than that of
    others? Each round orders all labelled items by a hash and hands the labels
    out again in that order; rounds are rows, so they run side by side."""
    from weftline.functions.tokens import portable_hash

    named = labels.select(F.col("seq"), F.col("label")).dropna()
    rounds_of = named.select("seq", "label", F.explode(F.sequence(F.lit(0), F.lit(rounds))).alias("round"))
    h = portable_hash(F.concat_ws("|", F.col("seq").cast("string"), F.col("round").cast("string"), F.lit(str(seed))))
    place = F.row_number().over(Window.partitionBy("round").orderBy(F.when(F.col("round") == 0, F.lit(0)).otherwise(h), "seq"))
    own = F.row_number().over(Window.partitionBy("round").orderBy("seq"))
    shuffled = rounds_of.select("round", "seq", place.alias("k")).join(rounds_of.select("round", "label", own.alias("k")), ["round", "k"]).select("round", "seq", "label")
    a = shuffled.select("round", F.col("seq").alias("a"), F.col("label").alias("la"))
    b = shuffled.select("round", F.col("seq").alias("b"), F.col("label").alias("lb"))
    v = pairs.join(a, "a").join(b, ["round", "b"])
    gap = F.avg(F.when(F.col("la") == F.col("lb"), F.col("v"))) - F.avg(F.when(F.col("la") != F.col("lb"), F.col("v")))
    each = v.groupBy("round").agg(gap.alias("gap"))
    seen = each.filter("round = 0").select(F.col("gap").alias("observed"))
    return each.filter("round > 0").join(F.broadcast(seen)).groupBy("observed").agg(((F.sum((F.col("gap") <= F.col("observed")).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
