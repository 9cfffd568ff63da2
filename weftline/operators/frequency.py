"""Frequencies, ranks and Zipf fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import portable_hash
from weftline.session import grows

#: Ranks that one task sums up together.
PIECE = 1 << 16


def token_counts(units: DataFrame, by: list[str] | None = None) -> DataFrame:
    """([by...,] tok, c) of exploded units; one exchange with map-side combining."""
    return units.select(*(by or []), F.explode("ops").alias("tok")).groupBy(*(by or []), "tok").agg(F.count(F.lit(1)).alias("c"))


def dense_ranks(rows: DataFrame, tok: str = "tok", c: str | None = None) -> DataFrame:
    """Rows with ``rank`` from 1, by falling ``c`` if given, then by ``tok``, and
    no task that sees all: rows are ranked within groups of one count and the
    first two letters, and the groups' sizes give the ranks before them."""
    group = [*([c] if c else []), "letters"]
    falling = [*([F.desc(c)] if c else []), "letters"]
    keyed = rows.withColumn("letters", F.substring(tok, 1, 2))
    sizes = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    # a row for each count and two letters
    before = F.sum("size").over(Window.orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    own = F.row_number().over(Window.partitionBy(*group).orderBy(tok))
    placed = keyed.withColumn("own", own).join(grows(sizes.select(*group, before.alias("before"))), group)
    return placed.select(*rows.columns, (F.col("own") + F.col("before")).cast("bigint").alias("rank"))


def rank_frequency(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts with rank (ties by token) and relative frequency. Without ``by`` no
    task sees all distinct tokens; with it one sees those of a group."""
    if by:
        part = Window.partitionBy(*by)
        rank = F.row_number().over(part.orderBy(F.desc("c"), "tok"))
        return counts.withColumn("rank", rank.cast("bigint")).withColumn("rel", F.col("c") / F.sum("c").over(part))
    total = counts.agg(F.sum("c").alias("_total"))  # one row
    return dense_ranks(counts, "tok", "c").join(F.broadcast(total)).select(*counts.columns, "rank", (F.col("c") / F.col("_total")).alias("rel"))


def zipf_ols(ranks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """alpha, c, r2 of the line through (ln rank, ln count); zeros below two ranks."""
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("c").cast("double"))
    fits = ranks.select(*(by or []), x.alias("x"), y.alias("y")).groupBy(*(by or [])).agg(
        F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"), F.regr_r2("y", "x").alias("r"), F.count(F.lit(1)).alias("v")
    )
    zero = lambda c: F.when(F.col("v") >= 2, c).otherwise(0.0)
    return fits.select(*(by or []), zero(-F.col("s")).alias("alpha"), zero(F.exp("i")).alias("scale"), zero(F.col("r")).alias("r2"), "v")


def zipf_bootstrap(ranks: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Percentile interval of the OLS exponent: every (rank, count) point is
    drawn a Poisson(1) number of times in each replicate, decided by a hash."""
    u = portable_hash(F.concat_ws("|", "tok", F.col("rep").cast("string"), F.lit(str(seed)))) / F.lit(float(1 << 60))
    edges = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    weight = F.lit(6)
    for k, e in reversed(list(enumerate(edges))):
        weight = F.when(u < e, F.lit(k)).otherwise(weight)
    points = ranks.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    points = points.select("rep", weight.alias("w"), F.log(F.col("rank").cast("double")).alias("x"), F.log(F.col("c").cast("double")).alias("y"))
    sums = points.groupBy("rep").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * e).alias(k) for k, e in {"sx": F.col("x"), "sy": F.col("y"), "sxy": F.col("x") * F.col("y"), "sxx": F.col("x") * F.col("x")}.items()])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    alphas = sums.filter("n >= 2").select((-slope).alias("a"))
    return alphas.agg(F.percentile("a", F.lit(0.025)).alias("low"), F.percentile("a", F.lit(0.5)).alias("mid"), F.percentile("a", F.lit(0.975)).alias("high"))


#: Terms of a sum over ranks that are added one by one; beyond, an integral with its end corrections is as exact.
HEAD = 4096
_NODES, _WEIGHTS = (x.tolist() for x in np.polynomial.legendre.leggauss(64))


def _power_sums(alpha: Column, v: Column) -> list[Column]:
    """Sums of r^-alpha (ln r)^k for k = 0, 1, 2 and r from 1 to v, with work that
    does not grow with v: the first HEAD terms, then Euler-Maclaurin, its
    integral over ln r by Gauss-Legendre quadrature."""
    f = lambda r, k: F.pow(r.cast("double"), -alpha) * F.pow(F.log(r.cast("double")), F.lit(k))
    # derivative of r^-alpha (ln r)^k
    slope = lambda r, k: F.pow(r, -alpha - 1) * (k * F.pow(F.log(r), F.lit(max(k - 1, 0))) - alpha * F.pow(F.log(r), F.lit(k)))
    first = F.least(v, F.lit(HEAD).cast("bigint"))
    a, b = F.log(F.lit(float(HEAD))), F.log(v.cast("double"))
    nodes = F.arrays_zip(F.array(*map(F.lit, _NODES)).alias("x"), F.array(*map(F.lit, _WEIGHTS)).alias("w"))
    at = lambda x: (b - a) / 2 * x + (a + b) / 2

    def total(k: int) -> Column:
        head = F.aggregate(F.sequence(F.lit(1).cast("bigint"), first), F.lit(0.0), lambda s, r: s + f(r, k))
        integral = F.aggregate(nodes, F.lit(0.0), lambda s, p: s + p["w"] * F.exp((1 - alpha) * at(p["x"])) * F.pow(at(p["x"]), F.lit(k))) * (b - a) / 2
        ends = (f(v, k) - f(F.lit(HEAD), k)) / 2 + (slope(v.cast("double"), k) - slope(F.lit(float(HEAD)), k)) / 12
        return head + F.when(v > HEAD, integral + ends).otherwise(0.0)

    return [total(k) for k in range(3)]


def _moment(alpha: Column, v: Column) -> Column:
    """E and Var of ln r under r^-alpha on 1..v, as struct(e, d)."""
    z, x, y = _power_sums(alpha, v)
    return F.struct((x / z).alias("e"), (y / z - (x / z) * (x / z)).alias("d"))


def zipf_mle(ranks: DataFrame, steps: int = 12) -> DataFrame:
    """alpha of the truncated discrete Zipf law by Newton steps on one row of
    sums, kept within (0.01, 15): the likelihood needs only sum(c ln r), n and v."""
    row = ranks.agg((F.sum(F.col("c") * F.log(F.col("rank").cast("double"))) / F.sum("c")).alias("target"), F.max("rank").alias("v"), F.sum("c").alias("n"))
    row = row.withColumn("alpha", F.lit(1.0))
    for _ in range(steps):
        row = row.withColumn("m", _moment(F.col("alpha"), F.col("v")))
        row = row.withColumn("alpha", F.least(F.greatest(F.col("alpha") + (F.col("m.e") - F.col("target")) / F.col("m.d"), F.lit(0.01)), F.lit(15.0))).drop("m")
    return row.filter("v >= 2").select("alpha", "n", "v")


def zipf_ks(ranks: DataFrame, fit: DataFrame) -> DataFrame:
    """Greatest distance between the empirical and the fitted distribution of ranks."""
    both = ranks.join(F.broadcast(fit.select("alpha")))  # one row
    rows = both.select("rank", "c", F.pow(F.col("rank").cast("double"), -F.col("alpha")).alias("p"), "alpha", F.floor(F.col("rank") / PIECE).alias("piece"))
    sums = rows.groupBy("piece").agg(F.sum("c").alias("sc"), F.sum("p").alias("sp"))
    upto = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)  # a row for each PIECE ranks
    sums = sums.select("piece", (F.sum("sc").over(upto) - F.col("sc")).alias("bc"), (F.sum("sp").over(upto) - F.col("sp")).alias("bp"))
    w = Window.partitionBy("piece").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cum = rows.withColumn("cc", F.sum("c").over(w)).withColumn("cp", F.sum("p").over(w)).join(grows(sums), "piece")
    cum = cum.select("alpha", (F.col("cc") + F.col("bc")).alias("cc"), (F.col("cp") + F.col("bp")).alias("cp"))
    ends = cum.agg(F.max("cc").alias("n"), F.max("cp").alias("z"))
    d = F.abs(F.col("cc") / F.col("n") - F.col("cp") / F.col("z"))
    return cum.join(F.broadcast(ends)).groupBy("alpha").agg(F.max(d).alias("ks"))


def zipf_against_lognormal(ranks: DataFrame, fit: DataFrame) -> DataFrame:
    """Log-likelihoods of the Zipf law over occurrences and of a log-normal law
    over frequencies, and their difference. They live on different sample
    spaces, so the difference only repeats what is usually reported."""
    stats = ranks.agg(
        F.avg(F.log("c")).alias("mu"), F.stddev_pop(F.log("c")).alias("sd"), F.sum(F.col("c") * F.log("rank")).alias("s"), F.sum("c").alias("n"),
        F.count(F.lit(1)).alias("v"), F.sum(F.log("c")).alias("sl"), F.sum(F.log("c") * F.log("c")).alias("sq"),
    )
    both = stats.join(F.broadcast(fit.select("alpha")))
    both = both.withColumn("z", _power_sums(F.col("alpha"), F.col("v"))[0])
    zipf = -F.col("alpha") * F.col("s") - F.col("n") * F.log("z")
    normal = -F.col("sl") - F.col("v") * F.log(F.col("sd") * F.sqrt(F.lit(6.283185307179586))) - (F.col("sq") - 2 * F.col("mu") * F.col("sl") + F.col("v") * F.col("mu") * F.col("mu")) / (2 * F.col("sd") * F.col("sd"))
    return both.select(zipf.alias("zipf"), normal.alias("lognormal"), (zipf - normal).alias("ratio"))


def vocabulary(counts: DataFrame) -> DataFrame:
    """(tok, id): dense ids from 0 in code-point order of the distinct tokens."""
    return dense_ranks(counts.select("tok")).select("tok", (F.col("rank") - 1).alias("id"))


def encode(units: DataFrame, vocab: DataFrame) -> DataFrame:
    """Units with ``ids``: the vocabulary id of every token, unknown ones get
    the size of the vocabulary. An equi-join on distinct tokens of units."""
    size = vocab.agg(F.count(F.lit(1)).alias("_v"))
    tokens = units.select("seq", "unit", "at", F.posexplode("ops").alias("i", "tok"))
    ids = tokens.join(vocab, "tok", "left").join(F.broadcast(size)).select("seq", "unit", "at", F.struct("i", F.coalesce("id", "_v").alias("id")).alias("x"))
    packed = ids.groupBy("seq", "unit", "at").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a unit has a bounded size
    return packed.select("seq", "unit", "at", F.transform("x", lambda s: s["id"]).alias("ids"))
