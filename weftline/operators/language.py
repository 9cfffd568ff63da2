"""n-gram language models with add-k smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.tokens import ngrams

BOS = "<BOS>"


def split(sequences: DataFrame, share: float = 0.8) -> DataFrame:
    """(seq, part, tokens): the first ``share`` of each sequence trains, the rest tests."""
    cut = F.floor(F.size("tokens") * F.lit(share)).cast("int")
    both = F.array(F.struct(F.lit("train").alias("part"), F.slice("tokens", F.lit(1), cut).alias("t")), F.struct(F.lit("test").alias("part"), F.slice("tokens", cut + 1, F.size("tokens")).alias("t")))
    return sequences.filter("size(tokens) > 0").select("seq", F.explode(both).alias("x")).select("seq", "x.part", F.col("x.t").alias("tokens"))


def padded_ngrams(sequences: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep..., n, context, gram): n-grams of sequences padded with n - 1 markers."""

    def of(n: int):
        padded = F.concat(F.array_repeat(F.lit(BOS), n - 1), "tokens") if n > 1 else F.col("tokens")
        whole = ngrams(padded, n)
        # no token holds a space; the context is what comes before the last one
        context = lambda g: F.substring_index(g, " ", n - 1) if n > 1 else F.lit("")
        return F.transform(whole, lambda g: F.struct(F.lit(n).cast("bigint").alias("n"), context(g).alias("context"), g.alias("gram")))

    rows = sequences.select(*keep, F.explode(F.concat(*[of(n) for n in lengths])).alias("g"))
    return rows.select(*keep, "g.n", "g.context", "g.gram")


def train(sequences: DataFrame, lengths: list[int]) -> DataFrame:
    """(n, gram, context, c) of the training sequences."""
    return padded_ngrams(sequences, lengths, []).groupBy("n", "context", "gram").agg(F.count(F.lit(1)).alias("c"))


def cross_entropy(model: DataFrame, test: DataFrame, lengths: list[int], by: list[str], k: float = 1.0) -> DataFrame:
    """(n, by..., tokens, cross_entropy, perplexity) of test sequences. n-grams
    are counted before they meet the model, so a common one is looked up once."""
    v = model.filter("n = 1").agg(F.count(F.lit(1)).alias("v"))
    contexts = model.groupBy("n", "context").agg(F.sum("c").alias("cc"))
    asked = padded_ngrams(test, lengths, by).groupBy(*by, "n", "context", "gram").agg(F.count(F.lit(1)).alias("m"))
    rows = asked.join(model, ["n", "context", "gram"], "left").join(contexts, ["n", "context"], "left").join(F.broadcast(v))
    p = (F.coalesce("c", F.lit(0)) + k) / (F.coalesce("cc", F.lit(0)) + F.lit(k) * F.col("v"))
    out = rows.groupBy(*by, "n").agg(F.sum("m").alias("tokens"), (-F.sum(F.col("m") * F.log2(p)) / F.sum("m")).alias("cross_entropy"))
    return out.withColumn("perplexity", F.pow(F.lit(2.0), "cross_entropy"))
