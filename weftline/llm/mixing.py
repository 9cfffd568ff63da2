"""Problem 9: mixing sources to target weights (Pareto order sampling)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Steps of the order variable at which the cut is searched; one step is settled row by row.
STEPS = 4096
#: Fixed value: the pattern by which the public vocabulary splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, key: str, text: str, carried: list[str], tokenizer: str) -> DataFrame:
    """(key, carried..., tokens): sizes of texts in tokens of the public
    byte-level BPE whose ranks are in the file ``tokenizer``; a null text has
    none. The driver reads the file, a vocabulary of fixed size, and hands it on."""
    with open(tokenizer, "rb") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"])

    rows = documents.select(key, *carried, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", tokens bigint"
    return rows.mapInArrow(run, schema)


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that only key and seed decide."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(sizes: DataFrame, targets: DataFrame, key: str, source: str, tokens: str = "tokens", weight: str | None = None, total: int | None = None, seed: int = 11) -> DataFrame:
    """(key, source, tokens, copies, part): the documents of a mixture in which
    each source has ``target_share`` of ``total`` tokens, no document more than
    ``max_repeats`` times. ``total`` defaults to all tokens of the sources named.

    A source must repeat its documents share * total / tokens times on average;
    a document's expected copies follow its ``weight`` (equal without one) and
    are capped. The whole copies are allocated for certain. What is left of a
    document is its inclusion odds: documents are ranked by random odds over
    inclusion odds, and the first in that order are taken until their tokens
    are what the source still lacks (the one at the boundary if that comes
    nearer). The order is cut by counting tokens at a fixed number of steps of
    the order variable; only the documents of one step are ranked among each
    other. Chance depends on key and seed alone, so lost tasks repeat it.

    Sources without a target, or targets without documents, give no rows; null
    sources, keys and empty texts aren't used. Rows with the same key are one
    document. ``part`` is the random copy, 0 or 1.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    docs = sizes.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens"), w.alias("w"))
    docs = docs.filter("key is not null and source is not null and tokens > 0 and w > 0").dropDuplicates(["key"])
    goals = targets.select(F.trim(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("most"))
    goals = goals.dropna().dropDuplicates(["source"])
    docs = cut(docs.join(goals.select("source"), "source", "left_semi"))
    sums = docs.groupBy("source").agg(F.sum("tokens").alias("have"), F.sum(F.col("tokens") * F.col("w")).alias("weighted"))
    if total is None:
        total = sums.agg(F.sum("have")).first()[0] or 0
    # one row for each source of the targets, a short table
    plan = sums.join(goals, "source").withColumn("want", F.least(F.col("share") * F.lit(float(total)), F.col("have") * F.col("most").cast("double")))
    plan = cut(plan.withColumn("rate", F.col("want") / F.col("weighted")))
    expected = F.least(F.col("rate") * F.col("w"), F.col("most").cast("double"))
    whole = F.floor(expected + 1e-9)
    rest = F.greatest(expected - whole, F.lit(0.0))
    u = _uniform(F.col("key"), seed)
    odds = (u / (1 - u)) / (rest / (1 - rest))
    rows = docs.join(F.broadcast(plan.select("source", "want", "rate", "most")), "source")
    rows = rows.select("key", "source", "tokens", "want", whole.cast("int").alias("whole"), F.when(rest > 1e-9, odds / (1 + odds)).alias("order"))
    rows = cut(rows.withColumn("step", F.least(F.floor(F.col("order") * STEPS), F.lit(STEPS - 1)).cast("int")))
    # at most STEPS rows a source from here on
    steps = rows.groupBy("source", "step").agg(F.sum(F.when(F.col("step").isNotNull(), F.col("tokens"))).alias("t"), F.sum(F.col("whole") * F.col("tokens")).alias("fixed"), F.max("want").alias("want"))
    by = Window.partitionBy("source")
    steps = steps.withColumn("lack", F.max("want").over(by) - F.sum("fixed").over(by)).filter("step is not null")
    upto = by.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    edge = steps.withColumn("upto", F.sum("t").over(upto)).filter(F.col("upto") >= F.col("lack"))
    edge = edge.groupBy("source").agg(F.min("step").alias("edge"), F.min_by(F.col("lack") - (F.col("upto") - F.col("t")), "step").alias("open"))
    rows = rows.join(F.broadcast(edge), "source", "left")
    inner = rows.filter(F.col("step") == F.col("edge"))
    ranked = inner.withColumn("upto", F.sum("tokens").over(by.orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0)))
    # the document at the boundary is taken if that comes nearer
    inner = ranked.withColumn("part", (F.col("upto") - F.col("tokens") / 2 <= F.col("open")).cast("int"))
    outer = rows.filter(~F.coalesce(F.col("step") == F.col("edge"), F.lit(False)))
    outer = outer.withColumn("part", F.when(F.col("step").isNull(), 0).when(F.col("edge").isNull() | (F.col("step") < F.col("edge")), 1).otherwise(0))
    cols = ["key", "source", "tokens", (F.col("whole") + F.col("part")).cast("int").alias("copies"), "part"]
    return outer.select(*cols).unionByName(inner.select(*cols)).filter("copies > 0").withColumnRenamed("key", key)


def mixture_shares(mixture: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share, most_copies) of
    every source of the targets; one without documents has a share of 0."""
    used = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    goals = targets.select(F.trim(F.col("source")).alias("source"), "target_share").dropna().dropDuplicates(["source"])
    rows = goals.join(used, "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
    all_tokens = used.agg(F.sum("tokens").alias("_all"))  # one row
    share = F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0))
    return rows.join(F.broadcast(all_tokens)).select("source", "target_share", "documents", "tokens", share.alias("actual_share"), "most_copies")


def default_tokenizer(spark: SparkSession | None = None) -> str:
    """The file of the public 50k byte-level BPE, in the folder that
    ``spark.weftline.tokenizers`` names."""
    folder = spark.conf.get("spark.weftline.tokenizers", "/opt/tokenizers") if spark else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.tiktoken")
