"""Views of stored tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.tokens import opcode_array, words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row for each key, the greatest by ``by``: redelivered rows collapse.
    Rows with a null key are left out. One hash exchange on the keys, with
    map-side combining."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    kept = df.filter(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
    best = kept.groupBy(*keys).agg(F.max_by(row, F.struct(*by)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def opcode_sequences(functions: DataFrame, key: str = "function_id", entries: str = "instructions", order: str | None = "loaded_at") -> DataFrame:
    """(function_id, ops): the opcode sequence of every distinct function.

    Null entries are left out; a null array is an empty sequence; rows with a
    null key are dropped. Of rows that share a key the latest by ``order``
    counts, then the greatest sequence. Other columns are not carried, so
    their names cannot clash.
    """
    ops = opcode_array(F.col(entries))
    when = F.col(order).cast("timestamp") if order else F.lit(None).cast("timestamp")
    rows = functions.select(F.col(key).alias("function_id"), when.alias("_at"), ops.alias("ops")).filter(F.col("function_id").isNotNull())
    return rows.groupBy("function_id").agg(F.max_by("ops", F.struct(F.col("_at"), F.col("ops"))).alias("ops"))


def document_sequences(documents: DataFrame, key: str = "doc_id", text: str = "text", category: str | None = "lang") -> DataFrame:
    """(seq_id, category, tokens) of documents: lower-cased words in order."""
    kind = F.col(category) if category else F.lit(None).cast("string")
    return documents.select(F.col(key).alias("seq_id"), kind.alias("category"), words(F.col(text)).alias("tokens"))


def event_sequences(events: DataFrame) -> DataFrame:
    """(seq_id, category, tokens) of users: event types in order of time, then id."""
    step = F.struct("ts", "event_id", "event_type")
    rows = events.groupBy(F.col("user_id").alias("seq_id")).agg(F.array_sort(F.collect_list(step)).alias("_s"))
    return rows.select("seq_id", F.lit(None).cast("string").alias("category"), F.transform("_s", lambda x: x["event_type"]).alias("tokens"))
