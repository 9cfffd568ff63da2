"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.tokens import normalize_token
from weftline.llm import classes, edits, leaks, linking, mixing, pages, patterns, runs, setjoin, spans, terms
from weftline.session import cut, grows
from weftline.sources.tables import opcode_sequences, table


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    """The sequences of all functions, written once: operators read them repeatedly."""
    return cut(opcode_sequences(table(spark, folder, "program_functions")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    links = linking.links_of(table(spark, folder, "clone_pairs"), "func_id1", "func_id2", table(spark, folder, "clone_families"), "members")
    return linking.connected_groups(links).select(F.col("id").alias("func_id"), "group_id")


def special_opcodes(reference: DataFrame) -> frozenset[str]:
    """Opcodes of a class other than generic; the reference table has a fixed size."""
    rows = reference.filter("op_class <> 'generic'").select(F.lower(F.trim("opcode")).alias("opcode")).dropna().distinct()
    return frozenset(r[0] for r in rows.collect())


def _patterns(spark: SparkSession, folder: str) -> DataFrame:
    seqs = _sequences(spark, folder)
    least = max(5, seqs.count() * 5 // 1000)
    return patterns.frequent_patterns(seqs, "function_id", "ops", special_opcodes(table(spark, folder, "opcode_ref")), least)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).select("pattern")


def p2_support(spark: SparkSession, folder: str) -> DataFrame:
    """function_count and function_coverage of every pattern with gaps."""
    functions = table(spark, folder, "program_functions").select("function_id").dropna().distinct()
    total = functions.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = _patterns(spark, folder).join(F.broadcast(total))
    return rows.select("pattern", F.col("support").alias("function_count"), F.round(F.col("support") / F.col("n"), 9).alias("function_coverage"))


def _similar(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return setjoin.similar_sequences(_sequences(spark, folder), "function_id", "ops", 4, 0.6, 40)


def _similar_functions(spark: SparkSession, folder: str) -> DataFrame:
    groups, pairs = _similar(spark, folder)
    pairs = pairs.select(F.col("id1").alias("rep1"), F.col("id2").alias("rep2"), "jaccard")
    # the test data ask for the pairs of functions, so copies are paired with each other too
    other = groups.select("rep", F.col("id").alias("id2"))
    alike = groups.join(grows(other), "rep").filter("id < id2").select(F.col("id").alias("id1"), "id2", F.lit(1.0).alias("jaccard"))
    return classes.expand(pairs, groups, ["jaccard"]).unionByName(alike)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _similar_functions(spark, folder).select(F.col("id1").alias("function_id1"), F.col("id2").alias("function_id2"))


def p3_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _similar_functions(spark, folder).select(F.col("id1").alias("function_id1"), F.col("id2").alias("function_id2"), F.round("jaccard", 9).alias("jaccard"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every function with its class of copies and the number of similar classes."""
    out = setjoin.similar_classes(*_similar(spark, folder))
    return out.select(F.col("id").alias("function_id"), "rep", "links")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_spans(_sequences(spark, folder), "function_id", "ops", 32).select(F.col("id").alias("function_id"), "start_pos", "end_pos")


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    seqs = _sequences(spark, folder)
    out = spans.shared_cover(seqs, "function_id", "ops", spans.shared_spans(seqs, "function_id", "ops", 32))
    return out.select(F.col("id").alias("function_id"), "spans", "covered", F.round("share", 9).alias("share"))


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return terms.term_frequencies(_sequences(spark, folder), "function_id", "ops", 2, 0.5)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder).filter("mark is not null").select(F.col("term").alias("opcode"), "mark")


def p5_frequency(spark: SparkSession, folder: str) -> DataFrame:
    out = _frequencies(spark, folder)
    return out.select(F.col("term").alias("opcode"), F.col("occurrences").alias("count"), F.round("relative_frequency", 9).alias("relative_frequency"), F.col("records").alias("functions"), "mark")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = edits.near_copy_groups(_sequences(spark, folder), "function_id", "ops", 40, 15)
    return groups.select(F.col("id").alias("function_id"), "group_id")


def _runs(spark: SparkSession, folder: str, **how) -> DataFrame:
    rows = table(spark, folder, "instructions").withColumn("op", normalize_token(F.col("mnemonic")))
    return runs.collapse_runs(rows, "function_id", "address", "op", "instr_id", **how).withColumnRenamed("entity", "function_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).filter("n >= 4").select("function_id", F.col("first").alias("start_address"), F.col("last").alias("end_address"))


def p7_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every run, single instructions included."""
    return _runs(spark, folder).select("function_id", F.col("event").alias("opcode"), F.col("n").alias("instructions"), F.col("first").alias("start_address"), F.col("last").alias("end_address"))


def p7_near_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of near-identical opcodes too (``movsd movss``), at most 64 addresses apart."""
    out = _runs(spark, folder, similarity=0.6, max_gap=64)
    return out.filter("n >= 4").select("function_id", F.col("event").alias("opcode"), F.col("n").alias("instructions"), F.col("first").alias("start_address"), F.col("last").alias("end_address"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of the question and of the answer of a leaked item a document shares."""
    return leaks.leak_overlap(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked test items with the number of documents that hold them."""
    return p8_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def _mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("source", F.trim("source"))
    sizes = cut(mixing.token_counts(docs, "doc_id", "text", ["source"], mixing.default_tokenizer(spark)))
    return mixing.mix_sources(sizes, table(spark, folder, "mix_targets"), "doc_id", "source")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder).select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_shares(_mixture(spark, folder), table(spark, folder, "mix_targets"), "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.stuffed_pages(table(spark, folder, "documents")).select("doc_id")


def p10_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of the flagged pages: how many pages each dominates."""
    return pages.stuffed_pages(table(spark, folder, "documents")).groupBy("shape").agg(F.count(F.lit(1)).alias("pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p2_found, p2_support, p3_found, p3_similarity, p3_classes, p4_found, p4_cover, p5_found, p5_frequency, p6_found, p7_found, p7_runs, p7_near_runs, p8_found, p8_overlap, p8_items, p9_mix, p9_shares, p10_found, p10_shapes]
    return {f.__name__: f for f in own}
