"""Views of the stored tables that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.tokens import opcode_array, words
from weftline.operators.units import as_units
from weftline.sources.tables import latest, table


def r6(c: Column | str) -> Column:
    """Rounded to six places; -0.0 becomes 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def functions(spark: SparkSession, folder: str) -> DataFrame:
    """(function_id, func_id, binary_name, name, func_pos, ops, size) of every
    distinct function, the latest delivery of each."""
    rows = table(spark, folder, "program_functions").select("function_id", "func_id", "binary_name", "name", "func_pos", opcode_array(F.col("instructions")).alias("ops"), "loaded_at")
    rows = latest(rows, ["function_id"], [F.col("loaded_at"), F.col("ops")])
    return rows.select("function_id", F.trim("func_id").alias("func_id"), F.trim("binary_name").alias("binary_name"), "name", "func_pos", "ops", F.size("ops").alias("size"))


def programs(spark: SparkSession, folder: str) -> DataFrame:
    """Functions as units of their binaries."""
    return as_units(functions(spark, folder), "binary_name", "function_id", "func_pos", "ops")


def instruction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded instructions, each instr_id once."""
    rows = table(spark, folder, "instructions").select("instr_id", "function_id", "binary_name", "address", "mnemonic", "operands", "loaded_at")
    return latest(rows, ["instr_id"], [F.col("loaded_at")]).filter("mnemonic is not null")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, category, source, tokens) of documents."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("category"), "source", words(F.col("text")).alias("tokens"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, tokens) of users' events in order; a user's events fit a row here,
    operators that scale with a hot user take ``user_days``."""
    step = F.struct("ts", "event_id", "event_type")
    rows = table(spark, folder, "events").groupBy(F.col("user_id").alias("seq")).agg(F.array_sort(F.collect_list(step)).alias("s"))
    return rows.select("seq", F.transform("s", lambda x: x["event_type"]).alias("tokens"))


def user_days(spark: SparkSession, folder: str) -> DataFrame:
    """Events as units: the days of users."""
    day = F.to_date("ts")
    rows = table(spark, folder, "events").groupBy("user_id", day.alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    rows = rows.select("user_id", F.unix_date("day").alias("day"), F.transform("s", lambda x: x["event_type"]).alias("ops"))
    return as_units(rows, "user_id", "day", "day", "ops")


OP = "lower(trim(split_part(split_part({}, '@', 1), '.', 1)))"
#: f: functions; t: their tokens with places in function and program.
SQL_F = f"""f AS (
  SELECT function_id, trim(func_id) AS func_id, trim(binary_name) AS binary_name, name, func_pos,
    list_filter(list_transform(instructions, lambda x: {OP.format("x")}), lambda x: x IS NOT NULL) AS ops
  FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY loaded_at DESC) AS rn FROM program_functions) WHERE rn = 1 AND function_id IS NOT NULL)"""
SQL_T = f"""{SQL_F},
u AS (SELECT binary_name AS seq, function_id AS unit, func_pos, unnest(ops) AS tok, unnest(range(len(ops))) AS pos FROM f),
t AS (SELECT seq, unit, pos, tok, row_number() OVER (PARTITION BY seq ORDER BY func_pos, unit, pos) - 1 AS gpos FROM u)"""
SQL_E = """t AS (SELECT user_id AS seq, event_type AS tok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS gpos FROM events)"""
SQL_D = r"""d AS (SELECT doc_id AS seq, lang AS category, source, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS tokens FROM documents),
dt AS (SELECT seq, unnest(tokens) AS tok, unnest(range(len(tokens))) AS gpos FROM d)"""


def sql_grams(most: int, source: str = "t") -> str:
    """g: (seq, n, gram) for n up to ``most``."""
    ahead = ", ".join(f"lead(tok, {k}) OVER w AS l{k}" for k in range(1, most))
    grams = ", ".join(" || ' ' || ".join(["tok", *[f"l{k}" for k in range(1, n)]]) for n in range(1, most + 1))
    ns = ", ".join(map(str, range(1, most + 1)))
    return f"""g AS (SELECT seq, n, gram FROM (SELECT seq, unnest([{ns}]) AS n, unnest([{grams}]) AS gram
  FROM (SELECT seq, tok{", " if ahead else ""}{ahead} FROM {source} WINDOW w AS (PARTITION BY seq ORDER BY gpos))) WHERE gram IS NOT NULL)"""


#: Entropy of counts c, as an aggregate.
SQL_H = "log2(sum(c)) - sum(c * log2(c)) / sum(c)"
