"""Disassembly listings and sequence files as tables, parsed inside the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Line formats of disassembly listings.
HEADER = r"^([0-9a-f]+) <(.+?)>:$"
WITH_BYTES = r"^\s*([0-9a-f]+):\t[0-9a-f ]+\t\s*([a-zA-Z][a-zA-Z0-9]*)(.*)$"
WITHOUT_BYTES = r"^\s*([0-9a-f]+):\s+([a-zA-Z][\w.]*)\s*(.*)$"
SOURCE = r"^(/?\S+\.(?:cpp|cc|c|h|hpp)):(\d+)(?:\s|$)"


def lines_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(file, nr, line) of rows that hold whole listings."""
    return texts.select(F.col(key).alias("file"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("nr", "line"))


def parse_listing(lines: DataFrame, raw_bytes: bool = False, least: int = 1) -> DataFrame:
    """(file, func, func_pos, pos, address, mnemonic, operands, src_file, src_line)
    of the instructions below function headers. Lines of bytes that continue an
    instruction are not instructions; those before any header are left out, as
    are functions of fewer than ``least`` instructions. Of functions with one
    name in a file the last stays."""
    pattern = WITH_BYTES if raw_bytes else WITHOUT_BYTES
    line, bare = F.col("line"), F.trim("line")
    header = F.when(bare.rlike(HEADER), F.regexp_extract(bare, HEADER, 2))
    source = F.when(bare.rlike(SOURCE), F.struct(F.regexp_extract(bare, SOURCE, 1).alias("f"), F.regexp_extract(bare, SOURCE, 2).cast("int").alias("l")))
    code = F.when(header.isNull() & source.isNull() & line.rlike(pattern), F.struct(F.conv(F.regexp_extract(line, pattern, 1), 16, 10).cast("bigint").alias("a"), F.lower(F.regexp_extract(line, pattern, 2)).alias("m"), F.trim(F.regexp_extract(line, pattern, 3)).alias("o")))
    w = Window.partitionBy("file").orderBy("nr").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select("file", "nr", header.alias("h"), source.alias("s"), code.alias("c"))
    rows = rows.select("file", "nr", "c", F.last("h", True).over(w).alias("func"), F.last(F.when(F.col("h").isNotNull(), F.col("nr")), True).over(w).alias("at"), F.last("s", True).over(w).alias("s"))
    rows = rows.filter("c is not null and func is not null")
    f = Window.partitionBy("file", "func", "at")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(f)).filter(F.col("n") >= least)
    rows = rows.withColumn("last_at", F.max("at").over(Window.partitionBy("file", "func"))).filter("at = last_at")
    return rows.select("file", "func", F.col("at").alias("func_pos"), (F.row_number().over(f.orderBy("nr")) - 1).alias("pos"), F.col("c.a").alias("address"), F.col("c.m").alias("mnemonic"), F.col("c.o").alias("operands"), F.col("s.f").alias("src_file"), F.col("s.l").alias("src_line"))


def load_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, tokens) of files with one token a line, named by file stem."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("seq"), "value")
    return files.select("seq", F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("tokens"))


def elf_files(spark: SparkSession, path: str, most: int = 100 << 20) -> DataFrame:
    """(path, length) of files that begin with the ELF magic."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter((F.col("length") <= most) & (F.substring("content", 1, 4) == F.unhex(F.lit("7F454C46")))).select("path", "length")


def resolve_addresses(addresses: DataFrame, segments: DataFrame, width: int = 4096) -> DataFrame:
    """(address, base, text): the printable string that starts at an address in a
    segment (base, content). A range join made an equi-join on pages of
    ``width`` addresses, which bounds the rows a segment turns into."""
    pages = segments.select("base", "content", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.length("content") - 1) / width))).alias("page"))
    hits = addresses.withColumn("page", F.floor(F.col("address") / width)).join(pages, "page")
    hits = hits.filter((F.col("address") >= F.col("base")) & (F.col("address") < F.col("base") + F.length("content")))
    text = F.regexp_extract(F.decode(F.substring("content", F.col("address") - F.col("base") + 1, F.lit(4096)), "ISO-8859-1"), r"^[\x20-\x7e]{2,}", 0)
    return hits.select("address", "base", text.alias("text")).filter("text <> ''")


def first_per_inode(rows: DataFrame, inode: str, order: str) -> DataFrame:
    """One row for each inode, the first in ``order``; rows without an inode stay."""
    w = Window.partitionBy(inode).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).filter((F.col("_k") == 1) | F.col(inode).isNull()).drop("_k")
