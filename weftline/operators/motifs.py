"""Exact motifs, their labels, and positional patterns of units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import bound, ngrams
from weftline.operators.information import entropy
from weftline.session import cut

# Opcodes that branch.
BRANCHES = ["je", "jne", "jl", "jle", "jg", "jge", "jb", "jbe", "ja", "jae", "js", "jns", "jo", "jno", "jp", "jnp", "jmp"]
# What a motif probably does; the first rule counts of which all demands are met.
MOTIF_RULES = [
    {"label": "prologue: frame", "begins": ["push", "mov"]},
    {"label": "prologue: save", "begins": ["push"]},
    {"label": "epilogue: leave", "holds": ["leave", "ret"]},
    {"label": "epilogue: pop", "holds": ["pop", "ret"]},
    {"label": "epilogue: return", "ends": ["ret"]},
    {"label": "branch: compare", "holds": ["cmp"], "any_of": BRANCHES},
    {"label": "branch: test", "holds": ["test"], "any_of": BRANCHES},
    {"label": "zeroing", "holds": ["xor"], "at_most": 3},
    {"label": "call", "holds": ["call"]},
    {"label": "bulk moves", "repeats": ("mov", 3)},
    {"label": "address and load", "holds": ["lea", "mov"]},
    {"label": "arithmetic", "any_of": ["add", "sub", "imul", "idiv"]},
    {"label": "pushes", "repeats": ("push", 2)},
    {"label": "pops", "repeats": ("pop", 2)},
]


def motif_counts(units: DataFrame, lengths: list[int]) -> DataFrame:
    """(k, motif, units, occurrences) of the k-mers inside units. Occurrences are
    combined within each unit before the exchange, which then carries one row
    for a motif and unit."""
    def of(k: int) -> Column:
        return F.transform(ngrams(F.col("ops"), k), lambda g: F.struct(F.lit(k).cast("bigint").alias("k"), g.alias("motif")))

    grams = F.concat(*[of(k) for k in lengths])
    each = units.select("unit", F.explode(grams).alias("g")).groupBy("unit", "g.k", "g.motif").agg(F.count(F.lit(1)).alias("c"))
    return each.groupBy("k", "motif").agg(F.count(F.lit(1)).alias("units"), F.sum("c").alias("occurrences"))


def frequent_motifs(counts: DataFrame, total: DataFrame, least: int = 5, share: float = 0.005, coverage: float = 0.01) -> DataFrame:
    """Motifs in at least max(1, coverage) of the units that occur at least
    max(least, share) times; ``total`` has one row with the number of units."""
    rows = counts.join(F.broadcast(total))
    keep = (F.col("occurrences") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))) & (F.col("units") >= F.greatest(F.lit(1), F.floor(F.col("n") * coverage)))
    return rows.filter(keep).select("k", "motif", "units", "occurrences", (F.col("units") / F.col("n")).alias("coverage"))


def frequent_by_length(units: DataFrame, lengths: range, total: DataFrame) -> DataFrame:
    """frequent_motifs of consecutive ``lengths``, shortest first. A motif is in no
    more units and occurs no more often than its first k - 1 tokens, so only the
    motifs whose beginning is frequent are counted; none is lost."""
    found = level = cut(frequent_motifs(motif_counts(units, [lengths[0]]), total))
    for k in lengths[1:]:

        def of(t: Column) -> Column:
            part = lambda i, n: F.array_join(F.slice(t, i, F.lit(n)), " ")
            places = F.sequence(F.lit(1), F.greatest(F.size(t) - F.lit(k - 1), F.lit(1)))
            return F.transform(places, lambda i: F.struct(part(i, k).alias("motif"), part(i, k - 1).alias("start")))

        rows = units.filter(F.size("ops") >= k).select("unit", F.explode(bound(F.col("ops"), of)).alias("g")).select("unit", "g.motif", "g.start")
        rows = rows.join(level.select(F.col("motif").alias("start")), "start", "left_semi")
        each = rows.groupBy("unit", "motif").agg(F.count(F.lit(1)).alias("c"))
        counts = each.groupBy(F.lit(k).cast("bigint").alias("k"), "motif").agg(F.count(F.lit(1)).alias("units"), F.sum("c").alias("occurrences"))
        level = cut(frequent_motifs(counts, total))
        found = found.unionByName(level)
    return found


def top_motifs(motifs: DataFrame, most: int) -> DataFrame:
    score = F.col("units") * F.col("coverage")
    w = Window.partitionBy("k").orderBy(F.desc(score), "motif")
    return motifs.withColumn("score", score).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= most)


def motif_label(motif: Column, rules: list[dict] | None = None, other: str = "other") -> Column:
    """The label of the first of ``rules`` whose demands a motif meets, as one
    lookup among the numbers of the rules that it meets; null for null."""
    m = F.split(motif, " ")
    literal = lambda tokens: F.array(*map(F.lit, tokens))
    demands = {
        "begins": lambda t: F.slice(m, 1, len(t)) == literal(t),
        "ends": lambda t: F.slice(F.reverse(m), 1, len(t)) == literal(t[::-1]),
        "holds": lambda t: F.size(F.array_intersect(literal(t), m)) == len(t),
        "any_of": lambda t: F.arrays_overlap(m, literal(t)),
        "repeats": lambda t: F.size(F.filter(m, lambda x: x == t[0])) >= t[1],
        "at_most": lambda n: F.size(m) <= n,
    }
    rules = MOTIF_RULES if rules is None else rules
    meets = F.array(*[reduce(Column.__and__, [demands[k](v) for k, v in rule.items() if k != "label"]) for rule in rules])
    first = F.array_position(meets, True)
    label = F.element_at(F.array(*[F.lit(r["label"]) for r in rules], F.lit(other)), F.when(first > 0, first).otherwise(len(rules) + 1).cast("int"))
    return F.when(motif.isNotNull(), label)


def positional(units: DataFrame, window: int = 20) -> DataFrame:
    """(side, offset, tok, c) of the first and last ``window`` tokens of the units
    that have at least twice as many."""
    long = units.filter(F.size("ops") >= 2 * window)
    ends = F.array(F.struct(F.lit("start").alias("side"), F.slice("ops", 1, window).alias("o")), F.struct(F.lit("end").alias("side"), F.reverse(F.slice("ops", -window, window)).alias("o")))
    rows = long.select(F.explode(ends).alias("e")).select("e.side", F.posexplode("e.o").alias("offset", "tok"))
    return rows.groupBy("side", F.col("offset").cast("bigint").alias("offset"), "tok").agg(F.count(F.lit(1)).alias("c"))


def positional_entropy(counts: DataFrame) -> DataFrame:
    return entropy(counts, ["side", "offset"]).select("side", "offset", "h")


def consensus(counts: DataFrame, most: int = 3) -> DataFrame:
    """The commonest tokens of each offset with their share."""
    w = Window.partitionBy("side", "offset")
    rank = F.row_number().over(w.orderBy(F.desc("c"), "tok")).cast("bigint")
    return counts.select("side", "offset", "tok", (F.col("c") / F.sum("c").over(w)).alias("p"), rank.alias("rank")).filter(F.col("rank") <= most)
