"""The generic input of the operators: units of sequences.

A *unit* (function, line, user day) belongs to a *sequence* (program, document,
user) and has a place in it: columns ``seq, unit, upos, ops``. Operators of
whole sequences span unit borders but never sequence borders; they never put a
sequence together in one row, so a sequence with a third of all tokens is as
cheap as its units are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import bound, ngrams
from weftline.session import grows


#: Places of a sequence (units, or single tokens) that one task handles together.
PIECE, TOKENS = 1024, 1 << 16


def as_units(df: DataFrame, seq: str, unit: str, upos: str, ops: str, size: int = 1024) -> DataFrame:
    """(seq, unit, upos, ops) without empty units; longer units are cut into
    pieces of ``size`` tokens that follow each other, so no row grows with a
    hot sequence. Null sequences are left out."""
    rows = df.select(F.col(seq).alias("seq"), F.col(unit).alias("unit"), F.col(upos).cast("bigint").alias("upos"), F.col(ops).alias("ops"))
    rows = rows.filter("seq is not null and size(ops) > 0")
    starts = F.sequence(F.lit(0), F.size("ops") - 1, F.lit(size))
    cut = rows.select("seq", "unit", "upos", F.explode(starts).alias("at"), "ops")
    return cut.select("seq", "unit", F.struct("upos", "unit", "at").alias("upos"), "at", F.slice("ops", F.col("at") + 1, size).alias("ops"))


def _piece(place: Column, size: int) -> Column:
    return F.floor(place / size).cast("bigint")


def _in_piece() -> Window:
    return Window.partitionBy("seq", "piece").orderBy("upos")


def positions(units: DataFrame) -> DataFrame:
    """(seq, unit, pos, gpos, tok): every token with its place in its unit and
    in its sequence. Running totals are over the units of a piece and over the
    pieces of a sequence, never over tokens."""
    rows = units.select("seq", "unit", "upos", "at", "ops", _piece(F.col("upos.upos"), PIECE).alias("piece"))
    sums = rows.groupBy("seq", "piece").agg(F.sum(F.size("ops")).alias("n"))
    upto = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("seq", "piece", upto(Window.partitionBy("seq").orderBy("piece"), F.col("n")).alias("earlier"))
    placed = rows.withColumn("before", upto(_in_piece(), F.size("ops"))).join(grows(sums), ["seq", "piece"])
    out = placed.select("seq", "unit", "at", (F.col("before") + F.col("earlier")).alias("before"), F.posexplode("ops").alias("i", "tok"))
    return out.select("seq", "unit", (F.col("at") + F.col("i")).cast("bigint").alias("pos"), (F.col("before") + F.col("i")).alias("gpos"), "tok")


def with_context(units: DataFrame, more: int) -> DataFrame:
    """Units with ``next``: the ``more`` tokens that follow them in their
    sequence, those of the next pieces included."""
    if more < 1:
        return units.withColumn("next", F.array().cast("array<string>"))
    few = lambda lists: F.slice(F.flatten(lists), 1, more)
    rows = units.withColumn("piece", _piece(F.col("upos.upos"), PIECE)).withColumn("head", F.slice("ops", 1, more))
    rows = rows.withColumn("own", few(F.collect_list("head").over(_in_piece().rowsBetween(1, more)))).withColumn("nr", F.row_number().over(_in_piece()))
    heads = rows.filter(F.col("nr") <= more).groupBy("seq", "piece").agg(F.array_sort(F.collect_list(F.struct("nr", "head"))).alias("h"))
    heads = heads.select("seq", "piece", few(F.transform("h", lambda x: x["head"])).alias("head"))
    later = F.collect_list("head").over(Window.partitionBy("seq").orderBy("piece").rowsBetween(1, more))
    heads = heads.select("seq", "piece", few(later).alias("later"))
    both = rows.join(grows(heads), ["seq", "piece"])
    return both.select(*units.columns, F.slice(F.concat("own", "later"), 1, more).alias("next"))


def unit_ngrams(units: DataFrame, lengths: list[int]) -> DataFrame:
    """(seq, n, gram): all n-grams of the sequences, those over unit borders
    included, with the tokens joined by spaces."""
    wide = with_context(units, max(lengths) - 1)

    def of(n: int) -> Column:
        grams = ngrams(F.concat("ops", F.slice("next", 1, n - 1)) if n > 1 else F.col("ops"), n)
        return F.transform(grams, lambda g: F.struct(F.lit(n).cast("bigint").alias("n"), g.alias("gram")))

    every = F.concat(*[of(n) for n in lengths])
    return wide.select("seq", F.explode(every).alias("g")).select("seq", "g.n", "g.gram")


def ngram_counts(units: DataFrame, lengths: list[int], by_seq: bool = False) -> DataFrame:
    """([seq,] n, gram, c), counted with map-side combining."""
    keys = ["seq", "n", "gram"] if by_seq else ["n", "gram"]
    return unit_ngrams(units, lengths).groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))


def lag_pairs(units: DataFrame, lags: int) -> DataFrame:
    """(seq, lag, x, y): tokens ``lag`` places apart, for lags 1 to ``lags``."""
    wide = with_context(units, lags).select("seq", F.size("ops").alias("n"), F.concat("ops", "next").alias("chain"))

    def of(c, n):
        def at(lag: int):
            m = F.greatest(F.least(n, F.size(c) - lag), F.lit(0))
            pair = lambda x, y: F.struct(F.lit(lag).cast("bigint").alias("lag"), x.alias("x"), y.alias("y"))
            return F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, F.lit(lag + 1), m), pair)

        return F.concat(*[at(lag) for lag in range(1, lags + 1)])

    pairs = bound(F.col("chain"), lambda c: of(c, F.col("n")))
    return wide.select("seq", F.explode(pairs).alias("p")).select("seq", "p.lag", "p.x", "p.y")


def shuffled(units: DataFrame, seed: int) -> DataFrame:
    """The tokens of each sequence in an order that only sequence, place and
    seed decide, as positions (seq, gpos, tok); other engines can repeat it.
    Tokens are ranked within 4096 ranges of the random order, whose sizes give
    the places at which they begin."""
    tokens = positions(units)
    rank = F.md5(F.concat_ws("|", F.col("seq").cast("string"), F.col("gpos").cast("string"), F.lit(str(seed))))
    keyed = tokens.select("seq", "gpos", "tok", rank.alias("rank"), F.substring(rank, 1, 3).alias("range"))
    sizes = keyed.groupBy("seq", "range").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("seq").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    own = F.row_number().over(Window.partitionBy("seq", "range").orderBy("rank", "gpos")) - 1
    placed = keyed.withColumn("own", own).join(grows(sizes.select("seq", "range", upto.alias("upto"))), ["seq", "range"])
    return placed.select("seq", (F.col("own") + F.col("upto")).cast("bigint").alias("gpos"), "tok")


def position_ngrams(tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """(seq, n, gram) of a table of single positions without gaps. Each piece
    also gets the first tokens of the next, from which no gram of it begins."""
    most = max(lengths)
    piece = _piece(F.col("gpos"), TOKENS)
    lent = (F.col("gpos") % TOKENS < most - 1) & (F.col("gpos") >= TOKENS)
    pieces = F.when(lent, F.array(piece, piece - 1)).otherwise(F.array(piece))
    held = tokens.select("seq", "gpos", "tok", piece.alias("own"), F.explode(pieces).alias("piece"))
    w = Window.partitionBy("seq", "piece").orderBy("gpos")
    ahead = [F.lead("tok", k).over(w) for k in range(1, most)]
    wide = held.select("seq", "own", "piece", F.col("tok").alias("t0"), *[a.alias(f"t{k + 1}") for k, a in enumerate(ahead)])
    wide = wide.filter("own = piece")

    def of(n: int) -> Column:
        gram = F.concat_ws(" ", *[F.col(f"t{k}") for k in range(n)])
        return F.struct(F.lit(n).cast("bigint").alias("n"), F.when(F.col(f"t{n - 1}").isNotNull(), gram).alias("gram"))

    return wide.select("seq", F.explode(F.array(*[of(n) for n in lengths])).alias("g")).select("seq", "g.n", "g.gram").filter("gram is not null")
