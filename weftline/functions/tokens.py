"""Token-level column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script; never splits an accented word.
WORD = r"[\p{L}\p{N}]+"


def normalize_token(col: Column) -> Column:
    """Text before the first ``@``, then before the first ``.``, trimmed, lower-cased."""
    return F.lower(F.trim(F.substring_index(F.substring_index(col, "@", 1), ".", 1)))


def opcode_array(col: Column) -> Column:
    """An array of raw mnemonics in opcode form; null entries are left out, a
    null array counts as empty."""
    kept = F.filter(F.transform(col, normalize_token), lambda x: x.isNotNull())
    return F.coalesce(kept, F.array().cast("array<string>"))


def words(col: Column) -> Column:
    """Lower-cased words: the longest runs of letters and digits."""
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """``use(value)`` for an array-valued ``use``, with ``value`` computed once a
    row: a lambda that refers to an expression computes it for every element."""
    return F.flatten(F.transform(F.array(value), use))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All contiguous n-grams as joined strings; empty if there are fewer tokens."""

    def of(t: Column) -> Column:
        size = F.size(t)
        grams = F.transform(F.sequence(F.lit(1), size - F.lit(n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), sep))
        return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    return bound(tokens, of)


def encode(token: Column, ids: Column, unknown: Column) -> Column:
    """Dense id of a token in a vocabulary map, unknown tokens get ``unknown``."""
    return F.coalesce(F.element_at(ids, token), unknown)


def systematic_sample(tokens: Column, most: int) -> Column:
    """Every ``len // most``-th token, at most ``most`` of them; short arrays stay whole."""
    step = F.floor(F.size(tokens) / F.lit(most)).cast("int")
    strided = F.slice(F.filter(tokens, lambda _, i: i % F.greatest(step, F.lit(1)) == 0), 1, most)
    return F.when(F.size(tokens) <= most, tokens).otherwise(strided)


def chunks(tokens: Column, size: int) -> Column:
    """Consecutive chunks of ``size`` tokens, the last one shorter."""
    n = F.size(tokens)
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.slice(tokens, i + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<array<string>>"))


def portable_hash(col: Column) -> Column:
    """60-bit hash that other engines reproduce: the first 15 hex digits of MD5."""
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge that ``value`` stays below; the last label
    beyond all edges; null for null."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(value < edge, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)
