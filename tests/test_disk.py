"""Disk that queries leave behind, and work in rounds."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import clones
from weftline.plans import registry
from weftline.session import checkpoint_folder


def held(spark) -> int:
    """Bytes of shuffle files and checkpoints."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    shared = checkpoint_folder(spark).removeprefix("file:")
    kept = [os.path.join(d, f) for d, _, names in os.walk(shared) for f in names]
    return sum(files.apply(i).length() for i in range(files.size())) + sum(map(os.path.getsize, kept))


@pytest.mark.parametrize("name, most", [("lsh_candidates", 100_000), ("best_jaccard", 100_000)])
def test_disk_of_a_query(spark, folder, name, most):
    """What a query holds besides its result follows its functions, not its hashes, bands or pairs."""
    before = held(spark)
    found = registry.queries()[name](spark, folder)
    assert found.count()
    took = held(spark) - before
    assert took < most


def test_estimates_in_rounds(spark):
    """Pairs that agree in bands of several rounds come out once, tokens may hold blanks."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        base = [f"o{x}" for x in rng.integers(0, 9, 30)]
        rows += [base, [*base[:26], *[f"o{x}" for x in rng.integers(0, 9, 4)]], [*base[:13], "a b", *base[14:]]]
    units = spark.createDataFrame([*enumerate(rows), (900, ["a b", "c", "d"] * 4), (901, ["a", "b c", "d"] * 4), (999, ["a"])], "unit bigint, ops array<string>")
    sigs: dict[int, list] = {}
    for r in clones.signatures(units, 3, 32).orderBy("unit", "i").collect():
        sigs.setdefault(r.unit, []).append(r.m)
    same = {(a, b): [x == y for x, y in zip(sigs[a], sigs[b])] for a in sigs for b in sigs if a < b}
    want = sorted((a, b, sum(s) / 32) for (a, b), s in same.items() if any(all(s[i : i + 4]) for i in range(0, 32, 4)))
    assert len(want) > 30
    for entries, least in ((5_000_000, 4), (1, 3)):
        got = clones.banded_estimates(units, 3, 8, 4, entries, least)
        assert sorted(map(tuple, got.select("a", "b", F.col("estimate")).collect())) == want


def test_similar_units_in_rounds(spark):
    """Rounds give the pairs that one round gives, once; different tokens that join to the same shingle are the same."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(20):
        base = [f"o{x}" for x in rng.integers(0, 90, 30)]
        rows += [base, base[:25] + [f"o{x}" for x in rng.integers(0, 90, 5)]]
    rows += [["a b", "c", "d", *rows[0]], ["a", "b c", "d", *rows[0]]]
    sets = [{" ".join(r[i : i + 3]) for i in range(len(r) - 2)} for r in rows]
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(rows)) for b in range(a + 1, len(rows))}
    want = sorted((a, b, j) for (a, b), j in want.items() if j >= 0.5)
    units = spark.createDataFrame(list(enumerate(rows)), "unit bigint, ops array<string>")
    assert len(want) > 15 and sorted(map(tuple, clones.similar_units(units, 3, 0.5, entries=1, floor=40).collect())) == want
