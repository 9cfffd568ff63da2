"""The training-data operators: SQL parity, brute force, and the odd cases."""

import os
from collections import Counter, defaultdict

import numpy as np
import parity
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import classes, edits, leaks, linking, mixing, pages, patterns, queries, runs, setjoin, spans, sql, terms

DATA = os.path.exists("/root/testdata/sf0.001")
SEQ = "function_id bigint, ops array<string>, extra string, id string, rep bigint, seq bigint, key string"


@pytest.mark.skipif(not DATA, reason="no test data")
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_as_sql(spark, duck, folder, name):
    assert parity.difference(spark, duck, queries.queries()[name], sql.oracle_sql()[name], folder) == ""


@pytest.mark.skipif(not DATA, reason="no test data")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(sql.oracle_sql())))
def test_queries_without_sql_run(spark, folder, name):
    assert queries.queries()[name](spark, folder).count() >= 0


def table(spark, rows):
    """Sequences beside columns whose names the operators use inside."""
    return spark.createDataFrame([(k, s, "x", "y", 7, 8, "z") for k, s in rows], SEQ)


def corpus(seed=3, families=6, alone=30):
    rng = np.random.default_rng(seed)
    words = np.array([f"o{i}" for i in range(40)])
    rows = []
    for f in range(families):
        base = rng.choice(words, rng.integers(60, 120)).tolist()
        for m in range(4):
            s = list(base)
            for _ in range(m * 3):
                p = int(rng.integers(len(s)))
                if rng.random() < 0.5:
                    s[p] = str(rng.choice(words))
                else:
                    s.insert(p, str(rng.choice(words)))
            rows.append((f * 10 + m + 1, s))
        rows.append((f * 10 + 9, list(base)))  # an exact copy
    rows += [(1000 + i, rng.choice(words, rng.integers(0, 90)).tolist()) for i in range(alone)]
    return rows


ODD = [(None, ["a"] * 50), (5001, None), (5002, []), (5003, ["q"] * 3), (5004, ["long", "run", "of", "words"] * 1500)]


# 1


def reference_groups(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("links", [
    [("n%03d" % i, "n%03d" % (i + 1)) for i in range(300)],
    [("hub", f"x{i}") for i in range(500)] + [("x1", "x2"), ("x2", "x1"), ("x2", "x1")],
    [("a", "a"), (None, "b"), ("c", None), (None, None)],
    [(f"k{a}", f"k{b}") for a, b in np.random.default_rng(1).integers(0, 400, (350, 2)).tolist()],
    [],
])
def test_groups(spark, links):
    df = spark.createDataFrame(links, "a string, b string").withColumn("u", F.lit(1)).withColumn("vid", F.lit(2))
    got = {r.id: r.group_id for r in linking.connected_groups(df).collect()}
    assert got == reference_groups(links)


def test_links_of_sets(spark):
    pairs = spark.createDataFrame([(" p", "q "), ("p", None)], "l string, r string")
    sets = spark.createDataFrame([(["a", " b", None],), ([],), (None,), (["z"],)], "m array<string>")
    assert sorted(map(tuple, linking.links_of(pairs, "l", "r", sets, "m").collect())) == [("a", "a"), ("a", "b"), ("p", "q"), ("z", "z")]


# 2


def count_patterns(rows, alphabet, least):
    found = Counter()
    for k, o in rows:
        if k is None or not o:
            continue
        own = set()

        def grow(p, i, o=o, own=own):
            if len(p) >= 3:
                own.add(" ".join(p))
            if len(p) < 5:
                for j in range(i + 1, min(i + 5, len(o))):
                    if o[j] in alphabet:
                        grow((*p, o[j]), j)

        for i, x in enumerate(o):
            if x in alphabet:
                grow((x,), i)
        found.update(own)
    return {(p, n) for p, n in found.items() if n >= least}


@pytest.mark.parametrize("parts", [20_000, 10])
def test_patterns(spark, parts):
    rows = corpus() + ODD
    alphabet = frozenset(f"o{i}" for i in range(0, 40, 3)) | {"q"}
    got = {tuple(r) for r in patterns.frequent_patterns(table(spark, rows), "function_id", "ops", alphabet, 4, part_rows=parts, block=7).collect()}
    assert got == count_patterns(rows, alphabet, 4) and got
    assert patterns.frequent_patterns(table(spark, []), "function_id", "ops", alphabet, 4).count() == 0
    assert patterns.frequent_patterns(table(spark, rows), "function_id", "ops", frozenset(), 1).count() == 0


# 3


def test_similar_pairs(spark):
    rows = corpus() + ODD
    sets = setjoin.shingle_sets(table(spark, rows), "function_id", "ops", 4)
    own = {k: {tuple(s[i : i + 4]) for i in range(len(s) - 3)} for k, s in rows if k is not None and s and len(s) >= 4}
    want = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    want = {p: pytest.approx(j) for p, j in want.items() if j >= 0.6}
    assert {(r.id1, r.id2): r.jaccard for r in setjoin.similar_pairs(sets, 0.6).collect()} == want and want
    two = setjoin.similar_pairs(sets.filter("id < 30"), 0.6, sets.filter("id >= 30"))
    assert {(r.id1, r.id2) for r in two.collect()} == {p for p in want if p[0] < 30 <= p[1]}
    assert setjoin.similar_pairs(sets.limit(0), 0.6).count() == 0
    tags = spark.createDataFrame([(1, ["a", "b", None]), (2, ["b", "a", "a"]), (3, None), (4, [])], "k bigint, v array<string>")
    assert [tuple(r) for r in setjoin.similar_pairs(setjoin.hashed_sets(tags, "k", "v"), 0.9).collect()] == [(1, 2, 1.0)]


def test_no_side_that_grows_is_broadcast(spark):
    """Kernels multiply rows beyond what the planner guesses; with a threshold that takes any guess nothing may be broadcast."""
    rows = corpus() + [(9000 + i, ["h"] * (40 + i)) for i in range(80)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        data = table(spark, rows)
        groups, pairs = setjoin.similar_sequences(data, "function_id", "ops", 4, 0.6, 40)
        frames = [groups, pairs, classes.expand(pairs.toDF("rep1", "rep2", "jaccard"), groups, ["jaccard"]), setjoin.similar_classes(groups, pairs)]
        frames += [spans.shared_spans(data, "function_id", "ops", 32, 4), edits.near_copy_groups(data, "function_id", "ops"), linking.connected_groups(groups, "id", "rep")]
        for frame in frames:
            assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()
            frame.collect()
            assert "BroadcastExchange" not in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_similar_classes(spark):
    base = [f"o{i}" for i in range(50)]
    rows = [(3, base), (1, base), (2, base[:-2] + ["x", "y"]), (4, ["z"] * 50), (5, base[:9]), (None, base), (6, None)]
    got = setjoin.similar_classes(*setjoin.similar_sequences(table(spark, rows), "function_id", "ops", 4, 0.6, 40))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 2, 1), (3, 1, 1), (4, 4, 0)]


def test_copies_expand(spark):
    df = table(spark, [(3, ["a"]), (1, ["a"]), (2, ["b"]), (None, ["a"])])
    groups = classes.copy_classes(df, "function_id", "ops")
    assert sorted(map(tuple, groups.collect())) == [(1, 1), (2, 2), (3, 1)]
    pairs = spark.createDataFrame([(1, 2, 0.7)], "rep1 bigint, rep2 bigint, jaccard double")
    assert sorted(map(tuple, classes.expand(pairs, groups, ["jaccard"]).collect())) == [(1, 2, 0.7), (2, 3, 0.7)]


# 4


def reference_spans(rows, least):
    rows = [(k, s) for k, s in rows if k is not None and s]
    where = defaultdict(set)
    for k, s in rows:
        for i in range(len(s) - least + 1):
            where[tuple(s[i : i + least])].add(k)
    out = set()
    for k, s in rows:
        shared = {j for i in range(len(s) - least + 1) if len(where[tuple(s[i : i + least])]) > 1 for j in range(i, i + least)}
        for a in shared:
            if a - 1 not in shared:
                b = a
                while b + 1 in shared:
                    b += 1
                out.add((k, a, b))
    return out


@pytest.mark.parametrize("postings", [64, 0])
def test_spans(spark, postings):
    rows = corpus() + ODD + [(7000 + i, ["h"] * (40 + i)) for i in range(5)] + [(8000, ["x"] * 20 + ["h"] * 33)]
    got = {tuple(r) for r in spans.shared_spans(table(spark, rows), "function_id", "ops", 32, postings).select("id", "start_pos", "end_pos").collect()}
    assert got == reference_spans(rows, 32) and got
    assert spans.shared_spans(table(spark, []), "function_id", "ops").count() == 0


def test_cover(spark):
    df = table(spark, [(1, ["a", "b", "c", "d"]), (2, []), (3, None)])
    found = spark.createDataFrame([(1, 0, 1)], "id bigint, start_pos int, end_pos int")
    assert sorted(map(tuple, spans.shared_cover(df, "function_id", "ops", found).collect())) == [(1, 1, 2, 0.5), (2, 0, 0, None), (3, 0, 0, None)]


# 5


def test_terms(spark):
    rows = [(1, ["a", "b", "a", None]), (2, ["b"]), (70000, ["b", "c"]), (3, []), (None, ["zz"]), (4, None)]
    df = spark.createDataFrame(rows, "key bigint, terms array<string>").repartition(4)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in terms.term_frequencies(df, "key", "terms", 1, 0.5).collect()}
    assert got == {"a": (2, 1, "rare"), "b": (3, 3, "common"), "c": (1, 1, "rare")}
    assert terms.term_frequencies(df.limit(0), "key", "terms").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 65535), max_size=200), st.booleans())
def test_containers_round_trip(ids, dense):
    low = np.array(sorted(ids | set(range(0, 65536, 3) if dense else [])), int)
    assert terms.unpack(terms.pack(low)).tolist() == low.tolist()
    assert len(terms.pack(low)) <= 8192


# 6


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14)), min_size=1, max_size=6), st.integers(0, 8))
def test_banded_distances(pairs, most):
    ao, bo = (np.concatenate([[0], np.cumsum([len(p[i]) for p in pairs])]) for i in (0, 1))
    a, b = (np.array([x for p in pairs for x in p[i]], np.int64) for i in (0, 1))
    got = edits.banded_distances(a, ao, b, bo, np.full(len(pairs), most))
    for g, (x, y) in zip(got, pairs):
        d = distance(x, y)
        assert g == d if d <= most else g > most


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 9), st.integers(0, 2)), max_size=6))
def test_suffix_filter_keeps_what_few_edits_make(x, changes):
    y = list(x)
    for at, token, kind in changes:
        at %= len(y) + 1
        y[at : at + (kind != 0)] = [] if kind == 2 else [token]
    a, b = np.array(x, np.uint64), np.array(y, np.uint64)
    most = np.array([distance(x, y)])
    assert edits.suffix_filter(a, np.array([0, len(a)]), b, np.array([0, len(b)]), most).all()


def test_slices_are_bounded():
    longest = np.sort(np.array([40] * 5000 + [1000] * 500 + [3_000_000] * 3))
    cuts = list(edits._slices(longest, 15))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(longest)
    assert all(b - a == 1 or (b - a) * longest[b - 1] <= edits.TABLES for a, b in cuts) and cuts[-3:] == [(5500, 5501), (5501, 5502), (5502, 5503)]


def test_dense_family_needs_no_pair_inside_its_groups(spark):
    rng = np.random.default_rng(11)
    base = rng.choice(list("abcdefgh"), 80).tolist()
    rows = []
    for i in range(60):
        s = list(base)
        for _ in range(4):
            s[int(rng.integers(80))] = str(rng.choice(list("abcdefgh")))
        rows.append((i + 1, s))
    assert {r.group_id for r in edits.near_copy_groups(table(spark, rows), "function_id", "ops").collect()} == {1}


def test_near_copies(spark):
    rows = corpus(5, 8, 20) + ODD
    long = [(k, s) for k, s in rows if k is not None and s and len(s) >= 40]
    links = [(a, b) for i, (a, s) in enumerate(long) for b, t in long[:i] if abs(len(s) - len(t)) <= 200 and distance(s, t) <= max(len(s), len(t)) * 15 // 100]
    assert {tuple(r) for r in edits.near_copy_groups(table(spark, rows), "function_id", "ops").collect()} == set(reference_groups(links).items()) and links
    assert edits.near_copy_groups(table(spark, []), "function_id", "ops").count() == 0
    with pytest.raises(ValueError):
        edits.near_copy_groups(table(spark, rows), "function_id", "ops", least=10).count()


# 7


def events(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "f bigint, at bigint, op string, row bigint, n bigint, event string")


def test_runs(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 10 * i, str(rng.choice(["a", "a", "b"])), i) for i in range(3000)] + [(2, 5, "z", 9001), (2, 6, None, 9002), (2, 7, "z", 9003), (None, 1, "a", 9004), (3, None, "a", 9005)]
    rows += rows[:200]  # delivered again
    want, clean = [], sorted({r for r in rows if None not in r[:3]}, key=lambda r: (r[0], r[1], r[3]))
    for f, at, op, _ in clean:
        if want and want[-1][:2] == [f, op]:
            want[-1][2] += 1
            want[-1][4] = at
        else:
            want.append([f, op, 1, at, at])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that borders cut runs
    try:
        got = sorted(map(tuple, runs.collapse_runs(events(spark, rows), "f", "at", "op", "row").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(map(tuple, want))
    assert runs.collapse_runs(events(spark, []), "f", "at", "op", "row").count() == 0
    gapped = runs.collapse_runs(events(spark, [(1, 0, "a", 1), (1, 5, "a", 2), (1, 100, "a", 3)]), "f", "at", "op", "row", max_gap=10)
    assert sorted((r.n, r.first, r["last"]) for r in gapped.collect()) == [(1, 100, 100), (2, 0, 5)]


def test_near_runs(spark):
    rows = [(1, 0, "movsd", 1), (1, 1, "movss", 2), (1, 2, "movsd", 3), (1, 3, "call", 4), (1, 4090, "movsd", 5), (1, 4096, "movsd", 6)]
    got = runs.collapse_runs(events(spark, rows), "f", "at", "op", "row", similarity=0.6, span=4096)
    assert sorted((r["first"], r["event"], r.n) for r in got.collect()) == [(0, "movsd", 3), (3, "call", 1), (4090, "movsd", 1), (4096, "movsd", 1)]
    with pytest.raises(ValueError):
        runs.collapse_runs(events(spark, rows), "f", "at", "op", "row", similarity=0.6)


def test_near_runs_pass_multiples_of_4096(spark, monkeypatch):
    rows = [(1, 4093 + i, ("movsd", "movss")[i % 2], i) for i in range(6)] + [(1, 5000 + i, "movsd", 10 + i) for i in range(3)] + [(1, 5100, "movsd", 20)]
    rows += [(2, 4000 + i, "call", 30 + i) for i in range(200)] + [(3, 8190 + i, ("movss", "movsd", "call")[i % 3], 300 + i) for i in range(4)]
    table = spark.createDataFrame(rows, "function_id bigint, address bigint, mnemonic string, instr_id bigint")
    monkeypatch.setattr(queries, "table", lambda *_: table)
    got = sorted((r.function_id, r.opcode, r.instructions, r.start_address, r.end_address) for r in queries.p7_near_runs(spark, "").collect())
    assert got == [(1, "movsd", 6, 4093, 4098), (2, "call", 200, 4000, 4199)]


def test_near_runs_against_the_queue(spark):
    rng = np.random.default_rng(4)
    rows = []
    for f in range(5):
        at = np.cumsum(rng.choice([1, 4, 20, 100], 4000, p=[0.6, 0.3, 0.09, 0.01])).tolist()
        rows += [(f, a, str(rng.choice(["mov", "movs", "movsd", "movss", "call", "cmp"])), f * 4000 + i) for i, a in enumerate(at)]
    got = sorted(map(tuple, runs.collapse_runs(events(spark, rows), "f", "at", "op", "row", similarity=0.6, max_gap=64).collect()))
    want = [(f, *run) for f in range(5) for run in runs.agglomerate([(op, 1, at, at) for g, at, op, _ in rows if g == f], 0.6, 64)]
    assert got == sorted(want)


def repeatedly_merged(runs_of, least, max_gap):
    """The most similar neighbours first, found anew each time; independent of queue and parting."""
    own = list(runs_of)
    while True:
        best = None
        for i, (x, y) in enumerate(zip(own, own[1:])):
            if (max_gap is None or y[2] - x[3] <= max_gap) and runs.likeness(x[0], y[0]) >= least:
                key = (-runs.likeness(x[0], y[0]), x[2])
                best = min(best, (key, i)) if best else (key, i)
        if not best:
            return own
        i = best[1]
        x, y = own[i], own[i + 1]
        own[i : i + 2] = [(min((-x[1], x[0]), (-y[1], y[0]))[1], x[1] + y[1], x[2], y[3])]


@pytest.mark.parametrize("similarity,kinds", [(0.6, 1000), (0.6, 3), (1.0, 1000)])
def test_runs_cut_by_borders_against_repeated_search(spark, monkeypatch, similarity, kinds):
    monkeypatch.setattr(runs, "KINDS", kinds)
    rng = np.random.default_rng(8)
    rows = []
    for f in range(3):
        at = np.cumsum(rng.choice([1, 4, 100], 250, p=[0.7, 0.27, 0.03])).tolist()
        rows += [(f, a, str(rng.choice(["mov", "movs", "movsd", "movss", "call", "callq", "cmp"])), f * 4000 + i) for i, a in enumerate(at)]
    rows += [(7, i, "call" if i % 50 else "callq", 90_000 + i) for i in range(400)] + rows[:40]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, runs.collapse_runs(events(spark, rows), "f", "at", "op", "row", similarity=similarity, max_gap=64).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    clean = sorted(set(rows), key=lambda r: (r[0], r[1], r[3]))
    want = [(f, *run) for f in (0, 1, 2, 7) for run in repeatedly_merged([(op, 1, at, at) for g, at, op, _ in clean if g == f], similarity, 64)]
    assert got == sorted(want)


# 8


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x " * 30 + item.replace(" ", "_\n").upper() + " y"), (2, item.rsplit(" ", 2)[0]), (3, None), (4, ""), (5, "filler " * 30000 + item), (None, item), (1, item)]
    items = [(10, item), (11, "short one"), (12, None), (None, item), (13, "Straße über " * 8)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash")).withColumn("w", F.lit(1))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    for shard in (1024, 1):
        assert sorted(map(tuple, leaks.leaked_items(d, i, shard=shard).collect())) == [(1, 10), (5, 10)]
    assert leaks.leaked_items(d.limit(0), i).count() == 0 and leaks.leaked_items(d, i.limit(0)).count() == 0


# 9


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["big", "small", "tiny"][min(2, i % 97 % 3 if i % 97 < 4 else 0)], int(rng.integers(1, 200))) for i in range(4000)] + [(9001, None, 5), (None, "big", 5), (9003, "big", 0), (9004, "other", 50), (1, "big", 3)]
    sizes = spark.createDataFrame(rows, "k bigint, source string, tokens bigint").withColumn("share", F.lit(9)).withColumn("step", F.lit(1))
    targets = spark.createDataFrame([("big", 0.9, 2), ("small", 0.05, 8), ("tiny", 0.05, 2), ("none", 0.1, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(sizes, targets, "k", "source", total=200_000)
    got = mix.collect()
    again = {(r.k, r.copies) for r in mixing.mix_sources(sizes.repartition(5), targets, "k", "source", total=200_000).collect()}
    assert {(r.k, r.copies) for r in got if r.k != 1} == {x for x in again if x[0] != 1} and len({r.k for r in got}) == len(got)
    used = Counter()
    for r in got:
        used[r.source] += r.tokens * r.copies
        assert 1 <= r.copies <= {"big": 2, "small": 8, "tiny": 2}[r.source]
    assert abs(used["big"] - 180_000) <= 200 and abs(used["small"] - 10_000) <= 200
    shares = {r.source: r for r in mixing.mixture_shares(mix, targets, "k").collect()}
    assert shares["none"].actual_share == 0 and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    assert mixing.mix_sources(sizes.limit(0), targets, "k", "source").count() == 0


def test_inclusion_rates(spark):
    """Over many seeds a document is copied as often as its weight says."""
    rows = [(i, "s", 10, 1.0 + (i % 3)) for i in range(600)]
    sizes = spark.createDataFrame(rows, "k bigint, source string, tokens bigint, w double")
    targets = spark.createDataFrame([("s", 1.0, 3)], "source string, target_share double, max_repeats int")
    used, seeds = Counter(), 3
    for seed in range(seeds):
        mix = mixing.mix_sources(sizes, targets, "k", "source", weight="w", total=4500, seed=seed).collect()
        assert sum(r.tokens * r.copies for r in mix) == 4500
        used.update({r.k % 3: 0 for r in mix})
        for r in mix:
            used[r.k % 3] += r.copies
    for kind in range(3):
        assert used[kind] / (200 * seeds) == pytest.approx(450 / 1200 * (1 + kind), abs=0.07)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test data")
def test_shares_of_whole_tables(spark):
    """Every source reaches its share of what was asked, or all its capped copies where those are too few."""
    at = "/root/testdata/sf0.1"
    mix = queries.p9_mix(spark, at).cache()
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", F.trim("source").alias("source"), "text")
    sizes = mixing.token_counts(docs, "doc_id", "text", ["source"], mixing.default_tokenizer(spark))
    have = {r.source: (r.t, r.m) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).collect()}
    goals = spark.read.parquet(f"{at}/mix_targets.parquet").selectExpr("trim(source) source", "target_share", "max_repeats").dropna().dropDuplicates(["source"]).collect()
    total = sum(have[g.source][0] for g in goals if g.source in have)
    used = {r.source: (r.t, r.c) for r in mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()}
    for g in goals:
        if g.source in have:
            want = min(g.target_share * total, have[g.source][0] * g.max_repeats)
            assert abs(used[g.source][0] - want) <= have[g.source][1] and used[g.source][1] <= g.max_repeats


def test_token_counts(spark):
    if not os.path.exists(mixing.default_tokenizer()):
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "k bigint, t string")
    got = {r.k: r.tokens for r in mixing.token_counts(df, "k", "t", [], mixing.default_tokenizer()).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# 10


def test_pages(spark):
    prose = "The parser reads a line, and then it stops. Nobody knows why this happens so often. "
    cases = {
        1: "\n".join(f"{i}. Fibaza malware cleaner - 14.99 [in stock]" for i in range(9)),
        2: " ".join(f"http://a{i}.test/x" for i in range(9)), 3: " ".join(["#one-tag", "#two_tag"] * 6),
        4: "cheap driver update buy driver update for Timi best driver update free driver update key " * 3,
        5: "\n".join(["Unpacker Pro", "Binary Viewer"] * 9), 6: prose * 5, 7: prose.replace(" ", "\n"),
        8: "\n".join(f"  {4096 + i:x}:\tmov   rax,rbx" for i in range(20)), 9: "\n".join(f"mov\t{i}\t3.5" for i in range(20)),
        10: None, 11: "", 12: prose * 20 + "\n" + " ".join(["#tag"] * 9), 13: prose * 3000, 14: " / ".join(f"Item{i} Pro dump reader" for i in range(12)),
    }
    df = spark.createDataFrame(list(cases.items()) + [(None, cases[1]), (1, cases[1])], "doc_id bigint, text string").withColumn("words", F.lit("clash"))
    assert sorted(r.doc_id for r in pages.stuffed_pages(df).collect()) == [1, 2, 3, 4, 5, 14]
    assert pages.stuffed_pages(df.limit(0)).count() == 0


def test_pages_of_other_lines(spark):
    names = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sa", "te", "vo") for b in ("dem", "fin", "gor", "hup", "jat", "lig", "mun", "pes")]
    lines = ["The old parser reads every line of input before it", "stops and then nobody in our group can say with", "confidence whether those results came from the cache or"]
    cases = {
        1: "\n".join(["cheap driver update buy driver update cheap driver update"] * 5), 2: ", ".join(names[:24]), 3: " ".join(names * 5),
        4: "\n".join(f"{n.title()} file cleaner {i}4.99" for i, n in enumerate(names[:9])), 5: "\n".join(f"{n} ${i}.50" for i, n in enumerate(names[:6])),
        6: "\n".join(lines), 7: "\n".join(f"{n} {i}.50" for i, n in enumerate(names[:9])), 8: ", ".join(f"{i}.5" for i in range(30)),
    }
    df = spark.createDataFrame(list(cases.items()), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in pages.stuffed_pages(df).collect()) == [1, 2, 3, 4, 5]


def test_pages_told_apart_by_binding_words():
    stuffed = [
        "cheap laptops buy laptops cheap notebooks best laptops deals laptops online cheap laptops discount notebooks buy cheap laptops best price laptops notebooks sale",
        "flights hotels insurance mortgage casino poker loans credit watches replica handbags shoes jackets phones tablets laptops cameras games movies tickets holidays cruises villas yachts",
        "cheap laptops\nbuy laptops\nbest laptops\nlaptops online\nlaptops sale\ncheap notebooks\nbuy notebooks\nbest notebooks\nnotebooks online\nnotebooks sale",
        "example.com\nshop-example.net\nbest-deals.org\ncheapstuff.info\nmysite.co.uk\nlinks4u.biz",
        "red cotton shirt men\nblue cotton shirt men\ngreen cotton shirt men\nred wool sweater women\nblue wool sweater women\nblack leather belt men",
    ]
    ordinary = [
        "2 cups flour\n1 tsp salt\n3 eggs\n1 cup milk\n2 tbsp butter\n1 tbsp sugar\n1 tsp vanilla extract\n2 tsp baking powder",
        "The rain is on the roof tonight\nand I am far from home\nO carry me, O carry me\nacross the silver foam\n" * 3,
        "The market sold apples, pears, plums, cherries, fresh figs, dried dates, walnuts, almonds and wild honey",
        "The market sold apples, pears, plums, cherries, fresh figs, dried dates, walnuts, almonds, and wild honey",
    ]
    for texts, wanted in ((stuffed, True), (ordinary, False)):
        for text in texts:
            total, found = pages.page_words(text)
            assert (2 * sum(found.values()) > total) == wanted, text


def test_pages_of_many_shapes(spark):
    words = ["Alpha", "beta", "GAMMA"]
    links = "\n".join(f"{' '.join(words[i % 3] for _ in range(n))}{mark} http://a{n}{i}.test/x" for i in range(3) for n in range(1, 6) for mark in ("", ":", " |", " -"))
    assert len(pages.page_words(links)[1]) >= 24
    df = spark.createDataFrame([(1, links)], "doc_id bigint, text string")
    assert [r.doc_id for r in pages.stuffed_pages(df).collect()] == [1]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="no test data")
def test_pages_agree_with_annotators(spark):
    """Of pages on which all of several annotators agree; the rules were written with such pages in view."""
    at = "/root/testdata/sf0.1"
    votes = spark.read.parquet(f"{at}/page_labels.parquet").groupBy("doc_id").agg(F.collect_set("label").alias("l"), F.count(F.lit(1)).alias("n")).filter("size(l) = 1 and n > 1")
    flagged = {r.doc_id for r in pages.stuffed_pages(spark.read.parquet(f"{at}/documents.parquet")).collect()}
    rows = [(r.doc_id in flagged) == (r.l[0] == "stuffed") for r in votes.collect()]
    assert sum(rows) / len(rows) > 0.97
