"""Operators on small inputs with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import tokens as tk
from weftline.operators import classify, clones, cluster, compression, distance, frequency, information, language, resample, units
from weftline.sources import disassembly


def ops(spark, rows):
    return spark.createDataFrame(rows, "seq string, unit bigint, upos int, ops array<string>")


def test_ngrams_span_units_but_not_sequences(spark):
    df = ops(spark, [("a", 1, 0, ["x", "y"]), ("a", 2, 1, ["z"]), ("a", 3, 2, []), ("a", 4, 3, ["w"]), ("b", 5, 0, ["q"])])
    u = units.as_units(df, "seq", "unit", "upos", "ops")
    got = sorted((r.n, r.gram) for r in units.unit_ngrams(u, [2, 3]).collect())
    assert got == [(2, "x y"), (2, "y z"), (2, "z w"), (3, "x y z"), (3, "y z w")]


def test_units_are_cut_without_changing_ngrams(spark):
    df = ops(spark, [("a", 1, 0, [str(i % 7) for i in range(100)]), ("a", 2, 1, ["k"] * 5)])
    whole = units.ngram_counts(units.as_units(df, "seq", "unit", "upos", "ops"), [1, 3])
    cut = units.ngram_counts(units.as_units(df, "seq", "unit", "upos", "ops", size=9), [1, 3])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


@pytest.mark.parametrize("piece", [1, 2, 1024])
def test_sequences_in_pieces(spark, monkeypatch, piece):
    """Places, contexts and shuffles don't depend on where a sequence is parted."""
    monkeypatch.setattr(units, "PIECE", piece)
    monkeypatch.setattr(units, "TOKENS", piece * 3)
    rows = [(s, 10 * i + k, i, [f"{s}{i}_{j}" for j in range((i * 7 + k) % 5)]) for s in "ab" for i in range(9) for k in range(2)]
    u = units.as_units(ops(spark, rows), "seq", "unit", "upos", "ops")
    whole = {s: [t for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])) for t in r[3]] for s in "ab"}
    placed = units.positions(u).collect()
    assert {s: [r.tok for r in sorted(placed, key=lambda r: r.gpos) if r.seq == s] for s in "ab"} == whole
    assert all(sorted(r.gpos for r in placed if r.seq == s) == list(range(len(whole[s]))) for s in "ab")
    grams = sorted((s, " ".join(whole[s][i : i + 4])) for s in "ab" for i in range(len(whole[s]) - 3))
    assert sorted((r.seq, r.gram) for r in units.unit_ngrams(u, [4]).collect()) == grams
    assert sorted((r.seq, r.gram) for r in units.position_ngrams(units.positions(u), [4]).collect()) == grams
    mixed = units.shuffled(u, 3).collect()
    assert sorted((r.seq, r.gpos) for r in mixed) == sorted((r.seq, r.gpos) for r in placed) and sorted(r.tok for r in mixed) == sorted(r.tok for r in placed)


def test_norm_operand(spark):
    rows = [("[rip+0x2f] # 0040a0", "f"), ("[rip+0x2f]", "f"), ("4010 <g+0x8>", "f"), ("4010 <f+0x8>", "f"), ("4010a", "f"), ("0x8", "f"), ("401 <f>", None), ("[rip+0x1] # 0", "f")]
    df = spark.createDataFrame(rows, "op string, name string")
    got = [r.x for r in df.select(classify.norm_operand(F.col("op"), F.col("name")).alias("x")).collect()]
    assert got == ["DATA@40a0", "[rip+ADDR]", "SYM:g", "SELFREL", "REL", "0x8", "SYM:f", "DATA@0"]
    named = df.select(classify.norm_operand(F.col("op"), F.col("name"), lambda a: F.when(a == "40a0", "usage")).alias("x")).collect()
    assert [named[0].x, named[7].x] == ["STR:usage", "DATA@0"]


def test_entropy_of_a_fair_coin_and_of_nothing(spark):
    counts = spark.createDataFrame([("g", "h", 4), ("g", "t", 4), ("one", "x", 3)], "k string, tok string, c bigint")
    h = {r.k: r.h for r in information.entropy(counts, ["k"]).collect()}
    assert h["g"] == pytest.approx(1.0) and h["one"] == pytest.approx(0.0)
    assert information.entropy(counts.limit(0), ["k"]).count() == 0


def test_mutual_information_of_a_copy_is_the_entropy(spark):
    pairs = spark.createDataFrame([(1, "a", "a"), (1, "b", "b")] * 5, "lag bigint, x string, y string")
    assert information.mutual_information(pairs, ["lag"]).first().mi == pytest.approx(1.0)


def test_zipf_mle_recovers_the_exponent(spark):
    rows = [(f"t{r}", int(1e7 * r**-1.3), r) for r in range(1, 200)]
    fit = frequency.zipf_mle(spark.createDataFrame(rows, "tok string, c bigint, rank bigint")).first()
    assert fit.alpha == pytest.approx(1.3, abs=0.002)


def test_vocabulary_and_unknown_tokens(spark):
    u = units.as_units(ops(spark, [("a", 1, 0, ["b", "a", "z"])]), "seq", "unit", "upos", "ops")
    vocab = frequency.vocabulary(spark.createDataFrame([("b", 1), ("a", 1)], "tok string, c bigint"))
    assert frequency.encode(u, vocab).first().ids == [1, 0, 2]


def test_language_model_by_hand(spark):
    seqs = spark.createDataFrame([(1, ["a", "b", "a", "b"])], "seq bigint, tokens array<string>")
    model = language.train(seqs, [1, 2])
    row = language.cross_entropy(model, seqs, [2], []).first()
    # contexts: <BOS>:a 1, a:b 2, b:a 1; two words
    want = -(np.log2(2 / 3) + 2 * np.log2(3 / 4) + np.log2(2 / 3)) / 4
    assert row.tokens == 4 and row.cross_entropy == pytest.approx(want)


def test_lz78_by_hand():
    assert compression.phrases(list("ababab")) == 4  # a, b, ab, (ab)
    assert compression.phrases([]) == 0
    assert compression.phrases(["x"]) == 1


def brute_local(x, y):
    h = np.zeros((len(x) + 1, len(y) + 1))
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x[i - 1] == y[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def brute_common(x, y):
    t = np.zeros((len(x) + 1, len(y) + 1), int)
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            t[i, j] = t[i - 1, j - 1] + 1 if x[i - 1] == y[j - 1] else max(t[i - 1, j], t[i, j - 1])
    return t[-1, -1]


short = st.lists(st.sampled_from("abcd"), max_size=12)


@settings(max_examples=80, deadline=None)
@given(short, short)
def test_alignments_against_tables(x, y):
    a, b = np.array(x, object), np.array(y, object)
    assert clones.local_score(a, b) == brute_local(x, y) == clones.local_score(b, a)
    assert clones.common_length(a, b) == brute_common(x, y) == len(clones.common_subsequence(x, y))
    assert clones.global_score(a, a) == len(x)


def test_clone_types(spark):
    rows = spark.createDataFrame([(0.96, 0.9), (0.96, 0.5), (0.8, 0.8), (0.6, 0.1), (0.4, 0.9), (0.55, 0.9)], "j double, s double")
    got = [r[0] for r in rows.select(clones.clone_type(F.col("j"), F.col("s"))).collect()]
    assert got == [1, 2, 2, 0, 0, 3]


def test_similar_units_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):  # pairs of about 0.5 to 0.6, of which eight bands of four find under two thirds
        base = [f"o{x}" for x in rng.integers(0, 300, 40)]
        rows += [base, base[:28] + [f"o{x}" for x in rng.integers(0, 300, 11)]]
    sets = [{" ".join(r[i : i + 3]) for i in range(len(r) - 2)} for r in rows]
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j])}
    units = spark.createDataFrame(list(enumerate(rows)) + [(999, ["a"])], "unit bigint, ops array<string>")
    assert len(want) >= 50 and {(r.a, r.b) for r in clones.similar_units(units, 3, 0.5).collect()} == want


def test_clones_hold_all_pairs_of_the_table(spark, folder):
    from weftline.plans import similarity

    reps = {r.unit: r.ops for r in similarity._reps(spark, folder).collect()}
    sets = {u: {" ".join(o[i : i + 3]) for i in range(len(o) - 2)} for u, o in reps.items()}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    score = lambda x, y: clones.local_score(np.array(x, object), np.array(y, object)) / (2 * min(len(x), len(y)))
    want = {(a, b) for a, b in alike if score(reps[a], reps[b]) >= 0.3}
    assert {(r.a, r.b) for r in similarity.found_clones(spark, folder).collect()} == want


def test_families_fold_in_order(spark):
    rows = spark.createDataFrame([("f", 2, list("abxc")), ("f", 1, list("abcd")), ("g", 3, list("zz"))], "family string, unit bigint, ops array<string>")
    got = {r.family: (r.size, r.core) for r in clones.families(rows).collect()}
    assert got == {"f": (2, "a b c"), "g": (1, "z z")}


def test_families_use_whole_sequences(spark):
    rows = spark.createDataFrame([("f", 1, ["a"] * 200 + ["b"] * 200), ("f", 2, ["a"] * 200 + ["c"] * 600)], "family string, unit bigint, ops array<string>")
    (got,) = clones.families(rows).collect()
    assert got.core == " ".join(["a"] * 200) and got.divergence == pytest.approx(1 - 200 / 600)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
def test_common_subsequence_against_table(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i][j + 1], t[i + 1][j])
    i, j, want = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            want.append(x[i - 1])
            i, j = i - 1, j - 1
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    assert clones.common_subsequence(x, y) == want[::-1]


def test_motifs_of_all_lengths(spark, folder):
    from collections import Counter

    from weftline.plans import common, registry

    rows = [r.ops for r in common.functions(spark, folder).select("ops").collect()]
    seen, held = Counter(), Counter()
    for o in rows:
        found = [(k, " ".join(o[i : i + k])) for k in range(4, 13) for i in range(len(o) - k + 1)]
        seen.update(found)
        held.update(set(found))
    want = {(*m, held[m], c) for m, c in seen.items() if c >= max(5, len(rows) * 5 // 1000) and held[m] >= max(1, len(rows) // 100)}
    got = {(r.k, r.motif, r.units, r.occurrences) for r in registry.queries()["motifs_k_all"](spark, folder).collect()}
    assert got == want and max(k for k, *_ in got) > 6
    assert {r.k for r in registry.queries()["motif_topk_all"](spark, folder).collect()} == {k for k, *_ in want}


def test_components_chain_cycle_and_self(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 5)], "a bigint, b bigint")
    got = {r.id: r.component for r in cluster.components(links, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100, 200: 200}


def test_linkage_and_silhouette(spark):
    d = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("b", "c", 0.8), ("c", "d", 0.1), ("a", "d", 0.9), ("b", "d", 0.9)], "a string, b string, d double")
    got = {r.id: r.cluster for r in cluster.linkage_labels(d, 0.5).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c"}
    labels = spark.createDataFrame(got.items(), "id string, label string")
    assert cluster.silhouette(d, labels).first().silhouette > 0.85
    with pytest.raises(ValueError):
        cluster.linkage_labels(d, 0.5, most=3)


def test_rank_sum_by_hand(spark):
    rows = spark.createDataFrame([("w", 1.0), ("w", 2.0), ("b", 3.0), ("b", 4.0), ("b", 2.0)], "g string, v double")
    r = distance.rank_sum(rows, "g", "v", "w", "b").first()
    assert (r.n1, r.n2, r.u) == (2, 3, 0.5) and 0 < r.p < 0.2


def test_permutation_is_small_for_real_groups(spark):
    ids = [(f"i{k}", "x" if k < 5 else "y") for k in range(10)]
    pairs = [(a, b, 0.1 if la == lb else 0.9) for i, (a, la) in enumerate(ids) for b, lb in ids[i + 1 :]]
    r = distance.permutation_p(spark.createDataFrame(pairs, "a string, b string, v double"), spark.createDataFrame(ids, "seq string, label string"), 99).first()
    assert r.observed == pytest.approx(-0.8) and r.p < 0.1


def test_roles_and_operands(spark):
    rows = spark.createDataFrame([("xor", "eax,eax"), ("mov", "rdi, 0x5"), ("nop", None), ("add", "rax,[rbx,1]"), ("sub", "rax,rbx"), (None, None)], "m string, o string")
    got = [tuple(r) for r in rows.select(classify.role(F.col("m"), F.col("o")), F.size(classify.operand_list(F.col("o")))).collect()]
    assert got == [("set-imm rax", 2), ("set-imm rdi", 2), ("pad", 0), ("add", 2), ("sub", 2), (None, 0)]
    token = rows.select(classify.bucket_token(F.col("m"), F.col("o"))).collect()
    assert token[1][0] == "mov_reg_imm_small" and token[3][0] == "add_reg_mem"


LISTING = """junk before
0000000000001000 <f>:
f():
/src/a.c:10
  1000:\tpush   rbp
  1001:\tmov    edi,0x1
0000000000002000 <g>:
  2000:\trep stos
  2002:\t(bad)
0000000000003000 <empty>:
0000000000004000 <f>:
  4000:\tret"""


def test_listing(spark):
    files = spark.createDataFrame([(1, LISTING), (2, None), (3, "")], "k bigint, t string")
    rows = disassembly.parse_listing(disassembly.lines_of(files, "k", "t"))
    got = sorted((r.func, r.pos, r.address, r.mnemonic, r.operands) for r in rows.collect())
    assert got == [("f", 0, 0x4000, "ret", ""), ("g", 0, 0x2000, "rep", "stos")]
    raw = "00001000 <f>:\n  1000:\t48 89 e5\tmov    rbp,rsp\n  1003:\t00 00 00 ad \n"
    rows = disassembly.parse_listing(disassembly.lines_of(spark.createDataFrame([(1, raw)], "k bigint, t string"), "k", "t"), raw_bytes=True)
    assert [r.mnemonic for r in rows.collect()] == ["mov"]


def test_strings_in_segments(spark):
    segments = spark.createDataFrame([(4090, bytearray(b"xyhello\0world\0"))], "base bigint, content binary")
    asked = spark.createDataFrame([(4092,), (4098,), (9000,), (4097,)], "address bigint")
    got = sorted((r.address, r.text) for r in disassembly.resolve_addresses(asked, segments).collect())
    assert got == [(4092, "hello"), (4098, "world")]


def test_files(spark, tmp_path):
    (tmp_path / "seqs").mkdir()
    (tmp_path / "seqs" / "nm.txt").write_text("mov\n\npush\n")
    assert [tuple(r) for r in disassembly.load_sequences(spark, str(tmp_path / "seqs")).collect()] == [("nm", ["mov", "push"])]
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "a").write_bytes(b"\x7fELF123")
    (tmp_path / "bin" / "b").write_bytes(b"#!/bin/sh")
    assert disassembly.elf_files(spark, str(tmp_path / "bin")).count() == 1


def test_leave_one_out_equals_recount(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "x", 2), ("c", "z", 5)], "seq string, tok string, c bigint")
    got = {r.seq: r.h for r in resample.leave_one_out(counts).collect()}
    for s in "abc":
        rest = counts.filter(F.col("seq") != s).groupBy("tok").agg(F.sum("c").alias("c"))
        assert got[s] == pytest.approx(resample.entropy_of(rest.withColumn("k", F.lit(1)), ["k"]).first().h)


def test_scalar_guards(spark):
    df = spark.createDataFrame([([],), (["a"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(tk.ngrams(F.col("t"), 2)).collect()][:2] == [[], []]
    assert [r[0] for r in df.select(tk.chunks(F.col("t"), 2)).collect()][:2] == [[], [["a"]]]
    assert spark.range(1).select(tk.band(F.lit(0.5), [0.1, 0.6], ["a", "b", "c"])).first()[0] == "b"


def test_stream_equals_batch(spark, tmp_path):
    from weftline.streaming.counts import run_to_table, stream_ngrams, stream_windows

    rows = spark.createDataFrame([(["a", "b", "a", "b"],), (["b"],)], "ops array<string>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run_to_table(stream_ngrams(stream, 2), "stream_test", str(tmp_path / "cp"))
    assert sorted(map(tuple, spark.table("stream_test").collect())) == [("a b", 2), ("b a", 1)]
    events = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:11:00", "y")], "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "ev"))
    windows = stream_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")), "ts", "kind", "5 minutes", "10 minutes")
    run_to_table(windows, "stream_windows_test", str(tmp_path / "cp2"))
    assert sorted((r.kind, r.c) for r in spark.table("stream_windows_test").collect()) == [("x", 2), ("y", 1)]
