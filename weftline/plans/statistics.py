"""Queries on frequencies, n-grams, motifs, information and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import band, chunks, ngrams, systematic_sample
from weftline.operators import frequency as fq
from weftline.operators import information as info
from weftline.operators import language as lm
from weftline.operators import motifs as mo
from weftline.operators import units as un
from weftline.plans.common import SQL_D, SQL_E, SQL_F, SQL_H, SQL_T, functions, programs, r6, sql_grams, texts, user_days, users
from weftline.session import cut
from weftline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


COUNTS = f"WITH {SQL_T}, c AS (SELECT tok, count(*) AS c FROM t GROUP BY tok), r AS (SELECT tok, c, row_number() OVER (ORDER BY c DESC, tok) AS rank, c / sum(c) OVER () AS rel FROM c)"


@query("normalize_token", "SELECT mnemonic AS raw, lower(trim(split_part(split_part(mnemonic, '@', 1), '.', 1))) AS opcode, count(*) AS n FROM instructions GROUP BY ALL")
def _(spark, folder):
    from weftline.functions.tokens import normalize_token

    rows = table(spark, folder, "instructions").groupBy(F.col("mnemonic").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("raw", normalize_token(F.col("raw")).alias("opcode"), "n")


@query("token_freq", f"{COUNTS} SELECT tok, c FROM c")
def token_freq(spark, folder):
    return fq.token_counts(programs(spark, folder))


@query("rank_freq", f"{COUNTS} SELECT tok, c, rank, round(rel, 9) AS rel FROM r")
def rank_freq(spark, folder):
    return fq.rank_frequency(token_freq(spark, folder)).select("tok", "c", "rank", F.round("rel", 9).alias("rel"))


def _ranks(spark, folder) -> DataFrame:
    return fq.rank_frequency(token_freq(spark, folder))


@query("zipf_ols", f"{COUNTS} SELECT round(-regr_slope(ln(c), ln(rank)), 6) AS alpha, round(ln(exp(regr_intercept(ln(c), ln(rank)))), 6) AS ln_scale, round(regr_r2(ln(c), ln(rank)), 6) AS r2, count(*) AS v FROM r")
def _(spark, folder):
    return fq.zipf_ols(_ranks(spark, folder)).select(r6("alpha").alias("alpha"), r6(F.log("scale")).alias("ln_scale"), r6("r2").alias("r2"), "v")


@query("zipf_ols_ci")
def _(spark, folder):
    return fq.zipf_bootstrap(_ranks(spark, folder), 200, 42)


ZIPF = f"""WITH RECURSIVE {SQL_T}, c AS (SELECT tok, count(*) AS c FROM t GROUP BY tok), r AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c DESC, tok) AS rank FROM c),
s AS MATERIALIZED (SELECT sum(c * ln(rank)) / sum(c) AS target, count(*) AS v, sum(c) AS n FROM r),
it AS (SELECT 0 AS k, CAST(1.0 AS DOUBLE) AS a UNION ALL
  SELECT k + 1, least(greatest(a + (list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a) * ln(x))) / list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a))) - target)
    / (list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a) * ln(x) * ln(x))) / list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a)))
      - pow(list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a) * ln(x))) / list_sum(list_transform(range(1, v + 1), lambda x: pow(x, -a))), 2)), 0.01), 15.0) FROM it, s WHERE k < 12),
fit AS MATERIALIZED (SELECT a AS alpha FROM it WHERE k = 12)"""


@query("zipf_mle", f"{ZIPF} SELECT round(alpha, 6) AS alpha, CAST(n AS BIGINT) AS n, v FROM fit, s")
def _(spark, folder):
    return fq.zipf_mle(_ranks(spark, folder)).select(r6("alpha").alias("alpha"), "n", "v")


@query("zipf_ks", f"{ZIPF}, cum AS (SELECT sum(c) OVER w AS cc, sum(pow(rank, -alpha)) OVER w AS cp FROM r, fit WINDOW w AS (ORDER BY rank)) SELECT round(max(abs(cc / (SELECT max(cc) FROM cum) - cp / (SELECT max(cp) FROM cum))), 6) AS ks FROM cum")
def _(spark, folder):
    ranks = cut(_ranks(spark, folder))
    return fq.zipf_ks(ranks, fq.zipf_mle(ranks)).select(r6("ks").alias("ks"))


@query("zipf_llr", f"""{ZIPF}, z AS (SELECT sum(pow(rank, -alpha)) AS z FROM r, fit), m AS (SELECT avg(ln(c)) AS mu, stddev_pop(ln(c)) AS sd FROM r),
a AS (SELECT sum(-alpha * c * ln(rank)) - sum(c) * ln(any_value(z)) AS zipf FROM r, fit, z), b AS (SELECT sum(-ln(c) - ln(sd * sqrt(2 * pi())) - pow(ln(c) - mu, 2) / (2 * sd * sd)) AS lognormal FROM r, m)
SELECT round(zipf, 3) AS zipf, round(lognormal, 3) AS lognormal, round(zipf - lognormal, 3) AS ratio FROM a, b""")
def _(spark, folder):
    ranks = cut(_ranks(spark, folder))
    return fq.zipf_against_lognormal(ranks, fq.zipf_mle(ranks)).select(*[F.round(c, 3).alias(c) for c in ("zipf", "lognormal", "ratio")])


@query("zipf_per_seq", f"""WITH {SQL_T}, c AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL), r AS (SELECT seq, c, row_number() OVER (PARTITION BY seq ORDER BY c DESC, tok) AS rank FROM c)
SELECT seq, CASE WHEN count(*) >= 2 THEN round(-regr_slope(ln(c), ln(rank)), 6) ELSE 0.0 END AS alpha, CASE WHEN count(*) >= 2 THEN round(regr_r2(ln(c), ln(rank)), 6) ELSE 0.0 END AS r2, count(*) AS v FROM r GROUP BY seq""")
def _(spark, folder):
    ranks = fq.rank_frequency(fq.token_counts(programs(spark, folder), ["seq"]), ["seq"])
    return fq.zipf_ols(ranks, ["seq"]).select("seq", r6("alpha").alias("alpha"), r6("r2").alias("r2"), "v")


@query("top_tokens", f"{COUNTS} SELECT tok, c, rank FROM r WHERE rank <= 50")
def _(spark, folder):
    return _ranks(spark, folder).filter("rank <= 50").select("tok", "c", "rank")


@query("bottom_tokens", f"{COUNTS} SELECT tok, c FROM r ORDER BY c, tok LIMIT 10")
def _(spark, folder):
    return token_freq(spark, folder).orderBy("c", "tok").limit(10)


@query("vocab", f"WITH {SQL_T} SELECT tok, row_number() OVER (ORDER BY tok) - 1 AS id FROM (SELECT DISTINCT tok FROM t)")
def vocab(spark, folder):
    return fq.vocabulary(token_freq(spark, folder))


@query("encode_sequence", f"""WITH {SQL_T}, k AS (SELECT tok FROM t GROUP BY tok HAVING count(*) >= 3), v AS (SELECT tok, row_number() OVER (ORDER BY tok) - 1 AS id FROM k)
SELECT unit, string_agg(CAST(coalesce(id, (SELECT count(*) FROM k)) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM t LEFT JOIN v USING (tok) WHERE seq IS NOT NULL GROUP BY unit""")
def _(spark, folder):
    units = programs(spark, folder)
    known = fq.vocabulary(fq.token_counts(units).filter("c >= 3"))
    rows = fq.encode(units, known)
    return rows.select("unit", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("corpus_summary", f"""WITH {SQL_T}, p AS (SELECT seq, count(*) AS n FROM t GROUP BY seq)
SELECT count(*) AS programs, (SELECT count(*) FROM f) AS functions, CAST(sum(n) AS BIGINT) AS tokens, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, (SELECT count(DISTINCT tok) FROM t) AS vocabulary FROM p""")
def _(spark, folder):
    f = cut(functions(spark, folder))
    per = f.groupBy("binary_name").agg(F.sum("size").alias("n")).filter("n > 0")
    sums = per.agg(F.count(F.lit(1)).alias("programs"), F.sum("n").alias("tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), r6(F.avg("n")).alias("mean"))
    one = f.agg(F.count(F.lit(1)).alias("functions")), f.select(F.explode("ops").alias("tok")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    return sums.join(F.broadcast(one[0])).join(F.broadcast(one[1]))


GRAMS = f"WITH {SQL_T}, {sql_grams(5)}, c AS (SELECT n, gram, count(*) AS c FROM g WHERE seq IS NOT NULL GROUP BY ALL)"


def _counts(spark, folder, lengths=(1, 2, 3, 4, 5)) -> DataFrame:
    return un.ngram_counts(programs(spark, folder), list(lengths))


for _n in (2, 3, 4, 5):
    query(f"ngram_counts_{_n}", f"{GRAMS} SELECT gram, c FROM c WHERE n = {_n}")(lambda spark, folder, n=_n: _counts(spark, folder, [n]).select("gram", "c"))
    query(f"top_ngrams_{_n}", f"{GRAMS} SELECT gram, c FROM c WHERE n = {_n} ORDER BY c DESC, gram LIMIT 50")(lambda spark, folder, n=_n: _counts(spark, folder, [n]).select("gram", "c").orderBy(F.desc("c"), "gram").limit(50))

RATES = f"{GRAMS}, h AS (SELECT n, {SQL_H} AS h, count(*) AS distinct_grams, CAST(sum(c) AS BIGINT) AS total FROM c GROUP BY n), e AS (SELECT n, h, h / n AS rate, h - coalesce(lag(h) OVER (ORDER BY n), 0) AS conditional, distinct_grams, total FROM h)"


def _rates(spark, folder) -> DataFrame:
    return info.entropy_rates(_counts(spark, folder))


@query("entropy_rates", f"{RATES} SELECT CAST(n AS BIGINT) AS n, round(h, 6) + 0.0 AS h, round(rate, 6) + 0.0 AS rate, round(conditional, 6) + 0.0 AS conditional, distinct_grams, total FROM e")
def _(spark, folder):
    return _rates(spark, folder).select("n", r6("h").alias("h"), r6("rate").alias("rate"), r6("conditional").alias("conditional"), F.col("distinct").alias("distinct_grams"), "total")


@query("ngram_summary", f"{RATES} SELECT CAST(n AS BIGINT) AS n, distinct_grams, total, round(h, 6) AS h, round(log2((SELECT count(*) FROM c WHERE n = 1)), 6) AS max_token_entropy, round(log2(distinct_grams), 6) AS max_gram_entropy, round(h / log2(distinct_grams), 6) AS normalized FROM e")
def _(spark, folder):
    rates = cut(_rates(spark, folder))
    v = rates.filter("n = 1").select(F.col("distinct").alias("v"))
    both = rates.join(F.broadcast(v))
    return both.select("n", F.col("distinct").alias("distinct_grams"), "total", r6("h").alias("h"), r6(F.log2("v")).alias("max_token_entropy"), r6(F.log2("distinct")).alias("max_gram_entropy"), r6(F.try_divide(F.col("h"), F.log2("distinct"))).alias("normalized"))


SEQ_RATES = f"""WITH {SQL_T}, {sql_grams(3)}, c AS (SELECT seq, n, gram, count(*) AS c FROM g WHERE seq IS NOT NULL GROUP BY ALL), h AS (SELECT seq, n, {SQL_H} AS h FROM c GROUP BY ALL)
SELECT seq, CAST(n AS BIGINT) AS n, round(h, 6) + 0.0 AS h, round(h / n, 6) + 0.0 AS rate, round(h - coalesce(lag(h) OVER (PARTITION BY seq ORDER BY n), 0), 6) + 0.0 AS conditional FROM h"""


@query("entropy_rates_per_seq", SEQ_RATES)
def _(spark, folder):
    rates = info.entropy_rates(un.ngram_counts(programs(spark, folder), [1, 2, 3], by_seq=True), ["seq"])
    return rates.select("seq", "n", r6("h").alias("h"), r6("rate").alias("rate"), r6("conditional").alias("conditional"))


SHUFFLED = f"""WITH {SQL_T}, s AS (SELECT seq, tok, row_number() OVER (PARTITION BY seq ORDER BY md5(seq || '|' || gpos || '|' || 42), gpos) - 1 AS gpos FROM t WHERE seq IS NOT NULL),
{sql_grams(3, "s")}, c AS (SELECT n, gram, count(*) AS c FROM g GROUP BY ALL), hs AS (SELECT n, {SQL_H} AS h FROM c GROUP BY n)"""


def _shuffled_rates(spark, folder) -> DataFrame:
    grams = un.position_ngrams(un.shuffled(programs(spark, folder), 42), [1, 2, 3])
    return info.entropy_rates(grams.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c")))


@query("entropy_rates_shuffled", f"{SHUFFLED} SELECT CAST(n AS BIGINT) AS n, round(h, 6) AS h, round(h / n, 6) AS rate FROM hs")
def _(spark, folder):
    return _shuffled_rates(spark, folder).select("n", r6("h").alias("h"), r6("rate").alias("rate"))


@query("entropy_gain", f"{SHUFFLED}, {sql_grams(3).replace('g AS', 'g0 AS', 1)}, c0 AS (SELECT n, gram, count(*) AS c FROM g0 WHERE seq IS NOT NULL GROUP BY ALL), h0 AS (SELECT n, {SQL_H} AS h FROM c0 GROUP BY n) SELECT CAST(n AS BIGINT) AS n, round((hs.h - h0.h) / n, 6) + 0.0 AS gain FROM hs JOIN h0 USING (n)")
def _(spark, folder):
    real = info.entropy_rates(_counts(spark, folder, [1, 2, 3])).select("n", F.col("rate").alias("real"))
    return _shuffled_rates(spark, folder).join(real, "n").select("n", r6(F.col("rate") - F.col("real")).alias("gain"))


@query("predictability", f"{RATES}, p AS (SELECT (SELECT rate FROM e WHERE n = 5) / (SELECT log2(distinct_grams) FROM e WHERE n = 1) AS ratio, (SELECT arg_min(n, rate) FROM e WHERE n >= 2) AS best_n) SELECT round(ratio, 6) AS ratio, CAST(best_n AS BIGINT) AS best_n, CASE WHEN ratio < 0.1 THEN 'extreme' WHEN ratio < 0.3 THEN 'high' WHEN ratio < 0.6 THEN 'moderate' WHEN ratio < 0.8 THEN 'some' ELSE 'low' END AS level FROM p")
def _(spark, folder):
    row = _rates(spark, folder).agg(F.max(F.when(F.col("n") == 5, F.col("rate"))).alias("r5"), F.max(F.when(F.col("n") == 1, F.log2("distinct"))).alias("m"), F.min_by(F.when(F.col("n") >= 2, F.col("n")), F.when(F.col("n") >= 2, F.col("rate"))).alias("best_n"))
    ratio = F.try_divide(F.col("r5"), F.col("m"))
    return row.select(r6(ratio).alias("ratio"), "best_n", band(ratio, [0.1, 0.3, 0.6, 0.8], ["extreme", "high", "moderate", "some", "low"]).alias("level"))


@query("entropy_decay", f"{RATES} SELECT round((a.rate - b.rate) / a.rate, 6) AS decay FROM e a, e b WHERE a.n = 2 AND b.n = 5")
def _(spark, folder):
    row = _rates(spark, folder).agg(F.max(F.when(F.col("n") == 2, F.col("rate"))).alias("a"), F.max(F.when(F.col("n") == 5, F.col("rate"))).alias("b"))
    return row.select(r6(F.try_divide(F.col("a") - F.col("b"), F.col("a"))).alias("decay"))


@query("cond_entropy", f"{GRAMS}, b AS (SELECT split_part(gram, ' ', 1) AS a, c FROM c WHERE n = 2), p AS (SELECT a, {SQL_H} AS h FROM b GROUP BY a), q AS (SELECT gram AS a, c FROM c WHERE n = 1) SELECT round(sum(q.c * h) / (SELECT sum(c) FROM q), 6) AS conditional FROM p JOIN q USING (a)")
def _(spark, folder):
    c = cut(_counts(spark, folder, [1, 2]))
    firsts = info.entropy(c.filter("n = 2").select(F.substring_index("gram", " ", 1).alias("a"), "c"), ["a"])
    ones = c.filter("n = 1").select(F.col("gram").alias("a"), F.col("c").alias("w"))
    total = ones.agg(F.sum("w").alias("t"))
    return firsts.join(ones, "a").agg(F.sum(F.col("w") * F.col("h")).alias("s")).join(F.broadcast(total)).select(r6(F.col("s") / F.col("t")).alias("conditional"))


@query("space_coverage", f"{GRAMS}, v AS (SELECT count(*) AS v FROM c WHERE n = 1), k AS (SELECT n, count(*) AS u, sum(c) AS t FROM c WHERE n <= 4 GROUP BY n) SELECT CAST(n AS BIGINT) AS n, u AS unique_grams, CAST(t AS BIGINT) AS total, round(log10(u / pow(v, n)), 6) + 0.0 AS log_coverage, round((t - u) / t, 6) AS redundancy FROM k, v")
def _(spark, folder):
    c = cut(_counts(spark, folder, [1, 2, 3, 4]))
    out = info.space_coverage(c, c.filter("n = 1"))
    return out.select("n", F.col("unique").alias("unique_grams"), "total", r6(F.log10("coverage")).alias("log_coverage"), r6("redundancy").alias("redundancy"))


@query("fast_compression", f"WITH {SQL_T}, c AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL) SELECT seq, round(CASE WHEN count(*) > 1 THEN ({SQL_H}) / log2(count(*)) ELSE 1.0 END, 6) + 0.0 AS entropy_ratio, round(count(*) / sum(c), 6) AS unique_ratio FROM c GROUP BY seq")
def _(spark, folder):
    h = info.entropy(fq.token_counts(programs(spark, folder), ["seq"]), ["seq"])
    return h.select("seq", r6(F.when(F.col("distinct") > 1, F.col("h") / F.log2("distinct")).otherwise(1.0)).alias("entropy_ratio"), r6(F.col("distinct") / F.col("total")).alias("unique_ratio"))


@query("fast_summary", f"WITH {SQL_T}, c AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY c DESC, tok) AS k FROM c) SELECT tok, CAST(sum(c) AS BIGINT) AS c FROM r WHERE k <= 50 GROUP BY tok")
def _(spark, folder):
    ranks = fq.rank_frequency(fq.token_counts(programs(spark, folder), ["seq"]), ["seq"])
    return ranks.filter("rank <= 50").groupBy("tok").agg(F.sum("c").alias("c"))


@query("pattern_stats", f"{GRAMS}, p AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY c DESC, gram) AS k FROM c WHERE n <= 2) SELECT CAST(n AS BIGINT) AS n, gram, c, k AS rank FROM p WHERE k <= 10")
def _(spark, folder):
    w = Window.partitionBy("n").orderBy(F.desc("c"), "gram")
    return _counts(spark, folder, [1, 2]).withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 10")


@query("shingles_3", f"WITH {SQL_F}, s AS (SELECT function_id AS unit, unnest(list_distinct(list_transform(range(len(ops) - 2), lambda i: array_to_string(ops[i + 1 : i + 3], ' ')))) AS shingle FROM f WHERE len(ops) >= 3) SELECT * FROM s")
def _(spark, folder):
    return functions(spark, folder).select(F.col("function_id").alias("unit"), F.explode(F.array_distinct(ngrams(F.col("ops"), 3))).alias("shingle"))


@query("systematic_sample", f"WITH {SQL_F} SELECT function_id AS unit, array_to_string(CASE WHEN len(ops) <= 20 THEN ops ELSE list_slice(list_filter(ops, lambda x, i: (i - 1) % (len(ops) // 20) = 0), 1, 20) END, ' ') AS sample FROM f")
def _(spark, folder):
    return functions(spark, folder).select(F.col("function_id").alias("unit"), F.array_join(systematic_sample(F.col("ops"), 20), " ").alias("sample"))


@query("chunk_sequence", f"WITH {SQL_F} SELECT function_id AS unit, k, array_to_string(ops[k * 16 + 1 : k * 16 + 16], ' ') AS chunk FROM (SELECT function_id, ops, unnest(range(CAST(ceil(len(ops) / 16) AS BIGINT))) AS k FROM f)")
def _(spark, folder):
    rows = functions(spark, folder).select(F.col("function_id").alias("unit"), F.posexplode(chunks(F.col("ops"), 16)).alias("k", "chunk"))
    return rows.select("unit", F.col("k").cast("bigint").alias("k"), F.array_join("chunk", " ").alias("chunk"))


@query("adaptive_weights", f"""WITH {SQL_F}, x AS (SELECT function_id AS unit, unnest(range(len(ops))) AS pos, ops, len(ops) AS n FROM f)
SELECT unit, pos, (CASE WHEN pos <= 5 THEN 3.0 ELSE 1.0 END) * (CASE WHEN pos >= n - 6 THEN 3.0 ELSE 1.0 END) * (CASE WHEN pos > 0 AND ops[pos + 1] <> ops[pos] THEN 1.5 ELSE 1.0 END)::DOUBLE AS weight FROM x""")
def _(spark, folder):
    rows = functions(spark, folder).select(F.col("function_id").alias("unit"), F.size("ops").alias("n"), "ops", F.posexplode("ops").alias("p", "tok"))
    p, n = F.col("p"), F.col("n")
    change = F.when((p > 0) & (F.get("ops", p - 1) != F.col("tok")), 1.5).otherwise(1.0)
    return rows.select("unit", p.cast("bigint").alias("pos"), (F.when(p <= 5, 3.0).otherwise(1.0) * F.when(p >= n - 6, 3.0).otherwise(1.0) * change).alias("weight"))


# Motifs and positions

MOTIFS = f"""WITH {SQL_F}, m AS (SELECT function_id AS unit, k, unnest(list_transform(range(len(ops) - k + 1), lambda i: array_to_string(ops[i + 1 : i + k], ' '))) AS motif FROM f, (SELECT unnest([4, 5, 6]) AS k) WHERE len(ops) >= k),
c AS (SELECT k, motif, count(DISTINCT unit) AS units, count(*) AS occurrences FROM m GROUP BY ALL), n AS (SELECT count(*) AS n FROM f),
q AS (SELECT k, motif, units, occurrences, units / n AS coverage FROM c, n WHERE occurrences >= greatest(5, n * 5 // 1000) AND units >= greatest(1, n // 100)),
r AS (SELECT *, units * coverage AS score, row_number() OVER (PARTITION BY k ORDER BY units * coverage DESC, motif) AS rank FROM q)"""


def _motifs(spark, folder) -> DataFrame:
    f = cut(functions(spark, folder).select(F.col("function_id").alias("unit"), "ops"))
    return mo.frequent_motifs(mo.motif_counts(f, [4, 5, 6]), f.agg(F.count(F.lit(1)).alias("n")))


@query("motifs_k", f"{MOTIFS} SELECT CAST(k AS BIGINT) AS k, motif, units, occurrences, round(coverage, 9) AS coverage FROM q")
def _(spark, folder):
    return _motifs(spark, folder).select("k", "motif", "units", "occurrences", F.round("coverage", 9).alias("coverage"))


@query("motif_topk", f"{MOTIFS} SELECT CAST(k AS BIGINT) AS k, motif, rank, round(score, 6) AS score FROM r WHERE rank <= 100")
def _(spark, folder):
    return mo.top_motifs(_motifs(spark, folder), 100).select("k", "motif", "rank", r6("score").alias("score"))


@query("motif_summary", f"{MOTIFS} SELECT CAST(k AS BIGINT) AS k, motif, units FROM r WHERE rank <= 5 ORDER BY score DESC, k, motif LIMIT 10")
def _(spark, folder):
    return mo.top_motifs(_motifs(spark, folder), 5).orderBy(F.desc("score"), "k", "motif").limit(10).select("k", "motif", "units")


# The same over all lengths of the survey, tested against counts by hand

def _all_motifs(spark, folder) -> DataFrame:
    f = cut(functions(spark, folder).select(F.col("function_id").alias("unit"), "ops"))
    return mo.frequent_by_length(f, range(4, 13), f.agg(F.count(F.lit(1)).alias("n")))


@query("motifs_k_all")
def _(spark, folder):
    return _all_motifs(spark, folder).select("k", "motif", "units", "occurrences", F.round("coverage", 9).alias("coverage"))


@query("motif_topk_all")
def _(spark, folder):
    return mo.top_motifs(_all_motifs(spark, folder), 100).select("k", "motif", "rank", r6("score").alias("score"))


@query("motif_summary_all")
def _(spark, folder):
    return mo.top_motifs(_all_motifs(spark, folder), 5).orderBy(F.desc("score"), "k", "motif").limit(10).select("k", "motif", "units")


@query("annotate_motif", """WITH m AS (SELECT DISTINCT lower(trim(motif)) AS motif, string_split(lower(trim(motif)), ' ') AS m FROM (SELECT regexp_replace(trim(motif), '\\s+', ' ', 'g') AS motif FROM motifs_k10 WHERE motif IS NOT NULL)),
b AS (SELECT ['je','jne','jl','jle','jg','jge','jb','jbe','ja','jae','js','jns','jo','jno','jp','jnp','jmp'] AS b)
SELECT motif, CASE WHEN m[1] = 'push' AND m[2] = 'mov' THEN 'prologue: frame' WHEN m[1] = 'push' THEN 'prologue: save' WHEN list_contains(m, 'leave') AND list_contains(m, 'ret') THEN 'epilogue: leave'
 WHEN list_contains(m, 'pop') AND list_contains(m, 'ret') THEN 'epilogue: pop' WHEN m[-1] = 'ret' THEN 'epilogue: return' WHEN list_contains(m, 'cmp') AND list_has_any(m, b) THEN 'branch: compare'
 WHEN list_contains(m, 'test') AND list_has_any(m, b) THEN 'branch: test' WHEN list_contains(m, 'xor') AND len(m) <= 3 THEN 'zeroing' WHEN list_contains(m, 'call') THEN 'call'
 WHEN len(list_filter(m, lambda x: x = 'mov')) >= 3 THEN 'bulk moves' WHEN list_contains(m, 'lea') AND list_contains(m, 'mov') THEN 'address and load' WHEN list_has_any(m, ['add','sub','imul','idiv']) THEN 'arithmetic'
 WHEN len(list_filter(m, lambda x: x = 'push')) >= 2 THEN 'pushes' WHEN len(list_filter(m, lambda x: x = 'pop')) >= 2 THEN 'pops' ELSE 'other' END AS label FROM m, b""")
def _(spark, folder):
    clean = F.lower(F.trim(F.regexp_replace(F.trim("motif"), r"\s+", " ")))
    rows = table(spark, folder, "motifs_k10").filter("motif is not null").select(clean.alias("motif")).distinct()
    return rows.select("motif", mo.motif_label(F.col("motif")).alias("label"))


POS = f"""WITH {SQL_F}, l AS (SELECT ops, len(ops) AS n FROM f WHERE len(ops) >= 40),
o AS (SELECT 'start' AS side, unnest(range(20)) AS "offset", unnest(ops[1:20]) AS tok FROM l UNION ALL SELECT 'end', unnest(range(20)), unnest(list_reverse(ops[n - 19 : n])) FROM l),
c AS (SELECT side, "offset", tok, count(*) AS c FROM o GROUP BY ALL)"""


def _positional(spark, folder) -> DataFrame:
    return mo.positional(functions(spark, folder).select(F.col("function_id").alias("unit"), "ops"))


@query("positional_dist", f'{POS} SELECT side, CAST("offset" AS BIGINT) AS "offset", tok, c FROM c')
def _(spark, folder):
    return _positional(spark, folder)


@query("positional_entropy", f'{POS} SELECT side, CAST("offset" AS BIGINT) AS "offset", round({SQL_H}, 6) + 0.0 AS h FROM c GROUP BY ALL')
def _(spark, folder):
    return mo.positional_entropy(_positional(spark, folder)).select("side", "offset", r6("h").alias("h"))


@query("consensus", f'{POS}, r AS (SELECT side, "offset", tok, c / sum(c) OVER (PARTITION BY side, "offset") AS p, row_number() OVER (PARTITION BY side, "offset" ORDER BY c DESC, tok) AS rank FROM c) SELECT side, CAST("offset" AS BIGINT) AS "offset", tok, round(p, 6) AS p, rank FROM r WHERE rank <= 3')
def _(spark, folder):
    return mo.consensus(_positional(spark, folder)).select("side", "offset", "tok", r6("p").alias("p"), "rank")


# Information

MI = """p AS (SELECT seq, lag, x, y FROM (SELECT seq, unnest(range(1, 11)) AS lag, tok AS x, unnest([{ahead}]) AS y FROM (SELECT seq, tok, {leads} FROM {src} WINDOW w AS (PARTITION BY seq ORDER BY gpos))) WHERE y IS NOT NULL)"""


def _mi_sql(src: str = "t") -> str:
    return MI.format(src=src, ahead=", ".join(f"l{k}" for k in range(1, 11)), leads=", ".join(f"lead(tok, {k}) OVER w AS l{k}" for k in range(1, 11)))


def _mi_body(by: str, name: str = "mi", src: str = "p") -> str:
    on = " AND ".join(f"j.{b.strip()} = {{}}.{b.strip()}" for b in by.split(","))
    return f"""j_{name} AS (SELECT {by}, x, y, count(*) AS c FROM {src} GROUP BY ALL), x_{name} AS (SELECT {by}, x, sum(c) AS c FROM j_{name} GROUP BY ALL), y_{name} AS (SELECT {by}, y, sum(c) AS c FROM j_{name} GROUP BY ALL),
a_{name} AS (SELECT {by}, sum(c) AS n, sum(c * log2(c)) AS s FROM j_{name} GROUP BY ALL), b_{name} AS (SELECT {by}, sum(c * log2(c)) AS s FROM x_{name} GROUP BY ALL), c_{name} AS (SELECT {by}, sum(c * log2(c)) AS s FROM y_{name} GROUP BY ALL),
{name} AS (SELECT j.*, log2(n) + (j.s - u.s - v.s) / n AS mi FROM a_{name} j JOIN b_{name} u ON {on.format(*["u"] * len(by.split(",")))} JOIN c_{name} v ON {on.format(*["v"] * len(by.split(",")))})"""


def _event_mi(spark, folder, by) -> DataFrame:
    return info.mutual_information(un.lag_pairs(user_days(spark, folder), 10), by)


@query("mi_by_lag", f"WITH {SQL_E}, {_mi_sql()}, {_mi_body('seq, lag')} SELECT seq, lag, round(mi, 6) + 0.0 AS mi FROM mi")
def _(spark, folder):
    return _event_mi(spark, folder, ["seq", "lag"]).select("seq", "lag", r6("mi").alias("mi"))


@query("mi_mean_decay", f"WITH {SQL_E}, {_mi_sql()}, {_mi_body('seq, lag')} SELECT lag, round(avg(mi), 6) + 0.0 AS mi FROM mi GROUP BY lag")
def mi_mean(spark, folder):
    return _event_mi(spark, folder, ["seq", "lag"]).groupBy("lag").agg(r6(F.avg("mi")).alias("mi"))


@query("mi_decay", f"WITH {SQL_T}, {_mi_sql()}, {_mi_body('lag')}, e AS (SELECT max(mi) FILTER (lag = 1) AS first, max(mi) FILTER (lag = 10) AS last FROM mi) SELECT round((first - last) / first, 6) + 0.0 AS decay, (SELECT min(lag) FROM mi, e WHERE mi <= first / 2) AS half_life FROM e")
def _(spark, folder):
    mi = cut(info.mutual_information(un.lag_pairs(programs(spark, folder), 10), ["lag"]))
    ends = mi.agg(F.max(F.when(F.col("lag") == 1, F.col("mi"))).alias("first"), F.max(F.when(F.col("lag") == 10, F.col("mi"))).alias("last"))
    half = mi.join(F.broadcast(ends)).agg(F.min(F.when(F.col("mi") <= F.col("first") / 2, F.col("lag"))).alias("half_life"))
    return ends.select(r6(F.try_divide(F.col("first") - F.col("last"), F.col("first"))).alias("decay")).join(F.broadcast(half))


@query("corpus_mi", f"WITH {SQL_T}, {_mi_sql()}, {_mi_body('lag')} SELECT lag, round(mi, 6) + 0.0 AS mi, CAST(n AS BIGINT) AS n FROM mi")
def _(spark, folder):
    return info.mutual_information(un.lag_pairs(programs(spark, folder), 10), ["lag"]).select("lag", r6("mi").alias("mi"), "n")


MIX = f"WITH {SQL_E}, s AS (SELECT seq, tok, row_number() OVER (PARTITION BY seq ORDER BY md5(seq || '|' || gpos || '|' || 42), gpos) - 1 AS gpos FROM t), {_mi_sql()}, {_mi_sql('s').replace('p AS', 'ps AS', 1)}, {_mi_body('lag')}, {_mi_body('lag', 'mis', 'ps')}"


@query("mi_gain", f"{MIX} SELECT lag, round(mi.mi, 6) + 0.0 AS mi, round(mi.mi - coalesce(mis.mi, 0), 6) + 0.0 AS gain FROM mi LEFT JOIN mis USING (lag)")
def _(spark, folder):
    units = user_days(spark, folder)
    real = info.mutual_information(un.lag_pairs(units, 10), ["lag"])
    tokens = un.shuffled(units, 42)
    w = Window.partitionBy("seq").orderBy("gpos")
    later = [F.lead("tok", k).over(w).alias(f"l{k}") for k in range(1, 11)]
    wide = tokens.select("seq", F.col("tok").alias("x"), *later)
    pairs = wide.select("x", F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), F.col(f"l{k}").alias("y")) for k in range(1, 11)])).alias("p")).select("p.lag", "x", "p.y").filter("y is not null")
    base = info.mutual_information(pairs, ["lag"]).select("lag", F.col("mi").alias("base"))
    return real.join(base, "lag", "left").select("lag", r6("mi").alias("mi"), r6(F.col("mi") - F.coalesce("base", F.lit(0.0))).alias("gain"))


@query("mi_half_life", f"WITH {SQL_T}, {_mi_sql()}, j AS (SELECT lag, {SQL_H} AS h FROM (SELECT lag, x, y, count(*) AS c FROM p GROUP BY ALL) GROUP BY lag), h1 AS (SELECT {SQL_H} AS h FROM (SELECT tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY tok)), m AS (SELECT lag, greatest(2 * h1.h - j.h, 0) AS mi FROM j, h1) SELECT lag, round(mi, 6) + 0.0 AS mi, lag >= coalesce((SELECT min(lag) FROM m WHERE mi <= (SELECT mi FROM m WHERE lag = 1) / 2), 10) AS beyond FROM m")
def _(spark, folder):
    units = programs(spark, folder)
    joint = info.entropy(un.lag_pairs(units, 10).groupBy("lag", "x", "y").agg(F.count(F.lit(1)).alias("c")), ["lag"]).select("lag", F.col("h").alias("hj"))
    one = fq.token_counts(units).agg((F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("h1"))
    m = cut(joint.join(F.broadcast(one)).select("lag", F.greatest(2 * F.col("h1") - F.col("hj"), F.lit(0.0)).alias("mi")))
    first = m.filter("lag = 1").select((F.col("mi") / 2).alias("half"))
    at = m.join(F.broadcast(first)).agg(F.coalesce(F.min(F.when(F.col("mi") <= F.col("half"), F.col("lag"))), F.lit(10)).alias("at"))
    return m.join(F.broadcast(at)).select("lag", r6("mi").alias("mi"), (F.col("lag") >= F.col("at")).alias("beyond"))


WINDOWS = """l AS (SELECT seq, count(*) AS len FROM t GROUP BY seq), k AS (SELECT seq, tok, unnest(range(CAST(greatest(0, ceil((gpos - 15) / 4.0)) AS BIGINT), gpos // 4 + 1)) AS k FROM t),
c AS (SELECT seq, k, tok, count(*) AS c FROM k JOIN l USING (seq) WHERE k * 4 + 16 <= len GROUP BY ALL), we AS (SELECT seq, k * 4 AS start, k * 4 + 8 AS centre, """ + SQL_H + " AS h FROM c GROUP BY seq, k)"


@query("window_entropy_16", f"WITH {SQL_T}, {WINDOWS} SELECT seq, start, centre, round(h, 6) + 0.0 AS h FROM we WHERE seq IS NOT NULL")
def window_entropy(spark, folder):
    return info.window_entropy(un.positions(programs(spark, folder)), 16).select("seq", "start", "centre", r6("h").alias("h"))


@query("entropy_profile", f"WITH {SQL_E}, {WINDOWS} SELECT seq, round(avg(h), 6) + 0.0 AS mean, round(stddev_pop(h), 6) + 0.0 AS deviation, round(min(h), 6) + 0.0 AS least, round(max(h), 6) + 0.0 AS most, count(*) AS windows FROM we GROUP BY seq")
def _(spark, folder):
    w = info.window_entropy(un.positions(user_days(spark, folder)), 16)
    return w.groupBy("seq").agg(r6(F.avg("h")).alias("mean"), r6(F.stddev_pop("h")).alias("deviation"), r6(F.min("h")).alias("least"), r6(F.max("h")).alias("most"), F.count(F.lit(1)).alias("windows"))


@query("ngram_pos_matrix", f"WITH {SQL_E}, b AS (SELECT seq, gpos, tok || ' ' || lead(tok) OVER (PARTITION BY seq ORDER BY gpos) AS gram FROM t), l AS (SELECT seq, count(*) AS len FROM t GROUP BY seq), w AS (SELECT seq, gram, unnest(range(greatest(0, gpos - 6), gpos + 1)) AS start FROM b WHERE gram IS NOT NULL) SELECT seq, start, gram, count(*) AS c FROM w JOIN l USING (seq) WHERE start + 8 <= len GROUP BY ALL")
def _(spark, folder):
    tokens = un.positions(user_days(spark, folder))
    w = Window.partitionBy("seq").orderBy("gpos")
    grams = tokens.withColumn("gram", F.concat("tok", F.lit(" "), F.lead("tok").over(w))).filter("gram is not null")
    length = tokens.groupBy("seq").agg((F.max("gpos") + 1).alias("len"))
    held = grams.select("seq", "gram", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("gpos") - 6), F.col("gpos"))).alias("start"))
    return held.join(length, "seq").filter("start + 8 <= len").groupBy("seq", "start", "gram").agg(F.count(F.lit(1)).alias("c"))


@query("participation_ratio", """WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT a.i AS i, b.i AS j, avg(CAST(a.v AS DOUBLE) * b.v) - avg(CAST(a.v AS DOUBLE)) * avg(CAST(b.v AS DOUBLE)) AS c FROM x a JOIN x b USING (vec_id) GROUP BY ALL)
SELECT round(pow(sum(c) FILTER (i = j), 2) / sum(c * c), 4) AS participation_ratio FROM c""")
def _(spark, folder):
    out = info.participation_ratio(table(spark, folder, "embeddings"), "embedding")
    return out.select(F.round("participation_ratio", 4).alias("participation_ratio"))


@query("d95")
def _(spark, folder):
    return info.components_for(table(spark, folder, "embeddings"), "embedding")


@query("intrinsic_dim_mle", """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT q.vec_id AS id, list_distance(q.e, r.e) AS d FROM q, r WHERE q.vec_id <> r.vec_id), k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM d WHERE d > 1e-9),
m AS (SELECT id, max(d) AS far, count(*) AS m, sum(ln(d)) AS s FROM k WHERE n <= 5 GROUP BY id)
SELECT round(avg((m - 1) / (m * ln(far) - s)), 4) AS mean, round(stddev_pop((m - 1) / (m * ln(far) - s)), 4) AS deviation, count(*) AS points FROM m WHERE m >= 2""")
def _(spark, folder):
    rows = table(spark, folder, "embeddings")
    near = info.nearest_distances(rows, "vec_id", "embedding", rows.filter("vec_id % 20 = 0"))
    return info.intrinsic_dimension(near).select(F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "points")


# Language models on documents: the first 80 % of each text train, the rest tests

LM = rf"""WITH {SQL_D}, s AS (SELECT seq, category, unnest(['train', 'test']) AS part, unnest([tokens[1 : CAST(floor(len(tokens) * 0.8) AS BIGINT)], tokens[CAST(floor(len(tokens) * 0.8) AS BIGINT) + 1 : len(tokens)]]) AS tokens FROM d WHERE len(tokens) > 0),
n AS (SELECT unnest([1, 2, 3]) AS n), pad AS (SELECT seq, category, part, n, list_concat(list_resize([]::VARCHAR[], n - 1, '<BOS>'), tokens) AS p FROM s, n WHERE len(tokens) > 0),
gr AS (SELECT seq, category, part, n, unnest(list_transform(range(len(p) - n + 1), lambda i: array_to_string(p[i + 1 : i + n], ' '))) AS gram, unnest(list_transform(range(len(p) - n + 1), lambda i: array_to_string(p[i + 1 : i + n - 1], ' '))) AS context FROM pad),
m AS (SELECT n, context, gram, count(*) AS c FROM gr WHERE part = 'train' GROUP BY ALL), mc AS (SELECT n, context, sum(c) AS cc FROM m GROUP BY ALL), v AS (SELECT count(*) AS v FROM m WHERE n = 1),
sc AS (SELECT gr.*, log2((coalesce(c, 0) + 1) / (coalesce(cc, 0) + v)) AS lp FROM gr LEFT JOIN m USING (n, context, gram) LEFT JOIN mc USING (n, context), v WHERE part = 'test')"""


def _parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = texts(spark, folder)
    both = lm.split(rows).join(rows.select("seq", "category"), "seq")
    return both.filter("part = 'train'"), both.filter("part = 'test'")


@query("lm_counts", f"{LM} SELECT CAST(n AS BIGINT) AS n, context, gram, c FROM m WHERE n <= 2")
def _(spark, folder):
    return lm.train(_parts(spark, folder)[0], [1, 2])


@query("lm_cross_entropy", f"{LM} SELECT CAST(n AS BIGINT) AS n, count(*) AS tokens, round(-avg(lp), 6) AS cross_entropy, round(pow(2, -avg(lp)), 3) AS perplexity FROM sc GROUP BY n")
def _(spark, folder):
    train, test = _parts(spark, folder)
    out = lm.cross_entropy(cut(lm.train(train, [1, 2, 3])), test, [1, 2, 3], [])
    return out.select("n", "tokens", r6("cross_entropy").alias("cross_entropy"), F.round("perplexity", 3).alias("perplexity"))


@query("lm_per_category", f"{LM} SELECT category, CAST(n AS BIGINT) AS n, count(*) AS tokens, round(-avg(lp), 6) AS cross_entropy FROM sc GROUP BY ALL")
def _(spark, folder):
    train, test = _parts(spark, folder)
    out = lm.cross_entropy(cut(lm.train(train, [1, 2, 3])), test, [1, 2, 3], ["category"])
    return out.select("category", "n", "tokens", r6("cross_entropy").alias("cross_entropy"))


@query("lm_per_seq", f"{LM} SELECT seq, CAST(n AS BIGINT) AS n, count(*) AS tokens, round(-avg(lp), 6) AS cross_entropy FROM sc WHERE n <= 2 GROUP BY ALL")
def _(spark, folder):
    train, test = _parts(spark, folder)
    out = lm.cross_entropy(cut(lm.train(train, [1, 2])), test, [1, 2], ["seq"])
    return out.select("seq", "n", "tokens", r6("cross_entropy").alias("cross_entropy"))


@query("lm_table", f"{LM}, ce AS (SELECT n, -avg(lp) AS ce FROM sc GROUP BY n), h AS (SELECT n, {SQL_H} AS h FROM (SELECT n, gram, count(*) AS c FROM gr WHERE part = 'test' GROUP BY ALL) GROUP BY n), k AS (SELECT n, h - coalesce(lag(h) OVER (ORDER BY n), 0) AS conditional FROM h) SELECT CAST(n AS BIGINT) AS n, round(ce, 6) AS cross_entropy, round(conditional, 6) + 0.0 AS conditional, round(ce - conditional, 6) + 0.0 AS gap FROM ce JOIN k USING (n)")
def _(spark, folder):
    train, test = _parts(spark, folder)
    ce = lm.cross_entropy(cut(lm.train(train, [1, 2, 3])), test, [1, 2, 3], [])
    counts = lm.padded_ngrams(test, [1, 2, 3], []).groupBy("n", "gram").agg(F.count(F.lit(1)).alias("c"))
    h = info.entropy_rates(counts).select("n", "conditional")
    return ce.join(h, "n").select("n", r6("cross_entropy").alias("cross_entropy"), r6("conditional").alias("conditional"), r6(F.col("cross_entropy") - F.col("conditional")).alias("gap"))


CROSS = rf"""WITH {SQL_D}, p AS (SELECT category, ['<BOS>'] || tokens AS p, tokens FROM d WHERE category IN ('en', 'de', 'fr') AND len(tokens) > 0), b AS (SELECT category, unnest(p[1 : len(p) - 1]) AS a, unnest(tokens) AS b FROM p),
m AS (SELECT category, a, b, count(*) AS c FROM b GROUP BY ALL), mc AS (SELECT category, a, sum(c) AS cc FROM m GROUP BY ALL), v AS (SELECT category, count(DISTINCT b) AS v FROM m GROUP BY ALL),
x AS (SELECT v.category AS train, y.category AS test, y.a, y.b, y.c AS m, v FROM v, m y WHERE v.category <> y.category)
SELECT train, x.test, CAST(sum(x.m) AS BIGINT) AS tokens, round(-sum(x.m * log2((coalesce(m.c, 0) + 1) / (coalesce(cc, 0) + v))) / sum(x.m), 6) AS cross_entropy FROM x LEFT JOIN m ON m.category = train AND m.a = x.a AND m.b = x.b LEFT JOIN mc ON mc.category = train AND mc.a = x.a GROUP BY ALL"""


@query("lm_cross", CROSS)
def _(spark, folder):
    rows = cut(texts(spark, folder).filter("category in ('en', 'de', 'fr') and size(tokens) > 0").select("category", "tokens"))
    out = None
    for a in ("de", "en", "fr"):
        model = cut(lm.train(rows.filter(F.col("category") == a), [1, 2]))
        part = lm.cross_entropy(model, rows.filter(F.col("category") != a), [2], ["category"]).select(F.lit(a).alias("train"), F.col("category").alias("test"), "tokens", r6("cross_entropy").alias("cross_entropy"))
        out = part if out is None else out.unionByName(part)
    return out


@query("lm_leaky", f"{LM}, ml AS (SELECT n, context, gram, count(*) AS c FROM (SELECT seq, 2 AS n, p FROM (SELECT seq, ['<BOS>'] || tokens AS p FROM d WHERE len(tokens) > 0)) q, (SELECT 1), LATERAL (SELECT unnest(list_transform(range(len(p) - 1), lambda i: array_to_string(p[i + 1 : i + 2], ' '))) AS gram, unnest(p[1 : len(p) - 1]) AS context) GROUP BY ALL), mlc AS (SELECT context, sum(c) AS cc FROM ml GROUP BY ALL), vl AS (SELECT count(DISTINCT tok) AS v FROM dt) SELECT count(*) AS tokens, round(-avg(log2((coalesce(ml.c, 0) + 1) / (coalesce(mlc.cc, 0) + vl.v))), 6) AS cross_entropy FROM (SELECT * FROM gr WHERE part = 'test' AND n = 2) g LEFT JOIN ml ON ml.gram = g.gram LEFT JOIN mlc ON mlc.context = g.context, vl")
def _(spark, folder):
    whole = texts(spark, folder).filter("size(tokens) > 0")
    out = lm.cross_entropy(cut(lm.train(whole, [1, 2])), _parts(spark, folder)[1], [2], [])
    return out.select("tokens", r6("cross_entropy").alias("cross_entropy"))
