"""Queries on compression, distances, clusters, clones and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import ngrams, opcode_array
from weftline.operators import clones as cl
from weftline.operators import cluster as cu
from weftline.operators import compression as co
from weftline.operators import distance as di
from weftline.operators import units as un
from weftline.plans.common import SQL_E, SQL_F, SQL_H, SQL_T, functions, programs, r6, sql_grams, texts, users
from weftline.session import cut, grows
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


# Compression

LZ = f"""WITH RECURSIVE {SQL_E}, s AS (SELECT seq, list(tok ORDER BY gpos) AS t FROM t GROUP BY seq),
r AS (SELECT seq, t, 1 AS i, '' AS cur, []::VARCHAR[] AS d, 0 AS c FROM s UNION ALL
  SELECT seq, t, i + 1, CASE WHEN list_contains(d, cur || '|' || t[i]) THEN cur || '|' || t[i] ELSE '' END,
    CASE WHEN list_contains(d, cur || '|' || t[i]) THEN d ELSE list_append(d, cur || '|' || t[i]) END, c + CASE WHEN list_contains(d, cur || '|' || t[i]) THEN 0 ELSE 1 END FROM r WHERE i <= len(t)),
z AS (SELECT seq, len(t) AS n, c + CASE WHEN cur <> '' THEN 1 ELSE 0 END AS lz78 FROM r WHERE i = len(t) + 1)"""


def _lz(spark, folder) -> DataFrame:
    return co.compression(users(spark, folder))


@query("lz78", f"{LZ} SELECT seq, n, CAST(lz78 AS BIGINT) AS lz78, round(lz78 * log2(greatest(2, n)) / n, 6) AS normalized FROM z")
def _(spark, folder):
    return _lz(spark, folder).select("seq", "n", "lz78", r6("lz78_norm").alias("normalized"))


@query("ratio_stats", f"{LZ}, q AS (SELECT lz78 * log2(greatest(2, n)) / n AS x FROM z) SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(min(x), 6) AS least, round(max(x), 6) AS most, round(quantile_cont(x, 0.5), 6) AS median FROM q")
def _(spark, folder):
    out = co.ratio_statistics(_lz(spark, folder), "lz78_norm")
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("size_corr", f"{LZ} SELECT round(corr(CAST(n AS DOUBLE), CAST(lz78 AS DOUBLE)), 6) AS correlation FROM z")
def _(spark, folder):
    return _lz(spark, folder).agg(r6(F.corr(F.col("n").cast("double"), F.col("lz78").cast("double"))).alias("correlation"))


@query("compression_ratio")
def _(spark, folder):
    return co.compression(texts(spark, folder)).drop("shuffled_zlib")


@query("compression_baseline")
def _(spark, folder):
    return co.compression(texts(spark, folder), shuffles=3).select("seq", "zlib", "shuffled_zlib")


@query("random_baseline")
def _(spark, folder):
    units = programs(spark, folder)
    v = units.select(F.explode("ops").alias("tok")).distinct().agg(F.count(F.lit(1)).alias("vocabulary"))
    sizes = v.withColumn("n", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1000, 5000, 10000, 50000)])))
    return co.random_baseline(sizes)


def _named_pairs(spark, folder) -> DataFrame:
    """(a, b) of the distinct pairs of candidate_pairs, smaller id first."""
    p, q = F.trim("func_id1"), F.trim("func_id2")
    return table(spark, folder, "candidate_pairs").select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), p.alias("p"), q.alias("q")).dropna().filter("p <> q").select("a", "b").distinct()


def _named(spark, folder) -> DataFrame:
    return functions(spark, folder).select(F.col("func_id").alias("unit"), "ops")


@query("ncd_pairs")
def ncd_pairs(spark, folder):
    f = cut(_named(spark, folder))
    pairs = _named_pairs(spark, folder).join(f.select(F.col("unit").alias("a"), F.col("ops").alias("x")), "a").join(f.select(F.col("unit").alias("b"), F.col("ops").alias("y")), "b")
    return co.ncd(pairs)


@query("ncd_stats")
def _(spark, folder):
    return co.ratio_statistics(ncd_pairs(spark, folder), "ncd")


@query("pair_alignments")
def _(spark, folder):
    return cl.pair_scores(_named_pairs(spark, folder), cut(_named(spark, folder)), ["local", "global", "common"])


# Distances of groups of programs: category and compiler, a vocabulary of fixed size

DIM = """dim AS (SELECT trim(name) AS seq, max(trim(category)) AS category, max(trim(compiler)) AS compiler FROM binaries GROUP BY 1),
grp AS (SELECT seq, coalesce(category, '?') || '/' || coalesce(compiler, '?') AS g FROM dim)"""


def _dim(spark, folder) -> DataFrame:
    return table(spark, folder, "binaries").groupBy(F.trim("name").alias("seq")).agg(F.max(F.trim("category")).alias("category"), F.max(F.trim("compiler")).alias("compiler"))


def _group_grams(spark, folder, n: int) -> DataFrame:
    dim = _dim(spark, folder).select("seq", F.concat(F.coalesce("category", F.lit("?")), F.lit("/"), F.coalesce("compiler", F.lit("?"))).alias("g"))
    grams = un.unit_ngrams(programs(spark, folder), [n]).groupBy("seq", "gram").agg(F.count(F.lit(1)).alias("c"))
    return grams.join(dim, "seq").groupBy(F.col("g").alias("seq"), "gram").agg(F.sum("c").alias("c"))


def _group_counts(spark, folder, n: int, most: int = 10_000) -> DataFrame:
    counts = cut(_group_grams(spark, folder, n))
    top = counts.groupBy("gram").agg(F.sum("c").alias("t")).orderBy(F.desc("t"), "gram").limit(most).select("gram")
    return counts.join(top, "gram", "left_semi")


def _cos_sql(n: int, name: str) -> str:
    return f"""gc{n} AS (SELECT grp.g AS seq, gram, count(*) AS c FROM g JOIN grp USING (seq) WHERE n = {n} GROUP BY ALL), top{n} AS (SELECT gram FROM gc{n} GROUP BY gram ORDER BY sum(c) DESC, gram LIMIT 10000), ft{n} AS (SELECT * FROM gc{n} SEMI JOIN top{n} USING (gram)),
nm{n} AS (SELECT seq, sqrt(sum(CAST(c AS DOUBLE) * c)) AS norm FROM ft{n} GROUP BY seq),
{name} AS (SELECT a.seq AS a, b.seq AS b, sum(CAST(a.c AS DOUBLE) * b.c) / any_value(na.norm) / any_value(nb.norm) AS cosine FROM ft{n} a JOIN ft{n} b ON a.gram = b.gram AND a.seq < b.seq JOIN nm{n} na ON na.seq = a.seq JOIN nm{n} nb ON nb.seq = b.seq GROUP BY a.seq, b.seq)"""


GROUPS = f"WITH {SQL_T}, {sql_grams(3)}, {DIM}, {_cos_sql(2, 'cs')}"


def _cosines(spark, folder, n: int = 2) -> DataFrame:
    return di.cosine_pairs(_group_counts(spark, folder, n))


@query("cosine_pairs", f"{GROUPS} SELECT a, b, round(cosine, 6) AS cosine FROM cs")
def _(spark, folder):
    return _cosines(spark, folder).select("a", "b", r6("cosine").alias("cosine"))


@query("cosine_stats", f"{GROUPS}, k AS (SELECT count(*) AS k FROM nm2) SELECT round((2 * sum(cosine) + any_value(k)) / (any_value(k) * any_value(k)), 6) AS mean, round(min(cosine), 6) AS least, round(max(cosine), 6) AS most FROM cs, k")
def _(spark, folder):
    counts = cut(_group_counts(spark, folder, 2))
    k = counts.select("seq").distinct().agg(F.count(F.lit(1)).alias("k"))
    s = di.cosine_pairs(counts).agg(F.sum("cosine").alias("s"), F.min("cosine").alias("least"), F.max("cosine").alias("most"))
    # over the full matrix, its diagonal of ones included
    return s.join(F.broadcast(k)).select(r6((2 * F.col("s") + F.col("k")) / (F.col("k") * F.col("k"))).alias("mean"), r6("least").alias("least"), r6("most").alias("most"))


@query("similar_pairs", f"{GROUPS} SELECT a, b, round(cosine, 6) AS cosine FROM cs ORDER BY round(cosine, 9) DESC, a, b LIMIT 5")
def _(spark, folder):
    return _cosines(spark, folder).orderBy(F.desc(F.round("cosine", 9)), "a", "b").limit(5).select("a", "b", r6("cosine").alias("cosine"))


@query("different_pairs", f"{GROUPS} SELECT a, b, round(cosine, 6) AS cosine FROM cs ORDER BY round(cosine, 9), a, b LIMIT 5")
def _(spark, folder):
    return _cosines(spark, folder).orderBy(F.round("cosine", 9), "a", "b").limit(5).select("a", "b", r6("cosine").alias("cosine"))


@query("top_features", f"{GROUPS}, r AS (SELECT seq, gram, c, row_number() OVER (PARTITION BY seq ORDER BY c DESC, gram) AS rank FROM ft2) SELECT seq, gram, c, rank FROM r WHERE rank <= 5")
def _(spark, folder):
    w = Window.partitionBy("seq").orderBy(F.desc("c"), "gram")
    return _group_counts(spark, folder, 2).withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5").select("seq", "gram", "c", "rank")


@query("matrix_corr", f"{GROUPS}, {_cos_sql(3, 'cs3')} SELECT round(corr(x.cosine, y.cosine), 6) AS correlation FROM cs x JOIN cs3 y USING (a, b)")
def _(spark, folder):
    x, y = _cosines(spark, folder, 2), _cosines(spark, folder, 3).withColumnRenamed("cosine", "other")
    return x.join(y, ["a", "b"]).agg(r6(F.corr("cosine", "other")).alias("correlation"))


@query("best_n", f"{GROUPS}, {_cos_sql(3, 'cs3')}, s AS (SELECT 2 AS n, stddev_pop(cosine) / greatest(avg(cosine), 0.001) AS v FROM cs UNION ALL SELECT 3, stddev_pop(cosine) / greatest(avg(cosine), 0.001) FROM cs3) SELECT CAST(arg_max(n, v) AS BIGINT) AS n, round(max(v), 6) AS spread FROM s")
def _(spark, folder):
    spread = F.stddev_pop("cosine") / F.greatest(F.avg("cosine"), F.lit(0.001))
    rows = cu.union_all([_cosines(spark, folder, n).agg(spread.alias("v")).withColumn("n", F.lit(n).cast("bigint")) for n in (2, 3)])
    return rows.agg(F.max_by("n", "v").alias("n"), r6(F.max("v")).alias("spread"))


@query("tfidf", f"WITH {SQL_T}, {sql_grams(3)}, {DIM}, tc AS (SELECT grp.g AS seq, gram, count(*) AS c FROM g JOIN grp USING (seq) WHERE n = 1 GROUP BY ALL), dfs AS (SELECT gram, count(*) AS df FROM tc GROUP BY gram), w AS (SELECT seq, gram, (1 + ln(c)) * (ln((1.0 + (SELECT count(DISTINCT seq) FROM tc)) / (1 + df)) + 1) AS w FROM tc JOIN dfs USING (gram)) SELECT seq, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY seq)), 6) AS w FROM w")
def _(spark, folder):
    counts = cut(_group_grams(spark, folder, 1))
    return di.tfidf(counts).select("seq", "gram", r6("w").alias("w"))


PAIRED = f"{GROUPS}, pg AS (SELECT CASE WHEN split_part(a, '/', 1) = split_part(b, '/', 1) THEN 'within' ELSE 'between' END AS kind, 1 - cosine AS d FROM cs WHERE a NOT LIKE '?/%' AND b NOT LIKE '?/%')"


def _paired(spark, folder) -> DataFrame:
    a, b = F.split_part("a", F.lit("/"), F.lit(1)), F.split_part("b", F.lit("/"), F.lit(1))
    rows = _cosines(spark, folder).filter((a != "?") & (b != "?"))
    return rows.select(F.when(a == b, "within").otherwise("between").alias("kind"), (1 - F.col("cosine")).alias("d"))


@query("pair_groups", f"{PAIRED} SELECT kind, count(*) AS pairs, round(avg(d), 6) AS mean FROM pg GROUP BY kind")
def _(spark, folder):
    return _paired(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("d")).alias("mean"))


@query("mw_u", f"{PAIRED}, q AS (SELECT kind, round(d, 6) AS d FROM pg), rk AS (SELECT kind, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS r FROM q), s AS (SELECT CAST(sum(r) FILTER (kind = 'within') AS DOUBLE) AS r1, CAST(count(*) FILTER (kind = 'within') AS DOUBLE) AS n1, CAST(count(*) FILTER (kind = 'between') AS DOUBLE) AS n2 FROM rk) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round(1 - 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS r FROM s")
def _(spark, folder):
    rows = _paired(spark, folder).select("kind", F.round("d", 6).alias("d"))
    return di.rank_sum(rows, "kind", "d", "within", "between").select("n1", "n2", "u", r6("r").alias("r"))


@query("category_permutation")
def _(spark, folder):
    pairs = cut(_cosines(spark, folder).select("a", "b", (1 - F.col("cosine")).alias("v")))
    ids = pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct()
    label = F.split_part("seq", F.lit("/"), F.lit(1))
    return di.permutation_p(pairs, ids.select("seq", F.when(label != "?", label).alias("label")))


@query("single_linkage", f"WITH RECURSIVE {GROUPS[5:]}, e AS (SELECT a, b FROM cs WHERE cosine >= 0.97 UNION SELECT b, a FROM cs WHERE cosine >= 0.97), rr AS (SELECT a AS id, a AS o FROM e UNION SELECT rr.id, e.b FROM rr JOIN e ON rr.o = e.a) SELECT id, min(o) AS component FROM rr GROUP BY id")
def _(spark, folder):
    return cu.components(_cosines(spark, folder).filter("cosine >= 0.97"), "a", "b")


@query("hclust_labels")
def _(spark, folder):
    return cu.linkage_labels(_cosines(spark, folder).select("a", "b", (1 - F.col("cosine")).alias("d")), 0.05)


@query("silhouette", f"{GROUPS}, bo AS (SELECT a, b, 1 - cosine AS d FROM cs UNION ALL SELECT b, a, 1 - cosine FROM cs), ms AS (SELECT a, split_part(a, '/', 1) AS la, split_part(b, '/', 1) AS lb, avg(d) AS m FROM bo GROUP BY ALL), ea AS (SELECT a, max(m) FILTER (la = lb) AS x, min(m) FILTER (la <> lb) AS y FROM ms GROUP BY a) SELECT round(avg(coalesce((y - x) / greatest(x, y), 0)), 6) AS silhouette, count(*) AS items FROM ea")
def _(spark, folder):
    pairs = cut(_cosines(spark, folder).select("a", "b", (1 - F.col("cosine")).alias("d")))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    out = cu.silhouette(pairs, ids.select("id", F.split_part("id", F.lit("/"), F.lit(1)).alias("label")))
    return out.select(r6("silhouette").alias("silhouette"), "items")


@query("ari_purity", f"WITH {DIM}, k AS (SELECT category AS a, compiler AS b, count(*) AS c FROM dim WHERE category IS NOT NULL AND compiler IS NOT NULL GROUP BY ALL), x AS (SELECT sum(c * (c - 1) / 2.0) AS s, CAST(sum(c) AS DOUBLE) AS n FROM k), y AS (SELECT sum(c * (c - 1) / 2.0) AS sa, avg(m / c) AS purity FROM (SELECT a, sum(c) AS c, max(c) AS m FROM k GROUP BY a)), z AS (SELECT sum(c * (c - 1) / 2.0) AS sb FROM (SELECT b, sum(c) AS c FROM k GROUP BY b)) SELECT round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) + 0.0 AS ari, round(purity, 6) AS purity FROM x, y, z")
def _(spark, folder):
    out = cu.agreement(_dim(spark, folder).filter("category is not null and compiler is not null"), "category", "compiler")
    return out.select(r6("ari").alias("ari"), r6("purity").alias("purity"))


@query("pca_embed")
def _(spark, folder):
    out = cu.pca_scores(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return out.select("id", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))


# Clones: one function stands for all with the same sequence

REPS = f"WITH {SQL_F}, rep AS (SELECT min(function_id) AS unit, ops FROM f WHERE len(ops) >= 10 GROUP BY ops)"


def _reps(spark, folder, between=lambda rows: rows) -> DataFrame:
    """``between`` is applied between the exchange by id and that by sequence."""
    rows = table(spark, folder, "program_functions").filter("function_id is not null")
    last = rows.groupBy("function_id").agg(F.max(F.struct("loaded_at", opcode_array(F.col("instructions")).alias("ops")))["ops"].alias("ops"))
    return between(last.filter(F.size("ops") >= 10)).groupBy("ops").agg(F.min("function_id").alias("unit")).select("unit", "ops")


HASHES, BANDS, ROWS = 128, 32, 4
_coef = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(map(cl.coefficients, range(HASHES))))
SIGS = f"""{REPS}, sh AS (SELECT DISTINCT unit, unnest(list_transform(range(len(ops) - 2), lambda i: array_to_string(ops[i + 1 : i + 3], ' '))) AS s FROM rep),
x AS (SELECT unit, ('0x' || substr(md5(s), 1, 15))::BIGINT % 2147483647 AS x FROM sh), k(i, a, b) AS (VALUES {_coef}), sg AS (SELECT unit, i, min((x * a + b) % 2147483647) AS m FROM x, k GROUP BY ALL),
bk AS (SELECT unit, i // 4 AS band, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS key FROM sg GROUP BY ALL), ca AS (SELECT DISTINCT p.unit AS a, q.unit AS b FROM bk p JOIN bk q ON p.band = q.band AND p.key = q.key AND p.unit < q.unit)"""


@query("minhash_sig", f"{SIGS} SELECT unit, CAST(i AS INTEGER) AS i, CAST(m AS BIGINT) AS m FROM sg")
def _(spark, folder):
    return cl.signatures(_reps(spark, folder), 3, HASHES)


@query("lsh_candidates", f"{SIGS} SELECT ca.a, ca.b, round(avg(CASE WHEN p.m = q.m THEN 1.0 ELSE 0.0 END), 6) AS estimate FROM ca JOIN sg p ON p.unit = ca.a JOIN sg q ON q.unit = ca.b AND p.i = q.i GROUP BY ALL")
def _(spark, folder):
    return cl.banded_estimates(_reps(spark, folder, cl.squeezed), 3, BANDS, ROWS).select("a", "b", r6("estimate").alias("estimate"))


def _similar_sql(k: int, least: float, name: str) -> str:
    """name: (a, b, jaccard) of all pairs of rep that share a k-shingle and reach ``least``."""
    return f"""sh{k} AS (SELECT DISTINCT unit, unnest(list_transform(range(len(ops) - {k - 1}), lambda i: array_to_string(ops[i + 1 : i + {k}], ' '))) AS s FROM rep), nn{k} AS (SELECT unit, count(*) AS n FROM sh{k} GROUP BY unit),
cc{k} AS (SELECT p.unit AS a, q.unit AS b, count(*) AS c FROM sh{k} p JOIN sh{k} q ON p.s = q.s AND p.unit < q.unit GROUP BY ALL),
{name} AS (SELECT cc{k}.a, cc{k}.b, c / (p.n + q.n - c) AS jaccard FROM cc{k} JOIN nn{k} p ON p.unit = cc{k}.a JOIN nn{k} q ON q.unit = cc{k}.b WHERE c / (p.n + q.n - c) >= {least})"""


@query("jaccard_pairs", f"{REPS}, {_similar_sql(3, 0.5, 'jp')} SELECT a, b, round(jaccard, 6) AS jaccard FROM jp")
def _(spark, folder):
    """All pairs of at least 0.5."""
    return cl.similar_units(_reps(spark, folder), 3, 0.5).select("a", "b", r6("jaccard").alias("jaccard"))


LENGTHS = (3, 4, 5)


@query("best_jaccard", f"{REPS}, {', '.join(_similar_sql(k, 0.5, f'j{k}') for k in LENGTHS)}, u AS ({' UNION ALL '.join(f'SELECT a, b, {k} AS k, round(jaccard, 6) AS jaccard FROM j{k}' for k in LENGTHS)}) SELECT a, b, CAST(arg_min(k, (-jaccard, k)) AS INTEGER) AS k, max(jaccard) AS jaccard FROM u GROUP BY a, b")
def _(spark, folder):
    """Pairs of at least 0.5 at any shingle length, with the length at which they are most similar."""
    reps = cl.packs(_reps(spark, folder, cl.squeezed))
    found = cu.union_all([cl.similar_units(reps, k, 0.5).select("a", "b", F.lit(k).alias("k"), r6("jaccard").alias("jaccard")) for k in LENGTHS])
    best = found.groupBy("a", "b").agg(F.max(F.struct("jaccard", (-F.col("k")).alias("k"))).alias("m"))
    return best.select("a", "b", (-F.col("m.k")).alias("k"), "m.jaccard")


FUZZY = f"WITH RECURSIVE {SQL_F}, rep AS (SELECT min(function_id) AS unit, ops FROM f WHERE len(ops) >= 5 GROUP BY ops), {_similar_sql(5, 0.85, 'jf')}, e AS (SELECT a, b FROM jf UNION SELECT b, a FROM jf UNION SELECT unit, unit FROM rep), r AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a), top AS (SELECT id, min(o) AS family FROM r GROUP BY id), fz AS (SELECT function_id, family FROM f JOIN rep USING (ops) JOIN top ON id = unit)"


@query("neardup_fuzzy", f"{FUZZY} SELECT function_id, family FROM fz QUALIFY count(*) OVER (PARTITION BY family) >= 2")
def _(spark, folder):
    """Families of functions linked by a similarity of 0.85 of their 5-shingles, copies included."""
    f = cut(functions(spark, folder).filter("size >= 5").select("function_id", "ops", F.md5(F.array_join("ops", " ")).alias("h")))
    first = f.groupBy("h").agg(F.min("function_id").alias("unit"), F.count(F.lit(1)).alias("n"))
    classes = cut(f.select("function_id", "h").join(grows(first), "h").select("function_id", "unit"))
    reps = f.join(grows(classes.filter("function_id = unit").select("function_id")), "function_id", "left_semi").select(F.col("function_id").alias("unit"), "ops")
    links = cl.similar_units(reps, 5, 0.85).select("a", "b").union(classes.select("unit", "function_id"))
    families = cut(cu.components(links, "a", "b").select(F.col("id").alias("function_id"), F.col("component").alias("family")))
    several = families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("family")
    return families.join(grows(several), "family", "left_semi").select("function_id", "family")


@query("found_clones")
def found_clones(spark, folder):
    """All pairs of at least 0.5 with exact similarity, alignment and clone type."""
    reps = cut(_reps(spark, folder))
    alike = cut(cl.similar_units(reps, 3, 0.5))
    scored = cl.pair_scores(alike, reps, ["local"]).join(alike, ["a", "b"])
    scored = scored.withColumn("alignment", cl.normalized(F.col("local"), F.col("na"), F.col("nb")))
    return scored.select("a", "b", "jaccard", "alignment", cl.clone_type(F.col("jaccard"), F.col("alignment")).alias("clone_type")).filter("clone_type > 0")


@query("found_families")
def _(spark, folder):
    found = cut(found_clones(spark, folder))
    members = cu.components(found, "a", "b").select(F.col("component").alias("family"), F.col("id").alias("unit"))
    return cl.families(members.join(_reps(spark, folder), "unit"))


PAIR = "cp AS (SELECT DISTINCT least(trim(func_id1), trim(func_id2)) AS a, greatest(trim(func_id1), trim(func_id2)) AS b, jaccard, alignment_score, clone_type FROM clone_pairs WHERE func_id1 IS NOT NULL AND func_id2 IS NOT NULL AND trim(func_id1) <> trim(func_id2))"


def _stored(spark, folder) -> DataFrame:
    p, q = F.trim("func_id1"), F.trim("func_id2")
    rows = table(spark, folder, "clone_pairs").filter(p.isNotNull() & q.isNotNull() & (p != q))
    return rows.select(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), "jaccard", "alignment_score", "clone_type").distinct()


@query("clone_type", f"WITH {PAIR} SELECT a, b, CASE WHEN jaccard IS NULL OR alignment_score IS NULL THEN NULL WHEN jaccard < 0.5 OR alignment_score < 0.3 THEN 0 ELSE least(3, CASE WHEN jaccard >= 0.95 THEN 1 WHEN jaccard >= 0.7 THEN 2 ELSE 3 END + CASE WHEN abs(jaccard - alignment_score) > 0.3 THEN 1 ELSE 0 END) END AS kind FROM cp")
def _(spark, folder):
    rows = _stored(spark, folder)
    kind = F.when(F.col("jaccard").isNotNull() & F.col("alignment_score").isNotNull(), cl.clone_type(F.col("jaccard"), F.col("alignment_score")))
    return rows.select("a", "b", kind.alias("kind"))


@query("clone_graph", f"WITH {PAIR}, e AS (SELECT a AS node, b AS other FROM cp UNION SELECT b, a FROM cp) SELECT node, count(*) AS degree FROM e GROUP BY node")
def _(spark, folder):
    p = _stored(spark, folder)
    e = p.select(F.col("a").alias("node"), F.col("b").alias("other")).union(p.select("b", "a")).distinct()
    return e.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


@query("components", f"WITH RECURSIVE {PAIR}, e AS (SELECT a, b FROM cp UNION SELECT b, a FROM cp), r AS (SELECT a AS id, a AS o FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a) SELECT id, min(o) AS component FROM r GROUP BY id")
def _(spark, folder):
    return cu.components(_stored(spark, folder), "a", "b")


@query("cross_matrix", f"WITH {PAIR}, d AS (SELECT DISTINCT a, b, split_part(a, '|', 1) AS x, split_part(b, '|', 1) AS y FROM cp) SELECT b1, b2, count(*) AS pairs FROM (SELECT x AS b1, y AS b2 FROM d UNION ALL SELECT y, x FROM d WHERE x <> y) GROUP BY ALL")
def _(spark, folder):
    d = _stored(spark, folder).select("a", "b").distinct().select(F.substring_index("a", "|", 1).alias("x"), F.substring_index("b", "|", 1).alias("y"))
    both = d.select(F.col("x").alias("b1"), F.col("y").alias("b2")).union(d.filter("x <> y").select("y", "x"))
    return both.groupBy("b1", "b2").agg(F.count(F.lit(1)).alias("pairs"))


@query("clone_stats", f"WITH {PAIR} SELECT clone_type, count(*) AS pairs, round(avg(jaccard), 6) AS jaccard, round(avg(alignment_score), 6) AS alignment FROM cp GROUP BY clone_type")
def _(spark, folder):
    return _stored(spark, folder).groupBy("clone_type").agg(F.count(F.lit(1)).alias("pairs"), r6(F.avg("jaccard")).alias("jaccard"), r6(F.avg("alignment_score")).alias("alignment"))


FAM = "fm AS (SELECT DISTINCT family_id, trim(m) AS func_id FROM (SELECT family_id, unnest(members) AS m FROM clone_families) WHERE m IS NOT NULL)"


def _members(spark, folder) -> DataFrame:
    rows = table(spark, folder, "clone_families").select("family_id", F.explode("members").alias("m"))
    return rows.select("family_id", F.trim("m").alias("func_id")).dropna().distinct()


@query("family_members", f"WITH {SQL_F}, {FAM} SELECT family_id, fm.func_id, coalesce(len(ops), 0) AS size FROM fm LEFT JOIN f ON f.func_id = fm.func_id")
def _(spark, folder):
    sizes = functions(spark, folder).select("func_id", F.col("size").cast("bigint").alias("size"))
    return _members(spark, folder).join(sizes, "func_id", "left").fillna(0, ["size"]).select("family_id", "func_id", "size")


@query("family_types", f"WITH {PAIR}, {FAM}, q AS (SELECT DISTINCT x.family_id, a, b, clone_type FROM cp JOIN fm x ON x.func_id = a JOIN fm y ON y.func_id = b AND x.family_id = y.family_id WHERE clone_type IS NOT NULL), n AS (SELECT family_id, clone_type, count(*) AS c FROM q GROUP BY ALL), t AS (SELECT family_id, arg_min(clone_type, (-c, clone_type)) AS dominant, CAST(sum(c) AS BIGINT) AS pairs FROM n GROUP BY family_id) SELECT DISTINCT family_id, coalesce(dominant, 3) AS dominant, coalesce(pairs, 0) AS pairs FROM fm LEFT JOIN t USING (family_id)")
def _(spark, folder):
    """The commonest type of the stored pairs inside each family, the smaller of equally common ones, 3 without pairs."""
    return cl.dominant_types(_members(spark, folder), _stored(spark, folder))


@query("family_size_hist", f"WITH {FAM} SELECT size, count(*) AS families FROM (SELECT family_id, count(*) AS size FROM fm GROUP BY family_id) GROUP BY size")
def _(spark, folder):
    return _members(spark, folder).groupBy("family_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("families"))


@query("clone_density", f"WITH {SQL_F}, {FAM} SELECT binary_name, round(count(*) FILTER (func_id IN (SELECT func_id FROM fm)) / count(*), 6) AS density FROM f GROUP BY binary_name")
def _(spark, folder):
    held = _members(spark, folder).select("func_id").distinct().withColumn("in", F.lit(1))
    rows = functions(spark, folder).select("binary_name", "func_id").join(held, "func_id", "left")
    return rows.groupBy("binary_name").agg(r6(F.count("in") / F.count(F.lit(1))).alias("density"))


@query("neardup_exact", f"WITH {SQL_F} SELECT min(function_id) AS representative, count(*) AS members, any_value(len(ops)) AS size FROM f WHERE len(ops) >= 12 GROUP BY ops HAVING count(*) >= 2")
def _(spark, folder):
    groups = functions(spark, folder).filter("size >= 12").groupBy("ops").agg(F.min("function_id").alias("representative"), F.count(F.lit(1)).alias("members"))
    return groups.filter("members >= 2").select("representative", "members", F.size("ops").cast("bigint").alias("size"))


@query("exact_dup_stats", f"WITH {SQL_F}, g AS (SELECT ops, count(*) AS n, any_value(len(ops)) AS s FROM f WHERE len(ops) >= 12 GROUP BY ops) SELECT CAST(sum(n) AS BIGINT) AS functions, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS duplicated, count(*) FILTER (n >= 2) AS groups, CAST(coalesce(sum((n - 1) * s) FILTER (n >= 2), 0) AS BIGINT) AS mergeable FROM g")
def _(spark, folder):
    g = functions(spark, folder).filter("size >= 12").groupBy("ops").agg(F.count(F.lit(1)).alias("n"))
    some = F.col("n") >= 2
    return g.agg(F.sum("n").alias("functions"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("duplicated"), F.count_if(some).alias("groups"), F.coalesce(F.sum(F.when(some, (F.col("n") - 1) * F.size("ops"))), F.lit(0)).alias("mergeable"))


@query("df_spectrum", f"WITH {SQL_F} SELECT held, count(*) AS signatures FROM (SELECT count(DISTINCT binary_name) AS held FROM f WHERE len(ops) >= 12 GROUP BY ops) GROUP BY held")
def _(spark, folder):
    pairs = functions(spark, folder).filter("size >= 12").select(F.md5(F.array_join("ops", " ")).alias("h"), "binary_name").distinct()
    return pairs.groupBy("h").agg(F.count("binary_name").alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("signatures"))


@query("exclusive_shingles", f"{REPS}, sh AS (SELECT DISTINCT unit, unnest(list_transform(range(len(ops) - 4), lambda i: array_to_string(ops[i + 1 : i + 5], ' '))) AS s FROM rep), x AS (SELECT min(unit) AS a, max(unit) AS b FROM sh GROUP BY s HAVING count(*) = 2) SELECT a, b, count(*) AS shingles FROM x GROUP BY ALL")
def _(spark, folder):
    sh = _reps(spark, folder).select("unit", F.explode(F.array_distinct(ngrams(F.col("ops"), 5))).alias("s"))
    two = sh.groupBy("s").agg(F.min("unit").alias("a"), F.max("unit").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shingles"))
