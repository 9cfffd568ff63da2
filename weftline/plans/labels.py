"""Queries on labels, ablations, resampling, sources and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.tokens import band
from weftline.operators import classify as cf
from weftline.operators import frequency as fq
from weftline.operators import resample as re
from weftline.plans.common import SQL_F, SQL_H, SQL_T, functions, instruction_rows, programs, r6
from weftline.session import checkpoint_folder, cut, grows
from weftline.sources import disassembly as ds
from weftline.sources.tables import latest, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


KIND = """CASE WHEN coalesce(name, '') IN ('_start','_init','_fini','__gmon_start__','deregister_tm_clones','register_tm_clones','__libc_csu_init','__libc_csu_fini','frame_dummy') OR regexp_matches(coalesce(name, ''), '^(__libc_|_IO_|__cxa_|_dl_|__do_global_)') THEN 'startup_runtime'
WHEN regexp_matches(lower(coalesce(name, '')), '[.@]plt|[.]got') OR (len(ops) BETWEEN 1 AND 4 AND len(list_filter(ops, lambda x: x NOT IN ('jmp','endbr64','nop','ret'))) = 0) THEN 'stubs' ELSE 'internal' END"""


@query("classify_unit", f"WITH {SQL_F} SELECT function_id, {KIND} AS kind FROM f")
def _(spark, folder):
    return functions(spark, folder).select("function_id", cf.unit_class(F.col("name"), F.col("ops")).alias("kind"))


@query("class_summary", f"WITH {SQL_F} SELECT {KIND} AS kind, count(*) AS functions, CAST(sum(len(ops)) AS BIGINT) AS instructions FROM f GROUP BY 1")
def _(spark, folder):
    return functions(spark, folder).groupBy(cf.unit_class(F.col("name"), F.col("ops")).alias("kind")).agg(F.count(F.lit(1)).alias("functions"), F.sum("size").alias("instructions"))


INS = "i AS (SELECT DISTINCT ON (instr_id) instr_id, function_id, address, lower(trim(split_part(split_part(mnemonic, '@', 1), '.', 1))) AS m, operands FROM instructions WHERE mnemonic IS NOT NULL ORDER BY instr_id, loaded_at DESC), o AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(coalesce(operands, ''), '\\[[^\\]]*\\]', '[]', 'g'), ','), lambda x: trim(x)), lambda x: x <> '') AS ops FROM i)"


def _ins(spark, folder) -> DataFrame:
    from weftline.functions.tokens import normalize_token

    return instruction_rows(spark, folder).withColumn("m", normalize_token(F.col("mnemonic")))


@query("split_operands", f"WITH {INS} SELECT len(ops) AS operands, count(*) AS n FROM o GROUP BY 1")
def _(spark, folder):
    return _ins(spark, folder).groupBy(F.size(cf.operand_list(F.col("operands"))).cast("bigint").alias("operands")).agg(F.count(F.lit(1)).alias("n"))


_REG = cf.ANY_REGISTER.replace("(?:", "(")
_CLS = f"CASE WHEN contains(x, '[') THEN 'mem' WHEN regexp_matches(lower(x), '^{_REG}$') THEN 'reg' WHEN regexp_matches(x, '^-?(0x[0-9a-fA-F]+|[0-9]+)$') THEN 'imm' WHEN regexp_matches(x, '^[a-zA-Z_][a-zA-Z0-9_@.<>+\\-]*$') THEN 'label' WHEN regexp_matches(lower(x), '\\b{_REG}\\b') THEN 'reg' ELSE 'imm' END"


NORM = r"""CASE WHEN contains(op, '[rip+') THEN CASE WHEN regexp_extract(op, '#\s*([0-9a-f]+)', 1) <> '' THEN 'DATA@' || coalesce(nullif(ltrim(regexp_extract(op, '#\s*([0-9a-f]+)', 1), '0'), ''), '0') ELSE regexp_replace(op, '\[rip\+0x[0-9a-f]+\]', '[rip+ADDR]', 'g') END
  WHEN regexp_extract(op, '<([^>+]+)(\+0x[0-9a-f]+)?>', 1) <> '' THEN CASE WHEN regexp_extract(op, '<([^>+]+)(\+0x[0-9a-f]+)?>', 1) = coalesce(name, '') THEN 'SELFREL' ELSE 'SYM:' || regexp_extract(op, '<([^>+]+)(\+0x[0-9a-f]+)?>', 1) END
  WHEN regexp_matches(trim(op), '^[0-9a-f]+$') THEN 'REL' ELSE op END"""


SPLIT = r"'(?:\[[^\]]*\]|[^,\[])+'"  # operands between commas outside brackets


@query("norm_operands", f"WITH {INS}, {SQL_F}, x AS (SELECT function_id, unnest(list_filter(list_transform(regexp_extract_all(coalesce(operands, ''), {SPLIT}), lambda x: trim(x)), lambda x: x <> '')) AS op FROM i), y AS (SELECT op, name FROM x LEFT JOIN f USING (function_id)) SELECT {NORM} AS operand, count(*) AS n FROM y GROUP BY 1")
def _(spark, folder):
    """Operands without what only their place decides."""
    rows = _ins(spark, folder).select("function_id", F.explode(cf.operand_list(F.col("operands"))).alias("op"))
    named = rows.join(grows(functions(spark, folder).select("function_id", "name")), "function_id", "left")
    return named.groupBy(cf.norm_operand(F.col("op"), F.col("name")).alias("operand")).agg(F.count(F.lit(1)).alias("n"))


@query("tokenize_class", f"WITH {INS} SELECT array_to_string([m] || list_transform(ops, lambda x: {_CLS}), '_') AS token, count(*) AS n FROM o GROUP BY 1")
def _(spark, folder):
    return _ins(spark, folder).groupBy(cf.class_token(F.col("m"), F.col("operands")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("tokenize_bucket")
def _(spark, folder):
    return _ins(spark, folder).groupBy(cf.bucket_token(F.col("m"), F.col("operands")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query("norm_role")
def _(spark, folder):
    return _ins(spark, folder).groupBy(cf.role(F.col("m"), F.col("operands")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def _role_units(spark, folder) -> DataFrame:
    """(function_id, rows): instructions of a function in order with their roles;
    a function has a bounded size."""
    rows = _ins(spark, folder).filter("function_id is not null and address is not null")
    step = F.struct("address", "instr_id", cf.role(F.col("m"), F.col("operands")).alias("role"), F.coalesce("operands", F.lit("")).alias("operands"), cf.value_kind(F.col("m"), F.col("operands")).alias("kind"))
    return rows.groupBy("function_id").agg(F.array_sort(F.collect_list(step)).alias("rows"))


@query("neardup_normalized")
def _(spark, folder):
    """Groups of functions with the same roles throughout."""
    key = F.md5(F.array_join(F.transform("rows", lambda x: x["role"]), " "))
    g = _role_units(spark, folder).filter(F.size("rows") >= 12).groupBy(key.alias("signature")).agg(F.min("function_id").alias("representative"), F.count(F.lit(1)).alias("members"))
    return g.filter("members >= 2")


@query("family_diff")
def _(spark, folder):
    """Kinds of differences between the representative and members of one signature."""
    key = F.md5(F.array_join(F.transform("rows", lambda x: x["role"]), " "))
    units = cut(_role_units(spark, folder).filter(F.size("rows") >= 12).withColumn("signature", key))
    rep = units.groupBy("signature").agg(F.min("function_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    lead = rep.join(units.select(F.col("function_id").alias("rep"), F.col("rows").alias("ref")), "rep").select("signature", "rep", "ref")
    both = units.join(lead, "signature").filter("function_id <> rep")
    diff = F.filter(F.zip_with("ref", "rows", lambda a, b: F.when((a["operands"] != b["operands"]) & (b["kind"] != "padding"), b["kind"])), lambda x: x.isNotNull())
    out = both.select("rep", "function_id", F.size("rows").alias("n"), diff.alias("d"))
    return out.select("rep", "function_id", F.size("d").alias("differences"), r6(100 * (F.col("n") - F.size("d")) / F.col("n")).alias("similarity"), F.array_join(F.array_sort(F.array_distinct("d")), ",").alias("kinds"))


@query("monotonic_check", f"WITH {INS}, q AS (SELECT function_id, address, lag(address) OVER (PARTITION BY function_id ORDER BY instr_id) AS before FROM i) SELECT function_id, count(*) FILTER (before >= address) AS backward FROM q GROUP BY function_id")
def _(spark, folder):
    w = Window.partitionBy("function_id").orderBy("instr_id")
    q = _ins(spark, folder).withColumn("before", F.lag("address").over(w))
    return q.groupBy("function_id").agg(F.count_if(F.col("before") >= F.col("address")).alias("backward"))


# Fingerprints

_SUMS = ", ".join(f"sum(CASE WHEN tok IN ({', '.join(repr(x) for x in t)}) THEN c ELSE 0 END) / sum(c) AS \"{n}\"" for n, t in cf.FEATURES.items())
FP = f"WITH {SQL_T}, c AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL), fp AS (SELECT seq, {_SUMS}, count(*) / sum(c) AS \"distinct\" FROM c GROUP BY seq)"


def _fp(spark, folder) -> DataFrame:
    return cf.fingerprint(fq.token_counts(programs(spark, folder), ["seq"]))


@query("fingerprint_features", f"{FP} SELECT seq, {', '.join(f'round({chr(34)}{n}{chr(34)}, 6) AS {chr(34)}{n}{chr(34)}' for n in [*cf.FEATURES, 'distinct'])} FROM fp")
def _(spark, folder):
    out = _fp(spark, folder)
    return out.select("seq", *[r6(c).alias(c) for c in out.columns if c != "seq"])


_P = lambda cond, n: f"CASE WHEN {cond} THEN {n} ELSE 0 END"
_SC: dict = {}
for _, _answer, _feature, _comparison, _value, _weight in cf.FINGERPRINT_RULES:
    _SC.setdefault(_answer, []).append((cf.rule_condition(_feature, _comparison, _value, '"'), round(10 * _weight)))
LABEL = f"{FP}, sc AS (SELECT seq, {', '.join('(' + ' + '.join(_P(c, n) for c, n in rules) + f') AS {k}' for k, rules in _SC.items())} FROM fp), lb AS (SELECT seq, CASE WHEN gcc >= clang AND gcc >= rustc THEN 'gcc' WHEN clang >= rustc THEN 'clang' ELSE 'rustc' END AS compiler, least(10, greatest(gcc, clang, rustc)) AS compiler_score, CASE WHEN O0 >= O2 AND O0 >= O3 THEN 'O0' WHEN O2 >= O3 THEN 'O2' ELSE 'O3' END AS level, least(10, greatest(O0, O2, O3)) AS level_score FROM sc)"


@query("fingerprint_label", f"{LABEL} SELECT * FROM lb")
def _(spark, folder):
    return cf.fingerprint_label(_fp(spark, folder))


@query("fingerprint_summary", f"{LABEL} SELECT compiler, level, count(*) AS programs, round(avg(compiler_score), 6) AS score FROM lb GROUP BY ALL")
def _(spark, folder):
    return cf.fingerprint_label(_fp(spark, folder)).groupBy("compiler", "level").agg(F.count(F.lit(1)).alias("programs"), r6(F.avg("compiler_score")).alias("score"))


# Ablations

VARIANTS = {
    "baseline": ("ops", lambda o: o), "first_2": ("CASE WHEN len(ops) > 2 THEN ops[3:] ELSE [] END", lambda o: cf.without_ends(o, 2, 0)), "last_2": ("CASE WHEN len(ops) > 2 THEN ops[:len(ops) - 2] ELSE [] END", lambda o: cf.without_ends(o, 0, 2)),
    "both_3": ("CASE WHEN len(ops) > 6 THEN ops[4:len(ops) - 3] ELSE [] END", lambda o: cf.without_ends(o, 3, 3)), "no_nop": ("list_filter(ops, lambda x: x <> 'nop')", lambda o: F.filter(o, lambda x: x != "nop")),
    "no_epilogue": ("CASE WHEN ops[len(ops) - 2 : len(ops)] = ['add', 'pop', 'ret'] THEN ops[:len(ops) - 3] WHEN ops[len(ops) - 1 : len(ops)] IN (['leave', 'ret'], ['pop', 'ret']) THEN ops[:len(ops) - 2] ELSE ops END", cf.without_epilogue),
    "no_prologue": ("CASE WHEN ops[:4] = ['endbr64', 'push', 'mov', 'sub'] THEN ops[5:] WHEN ops[:3] = ['endbr64', 'push', 'mov'] THEN ops[4:] WHEN ops[:2] = ['endbr64', 'push'] THEN ops[3:] WHEN ops[1] = 'endbr64' THEN ops[2:] WHEN ops[:3] = ['push', 'mov', 'sub'] THEN ops[4:] WHEN ops[:2] = ['push', 'mov'] THEN ops[3:] WHEN ops[1] = 'push' THEN ops[2:] ELSE ops END", cf.without_prologue),
}
ABLATE = f"WITH {SQL_F}, v AS ({' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS variant, {sql} AS ops FROM f' for k, (sql, _f) in VARIANTS.items())}), c AS (SELECT variant, tok, count(*) AS c FROM (SELECT variant, unnest(ops) AS tok FROM v WHERE len(ops) >= 5) GROUP BY ALL), h AS (SELECT variant, {SQL_H} AS h, CAST(sum(c) AS BIGINT) AS tokens FROM c GROUP BY variant)"


def _ablated(spark, folder) -> DataFrame:
    every = F.array(*[F.struct(F.lit(k).alias("variant"), f(F.col("ops")).alias("ops")) for k, (_s, f) in VARIANTS.items()])
    rows = functions(spark, folder).select(F.explode(every).alias("v")).select("v.*").filter(F.size("ops") >= 5)
    return re.entropy_of(fq.token_counts(rows, ["variant"]), ["variant"])


@query("ablate", f"{ABLATE} SELECT variant, round(h, 6) AS h, tokens FROM h")
def _(spark, folder):
    return _ablated(spark, folder).select("variant", r6("h").alias("h"), F.col("n").alias("tokens"))


@query("ablation_delta", f"{ABLATE} SELECT h.variant, round(100 * (h.h - b.h) / abs(b.h), 6) + 0.0 AS change, abs(100 * (h.h - b.h) / abs(b.h)) < 10 AS survives FROM h, h b WHERE b.variant = 'baseline'")
def _(spark, folder):
    h = cut(_ablated(spark, folder))
    base = h.filter("variant = 'baseline'").select(F.col("h").alias("old"))
    change = re.percent_change(F.col("h"), F.col("old"))
    return h.join(F.broadcast(base)).select("variant", r6(change).alias("change"), (F.abs(change) < 10).alias("survives"))


# Resampling

SEQC = f"WITH {SQL_T}, sc AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL)"
BOOT = f"""{SEQC}, dr AS (SELECT rep, seq, ('0x' || substr(md5(seq || '|' || rep || '|42'), 1, 15))::BIGINT % 1000000 AS u FROM (SELECT DISTINCT seq FROM sc), (SELECT unnest(range(1, 21)) AS rep)),
wt AS (SELECT rep, seq, CASE WHEN u < 367879 THEN 0 WHEN u < 735759 THEN 1 WHEN u < 919699 THEN 2 WHEN u < 981012 THEN 3 WHEN u < 996340 THEN 4 ELSE 5 END AS w FROM dr), c AS (SELECT rep, tok, sum(c * w) AS c FROM sc JOIN wt USING (seq) WHERE w > 0 GROUP BY ALL), h AS (SELECT rep, {SQL_H} AS h FROM c GROUP BY rep)"""


def _seq_counts(spark, folder) -> DataFrame:
    return cut(fq.token_counts(programs(spark, folder), ["seq"]))


@query("bootstrap_ci", f"{BOOT} SELECT round(quantile_cont(h, 0.025), 6) AS low, round(avg(h), 6) AS mean, round(quantile_cont(h, 0.975), 6) AS high, round(stddev_samp(h), 6) AS error, quantile_cont(h, 0.975) - quantile_cont(h, 0.025) < 0.1 * avg(h) AS stable FROM h")
def _(spark, folder):
    h = re.bootstrap_entropy(_seq_counts(spark, folder))
    low, high = F.percentile("h", F.lit(0.025)), F.percentile("h", F.lit(0.975))
    return h.agg(r6(low).alias("low"), r6(F.avg("h")).alias("mean"), r6(high).alias("high"), r6(F.stddev_samp("h")).alias("error"), (high - low < 0.1 * F.avg("h")).alias("stable"))


@query("leave_one_out", f"{SEQC}, tt AS (SELECT tok, sum(c) AS t FROM sc GROUP BY tok), x AS (SELECT s.seq, tt.t - coalesce(sc.c, 0) AS c FROM (SELECT DISTINCT seq FROM sc) s CROSS JOIN tt LEFT JOIN sc ON sc.seq = s.seq AND sc.tok = tt.tok), h AS (SELECT seq, {SQL_H} AS h FROM x WHERE c > 0 GROUP BY seq) SELECT seq, round(h, 6) AS h FROM h")
def _(spark, folder):
    return re.leave_one_out(_seq_counts(spark, folder)).select("seq", r6("h").alias("h"))


@query("subsample", f"{SEQC}, o AS (SELECT draw, seq, row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substr(md5(seq || '|' || draw || '|7'), 1, 15))::BIGINT, seq) AS k, count(*) OVER (PARTITION BY draw) AS n FROM (SELECT DISTINCT seq FROM sc), (SELECT unnest(range(1, 6)) AS draw)), p AS (SELECT share, draw, seq FROM o, (SELECT unnest([0.25, 0.5, 1.0]) AS share) WHERE k <= greatest(2, round(n * CAST(share AS DOUBLE)))), c AS (SELECT share, draw, tok, sum(c) AS c FROM p JOIN sc USING (seq) GROUP BY ALL), h AS (SELECT share, draw, {SQL_H} AS h FROM c GROUP BY ALL) SELECT CAST(share AS DOUBLE) AS share, round(avg(h), 6) AS mean, round(stddev_pop(h), 6) + 0.0 AS deviation FROM h GROUP BY share")
def _(spark, folder):
    counts = _seq_counts(spark, folder)
    picked = re.subsample(counts.select("seq").distinct(), [0.25, 0.5, 1.0], 5, 7)
    h = re.entropy_of(picked.join(counts, "seq").groupBy("share", "draw", "tok").agg(F.sum("c").alias("c")), ["share", "draw"])
    return h.groupBy("share").agg(r6(F.avg("h")).alias("mean"), r6(F.stddev_pop("h")).alias("deviation"))


@query("truncation", f"WITH {SQL_T}, c AS (SELECT cap, tok, count(*) AS c FROM t, (SELECT unnest([1000, 5000, 10000]) AS cap) WHERE gpos < cap AND seq IS NOT NULL GROUP BY ALL) SELECT CAST(cap AS BIGINT) AS cap, round({SQL_H}, 6) AS h, CAST(sum(c) AS BIGINT) AS tokens FROM c GROUP BY cap")
def _(spark, folder):
    """How much the entropy depends on the length of sequences: the cap is the feature."""
    from weftline.operators.units import positions

    caps = F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1000, 5000, 10000)]))
    counts = positions(programs(spark, folder)).select("gpos", "tok", caps.alias("cap")).filter("gpos < cap").groupBy("cap", "tok").agg(F.count(F.lit(1)).alias("c"))
    return re.entropy_of(counts, ["cap"]).select("cap", r6("h").alias("h"), F.col("n").alias("tokens"))


B = "b AS (SELECT DISTINCT ON (binary_id) * FROM binaries ORDER BY binary_id, extracted_at DESC, name)"


def _binaries(spark, folder) -> DataFrame:
    return latest(table(spark, folder, "binaries"), ["binary_id"], [F.col("extracted_at"), F.col("name")])


@query("group_means_gs", f"WITH {B} SELECT trim(category) AS category, trim(compiler) AS compiler, CAST(grouping(trim(category)) AS INTEGER) AS no_category, CAST(grouping(trim(compiler)) AS INTEGER) AS no_compiler, count(*) AS n, round(avg(instruction_count), 6) AS mean FROM b GROUP BY GROUPING SETS ((trim(category)), (trim(compiler)), (trim(category), trim(compiler)))")
def _(spark, folder):
    b = _binaries(spark, folder).select(F.trim("category").alias("category"), F.trim("compiler").alias("compiler"), "instruction_count")
    sets = b.groupingSets([["category"], ["compiler"], ["category", "compiler"]], "category", "compiler")
    return sets.agg(F.grouping("category").cast("int").alias("no_category"), F.grouping("compiler").cast("int").alias("no_compiler"), F.count(F.lit(1)).alias("n"), r6(F.avg("instruction_count")).alias("mean"))


@query("anova_r2", f"WITH {B}, l AS (SELECT 'category' AS factor, trim(category) AS lv, CAST(function_count AS DOUBLE) AS v FROM b UNION ALL SELECT 'compiler', trim(compiler), CAST(function_count AS DOUBLE) FROM b), k AS (SELECT factor, lv, count(*) AS k, sum(v) AS s, sum(v * v) AS q FROM l WHERE lv IS NOT NULL AND v IS NOT NULL GROUP BY ALL) SELECT factor, round((sum(s * s / k) - pow(sum(s), 2) / sum(k)) / (sum(q) - pow(sum(s), 2) / sum(k)), 6) AS r2, CAST(sum(k) AS BIGINT) AS n FROM k GROUP BY factor")
def _(spark, folder):
    b = _binaries(spark, folder).select(F.trim("category").alias("category"), F.trim("compiler").alias("compiler"), F.col("function_count").cast("double").alias("v"))
    return re.anova_r2(b, ["category", "compiler"], "v").select("factor", r6("r2").alias("r2"), "n")


@query("label_split", f"WITH {B} SELECT binary_id, split_part(trim(compiler), '-', 1) AS family, nullif(split_part(trim(compiler), '-', 2), '') AS level FROM b WHERE compiler IS NOT NULL")
def _(spark, folder):
    parts = F.split(F.trim("compiler"), "-")
    return _binaries(spark, folder).filter("compiler is not null").select("binary_id", F.get(parts, 0).alias("family"), F.get(parts, 1).alias("level"))


@query("dedup_first", "SELECT binary_id, inode FROM (SELECT *, row_number() OVER (PARTITION BY inode ORDER BY binary_id, name, path) AS k FROM (SELECT DISTINCT binary_id, inode, name, path FROM binaries)) WHERE k = 1 OR inode IS NULL")
def _(spark, folder):
    rows = table(spark, folder, "binaries").select("binary_id", "inode", "name", "path").distinct().withColumn("at", F.struct("binary_id", "name", "path"))
    return ds.first_per_inode(rows, "inode", "at").select("binary_id", "inode")


@query("infer_category", f"WITH {B} SELECT binary_id, CASE WHEN lower(name) LIKE '%zip%' OR lower(name) LIKE '%tar%' THEN 'compression' WHEN lower(name) LIKE '%fmt%' OR lower(name) LIKE '%cat%' THEN 'text_processing' WHEN lower(name) LIKE '%ctl%' THEN 'system' ELSE 'other' END AS category FROM b")
def _(spark, folder):
    n = F.lower("name")
    rules = [(["zip", "tar"], "compression"), (["fmt", "cat"], "text_processing"), (["ctl"], "system")]
    out = F.lit("other")
    for parts, label in reversed(rules):
        hit = n.contains(parts[0])
        for p in parts[1:]:
            hit = hit | n.contains(p)
        out = F.when(hit, label).otherwise(out)
    return _binaries(spark, folder).select("binary_id", out.alias("category"))


@query("category_summary", f"WITH {B}, c AS (SELECT trim(category) AS category, count(*) AS n FROM b WHERE category IS NOT NULL GROUP BY 1) SELECT count(*) AS categories, CAST(sum(n) AS BIGINT) AS labelled, arg_max(category, (n, category)) AS commonest, count(*) FILTER (n = 1) AS singletons FROM c")
def _(spark, folder):
    c = _binaries(spark, folder).filter("category is not null").groupBy(F.trim("category").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("categories"), F.sum("n").alias("labelled"), F.max_by("category", F.struct("n", "category")).alias("commonest"), F.count_if(F.col("n") == 1).alias("singletons"))


# Checks of one table against another

SIDES = f"WITH {SQL_T}, x AS (SELECT tok, count(*) AS n FROM t GROUP BY tok), r AS (SELECT DISTINCT ON (freq_id) * FROM frequency_table ORDER BY freq_id, reported_at DESC, count DESC), y AS (SELECT lower(trim(split_part(split_part(opcode, '@', 1), '.', 1))) AS tok, CAST(sum(count) AS BIGINT) AS n FROM r WHERE opcode IS NOT NULL GROUP BY 1)"


def _sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    from weftline.functions.tokens import normalize_token

    x = fq.token_counts(programs(spark, folder)).withColumnRenamed("c", "n")
    r = latest(table(spark, folder, "frequency_table"), ["freq_id"], [F.col("reported_at"), F.col("count")]).filter("opcode is not null")
    return x, r.groupBy(normalize_token(F.col("opcode")).alias("tok")).agg(F.sum("count").alias("n"))


@query("count_diff", f"{SIDES} SELECT tok, coalesce(x.n, 0) AS counted, coalesce(y.n, 0) AS reported FROM x FULL JOIN y USING (tok) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)")
def _(spark, folder):
    x, y = _sides(spark, folder)
    both = x.withColumnRenamed("n", "counted").join(y.withColumnRenamed("n", "reported"), "tok", "full_outer").fillna(0, ["counted", "reported"])
    return both.filter("counted <> reported")


@query("exclude_names", "SELECT DISTINCT trim(binary_name) AS name FROM program_functions WHERE trim(binary_name) NOT IN (SELECT trim(binary_name) FROM documents WHERE binary_name IS NOT NULL)")
def _(spark, folder):
    ours = table(spark, folder, "program_functions").select(F.trim("binary_name").alias("name")).dropna().distinct()
    return ours.join(table(spark, folder, "documents").select(F.trim("binary_name").alias("name")), "name", "left_anti")


@query("set_ops", "WITH a AS (SELECT DISTINCT trim(func_id) AS k FROM program_functions WHERE func_id IS NOT NULL), b AS (SELECT DISTINCT trim(func_id1) AS k FROM clone_pairs WHERE func_id1 IS NOT NULL) SELECT (SELECT count(*) FROM (FROM a UNION FROM b)) AS either, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_first")
def _(spark, folder):
    a = table(spark, folder, "program_functions").select(F.trim("func_id").alias("k")).dropna().distinct().withColumn("a", F.lit(1))
    b = table(spark, folder, "clone_pairs").select(F.trim("func_id1").alias("k")).dropna().distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full_outer").agg(F.count(F.lit(1)).alias("either"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_first"))


@query("zipf_band", f"WITH {SQL_T}, c AS (SELECT seq, tok, count(*) AS c FROM t WHERE seq IS NOT NULL GROUP BY ALL), r AS (SELECT seq, c, row_number() OVER (PARTITION BY seq ORDER BY c DESC, tok) AS rank FROM c), a AS (SELECT seq, CASE WHEN count(*) >= 2 THEN -regr_slope(ln(c), ln(rank)) ELSE 0 END AS a FROM r GROUP BY seq) SELECT CASE WHEN a < 0.5 THEN 'very flat' WHEN a < 0.8 THEN 'flat' WHEN a < 1.2 THEN 'classic' WHEN a < 1.5 THEN 'steep' ELSE 'extreme' END AS band, count(*) AS programs FROM a GROUP BY 1")
def _(spark, folder):
    fits = fq.zipf_ols(fq.rank_frequency(fq.token_counts(programs(spark, folder), ["seq"]), ["seq"]), ["seq"])
    labels = band(F.col("alpha"), [0.5, 0.8, 1.2, 1.5], ["very flat", "flat", "classic", "steep", "extreme"])
    return fits.groupBy(labels.alias("band")).agg(F.count(F.lit(1)).alias("programs"))


@query("listing_lines", r"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(trim(line), '^[0-9a-f]+ <.+>:$')) AS headers FROM l GROUP BY doc_id HAVING count(*) FILTER (regexp_matches(trim(line), '^[0-9a-f]+ <.+>:$')) > 0")
def _(spark, folder):
    lines = ds.lines_of(table(spark, folder, "documents"), "doc_id", "text")
    return lines.filter(F.trim("line").rlike(r"^[0-9a-f]+ <.+>:$")).groupBy(F.col("file").alias("doc_id")).agg(F.count(F.lit(1)).alias("headers"))


@query("parse_disasm")
def _(spark, folder):
    """Instructions of the listings in documents, with their functions."""
    return ds.parse_listing(ds.lines_of(table(spark, folder, "documents").filter("doc_id is not null"), "doc_id", "text"))


@query("stream_ngrams", f"WITH {SQL_F} SELECT gram, count(*) AS c FROM (SELECT unnest(list_transform(range(len(ops) - 1), lambda i: ops[i + 1] || ' ' || ops[i + 2])) AS gram FROM (SELECT list_filter(list_transform(instructions, lambda x: lower(trim(split_part(split_part(x, '@', 1), '.', 1)))), lambda x: x IS NOT NULL) AS ops FROM program_functions) WHERE len(ops) > 1) GROUP BY gram")
def _(spark, folder):
    """Bigrams counted by a stream over all delivered rows."""
    import uuid

    from weftline.functions.tokens import opcode_array
    from weftline.streaming.counts import run_to_table, stream_ngrams

    path = f"{folder}/program_functions.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/program_functions.parque[t]").select(opcode_array(F.col("instructions")).alias("ops"))
    name = f"grams_{uuid.uuid4().hex}"
    run_to_table(stream_ngrams(rows, 2), name, f"{checkpoint_folder(spark)}/{name}")
    return spark.table(name)


@query("catalog_scan", f"WITH {B}, k AS (SELECT binary_id, inode, trim(category) AS category, trim(name) AS name, file_size FROM b WHERE category IS NOT NULL AND file_size <= 100000), d AS (SELECT *, row_number() OVER (PARTITION BY inode ORDER BY category, name, binary_id) AS n FROM k) SELECT binary_id, category, name FROM d WHERE n = 1 OR inode IS NULL ORDER BY category, name, binary_id LIMIT 20")
def _(spark, folder):
    """The first 20 programs of the catalogue that aren't too large, each inode once: the limit is the feature."""
    k = _binaries(spark, folder).filter("category is not null and file_size <= 100000").select("binary_id", "inode", F.trim("category").alias("category"), F.trim("name").alias("name"))
    k = ds.first_per_inode(k.withColumn("at", F.struct("category", "name", "binary_id")), "inode", "at")
    return k.orderBy("category", "name", "binary_id").limit(20).select("binary_id", "category", "name")


SEEDS = f"""WITH {SQL_T}, s AS (SELECT seed, seq, tok, row_number() OVER (PARTITION BY seed, seq ORDER BY md5(seq || '|' || gpos || '|' || seed), gpos) AS gpos FROM t, (SELECT unnest([1, 2, 3]) AS seed) WHERE seq IS NOT NULL),
g2 AS (SELECT seed, tok || ' ' || lead(tok) OVER (PARTITION BY seed, seq ORDER BY gpos) AS gram FROM s), c AS (SELECT seed, gram, count(*) AS c FROM g2 WHERE gram IS NOT NULL GROUP BY ALL), h AS (SELECT seed, ({SQL_H}) / 2 AS rate FROM c GROUP BY seed)"""


@query("shuffle_seeds", f"{SEEDS} SELECT round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) + 0.0 AS deviation, stddev_pop(rate) < 0.05 * avg(rate) AS stable FROM h")
def _(spark, folder):
    from weftline.operators.cluster import union_all
    from weftline.operators.units import position_ngrams, shuffled

    units = programs(spark, folder)
    parts = [position_ngrams(shuffled(units, s), [2]).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).withColumn("seed", F.lit(s)) for s in (1, 2, 3)]
    h = re.entropy_of(union_all(parts), ["seed"]).select((F.col("h") / 2).alias("rate"))
    spread = F.stddev_pop("rate")
    return h.agg(r6(F.avg("rate")).alias("mean"), r6(spread).alias("deviation"), (spread < 0.05 * F.avg("rate")).alias("stable"))


CONS = f"""WITH {SQL_T}, dim AS (SELECT trim(name) AS seq, max(trim(category)) AS category FROM binaries GROUP BY 1), x AS (SELECT category, seq, gpos, tok, lead(tok) OVER (PARTITION BY seq ORDER BY gpos) AS nx FROM t JOIN dim USING (seq) WHERE category IS NOT NULL),
c1 AS (SELECT category, tok, count(*) AS c FROM x GROUP BY ALL), c2 AS (SELECT category, tok, nx, count(*) AS c FROM x WHERE nx IS NOT NULL GROUP BY ALL), h1 AS (SELECT category, {SQL_H} AS h FROM c1 GROUP BY category), h2 AS (SELECT category, ({SQL_H}) / 2 AS h FROM c2 GROUP BY category)"""


@query("consistency", f"{CONS} SELECT count(*) AS categories, bool_and(h2.h < h1.h) AS rates_fall, bool_and(h1.h > 1) AS varied, CASE WHEN bool_and(h2.h < h1.h) AND bool_and(h1.h > 1) THEN 'strong' WHEN bool_or(h2.h < h1.h) THEN 'mixed' ELSE 'none' END AS verdict FROM h1 JOIN h2 USING (category)")
def _(spark, folder):
    """Do all categories, taken as corpora of their own, show falling entropy rates?"""
    from weftline.operators.information import entropy_rates
    from weftline.operators.units import unit_ngrams

    dim = table(spark, folder, "binaries").groupBy(F.trim("name").alias("seq")).agg(F.max(F.trim("category")).alias("category")).filter("category is not null")
    counts = unit_ngrams(programs(spark, folder), [1, 2]).groupBy("seq", "n", "gram").agg(F.count(F.lit(1)).alias("c")).join(dim, "seq").groupBy("category", "n", "gram").agg(F.sum("c").alias("c"))
    rates = entropy_rates(counts, ["category"]).groupBy("category").agg(F.max(F.when(F.col("n") == 1, F.col("h"))).alias("h1"), F.max(F.when(F.col("n") == 2, F.col("rate"))).alias("h2")).dropna()
    falls = F.col("h2") < F.col("h1")
    verdict = F.when(F.bool_and(falls) & F.bool_and(F.col("h1") > 1), "strong").when(F.bool_or(falls), "mixed").otherwise("none")
    return rates.agg(F.count(F.lit(1)).alias("categories"), F.bool_and(falls).alias("rates_fall"), F.bool_and(F.col("h1") > 1).alias("varied"), verdict.alias("verdict"))
