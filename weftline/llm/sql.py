"""DuckDB SQL of the queries whose results SQL can express on whole tables.

None for p6 (edit distances of opcode sequences), p7_near_runs (a priority
queue), p9 (ordered sampling) and p10 (line shapes): their tests hold them
against brute force, properties and labels.
"""

from __future__ import annotations

OP = "lower(trim(split_part(split_part({}, '@', 1), '.', 1)))"
SEQ = f"""
f AS (
  SELECT function_id, list_filter(list_transform(instructions, lambda x: {OP.format("x")}), lambda x: x IS NOT NULL) AS ops
  FROM (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY loaded_at DESC) AS rn FROM program_functions)
  WHERE rn = 1 AND function_id IS NOT NULL),
tok AS (SELECT function_id, unnest(ops) AS op, unnest(range(len(ops))) AS pos FROM f)"""

PATTERNS = f"""
WITH {SEQ},
special AS (SELECT DISTINCT lower(trim(opcode)) AS op FROM opcode_ref WHERE op_class <> 'generic'),
s AS (SELECT function_id, pos, op FROM tok SEMI JOIN special USING (op)),
g2 AS (SELECT a.function_id, b.pos, a.op || ' ' || b.op AS p FROM s a JOIN s b ON a.function_id = b.function_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4),
g3 AS (SELECT DISTINCT a.function_id, b.pos, a.p || ' ' || b.op AS p FROM g2 a JOIN s b ON a.function_id = b.function_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4),
g4 AS (SELECT DISTINCT a.function_id, b.pos, a.p || ' ' || b.op AS p FROM g3 a JOIN s b ON a.function_id = b.function_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4),
g5 AS (SELECT DISTINCT a.function_id, b.pos, a.p || ' ' || b.op AS p FROM g4 a JOIN s b ON a.function_id = b.function_id AND b.pos BETWEEN a.pos + 1 AND a.pos + 4),
n AS (SELECT count(*) AS n FROM f),
c AS (SELECT p AS pattern, count(DISTINCT function_id) AS function_count FROM (FROM g3 UNION ALL FROM g4 UNION ALL FROM g5) GROUP BY p)
SELECT pattern{{more}} FROM c, n WHERE function_count >= greatest(5, n * 5 // 1000)"""

SIMILAR = f"""
WITH {SEQ},
sh AS (SELECT DISTINCT function_id, unnest(list_transform(range(len(ops) - 3), lambda i: array_to_string(ops[i + 1 : i + 4], ' '))) AS g FROM f WHERE len(ops) >= 40),
n AS (SELECT function_id, count(*) AS n FROM sh GROUP BY ALL),
c AS (SELECT a.function_id AS x, b.function_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.function_id < b.function_id GROUP BY ALL)
SELECT x AS function_id1, y AS function_id2{{more}}
FROM c JOIN n AS p ON p.function_id = x JOIN n AS q ON q.function_id = y WHERE c / (p.n + q.n - c) >= 0.6"""

SPANS = f"""
WITH {SEQ},
w AS (SELECT function_id, unnest(range(len(ops) - 31)) AS a, unnest(list_transform(range(len(ops) - 31), lambda i: md5(array_to_string(ops[i + 1 : i + 32], ' ')))) AS h FROM f WHERE len(ops) >= 32),
two AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT function_id) > 1),
sp AS (SELECT DISTINCT function_id, unnest(range(a, a + 32)) AS pos FROM w SEMI JOIN two USING (h)),
isl AS (SELECT function_id, pos, pos - row_number() OVER (PARTITION BY function_id ORDER BY pos) AS k FROM sp),
spans AS (SELECT function_id, CAST(min(pos) AS INTEGER) AS start_pos, CAST(max(pos) AS INTEGER) AS end_pos FROM isl GROUP BY function_id, k)"""

FREQUENCY = f"""
WITH {SEQ},
n AS (SELECT count(*) AS n FROM f),
t AS (SELECT op AS opcode, count(*) AS "count", count(DISTINCT function_id) AS functions FROM tok GROUP BY op),
m AS (SELECT opcode, "count", round("count" / sum("count") OVER (), 9) AS relative_frequency, functions,
  CASE WHEN functions <= 2 THEN 'rare' WHEN functions >= 0.5 * n THEN 'common' END AS mark FROM t, n)"""

RUNS = f"""
WITH i AS (SELECT DISTINCT instr_id, function_id, address, {OP.format("mnemonic")} AS op FROM instructions WHERE mnemonic IS NOT NULL AND function_id IS NOT NULL AND address IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY function_id ORDER BY address, instr_id) - row_number() OVER (PARTITION BY function_id, op ORDER BY address, instr_id) AS k FROM i),
r AS (SELECT function_id, op AS opcode, count(*) AS instructions, min(address) AS start_address, max(address) AS end_address FROM k GROUP BY function_id, op, k)"""

LEAKS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(len(w) - 11), lambda i: array_to_string(w[i + 1 : i + 12], ' '))) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT item_id, unnest(list_transform(range(len(w) - 11), lambda i: array_to_string(w[i + 1 : i + 12], ' '))) AS g FROM e WHERE len(w) >= 12),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
WITH RECURSIVE m AS (SELECT list_filter(list_transform(members, lambda x: trim(x)), lambda x: x IS NOT NULL) AS m FROM clone_families),
l AS (SELECT trim(func_id1) AS a, trim(func_id2) AS b FROM clone_pairs WHERE func_id1 IS NOT NULL AND func_id2 IS NOT NULL
  UNION SELECT m[1], unnest(m) FROM m WHERE len(m) > 0),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS func_id, a AS other FROM e UNION SELECT r.func_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT func_id, min(other) AS group_id FROM r GROUP BY func_id""",
        "p2_found": PATTERNS.format(more=""),
        "p2_support": PATTERNS.format(more=", function_count, round(function_count / n, 9) AS function_coverage"),
        "p3_found": SIMILAR.format(more=""),
        "p3_similarity": SIMILAR.format(more=", round(c / (p.n + q.n - c), 9) AS jaccard"),
        "p3_classes": f"""
WITH pairs AS ({SIMILAR.format(more="")}), {SEQ[1:]},
cl AS (SELECT function_id, min(function_id) OVER (PARTITION BY ops) AS rep FROM f WHERE len(ops) >= 40),
li AS (SELECT x, count(*) AS links FROM (SELECT function_id1 AS x, function_id2 AS y FROM pairs UNION ALL SELECT function_id2, function_id1 FROM pairs) e
  JOIN cl a ON a.function_id = x AND a.rep = x JOIN cl b ON b.function_id = y AND b.rep = y GROUP BY x)
SELECT function_id, rep, coalesce(links, 0) AS links FROM cl LEFT JOIN li ON x = rep""",
        "p4_found": f"{SPANS} SELECT * FROM spans",
        "p4_cover": f"""{SPANS}
SELECT f.function_id, count(start_pos) AS spans, CAST(coalesce(sum(end_pos - start_pos + 1), 0) AS BIGINT) AS covered,
  round(CASE WHEN len(any_value(ops)) > 0 THEN coalesce(sum(end_pos - start_pos + 1), 0) / len(any_value(ops)) END, 9) AS share
FROM f LEFT JOIN spans ON f.function_id = spans.function_id GROUP BY f.function_id""",
        "p5_found": f"{FREQUENCY} SELECT opcode, mark FROM m WHERE mark IS NOT NULL",
        "p5_frequency": f"{FREQUENCY} SELECT * FROM m",
        "p7_found": f"{RUNS} SELECT function_id, start_address, end_address FROM r WHERE instructions >= 4",
        "p7_runs": f"{RUNS} SELECT * FROM r",
        "p8_found": f"{LEAKS} SELECT * FROM hit",
        "p8_overlap": rf"""{LEAKS},
ea AS (SELECT item_id, len(w) AS n, len(regexp_extract_all(lower(list_extract(string_split_regex(trim(text), '[.?!]\s+'), -1)), '[\p{{L}}\p{{N}}]+')) AS a FROM e JOIN eval_items USING (item_id)),
eq AS (SELECT item_id, n, CASE WHEN a < n THEN n - a ELSE n END AS q FROM ea),
ep AS (SELECT item_id, unnest(range(len(w) - 11)) AS p, unnest(list_transform(range(len(w) - 11), lambda i: array_to_string(w[i + 1 : i + 12], ' '))) AS g FROM e WHERE len(w) >= 12),
cov AS (SELECT DISTINCT doc_id, item_id, unnest(range(p, p + 12)) AS word FROM dg JOIN ep USING (g))
SELECT doc_id, item_id, CAST(any_value(q) AS INTEGER) AS question_words, CAST(count(*) FILTER (word < q) AS INTEGER) AS question_shared,
  CAST(any_value(n - q) AS INTEGER) AS answer_words, CAST(count(*) FILTER (word >= q) AS INTEGER) AS answer_shared
FROM cov JOIN eq USING (item_id) GROUP BY doc_id, item_id""",
        "p8_items": f"{LEAKS} SELECT item_id, count(*) AS documents FROM hit GROUP BY item_id",
    }
