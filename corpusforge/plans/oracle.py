"""DuckDB SQL oracles for the registered queries (same derived inputs as
``derived.py``, computed independently; for Python-source inputs the oracle
uses the closed-form counts of the generated text instead of parsing it)."""

from __future__ import annotations

from corpusforge.functions.text import PY_WS_SQL, sql_strip, sql_tokens
from corpusforge.plans.queries import chain_rows

NL = "chr(10)"
PFX = "'qiskitHumanEval/'"


def _near_sql(base: str, out: str, thr: float = 0.95) -> str:
    """Greedy ordered containment dedup: edges by token self-join, then a
    recursive walk in order carrying the list of dropped rows."""
    return f"""
WITH RECURSIVE base AS ({base}),
st AS (SELECT doc_id, {sql_strip('text')} AS s FROM base),
d1 AS (SELECT min(doc_id) AS doc_id FROM st GROUP BY s),
tk AS (SELECT DISTINCT st.doc_id AS id, unnest({sql_tokens('st.s')}) AS tok
       FROM st JOIN d1 USING (doc_id)),
nn AS (SELECT id, count(*) AS n FROM tk GROUP BY id),
ed AS (SELECT a.id AS i, b.id AS j FROM tk a JOIN tk b ON a.tok = b.tok AND b.id < a.id
       JOIN nn ON nn.id = a.id
       GROUP BY a.id, b.id, nn.n
       HAVING count(*)::DOUBLE / nn.n::DOUBLE >= {thr}::DOUBLE),
nodes AS (SELECT i AS id, row_number() OVER (ORDER BY i) AS rn FROM (SELECT DISTINCT i FROM ed)),
rec(rn, dropped) AS (
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT r.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM ed JOIN nodes x ON x.id = ed.i
                           WHERE x.rn = r.rn + 1 AND NOT list_contains(r.dropped, ed.j))
              THEN list_append(r.dropped, (SELECT id FROM nodes WHERE rn = r.rn + 1))
              ELSE r.dropped END
  FROM rec r WHERE r.rn < (SELECT count(*) FROM nodes)),
dropped AS (SELECT unnest(dropped) AS id FROM rec WHERE rn = (SELECT count(*) FROM nodes))
SELECT {out} FROM base
WHERE doc_id IN (SELECT doc_id FROM d1) AND doc_id NOT IN (SELECT id FROM dropped)
"""


def _chain_values() -> str:
    rows = ", ".join(f"({i}::BIGINT, '{t}')" for i, t in chain_rows())
    return f"SELECT * FROM (VALUES {rows}) AS v(doc_id, text)"


# ---- part -> generated files (closed form) ---------------------------------------

_PART_FILES = f"""
SELECT 'org/' || lower(replace(p_brand, '#', '')) AS repo,
       'src/' || lower(p_type) || '/part_' || p_partkey || '.py' AS path,
       p_partkey AS k, p_name,
       (p_size % 20)::INT AS a, (p_partkey % 4)::INT AS c,
       (CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END)::INT AS b
FROM part WHERE p_partkey % 17 <> 0
"""

_PART_CODE = (f"'def part_' || k || '(n):' || {NL} || '    \"\"\"' || p_name || '.\"\"\"' || {NL}"
              f" || repeat('    n = n + 1' || {NL}, a) || repeat('    print(n)' || {NL}, c)"
              f" || CASE WHEN b = 1 THEN '    if n > 0:' || {NL} || '        n = n - 1' || {NL} ELSE '' END"
              f" || '    return n'")


def _label(s: str, c: str, b: str) -> str:
    return (f"CASE WHEN {s} <= 5 AND {c} <= 2 AND {b} = 0 THEN 'basic' "
            f"WHEN ({s} > 5 AND {s} <= 15) OR {c} > 2 OR {b} > 0 THEN 'intermediate' "
            f"ELSE 'advanced' END")


_FUNCS = f"""
WITH f AS ({_PART_FILES})
SELECT repo, path, 0::INT AS fn_ord, 4::INT AS lineno, 'part_' || k AS name,
       p_name || '.' AS docstring, {_PART_CODE} AS code,
       (2 + a + 2 * b)::INT AS num_stmts, c AS num_calls, b AS num_branches FROM f
UNION ALL
SELECT repo, path, 3::INT, (21 + a + c + 2 * b)::INT, 'helper_' || k, '',
       'def helper_' || k || '(x):' || {NL} || '    return x', 2::INT, 0::INT, 0::INT FROM f
"""


def _tasks_sql(variant: bool) -> str:
    word = "Implement function `" if variant else "Implement `"
    test = (f", 'def check(candidate):' || {NL} || '    # TODO: write tests for `' || name || '`' || {NL}"
            f" || '    pass' || {NL} AS test") if variant else ""
    return f"""
WITH fn AS ({_FUNCS})
SELECT {PFX} || (row_number() OVER (ORDER BY repo, path, fn_ord) - 1) AS task_id,
       '# ' || docstring || {NL} || {NL} || '# {word}' || name || '` below.' AS prompt,
       code AS canonical_solution{test},
       name AS entry_point,
       {_label('num_stmts', 'num_calls', 'num_branches')} AS difficulty_scale
FROM fn
"""


# ---- documents -> tasks ---------------------------------------------------------

_DOC_TASKS = (f"SELECT doc_id, '# ' || source || {NL} || {NL} || '# Implement `doc_' || doc_id || '` below.' AS prompt, "
              f"text AS canonical_solution FROM documents")
_REJECTED = f"'# Incomplete or incorrect version' || {NL} || 'pass'"
_SYSTEM = (f"'Return XML blocks strictly:' || {NL} || '<reasoning>...</reasoning>' || {NL} || "
           f"'<answer>...</answer>' || {NL} || 'Where <answer> contains ONLY a valid Python function definition.'")

# ---- conversations -> completion texts --------------------------------------------

_COMPLETIONS = f"""
SELECT conv_id, turn, v,
       CASE WHEN turn % 2 = 0 THEN 'GRPO' ELSE 'ORPO' END AS model,
       {PFX} || (conv_id * 8 + turn) AS task_id,
       CASE v WHEN 0 THEN rs || '<answer>' || {NL} || code || {NL} || '</answer>'
              WHEN 1 THEN rs || '<answer>' || {NL} || code
              WHEN 2 THEN rs || '<answer>' || code || '</answer>' || {NL} || '<answer>second</answer>'
              WHEN 3 THEN text
              WHEN 4 THEN rs || '<answer>' || {NL} || code || {NL} || '    os.system(''ls'')' || {NL} || '</answer>'
              ELSE rs || '<answer>' || {NL} || code || {NL} || {NL} || 'def g(m):' || {NL} || '    return m' || {NL} || '</answer>'
       END AS t,
       CASE WHEN v IN (0, 1, 2) THEN 'ok' WHEN v = 4 THEN 'banned_calls'
            ELSE 'must_contain_exactly_one_function_def' END AS struct_reason
FROM (SELECT conv_id, turn, text, ((conv_id + turn) % 6)::INT AS v,
             '<reasoning>' || text || '</reasoning>' || {NL} AS rs,
             CASE ((conv_id + turn) % 4)::INT WHEN 0 THEN 'import qiskit' || {NL}
                  WHEN 1 THEN 'from qiskit import Aer' || {NL} WHEN 2 THEN ''
                  ELSE 'from qiskit import QuantumCircuit' || {NL} END
             || 'def f_' || conv_id || '_' || turn || '(n):' || {NL} || '    return n + ' || length(text) AS code
      FROM conversations)
"""

_ANSWERS = f"""
SELECT *, {sql_strip("split_part(coalesce(string_split(t, '<answer>')[2], ''), '</answer>', 1)")} AS answer,
       coalesce(regexp_matches(t, '(?s)<reasoning>.*?</reasoning>{PY_WS_SQL}*<answer>.*?</answer>'), false) AS xml_ok
FROM ({_COMPLETIONS})
"""


def _import_reason(a: str) -> str:
    has = f"(contains({a}, 'import qiskit') OR contains({a}, 'from qiskit'))"
    dep = f"(contains({a}, 'from qiskit import Aer') OR contains({a}, 'qiskit.Aer'))"
    return (f"CASE WHEN {has} AND {dep} THEN 'deprecated_aer_import' "
            f"WHEN {has} THEN 'qiskit_import_ok' ELSE 'missing_qiskit_import' END")


def _import_score(r: str) -> str:
    return (f"CASE WHEN {r} = 'qiskit_import_ok' THEN 1.0::DOUBLE "
            f"WHEN {r} = 'missing_qiskit_import' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END")


# ---- events -> measurements, completion records, outcomes --------------------------

_MEAS = f"""
SELECT model, task_id, has, sv, (sv AND event_id % 7 <> 0) AS counts_ok, ref_ok,
       CASE WHEN sv AND ref_ok THEN (event_id % 101)::DOUBLE / 100.0::DOUBLE END AS fidelity,
       CASE WHEN has THEN (user_id % 50)::INT END AS depth,
       CASE WHEN has THEN (user_id % 200)::INT END AS gates
FROM (SELECT event_id, user_id,
             CASE WHEN event_id % 2 = 0 THEN 'GRPO' ELSE 'ORPO' END AS model,
             {PFX} || (event_id // 2) AS task_id,
             coalesce(event_type <> 'error', false) AS has,
             coalesce(event_type <> 'error', false) AND event_id % 5 <> 0 AS sv,
             event_id % 11 <> 0 AS ref_ok
      FROM events)
"""

_RECORDS = f"""
SELECT CASE WHEN event_id % 2 = 0 THEN 'GRPO' ELSE 'ORPO' END AS model,
       {PFX} || (event_id // 2) AS task_id,
       coalesce(CASE WHEN event_id % 3 <> 0 THEN 'qc = build_' || event_id || '()' END,
                CASE WHEN event_id % 5 <> 0 THEN 'completion_' || event_id END, '') AS code,
       coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN NULL
                            ELSE 'ref_' || event_id END, ''),
                CASE WHEN event_id % 9 <> 0 THEN 'sol_' || event_id END) AS ref
FROM events WHERE event_id % 13 <> 0
"""

_OUTCOMES = f"""
SELECT r.model, r.task_id,
       (CASE WHEN coalesce(m.has, false) AND r.code <> '' THEN 1 ELSE 0 END)::INT AS compile_success,
       (CASE WHEN coalesce(m.has, false) AND r.code <> '' AND coalesce(m.sv, false) THEN 1 ELSE 0 END)::INT AS sim_success,
       CASE WHEN coalesce(m.has, false) AND r.code <> '' AND coalesce(m.sv, false)
                 AND r.ref IS NOT NULL AND r.ref <> '' AND coalesce(m.ref_ok, false) THEN m.fidelity END AS fidelity,
       (CASE WHEN coalesce(m.has, false) AND r.code <> '' THEN m.depth END)::INT AS depth
FROM ({_RECORDS}) r LEFT JOIN ({_MEAS}) m USING (model, task_id)
"""

#: task n is generation n % 2 of task n // 2
_TASK_NO = "split_part(task_id, '/', 2)::BIGINT"

_ARRAY_LINES = f"""
SELECT event_id, event_id // 1000 AS file, (event_id // 1000) % 5 = 4 AS cut,
       CASE WHEN event_id % 2 = 0 THEN 'GRPO' ELSE 'ORPO' END AS model,
       CASE WHEN event_id % 13 = 0 THEN '"broken entry"' ELSE
         '{{"task_id":"' || {PFX} || (event_id // 2) || '"'
         || CASE WHEN event_id % 3 <> 0 THEN ',"generated_code":"qc = build_' || event_id || '()"' ELSE '' END
         || CASE WHEN event_id % 5 <> 0 THEN ',"completion":"completion_' || event_id || '"' ELSE '' END
         || CASE event_id % 4 WHEN 0 THEN ',"reference":""' WHEN 1 THEN ''
                 ELSE ',"reference":"ref_' || event_id || '"' END
         || CASE WHEN event_id % 9 <> 0 THEN ',"canonical_solution":"sol_' || event_id || '"' ELSE '' END
         || '}}' END AS line
FROM events
"""

_COPIES = f"""
SELECT *, 'def make_' || own || '():' || {NL}
       || CASE kind
            WHEN 0 THEN '    \"\"\"' || list_aggregate(list_transform(range(17), lambda i: 's' || i || '_' || own),
                                                  'string_agg', ' ') || '\"\"\"' || {NL}
            ELSE list_aggregate(list_transform(range(17), lambda i: '    s' || i || '_' || own
                   || CASE kind WHEN 1 THEN ' = 1' ELSE '()' END || {NL}), 'string_agg', '') END
       || '    return 1' || CASE WHEN k % 4 = 2 THEN {NL} || '    more_' || own || '()' ELSE '' END AS code
FROM (SELECT p_partkey AS k, 'org/' || lower(replace(p_brand, '#', '')) AS repo,
             'part_' || p_partkey || '.py' AS path, p_partkey // 4 % 3 AS kind,
             CASE WHEN p_partkey % 4 = 3 THEN 'u' || p_partkey ELSE 'g' || (p_partkey // 4) END AS own
      FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0)
"""

_COPY_TASKS = f"""
SELECT row_number() OVER (ORDER BY repo, path) - 1 AS doc_id, code AS text,
       'make_' || own AS entry_point,
       CASE kind WHEN 0 THEN 'basic' WHEN 1 THEN 'advanced' ELSE 'intermediate' END AS difficulty_scale
FROM ({_COPIES})
"""

_SUMMARY = f"""
SELECT model,
       round_even(avg(compile_success) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS compile_rate,
       round_even(avg(sim_success) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS sim_rate,
       round_even(avg(fidelity) * 1000.0::DOUBLE, 0) / 1000.0::DOUBLE AS mean_fidelity,
       round_even(quantile_cont(depth, 0.5)::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS median_depth,
       count(task_id) AS count
FROM ({_OUTCOMES}) WHERE model IS NOT NULL GROUP BY model
"""

def _hist_sql(bins: int = 20) -> str:
    return f"""
WITH v AS (SELECT model, fidelity AS x FROM ({_OUTCOMES}) WHERE fidelity IS NOT NULL AND NOT isnan(fidelity)),
r0 AS (SELECT min(x) AS lo0, max(x) AS hi0 FROM v),
r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0),
p AS (SELECT lo, hi, (hi - lo) / {bins}.0::DOUBLE AS st, {bins}.0::DOUBLE / (hi - lo) AS norm FROM r),
b AS (SELECT v.model, v.x, p.lo, p.hi, p.st, least(floor((v.x - p.lo) * p.norm)::INT, {bins - 1}) AS b0 FROM v, p),
b1 AS (SELECT *, CASE WHEN x < b0::DOUBLE * st + lo THEN b0 - 1 ELSE b0 END AS b1 FROM b),
b2 AS (SELECT *, CASE WHEN b1 < {bins - 1} AND x >= (b1 + 1)::DOUBLE * st + lo THEN b1 + 1 ELSE b1 END AS bin FROM b1)
SELECT model, bin::INT AS bin, bin::DOUBLE * st + lo AS bin_lo,
       CASE WHEN bin = {bins - 1} THEN hi ELSE (bin + 1)::DOUBLE * st + lo END AS bin_hi,
       count(*) AS count
FROM b2 GROUP BY model, bin, st, lo, hi
"""


def _box_sql(source: str, by: str, col: str, result: str = "box") -> str:
    """Box statistics of ``col`` per group, or the outlying values."""
    head = f"""
WITH v AS (SELECT {by}, {col}::DOUBLE AS x FROM {source} WHERE {col} IS NOT NULL AND {by} IS NOT NULL),
q AS (SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM v GROUP BY {by}),
w0 AS (SELECT q.{by}, q1, median, q3,
              max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS hi,
              min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS lo
       FROM v JOIN q USING ({by}) GROUP BY q.{by}, q1, median, q3),
w AS (SELECT {by}, q1, median, q3,
             CASE WHEN lo IS NULL OR lo > q1 THEN q1 ELSE lo END AS whisker_lo,
             CASE WHEN hi IS NULL OR hi < q3 THEN q3 ELSE hi END AS whisker_hi FROM w0)"""
    if result == "outliers":
        return head + f"""
SELECT {by}, x AS {col} FROM w JOIN v USING ({by}) WHERE x < whisker_lo OR x > whisker_hi"""
    return head + f"""
SELECT w.{by}, q1, median, q3, whisker_lo, whisker_hi,
       count(CASE WHEN x < whisker_lo OR x > whisker_hi THEN 1 END) AS n_outliers
FROM w JOIN v USING ({by}) GROUP BY w.{by}, q1, median, q3, whisker_lo, whisker_hi"""


_PRICES = """
SELECT l_returnflag, count(*) AS n, """ + ", ".join(
    f"round(quantile_cont(l_extendedprice, {p}), 6) AS {c}"
    for p, c in ((0.01, "p01"), (0.1, "p10"), (0.5, "p50"), (0.9, "p90"), (0.99, "p99"))) + """
FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY l_returnflag"""


def _reward_sql(generations: bool = False) -> str:
    gen = f"REPLACE ({PFX} || ({_TASK_NO} // 2) AS task_id), {_TASK_NO} % 2 AS completion_id" if generations else ""
    keys = "model, task_id, completion_id" if generations else "model, task_id"
    return f"""
WITH a AS (SELECT * {gen} FROM ({_ANSWERS})),
t AS (SELECT {PFX} || doc_id AS task_id, {sql_strip("coalesce(text, '')")} AS reference FROM documents),
j AS (SELECT a.*, t.reference, m.has, m.sv, m.counts_ok, m.ref_ok, m.fidelity, m.depth, m.gates,
             {_import_reason('a.answer')} AS ir,
             (a.struct_reason = 'ok' AND coalesce(m.has, false)) AS ran
      FROM a LEFT JOIN t USING (task_id) LEFT JOIN (SELECT * {gen} FROM ({_MEAS})) m USING ({keys}))
SELECT {keys},
       0.5 * xml_ok::INT::DOUBLE + 0.5 * (struct_reason = 'ok')::INT::DOUBLE AS r_format,
       {_import_score('ir')} AS r_import,
       CASE WHEN ran THEN coalesce(sv, false)::INT::DOUBLE + 0.5 * coalesce(counts_ok, false)::INT::DOUBLE
            ELSE 0.0 END AS r_run,
       round_even(coalesce(CASE WHEN ran AND coalesce(sv, false) AND coalesce(ref_ok, false)
                                     AND coalesce(reference <> '', false)
                                THEN 2.0 * sqrt(fidelity) END, 0.0), 9) AS r_fidelity,
       round_even(CASE WHEN ran THEN 1.0 / (1.0 + ln(1 + CASE WHEN coalesce(depth, 0) = 0 THEN 1 ELSE depth END)
                       + 0.5 * ln(1 + CASE WHEN coalesce(gates, 0) = 0 THEN 1 ELSE gates END)) ELSE 0.0 END, 9) AS r_size
FROM j
"""


ORACLE = {
    "dedup_exact": f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {sql_strip('text')}",
    "dedup_near": _near_sql("SELECT doc_id, text, lang, source, n_chars FROM documents",
                            "doc_id, lang, source, n_chars"),
    "dedup_near_chain": _near_sql(f"SELECT doc_id, text FROM documents UNION ALL {_chain_values()}",
                                  "doc_id"),
    "listing": f"""
WITH it AS (SELECT (doc_id // 100 + 1)::INT AS page,
                   (row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1)::INT AS pos,
                   'doc_' || doc_id || '.py' AS path, concat_ws('/', source, lang) AS repo,
                   'main' AS branch FROM documents),
pg AS (SELECT page, count(*) AS c FROM it GROUP BY page),
lim AS (SELECT least(coalesce((SELECT min(page + 1) FROM pg WHERE page + 1 NOT IN (SELECT page FROM pg)) - 1, 2147483647),
                     coalesce((SELECT min(page) FROM pg WHERE c < 100), 2147483647)) AS last)
SELECT page, pos, path, repo, branch,
       concat_ws('/', 'https://raw.githubusercontent.com', repo, branch, path) AS url
FROM it WHERE page <= (SELECT last FROM lim) AND EXISTS (SELECT 1 FROM pg WHERE page = 1)
""",
    "listing_stops": """
WITH it AS (SELECT doc_id // 100 + 1 AS page, 'doc_' || doc_id || '.py' AS path,
                   row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos FROM documents),
runs AS (SELECT unnest(['failed', 'missing', 'short', 'no_first', 'capped']) AS run),
a AS (SELECT run, page, pos, path FROM runs, it
      WHERE NOT (run = 'failed' AND page % 7 = 2) AND NOT (run = 'missing' AND page % 8 = 3)
        AND NOT (run = 'no_first' AND page = 1) AND NOT (run = 'short' AND page % 6 = 2 AND pos >= 60)),
pg AS (SELECT run, page, count(*) AS c FROM a GROUP BY ALL),
gap AS (SELECT run, min(page) + 1 AS first_missing FROM pg p
        WHERE NOT EXISTS (SELECT 1 FROM pg x WHERE x.run = p.run AND x.page = p.page + 1) GROUP BY run),
short AS (SELECT run, min(page) AS first_short FROM pg WHERE c < 100 GROUP BY run),
got AS (SELECT a.* FROM a JOIN gap USING (run) LEFT JOIN short USING (run)
        WHERE page < first_missing AND page <= coalesce(first_short, page)
          AND EXISTS (SELECT 1 FROM pg WHERE pg.run = a.run AND pg.page = 1))
SELECT run, page::INT AS page, pos::INT AS pos, path FROM got
QUALIFY run <> 'capped' OR row_number() OVER (PARTITION BY run ORDER BY page, pos) <= 150
""",
    "flat_names": """
SELECT page_id, repo, path,
       CASE WHEN suffix(fl, '.py') THEN fl ELSE fl || '.py' END AS flat_name
FROM (SELECT page_id, repo, path, translate(repo, '/', '_') || '__' || translate(path, '/', '_') AS fl
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS repo,
                   regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages))
""",
    "scan_files": f"""
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 3 = 1 THEN replace(text, {NL}, chr(13) || {NL}) ELSE text END,
                              '\\r\\n?', {NL}, 'g') AS content
FROM documents WHERE doc_id % 7 <> 3 AND text IS NOT NULL
""",
    "keyword_filter": "SELECT doc_id FROM documents WHERE doc_id % 10 <> 9 AND contains(lower(text), 'the')",
    "extract_functions": f"SELECT repo, path, fn_ord, lineno, name FROM ({_FUNCS})",
    "difficulty": f"""SELECT repo, path, name, num_stmts, num_calls, num_branches,
       {_label('num_stmts', 'num_calls', 'num_branches')} AS difficulty_scale FROM ({_FUNCS})""",
    "difficulty_counts": f"SELECT difficulty_scale, count(*) AS count FROM ({_tasks_sql(False)}) GROUP BY difficulty_scale",
    "task_rows": _tasks_sql(False),
    "task_rows_variant": _tasks_sql(True),
    "curated_tasks": f"SELECT task_id, entry_point, difficulty_scale FROM ({_tasks_sql(False)})",
    "curated_copies": _near_sql(
        f"SELECT doc_id, text, {PFX} || doc_id AS task_id, entry_point, difficulty_scale FROM ({_COPY_TASKS})",
        "task_id, entry_point, difficulty_scale"),
    "difficulty_kept": _near_sql(f"SELECT doc_id, text, difficulty_scale FROM ({_COPY_TASKS})",
                                 "difficulty_scale, count(*) AS count") + "GROUP BY difficulty_scale",
    "quarantine_files": """
SELECT 'org/' || lower(replace(p_brand, '#', '')) AS repo,
       'src/' || lower(p_type) || '/part_' || p_partkey || '.py' AS path
FROM part WHERE p_partkey % 17 = 0""",
    "read_tasks_array": f"""
SELECT {PFX} || doc_id AS task_id, prompt, canonical_solution, 'doc_' || doc_id AS entry_point,
       'basic' AS difficulty_scale FROM ({_DOC_TASKS})""",
    "preference_rows": f"SELECT prompt, canonical_solution AS chosen, {_REJECTED} AS rejected FROM ({_DOC_TASKS})",
    "instruction_rows": f"""
SELECT 'Below is an instruction that describes a task. Write a response that completes it.' || {NL} || {NL}
       || '### Instruction:' || {NL} || prompt || {NL} || {NL} || '### Response:' || {NL} AS prompt,
       canonical_solution || '</s>' AS chosen, {_REJECTED} || '</s>' AS rejected
FROM ({_DOC_TASKS})""",
    "chat_rows": f"""
SELECT doc_id, 'system' AS system_role, {_SYSTEM} AS system_content, 'user' AS user_role,
       prompt AS user_content, {sql_strip("coalesce(canonical_solution, '')")} AS reference
FROM ({_DOC_TASKS})""",
    "roundtrip_json": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "roundtrip_array": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "roundtrip_csv": f"""
SELECT 'doc ' || doc_id AS prompt,
       CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '    ' || text || '  '
            WHEN 2 THEN 'say \"hi\"\\' || text || chr(13) || {NL} || chr(9) || 'end' ELSE text END AS chosen,
       {_REJECTED} AS rejected
FROM documents""",
    "answers": f"SELECT conv_id, turn, answer, xml_ok FROM ({_ANSWERS})",
    "format_reward": f"""
SELECT conv_id, turn, struct_reason,
       0.5 * xml_ok::INT::DOUBLE + 0.5 * (struct_reason = 'ok')::INT::DOUBLE AS r_format
FROM ({_ANSWERS})""",
    "import_reward": f"""
SELECT conv_id, turn, ir AS import_reason, {_import_score('ir')} AS r_import
FROM (SELECT conv_id, turn, {_import_reason('answer')} AS ir FROM ({_ANSWERS}))""",
    "run_rewards": f"""
SELECT model, task_id,
       CASE WHEN has THEN sv::INT::DOUBLE + 0.5 * counts_ok::INT::DOUBLE ELSE 0.0 END AS r_run,
       round_even(coalesce(CASE WHEN has AND sv AND ref_ok THEN 2.0 * sqrt(fidelity) END, 0.0), 9) AS r_fidelity,
       round_even(CASE WHEN has THEN 1.0 / (1.0 + ln(1 + CASE WHEN depth = 0 THEN 1 ELSE depth END)
                       + 0.5 * ln(1 + CASE WHEN gates = 0 THEN 1 ELSE gates END)) ELSE 0.0 END, 9) AS r_size
FROM ({_MEAS})""",
    "reward_table": _reward_sql(),
    "reward_generations": _reward_sql(generations=True),
    "read_completions_array": f"""
SELECT model, task_id, code, ref FROM ({_RECORDS.replace("SELECT CASE", "SELECT event_id, CASE", 1)})
WHERE (event_id // 1000) % 5 <> 4""",
    "quarantine_completions": f"""
SELECT model, 'broken entry' AS raw FROM ({_ARRAY_LINES}) WHERE NOT cut AND event_id % 13 = 0
UNION ALL
SELECT model, '[' || {NL} || string_agg(line, ',' || {NL} ORDER BY event_id) || {NL} AS raw
FROM ({_ARRAY_LINES}) WHERE cut GROUP BY model, file""",
    "outcomes_generations": f"SELECT * REPLACE ({PFX} || ({_TASK_NO} // 2) AS task_id), "
                            f"{_TASK_NO} % 2 AS completion_id FROM ({_OUTCOMES})",
    "outcomes_detail": f"""
SELECT * REPLACE (CASE {_TASK_NO} % 5 WHEN 0 THEN ' ' || task_id || ' ' WHEN 1 THEN 'a"b,' || task_id
                       WHEN 2 THEN task_id || chr(13) || {NL} || 'x' WHEN 3 THEN '' ELSE task_id END AS task_id)
FROM ({_OUTCOMES})""",
    "read_completions": f"SELECT model, task_id, code, ref FROM ({_RECORDS})",
    "outcomes": _OUTCOMES,
    "model_summary": _SUMMARY,
    "rates_long": f"""
SELECT model, 'compile_rate' AS metric, compile_rate AS rate FROM ({_SUMMARY})
UNION ALL SELECT model, 'sim_rate' AS metric, sim_rate AS rate FROM ({_SUMMARY})""",
    "fidelity_hist": _hist_sql(20),
    "depth_box": _box_sql(f"({_OUTCOMES})", "model", "depth"),
    "value_box": _box_sql("events", "event_type", "value"),
    "value_outliers": _box_sql("events", "event_type", "value", "outliers"),
    "price_quantiles": _PRICES,
}
