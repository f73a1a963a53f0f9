"""The same answers in SQL for DuckDB, over tables of the same names."""

from ..operators import attempts as at, correction as co, runlog as rl
from . import fixtures as fx
from .queries import BASE, SMALL_PARTS, YEAR

_BLOCKS = {
    "transactions": fx.TRANSACTIONS,
    "scripts": fx.SCRIPTS,
    "paths": fx.PATHS,
    "attempts": fx.ATTEMPTS,
    "log_lines": fx.LOG_LINES,
    "error_lines": fx.ERROR_LINES,
    "raw_lines": fx.RAW_LINES,
    "responses": fx.RESPONSES,
    "people": fx.PEOPLE,
    "input_rows": fx.INPUT_ROWS,
    "untyped_rows": fx.UNTYPED_ROWS,
}

# The white space of ASCII; the fixtures hold no other at their edges.
_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _strip(text: str) -> str:
    return f"trim({text}, {_WS})"


def _text(value: str) -> str:
    """A SQL literal; line breaks as chr(10)."""
    parts = value.replace("'", "''").split("\n")
    return "(" + " || chr(10) || ".join(f"'{p}'" for p in parts) + ")"


def _over(blocks: str, query: str, **ctes: str) -> str:
    named = {b: fx.sql(_BLOCKS[b]) for b in blocks.split()} | ctes
    body = ",\n".join(f"{name} AS (\n{text}\n)" for name, text in named.items())
    return f"WITH {body}\n{query}"


_ENRICHED = """
SELECT id_registro, UPPER(nome_cliente) AS nome_cliente_upper, data_transacao, valor_transacao,
       CAST(YEAR(data_transacao) AS INT) AS ano_transacao,
       CAST(MONTH(data_transacao) AS INT) AS mes_transacao,
       'Sistema_B' AS source_system
FROM transactions
"""
_FINAL = """
SELECT id_registro, nome_cliente_upper AS cliente_final, data_transacao,
       valor_transacao AS valor_final, ano_transacao, mes_transacao, source_system
FROM enriched
"""

_KEY = "CAST(p_partkey AS STRING)"
_CALLS = f"""
SELECT p_partkey AS script_id, c.* FROM part JOIN (
  VALUES (0, 1, 'in_', '.parquet', '{BASE}/', 'read', false),
         (0, 2, 'out/', '.parquet', '{BASE}/', 'write', false),
         (1, 1, 'in_', '', '{BASE}/', 'read', false),
         (2, 1, '/abs/', '', '', 'read', false),
         (3, 1, NULL, NULL, NULL, 'read', false),
         (5, 1, 's3a://bucket/', '', '', 'read', false),
         (6, 1, '../up_', '', '{BASE}/', 'read', true),
         (7, 1, 'l', NULL, '{BASE}/', 'read', false),
         (7, 2, 'r', NULL, '{BASE}/', 'read', false)
) AS c(variant, call_no, head, tail, under, direction, escapes) ON p_partkey % 8 = c.variant
"""
_PATHS_OF_CALLS = f"""
SELECT script_id, CAST(call_no AS INT) AS call_no, direction, escapes, under,
       head || CASE WHEN variant = 7 THEN '' ELSE CAST(script_id AS STRING) || tail END
         AS original_path
FROM calls
"""
_ORDER = """
WITH RECURSIVE ids AS (
  SELECT p_partkey AS id FROM part
), uses AS (
  SELECT id, 't/' || CAST(id // 2 AS STRING) AS path, 'read' AS direction FROM ids
  UNION ALL SELECT id, 't/' || CAST(id AS STRING), 'write' FROM ids
  UNION ALL SELECT id, 'hub', CASE WHEN id <= 2 THEN 'write' ELSE 'read' END FROM ids
  UNION ALL SELECT id, 't/' || CAST(2 * id AS STRING), 'read' FROM ids WHERE id % 32 = 31
  UNION ALL SELECT id, 'raw/' || CAST(id AS STRING), 'read' FROM ids WHERE id % 5 = 0
), needs AS (
  SELECT DISTINCT r.id AS id, w.id AS other FROM uses r JOIN uses w
    ON r.path = w.path AND r.direction = 'read' AND w.direction = 'write' AND r.id <> w.id
), reach AS (
  SELECT id, other FROM needs
  UNION
  SELECT reach.id, needs.other FROM reach JOIN needs ON reach.other = needs.id
), cycles AS (
  SELECT id FROM reach WHERE id = other
), stuck AS (
  SELECT id FROM cycles UNION SELECT id FROM reach WHERE other IN (SELECT id FROM cycles)
), core AS (
  SELECT id FROM cycles
  UNION SELECT other FROM reach
    WHERE id IN (SELECT id FROM cycles) AND other IN (SELECT id FROM stuck)
    AND other IN (SELECT other FROM reach JOIN cycles ON reach.other = cycles.id)
), chains AS (
  SELECT id, 0::BIGINT AS level FROM ids WHERE id NOT IN (SELECT id FROM stuck)
  UNION
  SELECT needs.id, chains.level + 1 FROM chains JOIN needs ON needs.other = chains.id
  WHERE needs.id NOT IN (SELECT id FROM stuck)
), levels AS (
  SELECT id, max(level) AS level FROM chains GROUP BY id
), unwritten AS (
  SELECT id, count(DISTINCT path) AS n FROM uses
  WHERE direction = 'read' AND path NOT IN (SELECT path FROM uses WHERE direction = 'write')
  GROUP BY id
)
SELECT ids.id AS script_id, level, ids.id IN (SELECT id FROM core) AS on_cycle,
       coalesce(n, 0) AS n_unwritten
FROM ids LEFT JOIN levels ON levels.id = ids.id LEFT JOIN unwritten ON unwritten.id = ids.id
"""
_REWRITTEN = f"""
SELECT script_id, code,
       CASE script_id % 8
         WHEN 0 THEN 'df = spark.read.parquet(''{BASE}/in_' || k || '.parquet'')' || chr(10)
           || 'df.write.mode(''overwrite'').parquet(''{BASE}/out/' || k || '.parquet'')'
         WHEN 1 THEN 'df = spark.read.parquet(path=''{BASE}/in_' || k || ''')'
         WHEN 2 THEN 'df = spark.read.parquet(''/abs/' || k || ''')'
         WHEN 3 THEN 'p = ''x''' || chr(10) || 'df = spark.read.parquet(p)'
         WHEN 4 THEN code
         WHEN 5 THEN 'df = spark.read.parquet(''s3a://bucket/' || k || ''')'
         WHEN 6 THEN 'df = spark.read.parquet(''{BASE}/../up_' || k || ''')'
         ELSE 'a = spark.read.parquet(''{BASE}/l'')'
           || '.join(spark.read.parquet(''{BASE}/r''), ''id'')'
       END AS rewritten_code,
       CAST(NULL AS STRING) AS stage_error, script_id % 8 = 6 AS escapes
FROM (SELECT *, CAST(script_id AS STRING) AS k FROM scripts)
"""

_OUTPUTS = f"""
SELECT run_id, attempt, {_strip("string_agg(line, '' ORDER BY seq)")} AS full_output
FROM log_lines GROUP BY run_id, attempt
"""
_BOUNDS = f"""
SELECT run_id, attempt, MIN(seq) AS b_start, MAX(seq) AS b_end, BOOL_OR(line <> '') AS b_printed,
       MIN(seq) FILTER ({_strip("line")} <> '') AS b_first,
       MAX(seq) FILTER ({_strip("line")} <> '') AS b_last
FROM log_lines GROUP BY run_id, attempt
"""
# Lines between the outer white space; of blank outputs one empty line, or for notes all.
_TRIMMED = f"""
SELECT *, seq - COALESCE(b_first, b_start) AS place, b_first IS NULL AS blank,
       b_first IS NULL AND b_printed AS shown,
       CASE WHEN b_first IS NULL
              THEN CASE WHEN b_printed AND stream = 'stdout' THEN line ELSE '' END
            WHEN b_first = b_last THEN {_strip("line")}
            WHEN seq = b_first THEN ltrim(line, {_WS})
            WHEN seq = b_last THEN rtrim(line, {_WS})
            ELSE line END AS kept
FROM log_lines JOIN bounds USING (run_id, attempt)
"""


def _parts(width: int) -> str:
    return f"""
SELECT run_id, attempt, CAST(place // {width} AS BIGINT) AS part,
       string_agg(CASE WHEN blank THEN '' ELSE kept END, '' ORDER BY seq) AS full_output
FROM trimmed WHERE CASE WHEN blank THEN place = 0 ELSE seq BETWEEN b_first AND b_last END
GROUP BY ALL
"""


_SHOWN = f"""
SELECT run_id, attempt, CAST(place // {SMALL_PARTS} AS BIGINT) AS part, blank, b_printed,
       CASE WHEN shown THEN b_end - b_start ELSE COALESCE(b_last - b_first, 0) END
         // {SMALL_PARTS} AS last_part,
       string_agg(kept, '' ORDER BY seq) AS text
FROM trimmed
WHERE CASE WHEN shown THEN true WHEN blank THEN place = 0 ELSE seq BETWEEN b_first AND b_last END
GROUP BY ALL
"""
_WITH_OUTPUT = f"""
SELECT a.*, COALESCE(part, 0) AS part, COALESCE(part = 0, true) AS is_first,
       COALESCE(part = last_part, true) AS is_last,
       CASE WHEN NOT blank THEN text
            WHEN b_printed THEN CASE WHEN part = 0 THEN 'STDOUT:' || chr(10) ELSE '' END || text
              || CASE WHEN part = last_part THEN chr(10) || chr(10) || 'STDERR:' ELSE '' END
            WHEN COALESCE(exit_code, -99) <> 0
              THEN {_text(rl.NO_OUTPUT_NOTE).replace("%d",
                   "' || CAST(COALESCE(exit_code, -99) AS STRING) || '")}
            ELSE '' END AS output
FROM attempts a LEFT JOIN shown_parts o ON a.run_id = o.run_id AND a.attempt = o.attempt
"""
_LAST_LINE = "full_output LIKE '%SUCESSO%' AND string_split(full_output, chr(10))[-1]"

_SUGGESTS = "COALESCE(suggestion <> '', false)"
_DIFFERS = f"{_strip('suggestion')} IS DISTINCT FROM {_strip('code')}"
_ACTIONS = f"""
SELECT *, CASE WHEN stage_error = 'analysis' THEN 'analysis_error'
               WHEN stage_error = 'save' THEN 'save_error'
               WHEN COALESCE(exit_code, -99) = 0 AND stage_error IS NULL THEN 'success'
               WHEN attempt >= 3 THEN 'max_attempts'
               WHEN NOT {_SUGGESTS} THEN 'no_suggestion'
               WHEN NOT ({_DIFFERS}) THEN 'same_code'
               ELSE 'retry' END AS action
FROM attempts
"""
_OUTCOMES = """
SELECT r.run_id, COALESCE(a.action, 'incomplete') AS outcome, a.attempt,
       COALESCE(a.attempt, r.latest) AS attempts_used
FROM (SELECT run_id, MAX(attempt) AS latest,
             MIN(attempt) FILTER (WHERE action <> 'retry') AS final
      FROM actions GROUP BY run_id) r
LEFT JOIN actions a ON a.run_id = r.run_id AND a.attempt = r.final
"""
_CUT_OFF = (
    "CASE WHEN stage_error = 'stream' AND is_last"
    f" THEN {_text(rl.STREAM_ERROR_NOTE)} ELSE '' END"
)
_REPORT = f"""
SELECT o.run_id, o.outcome, o.attempt, w.part,
       CASE WHEN o.outcome IN ('analysis_error', 'save_error')
              THEN {_text(at.STAGE_ERROR_NOTE).replace("%s", "' || o.outcome || '")}
            ELSE w.output || {_CUT_OFF} || CASE WHEN NOT is_last THEN '' ELSE CASE o.outcome
              WHEN 'same_code' THEN {_text(at.SAME_CODE_NOTE)}
              WHEN 'no_suggestion' THEN {_text(at.NO_SUGGESTION_NOTE)}
              ELSE '' END END END AS report
FROM outcomes o JOIN with_output w ON o.run_id = w.run_id AND o.attempt = w.attempt
WHERE o.outcome NOT IN ('success', 'incomplete')
  AND (w.part = 0 OR o.outcome NOT IN ('analysis_error', 'save_error'))
"""
_PROMPTS = f"""
SELECT run_id, attempt, part,
       CASE WHEN is_first THEN {_text(co.INSTRUCTION + co.CODE_HEAD)}
         || COALESCE(code, {_text(co.NO_CODE_NOTE)}) || {_text(co.OUTPUT_HEAD)} ELSE '' END
         || CASE WHEN NOT (is_first AND is_last) THEN output || {_CUT_OFF}
                 WHEN {_strip("output || " + _CUT_OFF)} = '' THEN {_text(co.EMPTY_OUTPUT_NOTE)}
                 ELSE {_strip("output || " + _CUT_OFF)} END
         || CASE WHEN is_last THEN {_text(co.END)} ELSE '' END AS prompt
FROM with_output
WHERE (stage_error = 'stream' OR stage_error IS NULL AND COALESCE(exit_code, -99) <> 0)
  AND attempt < 3
"""
_UNFENCED = f"""
SELECT conv_id, turn, {_strip(
    "CASE WHEN starts_with(t, '```python') THEN substr(t, 10)"
    " WHEN starts_with(t, '```') THEN substr(t, 4) ELSE t END"
)} AS t
FROM (SELECT conv_id, turn, {_strip("raw")} AS t FROM responses)
"""
_CLEANED = f"""
SELECT conv_id, turn, NULLIF(CASE WHEN ends_with(t, '```')
         THEN {_strip("left(t, length(t) - 3)")} ELSE t END, '') AS code
FROM unfenced
"""

_ERROR = r"'(?m)^([\w.]*(?:Error|Exception))(?:: (.*))?$'"
_ERRORS = f"""
SELECT run_id, attempt, regexp_extract_all(out, {_ERROR}, 1)[-1] AS error_type,
       NULLIF(regexp_extract_all(out, {_ERROR}, 2)[-1], '') AS error_message
FROM (SELECT run_id, attempt, string_agg(line, '' ORDER BY seq) AS out
      FROM error_lines GROUP BY run_id, attempt)
"""

_KINDS = """
SELECT error_type, template, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT error_type, n_words, head, any_value(n) AS n,
         string_agg(CASE WHEN low IS NULL THEN '' WHEN low <> high OR regexp_matches(low, '[0-9]')
           THEN '<*>' ELSE low END, ' ' ORDER BY place) AS template
  FROM (
    SELECT error_type, n_words, head, place, min(ws[place]) AS low, max(ws[place]) AS high, count(*) AS n
    FROM (
      SELECT *, len(ws) AS n_words, unnest(range(1, greatest(len(ws), 1) + 1)) AS place,
             list_transform(ws[1:2], lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END)
               AS head
      FROM (
        SELECT error_type, list_filter(string_split_regex(coalesce(error_message, ''), ' +'),
          lambda w: w <> '') AS ws
        FROM errors WHERE error_type IS NOT NULL
      )
    )
    GROUP BY ALL
  )
  GROUP BY error_type, n_words, head
) GROUP BY ALL
"""

_TRANSACTION_COLUMNS = [
    ("id_registro", "bigint"),
    ("nome_cliente", "string"),
    ("data_transacao", "date"),
    ("valor_transacao", "double"),
]
_SCHEMA_REPORT = "\nUNION ALL\n".join(
    f"SELECT {i} AS pos, '{name}' AS name, '{kind}' AS type, true AS nullable,"
    f" COUNT(*) AS n_rows, COUNT(*) - COUNT({name}) AS n_null FROM transactions"
    for i, (name, kind) in enumerate(_TRANSACTION_COLUMNS)
)
_FRAMES = f"""
SELECT run_id, attempt, 'start' AS place,
       '--- Iniciando execução da Tentativa ' || CAST(attempt AS STRING) || ' ---' || chr(10) AS text
FROM attempts
UNION ALL
SELECT run_id, attempt, 'end' AS place,
       chr(10) || '--- Fim da execução (Tentativa ' || CAST(attempt AS STRING)
         || ') --- Código de Saída: ' || CAST(COALESCE(exit_code, -99) AS STRING)
         || ' ---' || chr(10) AS text
FROM attempts
"""
_RESOLVED = f"""
SELECT path_id, path,
       CASE path_id % 8
         WHEN 0 THEN '{BASE}/' || path
         WHEN 1 THEN '{BASE}/nested/in_' || CAST(path_id AS STRING)
         WHEN 2 THEN path WHEN 3 THEN path WHEN 5 THEN path
         ELSE '{BASE}/' || path END AS resolved_path,
       path_id % 8 IN (4, 6) AS escapes
FROM paths
"""


def oracle_sql() -> dict[str, str]:
    all_transactions = _over("transactions", "SELECT * FROM transactions")
    outputs = {"outputs": _OUTPUTS}
    trimmed = {"bounds": _BOUNDS, "trimmed": _TRIMMED}
    with_output = trimmed | {"shown_parts": _SHOWN, "with_output": _WITH_OUTPUT}
    calls = {"calls": _CALLS, "call_paths": _PATHS_OF_CALLS}
    outcomes = {"actions": _ACTIONS, "outcomes": _OUTCOMES}
    return {
        "rows_typed": _over(
            "untyped_rows",
            "SELECT id_registro, nome_cliente, CAST(data_transacao AS DATE) AS data_transacao,"
            " valor_transacao FROM untyped_rows",
        ),
        "rows_inferred": _over(
            "people", "SELECT id, name, CAST(age AS BIGINT) AS age FROM people"
        ),
        "parquet_scan": "SELECT * FROM orders",
        "parquet_roundtrip": all_transactions,
        "date_parts": _over(
            "transactions",
            "SELECT *, CAST(YEAR(data_transacao) AS INT) AS ano_transacao,"
            " CAST(MONTH(data_transacao) AS INT) AS mes_transacao FROM transactions",
        ),
        "upper_name": _over(
            "transactions",
            "SELECT *, UPPER(nome_cliente) AS nome_cliente_upper FROM transactions",
        ),
        "constant_column": _over(
            "transactions", "SELECT *, 'Sistema_B' AS source_system FROM transactions"
        ),
        "project_reorder": _over("transactions", _ENRICHED),
        "project_rename": _over("transactions", _FINAL, enriched=_ENRICHED),
        "filter_year": _over(
            "transactions",
            f"SELECT * FROM transactions WHERE YEAR(data_transacao) = {YEAR}",
        ),
        "filter_ge": _over("people", "SELECT * FROM people WHERE age >= 18"),
        "row_count": _over("transactions", "SELECT COUNT(*) AS n FROM transactions"),
        "preview": _over(
            "transactions", "SELECT * FROM transactions ORDER BY id_registro LIMIT 5"
        ),
        "schema_report": _over("transactions", _SCHEMA_REPORT),
        "etl_flow": _over(
            "transactions",
            f"{_FINAL} WHERE ano_transacao = {YEAR}",
            enriched=_ENRICHED,
        ),
        "etl_years": _over(
            "transactions",
            f"{_FINAL} WHERE ano_transacao IN ({YEAR}, {YEAR + 1})",
            enriched=_ENRICHED.replace(
                "'Sistema_B'",
                f"CASE YEAR(data_transacao) WHEN {YEAR} THEN 'Sistema_B' ELSE 'Sistema_A' END",
            ),
        ),
        "run_ids": (
            "SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS run_id,"
            " 'run_' || md5(CAST(o_orderkey AS VARCHAR)) AS base_name FROM orders"
        ),
        "resolve_paths": _over("paths", _RESOLVED),
        "workspace_roundtrip": all_transactions,
        "default_input": _over("input_rows", "SELECT * FROM input_rows"),
        "script_syntax": _over(
            "scripts",
            "SELECT script_id, script_id % 8 <> 4 AS ok,"
            " CASE WHEN script_id % 8 = 4 THEN 'SyntaxError' END AS error_type,"
            " CAST(CASE WHEN script_id % 8 = 4 THEN 2 END AS INT) AS line,"
            " CASE WHEN script_id % 8 = 4 THEN '''('' was never closed' END AS message"
            " FROM scripts",
        ),
        "script_paths": _over(
            "",
            "SELECT script_id, call_no, original_path, under || original_path AS resolved_path,"
            " direction, original_path IS NULL AS dynamic, escapes FROM call_paths",
            **calls,
        ),
        "script_inputs": _over(
            "",
            "SELECT script_id, original_path, COUNT(*) AS n FROM call_paths"
            f" WHERE direction = 'read' AND under = '{BASE}/' GROUP BY script_id, original_path",
            **calls,
        ),
        "script_rewrite": _over("scripts", _REWRITTEN),
        "dataset_usage": _over(
            "",
            "SELECT original_path, direction, COUNT(*) AS n FROM call_paths"
            " WHERE original_path IS NOT NULL GROUP BY original_path, direction",
            **calls,
        ),
        "script_inferred_paths": f"""
SELECT p_partkey AS script_id, CAST(1 AS INT) AS call_no, path AS inferred_path,
       '{BASE}/' || path AS resolved_path, direction, dynamic,
       COALESCE(path LIKE '..%', false) AS escapes
FROM (
  SELECT p_partkey, head || CAST(p_partkey AS STRING) AS path, direction, dynamic
  FROM part JOIN (
    VALUES (0, 'data/d', 'read', true), (1, 'in/n=', 'read', true), (2, NULL, 'read', true),
           (3, '../out_', 'write', true), (4, NULL, 'read', true), (5, 'in_', 'read', false)
  ) AS c(variant, head, direction, dynamic) ON p_partkey % 6 = c.variant
)
""",
        "script_order": _ORDER,
        "log_display": _over(
            "log_lines",
            "SELECT run_id, attempt, seq, CASE WHEN stream = 'stderr' THEN '[STDERR] ' ELSE '' END"
            " || line AS text FROM log_lines",
        ),
        "log_frames": _over("attempts", _FRAMES),
        "log_full_output": _over("log_lines", _parts(rl.PART_LINES), **trimmed),
        "log_output_parts": _over("log_lines", _parts(SMALL_PARTS), **trimmed),
        "log_by_stream": _over(
            "log_lines",
            f"SELECT run_id, attempt, CAST((seq - b_start) // {SMALL_PARTS} AS BIGINT) AS part,"
            " COALESCE(string_agg(line, '' ORDER BY seq) FILTER (stream = 'stdout'), '') AS stdout,"
            " COALESCE(string_agg(line, '' ORDER BY seq) FILTER (stream = 'stderr'), '') AS stderr,"
            " COUNT(*) FILTER (stream = 'stdout') AS stdout_lines,"
            " COUNT(*) FILTER (stream = 'stderr') AS stderr_lines"
            " FROM log_lines JOIN bounds USING (run_id, attempt) GROUP BY ALL",
            bounds=_BOUNDS,
        ),
        "output_or_note": _over(
            "attempts log_lines",
            "SELECT run_id, attempt, part, output FROM with_output",
            **with_output,
        ),
        "success_marker": _over(
            "log_lines",
            f"SELECT run_id, attempt, {_LAST_LINE} LIKE '%SUCESSO%' AS marker_last_line,"
            " full_output LIKE '%SUCESSO%' AS marker_any_line FROM outputs",
            **outputs,
        ),
        "error_type": _over("error_lines", _ERRORS),
        "failure_kinds": _over("error_lines", _KINDS, errors=_ERRORS),
        "suggestion_diff": """
SELECT p_partkey AS run_id, 1 AS attempt, CAST(hunk AS INT) AS hunk, at_line::BIGINT AS at_line,
       removed::BIGINT AS n_removed, added_lines::BIGINT AS n_added,
       CASE WHEN numbered THEN added || CAST(p_partkey AS STRING) ELSE added END AS added,
       true AS minimal
FROM part JOIN (
  VALUES (0, 1, 1, 1, 1, 'b', true), (1, 1, 1, 0, 1, 'x', false), (2, 1, 1, 1, 0, '', false),
         (2, 2, 3, 1, 1, 'e', false), (3, 1, 0, 1, 1, 's', true)
) AS c(variant, hunk, at_line, removed, added_lines, added, numbered) ON p_partkey % 5 = c.variant
""",
        "run_statistics": """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS n,
       COUNT(DISTINCT o_custkey) AS distinct_who, quantile_disc(o_totalprice, 0.5) AS q50,
       quantile_disc(o_totalprice, 0.9) AS q90
FROM orders GROUP BY 1
""",
        "attempt_verdict": _over(
            "attempts",
            "SELECT run_id, attempt, exit_code, COALESCE(exit_code, -99) = 0 AS exit_ok"
            " FROM attempts",
        ),
        "log_stream_totals": _over(
            "log_lines",
            "SELECT run_id, attempt, stream, COUNT(*) AS n FROM log_lines"
            " GROUP BY run_id, attempt, stream",
        ),
        "log_stream_output": _over("log_lines", _parts(rl.PART_LINES), **trimmed),
        "log_window_totals": _over(
            "log_lines",
            "SELECT date_trunc('day', ts) AS window_start, stream, COUNT(*) AS n,"
            " CAST(0 AS BIGINT) AS late, date_trunc('day', ts) + INTERVAL 25 HOUR"
            " <= (SELECT MAX(ts) FROM log_lines) AS closed"
            " FROM log_lines GROUP BY 1, 2",
        ),
        "attempt_closed": _over(
            "attempts",
            "SELECT run_id, attempt, COALESCE(exit_code, -99) AS exit_code,"
            " COALESCE(exit_code, -99) = 0 AS exit_ok,"
            " CASE WHEN exit_code IS NULL THEN 'timeout' ELSE 'status' END AS closed_by"
            " FROM attempts",
        ),
        "live_output_or_note": _over(
            "attempts log_lines",
            "SELECT run_id, attempt, part, output FROM with_output",
            **with_output,
        ),
        "raw_lines": _over(
            "raw_lines",
            "SELECT CAST(run_id AS VARCHAR) AS run_id, attempt, CAST(2 * (SUM(strlen(line) + 1)"
            " OVER (PARTITION BY run_id, attempt, stream ORDER BY seq) - strlen(line) - 1)"
            " + CASE stream WHEN 'stderr' THEN 1 ELSE 0 END AS BIGINT) AS seq, stream,"
            " line || chr(10) AS line FROM raw_lines",
        ),
        "suggestion_changed": _over(
            "attempts",
            f"SELECT run_id, attempt, {_SUGGESTS} AS has_suggestion,"
            f" {_SUGGESTS} AND {_DIFFERS} AS changed FROM attempts",
        ),
        "attempt_action": _over(
            "attempts", "SELECT run_id, attempt, action FROM actions", actions=_ACTIONS
        ),
        "run_outcome": _over("attempts", "SELECT * FROM outcomes", **outcomes),
        "run_summary": _over(
            "attempts",
            "SELECT outcome, COUNT(*) AS runs,"
            " COUNT(*) / (SELECT COUNT(*) FROM outcomes) AS share,"
            " AVG(attempts_used) AS mean_attempts FROM outcomes GROUP BY outcome",
            **outcomes,
        ),
        "failure_report": _over(
            "attempts log_lines", _REPORT, **with_output, **outcomes
        ),
        "prompt_text": _over("attempts log_lines", _PROMPTS, **with_output),
        "clean_response": _over("responses", _CLEANED, unfenced=_UNFENCED),
        "map_corrector": _over(
            "scripts",
            "SELECT script_id, 'x = 1' || chr(10) || 'y = (1,)' AS suggestion FROM scripts"
            " WHERE script_id % 8 = 4",
        ),
        "ask_once": _over(
            "scripts",
            "SELECT script_id, 'x = 1' || chr(10) || 'y = (1,)' AS suggestion FROM scripts"
            " WHERE script_id % 8 = 4",
        ),
    }
