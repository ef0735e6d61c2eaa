"""The views of plans/views.py as SQL text for the check engine."""

from __future__ import annotations

V_REPOS = """v_repos AS (
  SELECT c_custkey AS repo_id, c_name AS name,
         CASE c_custkey % 2 WHEN 0 THEN 'github' ELSE 'zip' END AS source_type,
         make_timestamp((1700000000 + c_custkey % 97 * 3600) * 1000000) AS created_at
  FROM customer)"""

V_RUNS = """v_runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS repo_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running'
              WHEN 'P' THEN 'pending' END AS status,
         o_orderdate AS started_at
  FROM orders)"""

V_FINDINGS = """v_base AS (
  SELECT l.*, l_orderkey % 20 AS run_id,
         CASE l_returnflag WHEN 'A' THEN 'ast-custom' WHEN 'N' THEN 'bandit' WHEN 'R' THEN 'ruff' END AS source,
         CASE p_type WHEN 'ECONOMY' THEN 'SQL_INJECTION' WHEN 'LARGE' THEN 'HARDCODED_SECRET'
              WHEN 'MEDIUM' THEN 'SELF_COMPARISON' WHEN 'PROMO' THEN 'UNUSED_VARIABLE'
              WHEN 'SMALL' THEN 'WEAK_HASH' WHEN 'STANDARD' THEN 'UNUSED_FUNCTION' END AS type,
         'src/p' || (l_partkey % 50) || '.py' AS file, l_linenumber AS line,
         l_discount * 10 AS confidence
  FROM lineitem l JOIN part ON l_partkey = p_partkey),
v_findings AS (
  SELECT *, CASE WHEN type IN ('SQL_INJECTION', 'HARDCODED_SECRET', 'WEAK_HASH') THEN 'SECURITY'
                 WHEN type = 'SELF_COMPARISON' THEN 'CORRECTNESS' ELSE 'CODE_SMELL' END AS category
  FROM v_base)"""
ORD = "l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate"

V_STATS = """v_raw_stats AS (
  SELECT l_orderkey % 20 AS run_id, 'src/p' || (l_partkey % 50) || '.py' AS path,
         l_quantity / 2 AS complexity,
         row_number() OVER (PARTITION BY l_orderkey % 20, l_partkey % 50
           ORDER BY l_shipdate DESC, l_orderkey DESC, l_partkey DESC, l_suppkey DESC,
                    l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_tax DESC) AS rn
  FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 50 >= 5),
v_file_stats AS (SELECT run_id, path, complexity FROM v_raw_stats WHERE rn = 1)"""

V_DEDUPED = f"""v_deduped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, source, type, file, line ORDER BY {ORD}) AS rn
    FROM v_findings) WHERE rn = 1)"""

V_SCORED = """v_shrunk AS (
  SELECT d.*, s.complexity,
    (CAST(0.5 AS DOUBLE)
     + CASE type WHEN 'SQL_INJECTION' THEN CAST(0.25 AS DOUBLE) WHEN 'HARDCODED_SECRET' THEN CAST(0.25 AS DOUBLE)
            WHEN 'SELF_COMPARISON' THEN CAST(0.3 AS DOUBLE) WHEN 'UNUSED_VARIABLE' THEN CAST(-0.15 AS DOUBLE)
            WHEN 'UNUSED_FUNCTION' THEN CAST(-0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
     + CASE category WHEN 'SECURITY' THEN CAST(0.1 AS DOUBLE) WHEN 'CORRECTNESS' THEN CAST(0.05 AS DOUBLE)
            WHEN 'CODE_SMELL' THEN CAST(-0.05 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS base
  FROM v_deduped d LEFT JOIN v_file_stats s ON d.run_id = s.run_id AND d.file = s.path),
v_raw AS (
  SELECT *, greatest(CAST(0.05 AS DOUBLE), least(CAST(0.98 AS DOUBLE),
      base * confidence + (CAST(1 AS DOUBLE) - confidence) * CAST(0.5 AS DOUBLE)
      + CASE WHEN complexity >= 10 THEN CAST(0.03 AS DOUBLE)
             WHEN complexity >= 5 THEN CAST(0.015 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS risk_raw
  FROM v_shrunk),
v_scored AS (
  SELECT *, (floor((risk_raw * 1000::DOUBLE)) + CASE WHEN (risk_raw * 1000::DOUBLE) - floor((risk_raw * 1000::DOUBLE)) > 0.5::DOUBLE OR ((risk_raw * 1000::DOUBLE) - floor((risk_raw * 1000::DOUBLE)) = 0.5::DOUBLE AND ((((risk_raw * 134217729::DOUBLE - (risk_raw * 134217729::DOUBLE - risk_raw)) * 1000::DOUBLE - (risk_raw * 1000::DOUBLE)) + (risk_raw - (risk_raw * 134217729::DOUBLE - (risk_raw * 134217729::DOUBLE - risk_raw))) * 1000::DOUBLE) > 0 OR ((((risk_raw * 134217729::DOUBLE - (risk_raw * 134217729::DOUBLE - risk_raw)) * 1000::DOUBLE - (risk_raw * 1000::DOUBLE)) + (risk_raw - (risk_raw * 134217729::DOUBLE - (risk_raw * 134217729::DOUBLE - risk_raw))) * 1000::DOUBLE) = 0 AND CAST(floor((risk_raw * 1000::DOUBLE)) AS BIGINT) % 2 = 1)))
    THEN 1::DOUBLE ELSE 0::DOUBLE END) / 1000::DOUBLE AS risk_score,
         CASE WHEN risk_raw >= CAST(0.8 AS DOUBLE) THEN 'critical' WHEN risk_raw >= CAST(0.65 AS DOUBLE) THEN 'high'
              WHEN risk_raw >= CAST(0.45 AS DOUBLE) THEN 'medium' WHEN risk_raw >= CAST(0.25 AS DOUBLE) THEN 'low'
              ELSE 'info' END AS severity
  FROM v_raw)"""

V_FINDINGS_EV = """v_ev_base AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
         CASE event_id % 6 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'HARDCODED_SECRET'
              WHEN 2 THEN 'SELF_COMPARISON' WHEN 3 THEN 'UNUSED_VARIABLE' WHEN 4 THEN 'WEAK_HASH'
              ELSE 'UNUSED_FUNCTION' END AS type
  FROM events),
v_findings_ev AS (
  SELECT event_id AS id, user_id AS run_id,
         CASE event_id % 7 WHEN 0 THEN 'ast-custom' WHEN 1 THEN 'bandit' WHEN 2 THEN 'ruff'
              WHEN 3 THEN 'radon' WHEN 4 THEN 'dup' WHEN 5 THEN 'ts-morph' ELSE 'eslint' END AS source,
         type,
         CASE event_type WHEN 'view' THEN 'CODE_SMELL' WHEN 'signup' THEN 'STYLE'
              WHEN 'error' THEN 'CORRECTNESS' WHEN 'click' THEN 'PERFORMANCE'
              WHEN 'purchase' THEN 'SECURITY' END AS category,
         'src/f' || k || '.py' AS file, k % 40 AS line, k % 3 AS col,
         type || ' after ' || event_type AS message,
         least(CAST(1 AS DOUBLE), value / 600) AS confidence,
         CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'false_positive'
              ELSE 'overridden' END AS status,
         ts AS created_at
  FROM v_ev_base)"""

V_UPDATES = """v_updates AS (
  SELECT event_id AS update_id,
         user_id + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS run_id,
         event_id AS finding_id,
         CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'false_positive'
              WHEN 3 THEN 'overridden' ELSE 'closed' END AS status, ts
  FROM events
  UNION ALL
  SELECT event_id + 1000000000, user_id, event_id, 'overridden', ts FROM events
  WHERE event_id % 4 = 1)"""

V_RUN_EVENTS = """v_run_events AS (
  SELECT event_id, user_id AS run_id,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'running'
              WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed'
              WHEN 'purchase' THEN 'completed' END AS state,
         CASE k % 5 WHEN 0 THEN 'ingest' WHEN 1 THEN 'profile' WHEN 2 THEN 'analyze'
              WHEN 3 THEN 'predict' ELSE 'finalize' END AS stage,
         CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 50 WHEN 3 THEN 75 ELSE 100 END AS progress,
         repeat('x', 2990 + k) || ' at step ' || k AS error, ts
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

V_FILES = """v_files AS (
  SELECT source AS repo_id, doc_id AS file_id,
    CASE (doc_id // 20) % 12
      WHEN 0 THEN 'src/a' || doc_id || '.py' WHEN 1 THEN 'web/x' || doc_id || '.ts'
      WHEN 2 THEN 'node_modules/m' || doc_id || '.js' WHEN 3 THEN 'docs/r' || doc_id || '.md'
      WHEN 4 THEN '.git/c' || doc_id WHEN 5 THEN 'tests/t' || doc_id || '.py'
      WHEN 6 THEN 'package.json' WHEN 7 THEN 'yarn.lock'
      WHEN 8 THEN 'lib/d' || doc_id || '/package.json' WHEN 9 THEN 'web/Y' || doc_id || '.JSX'
      WHEN 10 THEN 'README' ELSE '.hidden/h' || doc_id || '.pyi' END AS path,
    n_chars AS size,
    CASE WHEN (doc_id // 20) % 12 = 0 AND doc_id % 4 = 0 THEN 'import flask' || chr(10) || text
         WHEN (doc_id // 20) % 12 = 0 AND doc_id % 4 = 1 THEN 'from django.db import x' || chr(10) || text
         WHEN (doc_id // 20) % 12 IN (6, 8) THEN CASE doc_id % 4
           WHEN 0 THEN '{"dependencies": {"Preact-dom": "1"}' WHEN 1 THEN '{"devDependencies": {"express": "2"}'
           WHEN 2 THEN '{"dependencies": {"vue": "3"}, "devDependencies": {"left-pad": "1"}'
           ELSE '{"dependencies": ' END || ', "private": true}'
         ELSE text END AS content
  FROM documents),
v_scan AS (
  SELECT *, parse_filename(path) AS name,
         lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext,
         len(content) - len(replace(content, chr(10), ''))
           + CASE WHEN content = '' OR suffix(content, chr(10)) THEN 0 ELSE 1 END AS loc
  FROM v_files
  WHERE NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|out|target|__pycache__|\\.venv|venv)(/|$)')
    AND parse_filename(path) NOT IN ('yarn.lock', 'package-lock.json'))"""

LANGUAGE_CASE = """CASE WHEN ext IN ('.py', '.pyi') THEN 'python'
    WHEN ext IN ('.js', '.jsx', '.mjs', '.cjs') THEN 'javascript'
    WHEN ext IN ('.ts', '.tsx') THEN 'typescript' WHEN ext = '.html' THEN 'html'
    WHEN ext = '.css' THEN 'css' WHEN ext = '.json' THEN 'json' WHEN ext = '.md' THEN 'markdown'
    ELSE 'other' END"""

V_ENTRIES = """v_entries AS (
  SELECT 'z' || (doc_id // 20) || '.zip' AS archive, doc_id AS entry_no,
         CASE doc_id % 97 WHEN 1 THEN 'src/../../x' || doc_id WHEN 2 THEN '/abs/x' || doc_id
              WHEN 6 THEN '../dir' || doc_id || '/' WHEN 7 THEN 'a/..b/./x' || doc_id
              ELSE 'src/x' || doc_id END AS entry,
         doc_id % 97 = 6 AS is_dir, n_chars * 1000 AS file_size,
         CASE doc_id % 97 WHEN 5 THEN n_chars * 1000 // 150 WHEN 8 THEN 0
              ELSE n_chars * 1000 // 3 END AS compress_size,
         doc_id % 97 = 3 AS is_link
  FROM documents),
v_checked AS (
  SELECT *, CASE WHEN is_dir THEN NULL
      WHEN doc_kind IN (1, 2) THEN 'unsafe path'
      WHEN is_link THEN 'symlink'
      WHEN file_size > 10 * 1024 * 1024 THEN 'too large'
      WHEN compress_size > 0 AND file_size / compress_size > 100 THEN 'suspicious ratio' END AS reason
  FROM (SELECT *, entry_no % 97 AS doc_kind FROM v_entries))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
