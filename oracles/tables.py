"""Sources, filters, formats, table quality, request logs, run tables, streams."""

from oracles.fragments import base, metrics_sql, type_score, with_inputs
from plumbline.plans.inputs import TABLE_NAMES

O = ORACLES = {}

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS row_count FROM {t}" for t in TABLE_NAMES)
_TYPE_NAMES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
  WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"""
_IN_TABLES = "table_name IN (" + ", ".join(f"'{t}'" for t in TABLE_NAMES) + ")"

O["catalog_scan"] = f"""
WITH n AS ({_COUNTS})
SELECT 'lake' AS system, table_name AS entity, column_name AS field, CAST(ordinal_position - 1 AS INTEGER) AS field_ord,
       {_TYPE_NAMES} AS type, row_count
FROM information_schema.columns JOIN n ON n.entity = table_name WHERE {_IN_TABLES}
"""
O["catalog_upper"] = f"""
WITH n AS ({_COUNTS})
SELECT 'warehouse' AS system, upper(table_name) AS entity, upper(column_name) AS field,
       CAST(ordinal_position - 1 AS INTEGER) AS field_ord, {_TYPE_NAMES} AS type, false AS pk, CAST(NULL AS VARCHAR) AS fk_to, row_count
FROM information_schema.columns JOIN n ON n.entity = table_name WHERE {_IN_TABLES}
"""
O["catalog_pk"] = with_inputs(
    "fx_columns fx_constraints fx_key_columns",
    """
SELECT c.table_schema AS system, c.table_name AS entity, c.column_name AS field, is_nullable = 'YES' AS nullable,
       EXISTS (SELECT 1 FROM fx_constraints tc JOIN fx_key_columns k
                 ON tc.constraint_name = k.constraint_name AND tc.table_schema = k.table_schema AND tc.table_name = k.table_name
               WHERE tc.constraint_type = 'PRIMARY KEY' AND tc.table_schema = c.table_schema AND tc.table_name = c.table_name
                 AND k.column_name = c.column_name) AS pk
FROM fx_columns c
""",
)
O["catalog_fk"] = with_inputs(
    "fx_columns fx_constraints fx_key_columns fx_referenced",
    """
, fk AS (
  SELECT tc.table_schema, tc.table_name, k.column_name, concat(r.table_name, '.', r.column_name) AS fk_to,
         row_number() OVER (PARTITION BY tc.table_schema, tc.table_name, k.column_name ORDER BY tc.constraint_name DESC) AS rn
  FROM fx_constraints tc
  JOIN fx_key_columns k ON tc.constraint_name = k.constraint_name AND tc.table_schema = k.table_schema
  JOIN fx_referenced r ON r.constraint_name = tc.constraint_name AND r.table_schema = tc.table_schema
  WHERE tc.constraint_type = 'FOREIGN KEY')
SELECT c.table_schema AS system, c.table_name AS entity, c.column_name AS field, fk_to
FROM fx_columns c LEFT JOIN fk ON fk.rn = 1 AND fk.table_schema = c.table_schema AND fk.table_name = c.table_name AND fk.column_name = c.column_name
""".replace(", fk AS", "WITH fk AS", 1),
)
O["catalog_from_describe"] = with_inputs(
    "fx_catalog",
    """
WITH sized AS (SELECT *, count(*) OVER (PARTITION BY system, entity) AS n,
                      row_number() OVER (PARTITION BY system, entity ORDER BY field_ord) - 1 AS pos FROM fx_catalog)
SELECT system, system_ord, entity, field, CAST(pos AS INTEGER) AS field_ord, CASE WHEN pk THEN 'id' ELSE type END AS type,
       CAST(CASE WHEN field_ord = 3 THEN true ELSE nullable END AS VARCHAR) AS nullable, CAST(pk AS VARCHAR) AS pk,
       CASE WHEN field_ord = 6 THEN 'Account.Id' END AS fk_to, CASE WHEN field_ord <> 2 THEN concat('Label of ', field) END AS label,
       CASE WHEN field_ord % 2 = 0 THEN field_ord * 10 + 20 ELSE -1 END AS length, CAST(field_ord % 3 = 1 AS VARCHAR) AS createable,
       CAST(field_ord <> 4 AND NOT pk AS VARCHAR) AS updateable
FROM sized WHERE n > 2
UNION ALL
SELECT DISTINCT system, system_ord, entity, CAST(NULL AS VARCHAR), -1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
       CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), -1, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
FROM sized WHERE n = 2
""",
)
O["read_query"] = """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY ALL
"""
O["system_size"] = f"""
SELECT 'lake' AS system, count(*) AS entity_count, CAST(sum(row_count) AS BIGINT) AS total_rows FROM ({_COUNTS})
"""
O["table_stats"] = f"SELECT entity AS table_name, row_count AS live_rows FROM ({_COUNTS}) ORDER BY live_rows DESC, table_name"
O["sample_rows"] = "SELECT * FROM customer ORDER BY c_custkey LIMIT 1000"
O["finding_tables"] = with_inputs(
    "fx_findings",
    """
SELECT run_id, input_ord, entity_name, source_system, target_system, kind, field_name, severity, impact_description, remediation_hint
FROM fx_findings
""",
)

_BLOCKED = " OR ".join(
    f"upper(trim(query)) LIKE '{k}%' OR contains(upper(trim(query)), ' {k} ')"
    for k in ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE", "EXEC", "EXECUTE"]
)
O["readonly_audit"] = with_inputs(
    "fx_statements", f"SELECT stmt_id, user_id, query, NOT ({_BLOCKED}) AS allowed FROM fx_statements"
)
O["soql_audit"] = with_inputs(
    "fx_statements", "SELECT stmt_id, upper(trim(query)) LIKE 'SELECT%' AS allowed FROM fx_statements"
)
O["active_catalog"] = with_inputs("fx_systems", "SELECT run_id, name, type FROM fx_systems WHERE status = 'connected'")
O["entities_requested"] = with_inputs(
    "fx_catalog fx_wanted",
    "SELECT system, entity, field, type FROM fx_catalog WHERE entity IN (SELECT entity FROM fx_wanted)",
)
O["critical_counts"] = with_inputs(
    "fx_findings fx_bottlenecks fx_gaps",
    """
SELECT run_id, CAST(sum(c) AS BIGINT) AS critical_count, CAST(sum(b) AS BIGINT) AS blocking_count FROM (
  SELECT run_id, (severity = 'CRITICAL')::INT AS c, 0 AS b FROM fx_findings
  UNION ALL SELECT run_id, (severity = 'CRITICAL')::INT, 0 FROM fx_bottlenecks
  UNION ALL SELECT run_id, (severity = 'CRITICAL')::INT, blocking::INT FROM fx_gaps) GROUP BY run_id
""",
)
O["scenario_validate"] = with_inputs(
    "fx_scenarios",
    """
WITH checked AS (SELECT run_id, concat_ws(',',
    CASE WHEN NOT concurrent_users BETWEEN 1 AND 1000 THEN 'concurrent_users' END,
    CASE WHEN NOT queries_per_minute BETWEEN 1 AND 10000 THEN 'queries_per_minute' END,
    CASE WHEN NOT peak_multiplier BETWEEN 1 AND 10 THEN 'peak_multiplier' END,
    CASE WHEN NOT response_time_target_ms BETWEEN 50 AND 30000 THEN 'response_time_target_ms' END) AS failed_rules FROM fx_scenarios)
SELECT run_id, failed_rules, failed_rules = '' AS valid FROM checked
""",
)
O["unknown_refs"] = """
SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
"""
O["finding_view"] = with_inputs(
    "fx_findings",
    """
SELECT run_id, CAST(input_ord AS VARCHAR) AS id, entity_name, source_system, '' AS target_system, kind AS inconsistency_type,
       CASE WHEN severity = 'INFO' THEN 'MEDIUM' ELSE severity END AS severity, impact_description,
       'Review field definitions and align schemas' AS remediation_hint
FROM fx_findings
""",
)
O["gap_view"] = with_inputs(
    "fx_gaps",
    """
SELECT run_id, gap_id AS id, gap_type, severity, blocking, description,
       CASE WHEN severity = 'LOW' THEN 5 ELSE effort_min END AS effort_min_days,
       CASE WHEN severity = 'LOW' THEN 20 ELSE effort_max END AS effort_max_days, solution AS recommended_solution
FROM fx_gaps
""",
)
O["load_plan"] = with_inputs(
    "fx_scenarios",
    """
SELECT run_id, coalesce(queries_per_minute, 60)::DOUBLE / 60 * coalesce(peak_multiplier, 2::DOUBLE) AS target_qps,
       CASE WHEN duration_seconds IS NULL THEN 30 WHEN duration_seconds > 60 THEN 60 ELSE duration_seconds END AS duration_seconds,
       10 AS ramp_up_seconds, coalesce(concurrent_users, 10) AS concurrent_workers
FROM fx_scenarios
""",
)

O["normalize_names"] = with_inputs(
    "fx_catalog",
    """
WITH names AS (SELECT field FROM fx_catalog UNION SELECT unnest(string_split(text, ' ')) FROM documents)
SELECT field, trim(regexp_replace(regexp_replace(lower(regexp_replace(field, '([A-Z])', '_\\1', 'g')), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS norm
FROM names
""",
)
O["type_base"] = with_inputs(
    "fx_catalog", f"SELECT type, {base('type')} AS base, count(*) AS fields FROM fx_catalog GROUP BY type"
)
_MET = """
WITH met AS (SELECT a.type, b.type AS other, count(*) AS met FROM fx_catalog a JOIN fx_catalog b
             ON a.entity = b.entity AND a.field_ord = b.field_ord AND a.system_ord <> b.system_ord GROUP BY ALL)
"""
O["type_compat"] = with_inputs(
    "fx_catalog fx_compatible",
    f"""{_MET}
SELECT type, other, met, {base("type")} = {base("other")} OR EXISTS (SELECT 1 FROM fx_compatible WHERE a = {base("type")} AND b = {base("other")}) AS compatible
FROM met
""",
)
O["type_similarity"] = with_inputs(
    "fx_catalog fx_type_groups",
    f"""{_MET}
SELECT type, other, met, {type_score("type", "other")} AS similarity, {type_score("type", "other")} >= 0.9::DOUBLE AS equivalent FROM met
""",
)
O["enum_fallback"] = with_inputs(
    "fx_systems",
    """
SELECT type AS given, CASE WHEN type IN ('API', 'MESSAGE_QUEUE') THEN 'DATABASE' ELSE type END AS system_type, count(*) AS n
FROM fx_systems GROUP BY ALL
""",
)
O["py_round"] = """
SELECT l_orderkey, l_linenumber, l_partkey, printf('%.0f', l_extendedprice) AS whole, printf('%.1f', l_extendedprice / 7) AS tenths,
       printf('%.2f', l_discount * 12.5::DOUBLE) AS hundredths
FROM lineitem
"""
O["json_roundtrip"] = with_inputs(
    "fx_scenarios",
    """
SELECT run_id, name, concurrent_users, coalesce(queries_per_minute, 60) AS queries_per_minute,
       coalesce(peak_multiplier, 2::DOUBLE) AS peak_multiplier, response_time_target_ms, '' AS use_case,
       CASE WHEN run_id % 101 > 9 THEN (run_id % 101)::DOUBLE END AS score,
       CASE WHEN run_id % 101 > 50 THEN 'GO' END AS verdict,
       CASE WHEN run_id % 101 > 9 THEN substring(repeat(concat(name, ' '), 300), 1, 2000) ELSE '' END AS executive_summary
FROM fx_scenarios
""",
)

# --- table quality ---------------------------------------------------------------------

_NULLS = """
WITH cells AS (
  SELECT 0 AS column_ord, 'customer_id' AS "column", true AS key_like, count(*) AS row_count, count(*) FILTER (WHERE customer_id IS NULL) AS null_count FROM fx_dirty_customer
  UNION ALL SELECT 1, 'account_key', true, count(*), count(*) FILTER (WHERE account_key IS NULL) FROM fx_dirty_customer
  UNION ALL SELECT 2, 'name', false, count(*), count(*) FILTER (WHERE name IS NULL OR name = '') FROM fx_dirty_customer
  UNION ALL SELECT 3, 'segment', false, count(*), count(*) FILTER (WHERE segment IS NULL OR segment = '') FROM fx_dirty_customer
  UNION ALL SELECT 4, 'acctbal', false, count(*), count(*) FILTER (WHERE acctbal IS NULL) FROM fx_dirty_customer),
rates AS (SELECT 'crm' AS system, 'customer' AS "table", *, null_count / row_count AS null_rate FROM cells)
"""
O["dq_null_rate"] = with_inputs("fx_dirty_customer", _NULLS + "SELECT * FROM rates")
O["dq_completeness"] = with_inputs(
    "fx_dirty_customer",
    _NULLS
    + """
SELECT 'completeness' AS check_name, system, "table", "column",
       CASE WHEN key_like THEN 'CRITICAL' WHEN null_rate > 0.3::DOUBLE THEN 'HIGH' WHEN null_rate > 0.1::DOUBLE THEN 'MEDIUM' ELSE 'INFO' END AS severity,
       false AS passed, 1::DOUBLE - null_rate AS score, concat(printf('%.1f', null_rate * 100), '% null rate in ', "column") AS details
FROM rates WHERE null_rate > 0.05::DOUBLE
""",
)
O["dq_uniqueness"] = with_inputs(
    "fx_dirty_customer",
    """
WITH counted AS (
  SELECT 'crm' AS system, 'customer' AS "table", 'customer_id' AS "column", count(*) AS n, count(DISTINCT customer_id) AS u FROM fx_dirty_customer WHERE customer_id <> 0
  UNION ALL SELECT 'web', 'events', 'event_id', count(*), count(DISTINCT event_id) FROM events WHERE event_id <> 0
  UNION ALL SELECT 'web', 'events', 'user_id', count(*), count(DISTINCT user_id) FROM events WHERE user_id <> 0
  UNION ALL SELECT 'chat', 'conversations', 'conv_id', count(*), count(DISTINCT conv_id) FROM conversations WHERE conv_id <> 0)
SELECT 'uniqueness' AS check_name, system, "table", "column", 'CRITICAL' AS severity, false AS passed,
       1::DOUBLE - (n - u) / n AS score, concat(CAST(n - u AS VARCHAR), ' duplicate values in ', "column") AS details
FROM counted WHERE n > u
""",
)
O["dq_score"] = with_inputs(
    "fx_dq",
    """
WITH c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS f,
                  count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS c1, count(*) FILTER (WHERE NOT passed AND severity = 'HIGH') AS c2,
                  count(*) FILTER (WHERE NOT passed AND severity = 'MEDIUM') AS c3 FROM fx_dq GROUP BY run_id)
SELECT run_id, n AS result_count, f AS failed_count,
       CASE WHEN f = 0 THEN 1::DOUBLE ELSE greatest(0::DOUBLE, 1::DOUBLE - (c1 * 1::DOUBLE + c2 * 0.7::DOUBLE + c3 * 0.4::DOUBLE) / n) END AS quality_score
FROM c
""",
)
O["dq_referential"] = """
WITH checks AS (
  SELECT 'erp' AS system, 'lineitem' AS "table", 'l_orderkey' AS "column", count(*) AS checked_rows,
         count(*) FILTER (WHERE o_orderkey IS NULL) AS orphan_rows, count(DISTINCT CASE WHEN o_orderkey IS NULL THEN l_orderkey END) AS orphan_keys
  FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'web', 'labels', 'doc_id', count(*), count(*) FILTER (WHERE d.doc_id IS NULL), count(DISTINCT CASE WHEN d.doc_id IS NULL THEN l.doc_id END)
  FROM labels l LEFT JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d ON l.doc_id = d.doc_id)
SELECT 'referential_integrity' AS check_name, system, "table", "column", 'HIGH' AS severity, orphan_rows = 0 AS passed,
       checked_rows, orphan_rows, orphan_keys, orphan_rows / checked_rows AS orphan_rate
FROM checks
"""
O["dq_format"] = """
WITH v AS (SELECT 'crm' AS system, 'customer' AS "table", 'c_name' AS "column", c_name AS value FROM customer
           UNION ALL SELECT 'crm', 'customer', 'c_mktsegment', c_mktsegment FROM customer
           UNION ALL SELECT 'web', 'pages', 'url', url FROM pages),
s AS (SELECT system, "table", "column", regexp_replace(regexp_replace(value, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n
      FROM v WHERE value <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, shape) AS rn,
             sum(n) OVER (PARTITION BY "table", "column") AS total, count(*) OVER (PARTITION BY "table", "column") AS shapes FROM s)
SELECT 'format_consistency' AS check_name, system, "table", "column", 'MEDIUM' AS severity, shapes = 1 AS passed,
       CAST(total AS BIGINT) AS checked_rows, shapes AS shape_count, shape AS modal_shape, n / CAST(total AS BIGINT) AS score
FROM r WHERE rn = 1
"""

# --- request logs ----------------------------------------------------------------------

O["req_normalised"] = with_inputs(
    "fx_requests",
    "SELECT request_id, run_id, system_name, query_type, start_us, end_us, latency_ms, success, error FROM fx_requests",
)
O["req_counts"] = with_inputs(
    "fx_requests",
    """
SELECT run_id, system_name, count(*) AS total_requests, count(*) FILTER (WHERE success) AS successful_requests,
       count(*) FILTER (WHERE NOT success) AS failed_requests FROM fx_requests GROUP BY run_id, system_name
""",
)
O["req_rates"] = with_inputs("fx_metrics", "SELECT run_id, system_name, duration_s, actual_qps, error_rate_pct FROM fx_metrics")
O["req_percentiles"] = with_inputs("fx_metrics", "SELECT run_id, system_name, p50_ms, p95_ms, p99_ms, max_ms FROM fx_metrics")
O["req_percentiles_by_system"] = with_inputs(
    "fx_requests",
    f"SELECT system_name, successful_requests, p50_ms, p95_ms, p99_ms, max_ms FROM ({metrics_sql('fx_requests', 'system_name')})",
)
O["req_health"] = with_inputs(
    "fx_metrics",
    """
SELECT run_id, system_name, error_rate_pct < 5 AND p95_ms < 1000 AS is_healthy,
       CASE WHEN error_rate_pct < 5 AND p95_ms < 1000 THEN 'HEALTHY' ELSE 'DEGRADED' END AS overall_health FROM fx_metrics
""",
)
O["req_bottlenecks"] = with_inputs(
    "fx_bottlenecks",
    "SELECT run_id, system_name, bottleneck_type, severity, observed_value, threshold_value, unit FROM fx_bottlenecks",
)
O["breaking_points"] = with_inputs(
    "fx_requests",
    f"""
WITH phased AS (SELECT *, CAST(floor((start_us - 1704067200000000) / 604800000000::DOUBLE) AS BIGINT) AS phase FROM fx_requests),
m AS ({metrics_sql("phased", "system_name, phase")}),
b AS (SELECT *, first_value(p95_ms) OVER (PARTITION BY system_name ORDER BY phase) AS baseline_p95_ms FROM m)
SELECT system_name, baseline_p95_ms, min(CASE WHEN p95_ms > 3 * baseline_p95_ms OR error_rate_pct > 5 THEN phase END) AS breaking_phase,
       arg_max(actual_qps, phase) FILTER (WHERE p95_ms < 3 * baseline_p95_ms) AS max_safe_qps
FROM b GROUP BY system_name, baseline_p95_ms
""",
)
O["audit_operations"] = with_inputs(
    "fx_requests", "SELECT run_id, system_name, count(*) AS operation_count FROM fx_requests GROUP BY run_id, system_name"
)
O["findings_at_least"] = with_inputs(
    "fx_findings", "SELECT run_id, input_ord, severity, kind FROM fx_findings WHERE severity IN ('CRITICAL', 'HIGH')"
)
O["connection_summary"] = with_inputs(
    "fx_systems fx_existing",
    """
SELECT s.run_id, total, healthy, failed, total - healthy - failed AS pending, healthy / total AS success_rate, table_count
FROM (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'connected') AS healthy,
             count(*) FILTER (WHERE error IS NOT NULL) AS failed FROM fx_systems GROUP BY run_id) s
LEFT JOIN (SELECT run_id, count(*) AS table_count FROM fx_existing GROUP BY run_id) t ON s.run_id = t.run_id
""",
)

O["dq_uniqueness_sketch"] = with_inputs(
    "fx_dirty_customer",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"values\", count(DISTINCT {c}) AS exact, true AS estimate_holds FROM fx_dirty_customer"
        for c in ("customer_id", "account_key", "name")
    ),
)
O["req_percentiles_sketch"] = with_inputs(
    "fx_requests",
    """
SELECT system_name, count(*) AS total_requests, count(*) FILTER (WHERE NOT success) AS failed_requests, max(latency_ms) FILTER (WHERE success) AS max_ms,
       true AS p50_ms_holds, true AS p95_ms_holds, true AS p99_ms_holds
FROM fx_requests GROUP BY system_name
""",
)
O["connection_details"] = with_inputs(
    "fx_systems fx_connection_tables",
    """
SELECT s.run_id, s.name, s.type AS connector_type, s.status = 'connected' AS healthy, s.error,
       CASE WHEN s.status = 'connected' THEN (SELECT count(*) FROM fx_connection_tables t WHERE t.run_id = s.run_id AND t.name = s.name) ELSE -1 END AS tables
FROM fx_systems s
""",
)
O["filtered_scan"] = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 150000 AND o_orderpriority <> '5-LOW' AND o_custkey IS NOT NULL
"""

# --- run tables ------------------------------------------------------------------------

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
_CHANGE = f"SELECT * REPLACE ({_TIME.format('changed_at')}) FROM "
_LATEST = """
WITH latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY changed_at DESC, version_ord DESC) AS rn
                FROM fx_changes) WHERE rn = 1)
"""
O["upsert_latest"] = with_inputs("fx_changes", _LATEST + _CHANGE + "latest")
O["run_by_id"] = with_inputs("fx_changes", _CHANGE + "fx_changes WHERE run_id = 7")
O["runs_newest"] = with_inputs("fx_changes", _CHANGE + "fx_changes ORDER BY fx_changes.changed_at DESC, version_ord DESC")
O["connections_of_run"] = with_inputs("fx_systems", "SELECT * FROM fx_systems WHERE run_id = 7 ORDER BY name")
_CHILDREN = {
    "schema_findings": "fx_findings",
    "bottlenecks": "fx_bottlenecks",
    "gaps": "fx_gaps",
    "quality": "fx_dq",
    "connections": "fx_systems",
    "runs": "(SELECT c_custkey AS run_id FROM customer)",
}
O["cascade_delete"] = with_inputs(
    "fx_findings fx_bottlenecks fx_gaps fx_dq fx_systems",
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS surviving_rows FROM {t} WHERE run_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
        for name, t in _CHILDREN.items()
    ),
)
_STATE = """
WITH ordered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY changed_at DESC, version_ord DESC) AS rn,
                        row_number() OVER (PARTITION BY run_id, status = 'failed' ORDER BY changed_at DESC, version_ord DESC) AS rk FROM fx_changes)
SELECT run_id, max(CASE WHEN rn = 1 THEN status END) AS status,
       max(CASE WHEN rk = 1 AND status = 'running' THEN 0 WHEN rk = 1 AND status = 'completed' THEN 100 END)::DOUBLE AS progress_pct,
       strftime(min(CASE WHEN status = 'running' THEN changed_at END), '%Y-%m-%d %H:%M:%S') AS started_at,
       strftime(max(CASE WHEN status IN ('completed', 'failed') THEN changed_at END), '%Y-%m-%d %H:%M:%S') AS completed_at,
       max(CASE WHEN rk = 1 AND status = 'failed' THEN error_message END) AS error_message
FROM ordered GROUP BY run_id
"""
O["run_progress"] = with_inputs("fx_changes", _STATE)
O["progress_ttl"] = with_inputs(
    "fx_changes",
    _LATEST + _CHANGE + "latest WHERE latest.changed_at > (SELECT max(changed_at) FROM fx_changes) - INTERVAL 30 DAY",
)
O["runs_by_status"] = with_inputs("fx_changes", _LATEST + "SELECT status, count(*) AS run_count FROM latest GROUP BY status")

# --- streams -----------------------------------------------------------------------------

O["stream_req_windows"] = with_inputs(
    "fx_requests",
    f"""
WITH windowed AS (SELECT *, date_trunc('day', start_ts) AS w FROM fx_requests),
m AS ({metrics_sql("windowed", "w, system_name")})
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, system_name, total_requests, failed_requests, error_rate_pct,
       p50_ms, p95_ms, p99_ms, max_ms, CASE WHEN error_rate_pct < 5 AND p95_ms < 1000 THEN 'HEALTHY' ELSE 'DEGRADED' END AS overall_health
FROM m
""",
)
O["stream_dedup"] = "SELECT event_id, user_id, event_type, value FROM events"
O["stream_run_state"] = O["run_progress"]
O["stream_progress_ttl"] = O["progress_ttl"]
# Change by change: legal is what has a higher rank than all before it, while the run has not ended.
O["stream_run_lifecycle"] = with_inputs(
    "fx_changes",
    """
WITH r AS (
  SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 WHEN 'analyzing' THEN 2 WHEN 'reporting' THEN 3 ELSE 4 END AS rank FROM fx_changes
),
o AS (
  SELECT *, coalesce(max(rank) OVER (PARTITION BY run_id ORDER BY changed_at, version_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS highest FROM r
)
SELECT run_id, arg_max(status, rank) FILTER (WHERE rank > highest) AS status,
       strftime(arg_max(changed_at, rank) FILTER (WHERE rank > highest), '%Y-%m-%d %H:%M:%S') AS changed_at,
       count(*) FILTER (WHERE rank > highest) AS accepted, count(*) FILTER (WHERE rank <= highest) AS rejected
FROM o GROUP BY run_id
""",
)
O["stream_event_counts"] = """
WITH e AS (SELECT date_trunc('day', ts) AS w, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS event_count, CAST(sum(k) AS BIGINT) AS payload_total
FROM e GROUP BY w, event_type
"""
