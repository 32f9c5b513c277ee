"""Common table expressions over the test tables."""

from plumbline.plans import inputs as i

_NAMES = {name: name for name in i.TABLE_NAMES}


def _sql(text: str) -> str:
    return text.format_map({**_NAMES, "catalog": "fx_catalog"})


_SIMPLE = {
    "fx_dirty_customer": i.DIRTY_CUSTOMER,
    "fx_raw_requests": i.RAW_REQUESTS,
    "fx_findings": i.FINDINGS,
    "fx_gap_rows": i.GAP_ROWS,
    "fx_references": i.ENTITY_REFERENCES,
    "fx_dq": i.QUALITY,
    "fx_systems": i.SYSTEMS,
    "fx_connection_tables": i.CONNECTION_TABLES,
    "fx_existing": i.EXISTING,
    "fx_scenarios": i.SCENARIOS,
    "fx_changes": i.RUN_CHANGES,
    "fx_statements": i.STATEMENTS,
    "fx_catalog": i.CATALOG,
    "fx_named_entities": i.NAMED_ENTITIES,
    "fx_catalog_systems": i.CATALOG_SYSTEMS,
    "fx_wanted": i.WANTED_ENTITIES,
    "fx_run_catalog": i.RUN_CATALOG,
    "fx_run_systems": i.RUN_SYSTEMS,
    "fx_constraints": i.CONSTRAINTS,
    "fx_key_columns": i.KEY_COLUMNS,
    "fx_referenced": i.REFERENCED_COLUMNS,
    "fx_columns": i.INFORMATION_COLUMNS,
}

_PATTERNS = """
SELECT * FROM (VALUES
  ('rest_api', 'HTTP/REST interface for AI agent queries', 3, 10),
  ('message_queue', 'Async event streaming for AI agent notifications', 5, 15),
  ('etl_pipeline', 'Data synchronization between systems', 10, 40),
  ('api_gateway', 'Centralized API management with auth/rate limiting', 5, 20),
  ('data_virtualization', 'Unified query interface across heterogeneous systems', 15, 60),
  ('identity_federation', 'Unified authentication across enterprise systems', 3, 15),
  ('semantic_layer', 'Maps technical data models to business concepts', 10, 30)
) AS p(pattern, solution, effort_min, effort_max)
"""

_REQUESTS = """
SELECT request_id, run_id, system_name, query_type, start_ts, epoch_us(start_ts) AS start_us,
       epoch_us(start_ts) + CAST(floor(elapsed_ms * 1000::DOUBLE) AS BIGINT) AS end_us,
       CASE WHEN elapsed_ms > 5000 THEN 5000::DOUBLE ELSE elapsed_ms END AS latency_ms,
       elapsed_ms <= 5000 AND exception IS NULL AND result AS success,
       CASE WHEN elapsed_ms > 5000 THEN 'timeout' ELSE substring(exception, 1, 100) END AS error
FROM fx_raw_requests
"""


def metrics_sql(source: str, keys: str) -> str:
    """Request metrics of ``source`` per ``keys`` by sorting whole groups."""
    return f"""
SELECT {keys}, total_requests, ok AS successful_requests, total_requests - ok AS failed_requests, duration_s,
       total_requests / greatest(duration_s, 0.001::DOUBLE) AS actual_qps,
       (total_requests - ok) / total_requests * 100 AS error_rate_pct,
       coalesce(p50_ms, 0::DOUBLE) AS p50_ms, coalesce(p95_ms, 0::DOUBLE) AS p95_ms,
       coalesce(p99_ms, 0::DOUBLE) AS p99_ms, coalesce(max_ms, 0::DOUBLE) AS max_ms
FROM (SELECT {keys}, count(*) AS total_requests, count(*) FILTER (WHERE success) AS ok,
             (max(end_us) - min(start_us)) / 1000000::DOUBLE AS duration_s
      FROM {source} GROUP BY {keys}) totals
LEFT JOIN (
  SELECT {keys},
         (max(CASE WHEN r = (n - 1) // 2 THEN latency_ms END) + max(CASE WHEN r = n // 2 THEN latency_ms END)) / 2 AS p50_ms,
         max(CASE WHEN r = least(CAST(floor(n * 0.95::DOUBLE) AS BIGINT), n - 1) THEN latency_ms END) AS p95_ms,
         max(CASE WHEN r = least(CAST(floor(n * 0.99::DOUBLE) AS BIGINT), n - 1) THEN latency_ms END) AS p99_ms,
         max(latency_ms) AS max_ms
  FROM (SELECT {keys}, latency_ms, row_number() OVER (PARTITION BY {keys} ORDER BY latency_ms) - 1 AS r,
               count(*) OVER (PARTITION BY {keys}) AS n
        FROM {source} WHERE success) ranked
  GROUP BY {keys}) ranks USING ({keys})
"""


_BOTTLENECKS = """
SELECT run_id, system_name, CAST(substring(system_name, 5) AS BIGINT) * 2 AS input_ord, 'error_rate' AS bottleneck_type,
       CASE WHEN error_rate_pct >= 10 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, error_rate_pct AS observed_value,
       CASE WHEN error_rate_pct >= 10 THEN 10 ELSE 5 END::DOUBLE AS threshold_value, '%' AS unit
FROM fx_metrics WHERE error_rate_pct >= 5
UNION ALL
SELECT run_id, system_name, CAST(substring(system_name, 5) AS BIGINT) * 2 + 1, 'latency_p95',
       CASE WHEN p95_ms >= 3000 THEN 'CRITICAL' ELSE 'HIGH' END, p95_ms,
       CASE WHEN p95_ms >= 3000 THEN 3000 ELSE 1000 END::DOUBLE, 'ms'
FROM fx_metrics WHERE p95_ms >= 1000
"""

# Fields of the catalog with their normal form.
_FIELDS = """
SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(field, '([A-Z])', '_\\1', 'g')), '[^a-z0-9]', '_', 'g'), '_+', '_', 'g'), '_') AS norm
FROM fx_catalog
"""

_PAIRS = """
SELECT a.entity, a.system AS source_system, b.system AS target_system, a.system_ord AS source_ord, b.system_ord AS target_ord
FROM (SELECT DISTINCT entity, system, system_ord FROM fx_catalog) a
JOIN (SELECT DISTINCT entity, system, system_ord FROM fx_catalog) b ON a.entity = b.entity AND a.system_ord < b.system_ord
"""

# Types that are the same or may stand for each other, base names only.
_COMPATIBLE = """
SELECT a, b FROM (VALUES ('varchar','text'),('varchar','char'),('int','integer'),('int','bigint'),('int','smallint'),
  ('integer','bigint'),('decimal','numeric'),('decimal','float'),('float','double'),('timestamp','datetime'),
  ('timestamp','date'),('boolean','bit'),('boolean','tinyint'),('nvarchar','varchar'),('nvarchar','text'),('nchar','char')) AS t(a, b)
UNION ALL
SELECT b, a FROM (VALUES ('varchar','text'),('varchar','char'),('int','integer'),('int','bigint'),('int','smallint'),
  ('integer','bigint'),('decimal','numeric'),('decimal','float'),('float','double'),('timestamp','datetime'),
  ('timestamp','date'),('boolean','bit'),('boolean','tinyint'),('nvarchar','varchar'),('nvarchar','text'),('nchar','char')) AS t(a, b)
"""

_TYPE_GROUPS = """
SELECT name, grp FROM (VALUES ('varchar',1),('text',1),('string',1),('nvarchar',1),('char',1),
  ('int',2),('integer',2),('bigint',2),('smallint',2),('number',2),
  ('float',3),('double',3),('decimal',3),('numeric',3),('real',3),
  ('bool',4),('boolean',4),('bit',4),('tinyint',4),
  ('date',5),('datetime',5),('timestamp',5),('datetime2',5)) AS g(name, grp)
"""


def base(column: str) -> str:
    return f"lower(coalesce(nullif(regexp_extract(trim({column}), '^([A-Za-z]+)', 1), ''), trim({column})))"


def type_score(a: str, b: str) -> str:
    """Similarity of two type texts as a scalar expression over ``fx_type_groups``."""
    return f"""CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.5::DOUBLE
      WHEN lower(trim({a})) = lower(trim({b})) THEN 1::DOUBLE
      WHEN (SELECT max(grp) FROM fx_type_groups WHERE name = lower(trim({a}))) = (SELECT max(grp) FROM fx_type_groups WHERE name = lower(trim({b}))) THEN 0.9::DOUBLE
      ELSE 0.2::DOUBLE END"""


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_SHARED = " + ".join(f"least(length(a) - length(replace(a, '{c}', '')), length(b) - length(replace(b, '{c}', '')))" for c in _LETTERS)
# Longest common block of a[alo, ahi) and b[blo, bhi), the earliest in a and then in b.
_BEST = """
list_max(flatten([[
  {'k': list_max([k for k in range(0, least(ahi - i, bhi - j) + 1) if substr(a, i, k) = substr(b, j, k)]), 'i': -i, 'j': -j}
  for j in range(blo, bhi)] for i in range(alo, ahi)]))
"""


def scored_names(names: str, least: float = 0.8) -> str:
    """Pairs (a, b, score) of different names (entity, norm) whose matching ratio is at least ``least``; needs WITH RECURSIVE.

    The parts on either side of a longest common block are open blocks in their turn.
    """
    return f"""
WITH RECURSIVE pairs AS (
  SELECT DISTINCT x.norm AS a, y.norm AS b FROM {names} x JOIN {names} y ON x.entity = y.entity AND x.norm <> y.norm
  WHERE 2 * least(length(x.norm), length(y.norm)) >= {least} * (length(x.norm) + length(y.norm)) - 1e-9
),
likely AS (SELECT a, b FROM pairs WHERE 2 * ({_SHARED}) >= {least} * (length(a) + length(b)) - 1e-9),
blocks AS (
  SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS got FROM likely
  UNION ALL
  SELECT a, b, c.alo, c.ahi, c.blo, c.bhi, c.got FROM (
    SELECT a, b, unnest([
      {{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j, 'got': m.k}},
      {{'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi, 'got': 0}}]) AS c
    FROM (SELECT *, {_BEST} AS m FROM blocks WHERE alo < ahi AND blo < bhi) x WHERE m.k > 0) y
)
SELECT a, b, 2.0::DOUBLE * sum(got) / (length(a) + length(b)) AS score FROM blocks GROUP BY a, b
HAVING 2.0::DOUBLE * sum(got) / (length(a) + length(b)) >= {least}
"""


_FIELD_NAMES = "SELECT DISTINCT entity, norm FROM fx_fields WHERE norm <> ''"
# The names differ by entity, but not which pairs of names there are: each is scored once.
_SCORED = scored_names("(SELECT DISTINCT 'all' AS entity, norm FROM fx_names)")

# Every source field against every later system: the equal name if any, else the best similar one, the earliest on ties.
_COMPARED = f"""
SELECT p.*, s.field AS source_field, s.field_ord AS source_field_ord, s.type AS source_type, s.nullable AS source_nullable, s.pk AS source_pk,
       t.field AS target_field, t.field_ord AS target_field_ord, t.type AS target_type, t.nullable AS target_nullable, t.pk AS target_pk,
       CASE WHEN t.norm = s.norm THEN 1::DOUBLE ELSE c.score END AS score,
       t.field IS NOT NULL AND {base("s.type")} <> {base("t.type")}
         AND NOT EXISTS (SELECT 1 FROM fx_compatible c WHERE c.a = {base("s.type")} AND c.b = {base("t.type")}) AS mismatch
FROM fx_pairs p
JOIN fx_fields s ON s.entity = p.entity AND s.system = p.source_system
LEFT JOIN (fx_fields t LEFT JOIN fx_scored c ON c.b = t.norm)
  ON t.entity = p.entity AND t.system = p.target_system AND (t.norm = s.norm OR c.a = s.norm)
QUALIFY row_number() OVER (PARTITION BY p.entity, p.source_system, p.target_system, s.field
                           ORDER BY coalesce(t.norm = s.norm, false) DESC, CASE WHEN t.norm = s.norm THEN 1 ELSE c.score END DESC NULLS LAST, t.field_ord) = 1
"""

_DERIVED = {
    "fx_patterns": (_PATTERNS, []),
    "fx_requests": (_REQUESTS, ["fx_raw_requests"]),
    "fx_metrics": (metrics_sql("fx_requests", "run_id, system_name"), ["fx_requests"]),
    "fx_bottlenecks": (_BOTTLENECKS, ["fx_metrics"]),
    "fx_gaps": (
        "SELECT g.*, p.effort_min, p.effort_max, p.solution FROM fx_gap_rows g JOIN fx_patterns p ON p.pattern = g.gap_type",
        ["fx_gap_rows", "fx_patterns"],
    ),
    "fx_fields": (_FIELDS, ["fx_catalog"]),
    "fx_pairs": (_PAIRS, ["fx_catalog"]),
    "fx_compatible": (_COMPATIBLE, []),
    "fx_type_groups": (_TYPE_GROUPS, []),
    "fx_names": (_FIELD_NAMES, ["fx_fields"]),
    "fx_scored": (_SCORED, ["fx_names"]),
    "fx_compared": (_COMPARED, ["fx_pairs", "fx_fields", "fx_compatible", "fx_scored"]),
}

_FROM_CATALOG = ["fx_constraints", "fx_key_columns", "fx_referenced", "fx_columns", "fx_run_catalog", "fx_run_systems"]
_NEEDS = {name: ["fx_catalog"] for name in _FROM_CATALOG}


def with_inputs(names: str, body: str) -> str:
    """``body`` preceded by the named inputs and whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _DERIVED.get(name, ("", _NEEDS.get(name, [])))[1]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({_sql(_SIMPLE[n]) if n in _SIMPLE else _DERIVED[n][0]})" for n in ordered]
    head = "WITH " + ",\n".join(parts)
    rest = body.strip()
    # A body may bring more table expressions of its own.
    return f"{head},\n{rest[5:]}" if rest.upper().startswith("WITH ") else f"{head}\n{rest}"
