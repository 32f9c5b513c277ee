"""Gaps, scores and remediation per run."""

from oracles.fragments import type_score, with_inputs

O = ORACLES = {}

O["middleware_gaps"] = with_inputs(
    "fx_systems fx_findings fx_existing fx_patterns",
    """
WITH s AS (SELECT run_id, count(*) AS n, bool_or(type = 'ERP') AND bool_or(type = 'CRM') AS both_kinds FROM fx_systems GROUP BY run_id),
f AS (SELECT run_id, count(*) AS findings, count(*) FILTER (WHERE kind = 'key_mismatch') AS keys FROM fx_findings GROUP BY run_id),
facts AS (SELECT s.run_id, n, both_kinds, coalesce(findings, 0) AS findings, coalesce(keys, 0) AS keys FROM s LEFT JOIN f ON f.run_id = s.run_id),
g AS (
  SELECT run_id, 0 AS rule, 'api_gateway' AS gap_type, 'HIGH' AS severity, n > 4 AS blocking, concat('No API gateway detected for ', CAST(n AS VARCHAR), ' systems') AS description FROM facts WHERE n > 2
  UNION ALL
  SELECT run_id, 1, 'etl_pipeline', 'HIGH', true, 'Schema inconsistencies require ETL pipeline for data harmonization' FROM facts WHERE findings > 3
  UNION ALL
  SELECT run_id, 2, 'semantic_layer', CASE WHEN keys > 0 THEN 'CRITICAL' ELSE 'HIGH' END, keys > 0, 'AI agents need a semantic layer to understand business entities across systems' FROM facts
  UNION ALL
  SELECT run_id, 3, 'rest_api', 'MEDIUM', false, 'ERP systems typically lack REST APIs suitable for real-time AI agent queries' FROM facts WHERE both_kinds)
SELECT g.run_id, CAST(row_number() OVER (PARTITION BY g.run_id ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END, blocking DESC, rule) - 1 AS INTEGER) AS gap_ord,
       concat('gap_', gap_type) AS gap_id, gap_type, severity, blocking, description, effort_min, effort_max
FROM g JOIN fx_patterns p ON p.pattern = g.gap_type
WHERE NOT EXISTS (SELECT 1 FROM fx_existing e WHERE e.run_id = g.run_id AND e.pattern = g.gap_type)
""",
)
O["gap_effort"] = with_inputs(
    "fx_gaps",
    "SELECT c_custkey AS run_id, CAST(coalesce(sum(effort_min), 0) AS BIGINT) AS effort_min_days, CAST(coalesce(sum(effort_max), 0) AS BIGINT) AS effort_max_days "
    "FROM customer LEFT JOIN fx_gaps ON run_id = c_custkey GROUP BY c_custkey",
)

_INPUTS = "fx_findings fx_metrics fx_gaps fx_dq"
_SCORES = """
WITH f AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM fx_findings GROUP BY run_id),
p AS (SELECT run_id, count(*) FILTER (WHERE error_rate_pct > 5) AS e, count(*) FILTER (WHERE p95_ms > 1000) AS l FROM fx_metrics GROUP BY run_id),
g AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE blocking) AS b, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, sum(effort_max) AS days FROM fx_gaps GROUP BY run_id),
q AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE NOT passed) AS f, count(*) FILTER (WHERE NOT passed AND severity = 'CRITICAL') AS c FROM fx_dq GROUP BY run_id),
t AS (SELECT c_custkey AS run_id, coalesce(f.n, 0) AS fn, coalesce(f.c, 0) AS fc, coalesce(f.h, 0) AS fh, coalesce(p.e, 0) AS pe, coalesce(p.l, 0) AS pl,
             coalesce(g.n, 0) AS gn, coalesce(g.b, 0) AS gb, coalesce(g.c, 0) AS gc, CAST(coalesce(g.days, 0) AS BIGINT) AS gd,
             coalesce(q.n, 0) AS qn, coalesce(q.f, 0) AS qf, coalesce(q.c, 0) AS qc
      FROM customer LEFT JOIN f ON f.run_id = c_custkey LEFT JOIN p ON p.run_id = c_custkey LEFT JOIN g ON g.run_id = c_custkey LEFT JOIN q ON q.run_id = c_custkey),
s AS (SELECT *, greatest(0, 100 - fc * 15 - fh * 8 - fn * 2) AS schema_score, greatest(0, 100 - pe * 20 - pl * 10) AS pipeline_score,
             greatest(0, 100 - gb * 25 - gc * 15 - gn * 5) AS middleware_score, greatest(0, 100 - qc * 20 - qf * 5) AS data_quality_score,
             CAST(100 AS BIGINT) AS security_score FROM t),
o AS (SELECT *, schema_score * 0.30::DOUBLE + pipeline_score * 0.25::DOUBLE + middleware_score * 0.20::DOUBLE + data_quality_score * 0.15::DOUBLE
              + security_score * 0.10::DOUBLE AS overall, CAST(gd + fc * 7 + fh * 3 AS BIGINT) AS days FROM s),
r AS (SELECT run_id, schema_score, pipeline_score, middleware_score, data_quality_score, security_score,
             CAST(printf('%.1f', overall) AS DOUBLE) AS overall_score,
             CASE WHEN gb >= 2 THEN 'NOT_READY' WHEN gb = 1 THEN 'NOT_YET' WHEN overall >= 80 THEN 'GO' WHEN overall >= 50 THEN 'NOT_YET' ELSE 'NOT_READY' END AS verdict,
             gb AS blocking_issues, fc + gc + qc AS critical_issues, fn + gn + qn AS total_issues,
             CASE WHEN days > 0 THEN days / 5::DOUBLE END AS remediation_weeks FROM o),
readiness AS (SELECT *, CASE WHEN overall_score >= 80 THEN 'green' WHEN overall_score >= 50 THEN 'yellow' ELSE 'red' END AS color FROM r)
"""
O["subscores"] = with_inputs(
    _INPUTS,
    _SCORES + "SELECT run_id, schema_score, pipeline_score, middleware_score, data_quality_score, security_score FROM s",
)
O["readiness"] = with_inputs(_INPUTS, _SCORES + "SELECT * FROM readiness")

_POINTS = "CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 0 END"
_PENALTY_INPUTS = "fx_findings fx_bottlenecks fx_gaps fx_dq"
_PENALTY = f"""
p AS (SELECT c_custkey AS run_id,
        (SELECT coalesce(sum({_POINTS}), 0)::BIGINT FROM fx_findings x WHERE x.run_id = c_custkey) AS a,
        (SELECT coalesce(sum({_POINTS}), 0)::BIGINT FROM fx_bottlenecks x WHERE x.run_id = c_custkey) AS b,
        (SELECT coalesce(sum({_POINTS}), 0)::BIGINT FROM fx_gaps x WHERE x.run_id = c_custkey) AS c,
        (SELECT 3 * count(*) FROM fx_dq x WHERE x.run_id = c_custkey AND NOT passed) AS d FROM customer),
ps AS (SELECT run_id, greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - (a * 0.30::DOUBLE + b * 0.25::DOUBLE + c * 0.20::DOUBLE + d * 0.15::DOUBLE))) AS readiness_score FROM p),
penalty AS (SELECT *, CASE WHEN readiness_score >= 80 THEN 'GO' WHEN readiness_score >= 50 THEN 'NOT_YET' ELSE 'NOT_READY' END AS verdict FROM ps)
"""
O["readiness_penalty"] = with_inputs(_PENALTY_INPUTS, f"WITH {_PENALTY} SELECT * FROM penalty")
O["readiness_three_part"] = with_inputs(
    "fx_findings fx_metrics fx_bottlenecks fx_gaps fx_dq",
    _SCORES
    + """
, crit AS (SELECT run_id, count(*) AS k FROM (SELECT run_id FROM fx_findings WHERE severity = 'CRITICAL' UNION ALL SELECT run_id FROM fx_bottlenecks WHERE severity = 'CRITICAL'
           UNION ALL SELECT run_id FROM fx_gaps WHERE severity = 'CRITICAL') GROUP BY run_id),
three AS (SELECT s.run_id, coalesce(k, 0) AS critical_count, greatest(0::DOUBLE, schema_score * 0.40::DOUBLE + pipeline_score * 0.35::DOUBLE + middleware_score * 0.25::DOUBLE
                 - least(coalesce(k, 0), 3) * 10::DOUBLE) AS readiness_score FROM s LEFT JOIN crit ON crit.run_id = s.run_id)
SELECT *, CASE WHEN critical_count > 0 THEN 'NOT_READY' WHEN readiness_score >= 80 THEN 'GO' WHEN readiness_score >= 50 THEN 'NOT_YET' ELSE 'NOT_READY' END AS verdict FROM three
""",
)

_ITEMS = """
items AS (
  SELECT run_id, 0 AS kind_ord, CAST(input_ord AS BIGINT) AS input_ord,
         concat('Resolve ', replace(kind, '_', ' '), ' for ''', entity_name, '''.', field_name) AS title,
         CASE WHEN coalesce(remediation_hint, '') <> '' THEN remediation_hint ELSE impact_description END AS description, 'schema' AS category,
         CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 3 ELSE 1 END AS priority, severity,
         CASE severity WHEN 'CRITICAL' THEN 21 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS effort_min_days,
         CASE severity WHEN 'CRITICAL' THEN 90 WHEN 'HIGH' THEN 21 WHEN 'MEDIUM' THEN 5 ELSE 1 END AS effort_max_days,
         concat('entity:', entity_name) AS topic, sha256(concat_ws('|', run_id, 'schema_finding', input_ord)) AS related_gap_ids
  FROM fx_findings
  UNION ALL
  SELECT run_id, 1, input_ord, concat('Resolve ', replace(bottleneck_type, '_', ' '), ' bottleneck in ''requests'' on ', system_name),
         concat(replace(bottleneck_type, '_', ' '), ' is above its limit (observed ', CAST(observed_value AS VARCHAR), unit, ', threshold ', CAST(threshold_value AS VARCHAR), unit, ')'),
         'pipeline', CASE severity WHEN 'CRITICAL' THEN 9 ELSE 7 END, severity, 5, 21,
         concat('pipeline:', system_name), sha256(concat_ws('|', run_id, 'bottleneck', input_ord)) FROM fx_bottlenecks
  UNION ALL
  SELECT run_id, 2, gap_ord, concat('Implement ', replace(gap_type, '_', ' '), ' between ', source_system, ' and ', target_system),
         concat(description, ' Recommended solution: ', solution), 'middleware',
         least(10, CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 6 ELSE 3 END + CASE WHEN blocking THEN 1 ELSE 0 END), severity, effort_min, effort_max,
         concat('gap:', gap_type), gap_id FROM fx_gaps
  UNION ALL
  SELECT run_id, 3, input_ord, concat('Data quality issue #', CAST(row_number() OVER (PARTITION BY run_id ORDER BY input_ord) AS VARCHAR)), '', 'data_quality', 4, severity, 1, 5, 'quality', ''
  FROM fx_dq WHERE NOT passed)
"""
O["remediation_plan"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_ITEMS}
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC,
         CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END DESC, kind_ord, input_ord) AS recommended_sequence,
       title, description, category, priority, severity, effort_min_days, effort_max_days, related_gap_ids
FROM items
""",
)
# Longest chains by walking along all needs; a walk of 30 steps among 14 topics went round a cycle.
_TIERS = f"""
{_ITEMS},
needs AS (
  SELECT DISTINCT run_id, concat('entity:', entity) AS topic, concat('entity:', parent) AS needs FROM fx_references WHERE entity <> parent
  UNION
  SELECT g.run_id, concat('gap:', g.gap_type), concat('gap:', h.gap_type)
  FROM fx_gaps g JOIN fx_gaps h ON h.run_id = g.run_id
  JOIN (VALUES ('api_gateway', 'identity_federation'), ('rest_api', 'api_gateway'), ('message_queue', 'api_gateway'), ('data_virtualization', 'rest_api'),
               ('semantic_layer', 'etl_pipeline'), ('semantic_layer', 'data_virtualization')) v(kind, first) ON g.gap_type = v.kind AND h.gap_type = v.first
),
topics AS (SELECT run_id, topic FROM items UNION SELECT run_id, topic FROM needs UNION SELECT run_id, needs FROM needs),
up AS (WITH RECURSIVE w AS (
  SELECT run_id, topic, 0 AS depth FROM topics
  UNION SELECT n.run_id, n.topic, depth + 1 FROM w JOIN needs n ON n.run_id = w.run_id AND n.needs = w.topic WHERE depth < 30)
  SELECT run_id, topic, max(depth) AS depth FROM w GROUP BY ALL),
down AS (WITH RECURSIVE w AS (
  SELECT run_id, topic, 0 AS depth FROM topics
  UNION SELECT n.run_id, n.needs, depth + 1 FROM w JOIN needs n ON n.run_id = w.run_id AND n.topic = w.topic WHERE depth < 30)
  SELECT run_id, topic, max(depth) AS depth FROM w GROUP BY ALL),
tiers AS (
  SELECT run_id, topic, CASE WHEN up.depth < 30 THEN up.depth END AS tier, up.depth = 30 AND down.depth = 30 AS cycle FROM up JOIN down USING (run_id, topic)
)
"""
O["plan_tiers"] = with_inputs(f"{_PENALTY_INPUTS} fx_references", f"WITH {_TIERS} SELECT run_id, topic, coalesce(tier, -1) AS tier, cycle FROM tiers")
O["tiered_plan"] = with_inputs(
    f"{_PENALTY_INPUTS} fx_references",
    f"""
WITH {_TIERS},
numbered AS (
  SELECT items.*, tier, sha256(concat_ws('|', items.run_id, category, input_ord)) AS item_id, row_number() OVER (PARTITION BY items.run_id ORDER BY tier NULLS LAST,
         CASE severity WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 WHEN 'LOW' THEN 2 ELSE 1 END DESC, priority DESC, kind_ord, input_ord) AS recommended_sequence
  FROM items JOIN tiers ON tiers.run_id = items.run_id AND tiers.topic = items.topic
),
ends AS (SELECT run_id, topic, arg_max(item_id, recommended_sequence) AS item FROM numbered WHERE tier IS NOT NULL GROUP BY run_id, topic),
lists AS (SELECT n.run_id, n.topic, string_agg(item, ',' ORDER BY item) AS prerequisites FROM needs n JOIN ends e ON e.run_id = n.run_id AND e.topic = n.needs GROUP BY ALL)
SELECT n.run_id, recommended_sequence, title, n.topic, coalesce(tier, -1) AS tier, item_id, coalesce(prerequisites, '') AS prerequisites
FROM numbered n LEFT JOIN lists ON lists.run_id = n.run_id AND lists.topic = n.topic
""",
)
_EFFORT = f"""
{_ITEMS},
e AS (SELECT run_id, count(*) AS n, CAST(floor(CAST(sum(effort_min_days) AS BIGINT) * 0.70::DOUBLE) AS BIGINT) AS lo,
             CAST(floor(CAST(sum(effort_max_days) AS BIGINT) * 0.70::DOUBLE) AS BIGINT) AS hi FROM items GROUP BY run_id)
"""
O["remediation_effort"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_EFFORT}
SELECT c_custkey AS run_id, coalesce(n, 0) AS item_count, coalesce(lo, 0) AS min_days, coalesce(hi, 1) AS max_days,
       CASE WHEN n IS NULL OR hi <= 1 THEN 'TRIVIAL' WHEN hi <= 5 THEN 'LOW' WHEN hi <= 21 THEN 'MEDIUM' WHEN hi <= 90 THEN 'HIGH' ELSE 'CRITICAL' END AS effort_level,
       0.7::DOUBLE AS confidence
FROM customer LEFT JOIN e ON e.run_id = c_custkey
""",
)

_TAGGED = """
tagged AS (SELECT run_id, 'schema' AS kind, severity, false AS blocking FROM fx_findings
  UNION ALL SELECT run_id, 'pipeline', severity, false FROM fx_bottlenecks
  UNION ALL SELECT run_id, 'middleware', severity, blocking FROM fx_gaps
  UNION ALL SELECT run_id, 'data_quality', severity, false FROM fx_dq WHERE NOT passed),
summary AS (SELECT run_id, count(*) FILTER (WHERE kind = 'schema') AS schema_inconsistencies, count(*) FILTER (WHERE kind = 'pipeline') AS pipeline_bottlenecks,
  count(*) FILTER (WHERE kind = 'middleware') AS middleware_gaps, count(*) FILTER (WHERE kind = 'data_quality') AS data_quality_issues,
  count(*) FILTER (WHERE severity = 'CRITICAL' AND kind <> 'data_quality') AS critical_issues, count(*) FILTER (WHERE blocking) AS blocking_gaps
  FROM tagged GROUP BY run_id)
"""
O["finding_totals"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_TAGGED}
SELECT run_id, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind, CASE WHEN grouping(severity) = 1 THEN 'all' ELSE severity END AS severity,
       count(*) AS finding_count, count(*) FILTER (WHERE blocking) AS blocking_count
FROM tagged GROUP BY GROUPING SETS ((run_id, kind, severity), (run_id, kind), (run_id, severity), (run_id))
""",
)
O["findings_summary"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_TAGGED}
SELECT c_custkey AS run_id, coalesce(schema_inconsistencies, 0) AS schema_inconsistencies, coalesce(pipeline_bottlenecks, 0) AS pipeline_bottlenecks,
       coalesce(middleware_gaps, 0) AS middleware_gaps, coalesce(data_quality_issues, 0) AS data_quality_issues,
       coalesce(critical_issues, 0) AS critical_issues, coalesce(blocking_gaps, 0) AS blocking_gaps
FROM (SELECT c_custkey FROM customer UNION SELECT run_id FROM summary) r LEFT JOIN summary ON run_id = c_custkey
""",
)
O["severity_breakdown"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_TAGGED}
SELECT run_id, kind, severity, count(*) AS n, false AS is_total FROM tagged GROUP BY run_id, kind, severity
UNION ALL
SELECT k.run_id, k.kind, CAST(NULL AS VARCHAR), count(t.run_id), true
FROM (SELECT c_custkey AS run_id, kind FROM customer, (VALUES ('schema'), ('pipeline'), ('middleware'), ('data_quality')) v(kind)
      UNION SELECT run_id, kind FROM tagged) k LEFT JOIN tagged t ON t.run_id = k.run_id AND t.kind = k.kind GROUP BY k.run_id, k.kind
""",
)


def _line(label: str, kind: str, severity: str) -> str:
    n = f"count(*) FILTER (WHERE kind = '{kind}' AND severity = '{severity}')"
    return f"CASE WHEN {n} > 0 THEN concat('  {label}: ', {n}) END"


_TECHNICAL = ",\n  ".join(
    [
        "'=== Technical Readiness Summary ==='",
        "''",
        "concat('Schema Inconsistencies : ', count(*) FILTER (WHERE kind = 'schema'))",
        _line("CRITICAL", "schema", "CRITICAL"),
        _line("HIGH    ", "schema", "HIGH"),
        _line("MEDIUM  ", "schema", "MEDIUM"),
        _line("LOW     ", "schema", "LOW"),
        "concat('Pipeline Bottlenecks   : ', count(*) FILTER (WHERE kind = 'pipeline'))",
        _line("CRITICAL", "pipeline", "CRITICAL"),
        _line("HIGH    ", "pipeline", "HIGH"),
        _line("MEDIUM  ", "pipeline", "MEDIUM"),
        "concat('Middleware Gaps        : ', count(*) FILTER (WHERE kind = 'middleware'))",
        "CASE WHEN count(*) FILTER (WHERE blocking) > 0 THEN concat('  Blocking            : ', count(*) FILTER (WHERE blocking)) END",
        "concat('Data Quality Issues    : ', count(*) FILTER (WHERE kind = 'data_quality'))",
    ]
)
O["technical_summary"] = with_inputs(
    _PENALTY_INPUTS, f"WITH {_TAGGED} SELECT run_id, concat_ws(chr(10), {_TECHNICAL}) AS technical_summary "
    "FROM (SELECT * FROM tagged UNION ALL SELECT c_custkey, NULL, NULL, false FROM customer) x GROUP BY run_id"
)
O["report_json"] = with_inputs(
    "fx_findings fx_metrics fx_bottlenecks fx_gaps fx_dq",
    f"""{_SCORES}, {_TAGGED}, {_EFFORT}
SELECT r.run_id, overall_score AS readiness_score, verdict, coalesce(schema_inconsistencies, 0) AS schema_inconsistencies,
       coalesce(middleware_gaps, 0) AS middleware_gaps, coalesce(n, 0) AS remediation_items, coalesce(hi, 0) AS total_effort_max_days,
       coalesce(printf('%.0f', remediation_weeks), 'TBD') AS remediation_weeks
FROM readiness r LEFT JOIN summary ON summary.run_id = r.run_id LEFT JOIN e ON e.run_id = r.run_id
""",
)
O["simple_plan"] = with_inputs(
    "fx_findings fx_gaps",
    """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY gap_ord) AS seq FROM fx_gaps WHERE blocking),
nb AS (SELECT run_id, count(*) AS n FROM b GROUP BY run_id),
f AS (SELECT run_id, count(*) FILTER (WHERE severity = 'CRITICAL') AS c, count(*) FILTER (WHERE severity = 'HIGH') AS h FROM fx_findings GROUP BY run_id),
x AS (SELECT f.run_id, c, h, coalesce(n, 0) AS n FROM f LEFT JOIN nb ON nb.run_id = f.run_id),
names AS (SELECT * FROM (VALUES ('rest_api', 'Rest Api'), ('message_queue', 'Message Queue'), ('etl_pipeline', 'Etl Pipeline'), ('api_gateway', 'Api Gateway'),
  ('data_virtualization', 'Data Virtualization'), ('identity_federation', 'Identity Federation'), ('semantic_layer', 'Semantic Layer')) AS v(pattern, label))
SELECT run_id, concat('rem_', gap_id) AS id, concat('Implement ', label) AS title, description, 'middleware' AS category,
       CASE WHEN severity = 'CRITICAL' THEN 9 ELSE 7 END AS priority, severity, CAST(effort_min AS BIGINT) AS effort_min_days,
       CAST(effort_max AS BIGINT) AS effort_max_days, seq AS recommended_sequence
FROM b JOIN names ON pattern = gap_type
UNION ALL
SELECT run_id, 'rem_schema_critical', 'Resolve Critical Schema Mismatches', concat('Fix ', c, ' critical key/schema mismatches across systems'), 'schema', 10, 'CRITICAL',
       c * 3, c * 7, n + 1 FROM x WHERE c > 0
UNION ALL
SELECT run_id, 'rem_schema_high', 'Resolve High-Severity Schema Issues', concat('Fix ', h, ' high-severity schema issues'), 'schema', 8, 'HIGH',
       h * 2, h * 5, n + 1 + CASE WHEN c > 0 THEN 1 ELSE 0 END FROM x WHERE h > 0
""",
)
O["exec_summary"] = with_inputs(
    "fx_findings fx_metrics fx_bottlenecks fx_gaps fx_dq",
    f"""{_SCORES}, {_TAGGED}
SELECT r.run_id, concat_ws(chr(10),
  concat('**Readiness Assessment: ', printf('%.0f', overall_score), '% — ', replace(verdict, '_', ' '), '**'), '',
  CASE verdict WHEN 'GO' THEN 'Your enterprise infrastructure appears well-positioned for the proposed AI deployment.'
    WHEN 'NOT_YET' THEN 'Your enterprise infrastructure needs targeted improvements before AI deployment can succeed.'
    ELSE 'Significant infrastructure gaps were identified that would prevent a successful AI deployment.' END, '',
  CASE WHEN fn > 0 THEN concat('**Schema Consistency:** ', fn, ' inconsistencies found across connected systems',
    CASE WHEN fc > 0 THEN concat(', including ', fc, ' critical mismatches that would cause AI agent failures') ELSE '' END, '.') END,
  CASE WHEN pipeline_bottlenecks > 0 THEN concat('**Pipeline Performance:** ', pipeline_bottlenecks, ' performance bottleneck(s) detected under simulated AI agent load.') END,
  CASE WHEN gn > 0 THEN concat('**Integration Gaps:** ', gn, ' missing middleware component(s) identified',
    CASE WHEN gb > 0 THEN concat(', with ', gb, ' blocking deployment') ELSE '' END, '.') END,
  CASE WHEN remediation_weeks > 0 THEN concat(chr(10), '**Estimated Remediation Timeline:** ', printf('%.0f', remediation_weeks), '–', printf('%.0f', remediation_weeks * 1.5::DOUBLE),
    ' weeks to reach deployment readiness.') END,
  '', 'This assessment was conducted using read-only access to your systems. No data was modified.', 'Assessment date: January 31, 2024') AS executive_summary
FROM readiness r JOIN t ON t.run_id = r.run_id LEFT JOIN summary ON summary.run_id = r.run_id
""",
)
O["exec_summary_penalty"] = with_inputs(
    _PENALTY_INPUTS,
    f"""
WITH {_PENALTY}, {_TAGGED},
z AS (SELECT penalty.*, coalesce(schema_inconsistencies, 0) + coalesce(pipeline_bottlenecks, 0) + coalesce(middleware_gaps, 0) AS total,
             coalesce(data_quality_issues, 0) AS dq, coalesce(critical_issues, 0) AS crit, coalesce(blocking_gaps, 0) AS blk
      FROM penalty LEFT JOIN summary ON summary.run_id = penalty.run_id)
SELECT run_id, concat_ws(' ',
  concat('The readiness diagnostic assessment indicates that the connected enterprise systems ',
    CASE verdict WHEN 'GO' THEN 'systems are well-positioned for AI deployment' WHEN 'NOT_YET' THEN 'systems require moderate remediation before AI deployment'
      ELSE 'systems are not yet ready for AI deployment and require significant work' END, ' with a readiness score of ', printf('%.0f', readiness_score), '/100.'),
  CASE WHEN crit > 0 THEN concat('The assessment identified ', crit, ' critical issue(s) that require immediate attention prior to proceeding with any AI workload deployment.') END,
  CASE WHEN blk > 0 THEN concat(blk, ' middleware gap(s) are currently blocking and must be resolved before the AI workload can function correctly.') END,
  CASE WHEN total > 0 THEN concat('A total of ', total, ' findings were recorded across schema consistency, pipeline performance, and middleware coverage dimensions.') END,
  concat('The recommended remediation plan contains ', total + dq, ' action items to bring the environment to a GO state for the planned AI deployment.')) AS executive_summary
FROM z
""",
)
_RUN = "CAST(floor(CAST(substring(entity, 8) AS BIGINT) / 20) AS BIGINT)"
_KEY_SETS = """
SELECT entity, source_system, target_system, list_sort(list(DISTINCT source_field) FILTER (WHERE lower(source_field) LIKE '%id%')) AS ss,
       list_sort(list(DISTINCT target_field) FILTER (WHERE lower(target_field) LIKE '%id%')) AS ts
FROM fx_compared WHERE target_field IS NOT NULL GROUP BY ALL
"""
O["assessment"] = with_inputs(
    "fx_run_systems fx_compared",
    f"""
WITH f AS (
  SELECT {_RUN} AS run_id, count(*) FILTER (WHERE target_field IS NULL) AS high, count(*) FILTER (WHERE mismatch) AS medium FROM fx_compared GROUP BY 1),
k AS (SELECT {_RUN} AS run_id, count(*) AS critical FROM ({_KEY_SETS}) WHERE len(ss) > 0 AND len(ts) > 0 AND ss <> ts GROUP BY 1),
s AS (SELECT run_id, count(*) AS n, bool_or(type = 'ERP') AND bool_or(type = 'CRM') AS both_kinds FROM fx_run_systems GROUP BY run_id),
t AS (SELECT s.run_id, n, both_kinds, coalesce(high, 0) AS fh, coalesce(critical, 0) AS fc, coalesce(high, 0) + coalesce(medium, 0) + coalesce(critical, 0) AS fn
      FROM s LEFT JOIN f ON f.run_id = s.run_id LEFT JOIN k ON k.run_id = s.run_id),
g AS (SELECT *, (n > 4)::INT + (fn > 3)::INT + (fc > 0)::INT AS gb, (fc > 0)::INT AS gc, (n > 2)::INT + (fn > 3)::INT + 1 + both_kinds::INT AS gn,
             (n > 2)::INT * 20 + (fn > 3)::INT * 40 + 30 + both_kinds::INT * 10 AS gd FROM t),
x AS (SELECT *, greatest(0, 100 - fc * 15 - fh * 8 - fn * 2) AS schema_score, greatest(0, 100 - gb * 25 - gc * 15 - gn * 5) AS middleware_score FROM g),
o AS (SELECT *, schema_score * 0.30::DOUBLE + 100 * 0.25::DOUBLE + middleware_score * 0.20::DOUBLE + 100 * 0.15::DOUBLE + 100 * 0.10::DOUBLE AS overall FROM x),
r AS (SELECT run_id, schema_score, CAST(100 AS BIGINT) AS pipeline_score, CAST(middleware_score AS BIGINT) AS middleware_score, CAST(100 AS BIGINT) AS data_quality_score,
             CAST(100 AS BIGINT) AS security_score, CAST(printf('%.1f', overall) AS DOUBLE) AS overall_score,
             CASE WHEN gb >= 2 THEN 'NOT_READY' WHEN gb = 1 THEN 'NOT_YET' WHEN overall >= 80 THEN 'GO' WHEN overall >= 50 THEN 'NOT_YET' ELSE 'NOT_READY' END AS verdict,
             CAST(gb AS BIGINT) AS blocking_issues, fc + gc AS critical_issues, fn + gn AS total_issues, (gd + fc * 7 + fh * 3) / 5::DOUBLE AS remediation_weeks FROM o)
SELECT *, CASE WHEN overall_score >= 80 THEN 'green' WHEN overall_score >= 50 THEN 'yellow' ELSE 'red' END AS color FROM r
""",
)
O["assessment_exact"] = with_inputs(
    "fx_catalog fx_run_systems fx_type_groups",
    f"""
WITH found AS (
  SELECT {_RUN.replace("entity", "s.entity")} AS run_id, CASE WHEN s.pk THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM fx_catalog s JOIN (SELECT DISTINCT entity, system FROM fx_catalog) o ON o.entity = s.entity AND o.system <> s.system
  WHERE NOT EXISTS (SELECT 1 FROM fx_catalog t WHERE t.entity = s.entity AND t.system = o.system AND t.field = s.field)
  UNION ALL
  SELECT {_RUN.replace("entity", "s.entity")}, 'HIGH' FROM fx_catalog s JOIN fx_catalog t ON t.entity = s.entity AND t.field = s.field AND s.system_ord < t.system_ord
  WHERE s.type <> '' AND t.type <> '' AND {type_score("s.type", "t.type")} < 0.9::DOUBLE),
c AS (SELECT run_id, count(*) FILTER (WHERE severity = 'HIGH') AS h, count(*) FILTER (WHERE severity = 'MEDIUM') AS m FROM found GROUP BY run_id),
z AS (SELECT r.run_id, coalesce(h, 0) AS h, coalesce(m, 0) AS m FROM (SELECT DISTINCT run_id FROM fx_run_systems) r LEFT JOIN c ON c.run_id = r.run_id),
sc AS (SELECT *, greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - (h * 10 + m * 5) * 0.30::DOUBLE)) AS readiness_score FROM z)
SELECT run_id, readiness_score, CASE WHEN readiness_score >= 80 THEN 'GO' WHEN readiness_score >= 50 THEN 'NOT_YET' ELSE 'NOT_READY' END AS verdict,
       h + m AS item_count, CAST(floor((h * 5 + m * 1) * 0.70::DOUBLE) AS BIGINT) AS min_days,
       CASE WHEN h + m = 0 THEN 1 ELSE CAST(floor((h * 21 + m * 5) * 0.70::DOUBLE) AS BIGINT) END AS max_days
FROM sc
""",
)
O["top_issues"] = with_inputs(
    "fx_findings fx_gaps",
    """
WITH f AS (SELECT run_id, 'Schema' AS issue_type, row_number() OVER (PARTITION BY run_id ORDER BY
             CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 99 END, input_ord) AS rank,
             severity, impact_description AS detail FROM fx_findings),
g AS (SELECT run_id, 'Middleware' AS issue_type, row_number() OVER (PARTITION BY run_id ORDER BY gap_ord) AS rank, severity, description AS detail FROM fx_gaps)
SELECT * FROM f WHERE rank <= 5 UNION ALL SELECT * FROM g WHERE rank <= 3
""",
)
