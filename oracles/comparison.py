"""Cross-system comparison of field catalogs."""

from oracles.fragments import base, scored_names, type_score, with_inputs

O = ORACLES = {}
PAIR = "entity, source_system, target_system"

O["shared_entities"] = with_inputs(
    "fx_catalog",
    "SELECT entity, count(DISTINCT system) AS system_count FROM fx_catalog GROUP BY entity HAVING count(DISTINCT system) > 1",
)
O["system_pairs"] = with_inputs("fx_pairs", "SELECT * FROM fx_pairs")
O["exact_norm_match"] = with_inputs(
    "fx_compared",
    f"SELECT {PAIR}, source_field, target_field, score FROM fx_compared WHERE score = 1",
)
O["matched_type_mismatch"] = with_inputs(
    "fx_compared", f"SELECT {PAIR}, source_field, source_type, target_type FROM fx_compared WHERE mismatch"
)
O["missing_fields"] = with_inputs(
    "fx_compared",
    f"""
SELECT {PAIR}, source_field AS field, 'missing_in_target' AS side FROM fx_compared WHERE target_field IS NULL
UNION ALL
SELECT p.entity, p.source_system, p.target_system, t.field, 'missing_in_source'
FROM fx_pairs p JOIN fx_fields t ON t.entity = p.entity AND t.system = p.target_system
WHERE NOT EXISTS (SELECT 1 FROM fx_compared s WHERE s.entity = p.entity AND s.source_system = p.source_system
                  AND s.target_system = p.target_system AND s.target_field = t.field)
""",
)
O["schema_similarity"] = with_inputs(
    "fx_compared",
    f"""
WITH sizes AS (SELECT entity, system, count(*) AS n FROM fx_catalog GROUP BY entity, system),
c AS (SELECT {PAIR}, count(target_field) AS matched, count(*) FILTER (WHERE mismatch) AS mismatched FROM fx_compared GROUP BY {PAIR})
SELECT c.entity, source_system, target_system, s.n AS source_fields, t.n AS target_fields, matched, mismatched,
       greatest(0::DOUBLE, (matched - mismatched * 0.5::DOUBLE) / greatest(s.n, t.n)) AS overall_similarity
FROM c JOIN sizes s ON s.entity = c.entity AND s.system = source_system JOIN sizes t ON t.entity = c.entity AND t.system = target_system
""",
)
_KEYS = f"""
SELECT {PAIR}, list_sort(list(DISTINCT source_field) FILTER (WHERE lower(source_field) LIKE '%id%')) AS ss,
       list_sort(list(DISTINCT target_field) FILTER (WHERE lower(target_field) LIKE '%id%')) AS ts,
       string_agg(concat('''', source_field, ''''), ', ' ORDER BY source_field_ord) FILTER (WHERE lower(source_field) LIKE '%id%') AS src,
       string_agg(concat('''', target_field, ''''), ', ' ORDER BY source_field_ord) FILTER (WHERE lower(target_field) LIKE '%id%') AS tgt
FROM fx_compared WHERE target_field IS NOT NULL GROUP BY {PAIR}
"""
O["key_mismatch"] = with_inputs(
    "fx_compared",
    f"WITH k AS ({_KEYS}) SELECT {PAIR} FROM k WHERE len(ss) > 0 AND len(ts) > 0 AND ss <> ts",
)
O["inconsistency_report"] = with_inputs(
    "fx_compared",
    f"""
WITH k AS ({_KEYS})
SELECT {PAIR}, 'missing_field' AS kind, 'HIGH' AS severity,
       concat('Field ''', source_field, ''' present in ', source_system, ' but missing in ', target_system) AS detail
FROM fx_compared WHERE target_field IS NULL
UNION ALL
SELECT {PAIR}, 'type_mismatch', 'MEDIUM',
       concat('Field ''', source_field, ''': ', source_type, ' in ', source_system, ' vs ', target_type, ' in ', target_system)
FROM fx_compared WHERE mismatch
UNION ALL
SELECT {PAIR}, 'key_mismatch', 'CRITICAL', concat('Key fields differ: [', src, '] vs [', tgt, ']')
FROM k WHERE len(ss) > 0 AND len(ts) > 0 AND ss <> ts
""",
)
_ODD_TYPE = "CASE WHEN {p}_pk AND right({p}_system, 1) IN ('1', '3', '5') THEN 'bigint' ELSE {p}_type END"
O["nullability_difference"] = with_inputs(
    "fx_compared",
    f"""
WITH n AS (SELECT {PAIR}, source_field, target_field,
                  source_nullable AND NOT (right(source_system, 1) IN ('1', '3', '5') AND source_field_ord = 6) AS source_nullable,
                  target_nullable AND NOT (right(target_system, 1) IN ('1', '3', '5') AND target_field_ord = 6) AS target_nullable
           FROM fx_compared WHERE target_field IS NOT NULL)
SELECT * FROM n WHERE source_nullable <> target_nullable
""",
)
O["key_type_mismatch"] = with_inputs(
    "fx_compared",
    f"""
WITH k AS (SELECT {PAIR}, source_field, target_field, {_ODD_TYPE.format(p="source")} AS source_type, {_ODD_TYPE.format(p="target")} AS target_type
           FROM fx_compared WHERE source_pk AND target_pk)
SELECT * FROM k WHERE {base("source_type")} <> {base("target_type")}
  AND NOT EXISTS (SELECT 1 FROM fx_compatible WHERE a = {base("source_type")} AND b = {base("target_type")})
""",
)

# --- exact names -------------------------------------------------------------------------

O["canonical_schema"] = with_inputs(
    "fx_catalog",
    """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY system_ord) AS rn,
                  count(*) OVER (PARTITION BY entity, field) AS present FROM fx_catalog),
n AS (SELECT entity, count(DISTINCT system) AS systems FROM fx_catalog GROUP BY entity)
SELECT f.entity, field, type AS data_type, present < systems AS nullable, pk AS is_primary_key FROM f JOIN n ON f.entity = n.entity WHERE rn = 1
""",
)
_MAPPING = f"""
SELECT p.entity, p.source_system, p.target_system, s.field AS source_field, coalesce(t.field, '') AS target_field,
       CASE WHEN t.field IS NULL THEN 0::DOUBLE ELSE {type_score("s.type", "t.type")} END AS similarity_score
FROM fx_pairs p JOIN fx_catalog s ON s.entity = p.entity AND s.system = p.source_system
LEFT JOIN fx_catalog t ON t.entity = p.entity AND t.system = p.target_system AND t.field = s.field
"""
O["field_mapping"] = with_inputs(
    "fx_pairs fx_type_groups",
    f"""
WITH m AS ({_MAPPING})
SELECT *, CASE WHEN target_field = '' THEN 'unmapped' WHEN similarity_score >= 0.9::DOUBLE THEN 'exact' ELSE 'semantic' END AS mapping_type FROM m
""",
)
O["consistency_score"] = with_inputs(
    "fx_pairs fx_type_groups",
    f"""
WITH m AS ({_MAPPING}),
c AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE similarity_score = 1) AS a, count(*) FILTER (WHERE similarity_score = 0.9::DOUBLE) AS b,
             count(*) FILTER (WHERE similarity_score = 0.5::DOUBLE) AS c, count(*) FILTER (WHERE similarity_score = 0.2::DOUBLE) AS d FROM m GROUP BY entity)
SELECT e.entity, coalesce(n, 0) AS mappings,
       coalesce((a * 1::DOUBLE + b * 0.9::DOUBLE + c * 0.5::DOUBLE + d * 0.2::DOUBLE) / n, 1::DOUBLE) AS consistency_score
FROM (SELECT DISTINCT entity FROM fx_catalog) e LEFT JOIN c ON c.entity = e.entity
""",
)


def _missing(source: str) -> str:
    return f"""
SELECT s.entity, s.system AS source_system, o.system AS target_system, 'missing_field' AS inconsistency_type, s.field AS field_name,
       CASE WHEN s.pk THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM {source} s JOIN (SELECT DISTINCT entity, system FROM {source}) o ON o.entity = s.entity AND o.system <> s.system
WHERE NOT EXISTS (SELECT 1 FROM {source} t WHERE t.entity = s.entity AND t.system = o.system AND t.field = s.field)
"""


def _mismatch(source: str) -> str:
    return f"""
SELECT s.entity, s.system AS source_system, t.system AS target_system, 'type_mismatch' AS inconsistency_type, s.field AS field_name,
       s.type AS source_definition, t.type AS target_definition, 'HIGH' AS severity
FROM {source} s JOIN {source} t ON t.entity = s.entity AND t.field = s.field AND s.system_ord < t.system_ord
WHERE s.type <> '' AND t.type <> '' AND {type_score("s.type", "t.type")} < 0.9::DOUBLE
"""


O["missing_field_findings"] = with_inputs(
    "fx_catalog",
    f"""
WITH m AS ({_missing("fx_catalog")})
SELECT *, concat('Field ''', field_name, ''' exists in ', source_system, ' but is absent in ', target_system,
                 '. Queries spanning both systems may fail or return nulls.') AS impact_description,
       concat('Add field ''', field_name, ''' to ', target_system, ' or implement a transformation/default in the integration layer.') AS remediation_hint
FROM m
""",
)
O["type_mismatch_findings"] = with_inputs(
    "fx_catalog fx_type_groups",
    f"""
WITH m AS ({_mismatch("fx_catalog")})
SELECT *, concat('Field ''', field_name, ''' has type ''', source_definition, ''' in ', source_system, ' but ''', target_definition, ''' in ', target_system,
                 '. Data type coercion may silently corrupt values.') AS impact_description,
       concat('Align the type of ''', field_name, ''' between ', source_system, ' and ', target_system, ', or add explicit casting in the ETL pipeline.') AS remediation_hint
FROM m
""",
)
O["schema_analysis"] = with_inputs(
    "fx_catalog fx_catalog_systems fx_wanted fx_type_groups",
    f"""
WITH scope AS (SELECT * FROM fx_catalog WHERE system IN (SELECT name FROM fx_catalog_systems WHERE status = 'connected')
               AND entity IN (SELECT entity FROM fx_wanted))
SELECT entity, source_system, target_system, inconsistency_type, field_name, severity, CAST(NULL AS VARCHAR) AS target_definition FROM ({_missing("scope")})
UNION ALL
SELECT entity, source_system, target_system, inconsistency_type, field_name, severity, target_definition FROM ({_mismatch("scope")})
""",
)

# All pairs of entities of two systems, scored without any candidate step.
_WORDS = "list_sort(list_filter(regexp_split_to_array(lower(regexp_replace(entity, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> ''))"
_ENTITY_KIND = """CASE WHEN t = '' THEN 'unknown' WHEN t IN ('varchar', 'text', 'string', 'nvarchar', 'char') THEN 'varchar'
  WHEN t IN ('int', 'integer', 'bigint', 'smallint', 'number') THEN 'int' WHEN t IN ('float', 'double', 'decimal', 'numeric', 'real') THEN 'float'
  WHEN t IN ('bool', 'boolean', 'bit', 'tinyint') THEN 'bool' WHEN t IN ('date', 'datetime', 'timestamp', 'datetime2') THEN 'date' ELSE 'other' END"""
_BOTH_WAYS = scored_names("(SELECT DISTINCT 'all' AS entity, name AS norm FROM nodes)", 0.0)
O["entity_candidates"] = with_inputs(
    "fx_named_entities",
    f"""
WITH f AS (
  SELECT system, system_ord, entity, trim(regexp_replace(regexp_replace(lower(field), '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_') AS norm, pk, row_part,
         {base("type")} AS t
  FROM fx_named_entities
),
k AS (SELECT *, {_ENTITY_KIND} AS kind, string_split(norm, '_') AS words FROM f),
nodes AS (
  SELECT system, system_ord, entity, array_to_string({_WORDS}, '_') AS name, list_distinct(list(norm)) AS fields, count(*) AS n, length(CAST(sum(row_part) AS VARCHAR)) AS digits,
         list(kind) AS kinds,
         bool_or(pk) AS r1, bool_or(kind = 'date' OR list_has_any(words, ['created', 'updated', 'modified', 'date', 'time', 'timestamp', 'at'])) AS r2,
         bool_or(list_has_any(words, ['amount', 'price', 'cost', 'revenue', 'total', 'currency', 'balance'])) AS r3
  FROM k GROUP BY system, system_ord, entity
),
scored AS ({_BOTH_WAYS}),
p AS (
  SELECT a.system AS source_system, a.entity AS source_entity, b.system AS target_system, b.entity AS target_entity, a.name AS x, b.name AS y,
         a.n AS na, b.n AS nb, len(list_intersect(a.fields, b.fields)) AS in_both, abs(a.digits - b.digits) AS apart, a.kinds AS ka, b.kinds AS kb,
         (a.r1 <> b.r1)::INTEGER + (a.r2 <> b.r2)::INTEGER + (a.r3 <> b.r3)::INTEGER AS differ
  FROM nodes a JOIN nodes b ON a.system_ord < b.system_ord
),
s AS (
  SELECT source_system, source_entity, target_system, target_entity,
         CASE WHEN x = y THEN 1::DOUBLE ELSE coalesce(score, 0::DOUBLE) END AS name_score,
         in_both / (na + nb - in_both) AS field_score,
         CASE apart WHEN 0 THEN 1::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS row_score,
         list_sum([least(len(list_filter(ka, lambda v: v = g)) * nb, len(list_filter(kb, lambda v: v = g)) * na)
                   for g in ['varchar', 'int', 'float', 'bool', 'date', 'other', 'unknown']]) / (na * nb) AS type_score,
         (3 - differ) / 3 AS role_score
  FROM p LEFT JOIN scored ON scored.a = x AND scored.b = y
),
c AS (
  SELECT *, 0.35::DOUBLE * name_score + 0.3::DOUBLE * field_score + 0.15::DOUBLE * row_score + 0.1::DOUBLE * type_score + 0.1::DOUBLE * role_score AS confidence FROM s
)
SELECT * FROM c WHERE confidence >= 0.65::DOUBLE - 1e-9
""",
)
