"""Check SQL of the similar-name queries on words."""

from oracles.fragments import scored_names

ORACLES = {}

# Words of the benchmark texts: four systems, two entities, every word once per system and entity.
_WORDS = """
places AS (
  SELECT item_id, p, list_extract(w, p) AS field
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w))) AS p FROM (SELECT item_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM benchmark) x) y
),
words AS (
  SELECT concat('system_', item_id % 4) AS system, item_id % 4 AS system_ord, concat('domain_', (item_id // 4) % 2) AS entity, field,
         min(item_id * 100000 + p) AS field_ord, trim(regexp_replace(regexp_replace(field, '[^a-z0-9]+', '_', 'g'), '_+', '_', 'g'), '_') AS norm
  FROM places WHERE field <> '' GROUP BY ALL
)
"""
_SCORED = f"""
{_WORDS},
names AS (SELECT DISTINCT entity, norm FROM words WHERE norm <> ''),
scored AS ({scored_names("names")})
"""
_COMPARED = f"""
{_SCORED},
targets AS (SELECT entity, system, system_ord, norm, arg_min(field, field_ord) AS field, min(field_ord) AS field_ord FROM words GROUP BY ALL),
systems AS (SELECT DISTINCT entity, system, system_ord FROM words),
facing AS (
  SELECT s.entity, s.system AS source_system, t.system AS target_system, s.field AS source_field, s.field_ord AS source_field_ord, s.norm
  FROM words s JOIN systems t ON t.entity = s.entity AND t.system_ord > s.system_ord
),
options AS (
  SELECT f.*, t.field AS target_field, CASE WHEN t.norm = f.norm THEN 1.0::DOUBLE ELSE c.score END AS score, t.norm = f.norm AS same, t.field_ord
  FROM facing f JOIN targets t ON t.entity = f.entity AND t.system = f.target_system
  LEFT JOIN scored c ON c.a = f.norm AND c.b = t.norm WHERE t.norm = f.norm OR c.score IS NOT NULL
),
best AS (
  SELECT * FROM options
  QUALIFY row_number() OVER (PARTITION BY entity, source_system, target_system, source_field ORDER BY same DESC, score DESC, field_ord) = 1
)
"""
ORACLES["name_similarity"] = f"WITH {_SCORED} SELECT a AS source_norm, b AS target_norm, score FROM scored"
ORACLES["fuzzy_match"] = f"WITH {_COMPARED} SELECT entity, source_system, target_system, source_field, target_field, score FROM best"
ORACLES["fuzzy_report"] = f"""
WITH {_COMPARED},
keys AS (
  SELECT entity, source_system, target_system, list_sort(list(DISTINCT source_field) FILTER (WHERE source_field LIKE '%id%')) AS s,
         list_sort(list(DISTINCT target_field) FILTER (WHERE target_field LIKE '%id%')) AS t
  FROM best GROUP BY ALL
)
SELECT entity, 'missing_field' AS kind, 'HIGH' AS severity, count(*) AS n
FROM facing f WHERE NOT EXISTS (SELECT 1 FROM best b WHERE (b.entity, b.source_system, b.target_system, b.source_field) = (f.entity, f.source_system, f.target_system, f.source_field))
GROUP BY entity
UNION ALL
SELECT entity, 'key_mismatch', 'CRITICAL', count(*) FROM keys WHERE len(s) > 0 AND len(t) > 0 AND s <> t GROUP BY entity
"""
