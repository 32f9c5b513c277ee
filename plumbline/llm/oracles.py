"""Check SQL (DuckDB) of the text operators that SQL can express, written independently of them."""

from __future__ import annotations

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^ \t-\r]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM d
),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM words WHERE len(w) >= 8)
),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS j FROM twice) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
    length(array_to_string(w, '')) - length(regexp_replace(array_to_string(w, ''), '[\p{L}\p{M}]', '', 'g')) AS n_letters,
    length(t) - length(replace(t, '!', '')) AS n_exclamations
  FROM words w LEFT JOIN covered c USING (doc_id)
),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_upper > 5 * word_chars THEN 8 ELSE 0 END)
    + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END) + (CASE WHEN word_chars > 25 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 10 * n_exclamations > 3 * n_words THEN 128 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 256 ELSE 0 END) :: BIGINT AS failures
  FROM m
)
SELECT *, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, (failures & 3) = 0 AS kept_base,
  (failures & 111) = 0 AS kept_v1, failures = 0 AS kept_v2
FROM f
"""

# Base32 of the SHA-1: five hexadecimal digits make four symbols.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(x, 1 + 5 * (s // 4), 5)) AS INTEGER) >> (15 - 5 * (s % 4))) & 31), 1)
      for s in range(32)], '') AS digest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""



def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codebooks refined round by round, every part measured against every entry."""
    steps = [
        f"""kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v, len(embedding) // {parts} AS size
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * size + 1, (part + 1) * size) AS v FROM kept, range({parts}) t(part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v
  FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, entry := entry)) AS best
  FROM (SELECT p.vec_id, p.part, b.entry, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, b.v)]) AS d FROM p JOIN b{k} b USING (part))
  GROUP BY vec_id, part
)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (
  SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY place) AS v
  FROM (
    SELECT part, entry, place, sum(x) AS s, count(*) AS n
    FROM (SELECT p.part, a.best.entry AS entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS place FROM p JOIN a{k} a USING (vec_id, part))
    GROUP BY part, entry, place
  )
  GROUP BY part, entry
),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f""",
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (
  SELECT vec_id, string_agg(lower(printf('%02x', best.entry)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN kept k USING (vec_id), books"""
    )


# Terms: all of a text, A-Z as a-z.
LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
),
p AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term
),
r AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20
"""

ORACLES: dict[str, str] = {"op8_warc": WARC, "op10_quality_rules": QUALITY_RULES, "op11_vector_codes": vector_codes_sql(), "op13_lexical_search": LEXICAL_SEARCH}
