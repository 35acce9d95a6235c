"""DuckDB SQL for the document queries that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"


EXACT_DEDUP = """
SELECT doc_id, CASE WHEN count(*) OVER w = 1 THEN doc_id ELSE max(doc_id) OVER w END AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def mixing(table: str = "documents", columns: str = "doc_id, size, source_size, target, taken", where: str = "TRUE") -> str:
    return f"""
WITH sized AS (
  SELECT *, length(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h FROM {table}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS lim FROM per),
ranked AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lef,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM weighed WINDOW o AS (ORDER BY lim / weight, source IS NULL, source::BLOB)),
free AS (
  SELECT max(weight_left) AS fw, arg_max(lef, weight_left) AS fl FROM ranked WHERE NOT lef * weight / weight_left > lim),
goal AS (
  SELECT source, source_size, CASE WHEN lef * weight / weight_left > lim THEN lim ELSE fl * weight / fw END AS target,
         (('0x' || substr(md5('mix:offset:' || CASE WHEN source IS NULL THEN 'true:' ELSE 'false:' || source END), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM ranked LEFT JOIN free ON TRUE),
numbered AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY size, (('0x' || substr(h, 1, 4))::BIGINT) % 64, h, doc_id) - 1 AS k FROM sized s),
counted AS (
  SELECT n.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate, g.off
  FROM numbered n JOIN goal g ON n.source IS NOT DISTINCT FROM g.source),
copied AS (SELECT *, (floor(rate * (k + 1) + off) - floor(rate * k + off))::BIGINT AS copies FROM counted),
result AS (SELECT * REPLACE (source_size::BIGINT AS source_size), copies * size AS taken FROM copied WHERE {where})
SELECT {columns} FROM result"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_dedup": EXACT_DEDUP, "op9_mixing": mixing()}
