"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
named AS (
  SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CASE q.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS w, coalesce(md5(d.text), '') AS tie
  FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, w, tie) - 1 AS number FROM named),
slim AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), tie, number::VARCHAR)), 1, 13))::BIGINT::DOUBLE + 0.5)
               / 4503599627370496.0) / w AS key
  FROM numbered),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(w * max(level) OVER (), 2.0::DOUBLE * source_size) AS target
  FROM levels),
split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
sampled AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.epochs,
         2 * coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.tie, s.number, s.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size
           <= 2 * (g.target - g.epochs * g.source_size) AS extra
  FROM slim s JOIN split g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + CASE WHEN extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sampled
"""

ORACLES["op7_dedup_lines"] = r"""
WITH lines AS (
  SELECT doc_id, k::BIGINT AS k, string_split(text, chr(10))[k] AS line,
         regexp_matches(string_split(text, chr(10))[k], '[^\x20\x09-\x0D]') AS wordy
  FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(k)
  WHERE text IS NOT NULL AND doc_id IS NOT NULL),
hashed AS (
  SELECT *, (('0x' || substr(md5(line), 1, 8))::BIGINT) % 2147483647 AS h,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50 AS passage FROM lines),
ended AS (
  SELECT *, CASE WHEN (coalesce(lag(h) OVER (PARTITION BY doc_id, wordy ORDER BY k), 0) * 1000003 + h) % 2147483647 % 64 = 0 AND NOT passage
                 THEN 0 ELSE 1 END AS ends FROM hashed),
started AS (
  SELECT *, CASE WHEN NOT wordy OR row_number() OVER (PARTITION BY doc_id, wordy ORDER BY k) = 1 THEN 0 WHEN passage THEN 1
                      ELSE lag(ends) OVER (PARTITION BY doc_id, wordy ORDER BY k) END AS starts FROM ended),
placed AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS place FROM started),
chunked AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY k) AS whole, count(*) AS n_lines,
         coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE wordy), '') AS chunk, count(*) FILTER (WHERE wordy) AS n
  FROM placed GROUP BY doc_id, place),
paired AS (SELECT *, lead(chunk) OVER (PARTITION BY doc_id ORDER BY place) AS following FROM chunked),
units AS (
  SELECT doc_id, place, TRUE AS pair, chunk AS a, following AS b FROM paired WHERE following IS NOT NULL
  UNION ALL
  SELECT doc_id, place, FALSE, chunk, '' FROM chunked WHERE n > 1 OR len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) >= 50),
repeats AS (
  SELECT doc_id, place, pair FROM units
  QUALIFY row_number() OVER (PARTITION BY pair, a, b ORDER BY doc_id, place) > 1),
gone AS (SELECT DISTINCT doc_id, place + step AS place FROM repeats, generate_series(0, 1) AS s(step) WHERE pair OR step = 0),
cleaned AS (
  SELECT c.doc_id, coalesce(string_agg(whole, chr(10) ORDER BY c.place) FILTER (WHERE g.place IS NULL), '') AS text,
         coalesce(sum(n_lines) FILTER (WHERE g.place IS NOT NULL), 0)::BIGINT AS removed_lines
  FROM chunked c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.place = g.place GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, d.text) END AS text, coalesce(c.removed_lines, 0)::BIGINT AS removed_lines
FROM documents d LEFT JOIN cleaned c ON d.doc_id = c.doc_id
"""
