"""SQL of the queries that SQL can express, with the parameters of the registered queries."""

OP5_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, row_number() OVER () AS rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts
), windows AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM worded)
), counted_windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows
), covered AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM counted_windows WHERE n > 1) GROUP BY rid
), raw_lines AS (
  SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM worded
), lines AS (
  SELECT rid, host, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), repeated AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid
), sizes AS (
  SELECT host, count(*) AS documents FROM worded GROUP BY host
), frequent AS (
  SELECT host, h FROM (SELECT host, h, count(DISTINCT rid) AS n FROM lines GROUP BY host, h) JOIN sizes USING (host)
  WHERE n > 20 AND n > documents * 0.01::DOUBLE
), lost AS (
  SELECT rid, sum(words)::BIGINT AS removed FROM lines JOIN frequent USING (host, h) GROUP BY rid
), base AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(repeated.n, 0)::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed, 0)::BIGINT AS removed_words
  FROM worded LEFT JOIN covered USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= n_words * 0.5::DOUBLE AS kept,
       removed_words
FROM base
"""

OP4_PAGES = r"""
parsed AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments
  FROM split
), shaped AS (
  SELECT page_id, host, path, rule, rule IN ('example.com/en/', 'net/es/', 'net/fr/') AS blocked,
    array_to_string(list_transform(segments, lambda s:
      CASE WHEN regexp_matches(regexp_replace(s, '[.][A-Za-z]{1,5}$', ''), '^[0-9]+$') THEN '{n}' || regexp_extract(s, '([.][A-Za-z]{1,5})$', 1)
           WHEN regexp_matches(regexp_replace(s, '[.][A-Za-z]{1,5}$', ''), '^[0-9a-fA-F-]{8,}$')
            AND regexp_matches(regexp_replace(s, '[.][A-Za-z]{1,5}$', ''), '[0-9]') THEN '{hex}' || regexp_extract(s, '([.][A-Za-z]{1,5})$', 1)
           WHEN regexp_matches(regexp_replace(s, '[.][A-Za-z]{1,5}$', ''), '[0-9]') THEN '{x}' || regexp_extract(s, '([.][A-Za-z]{1,5})$', 1)
           ELSE s END), '/') AS shape
  FROM ruled
), leaves_0 AS (
  SELECT host, shape, '' AS template, count(*) AS n, count(blocked) AS labelled, count(*) FILTER (blocked) AS blocked
  FROM shaped GROUP BY host, shape
)"""


def _depth(i: int) -> str:
    """The tables that grow the templates by the segment of one depth."""
    return f"""
here_{i} AS (
  SELECT *, nullif(split_part(shape, '/', {i + 1}), '') AS child FROM leaves_{i}
), sized_{i} AS (
  SELECT c.*, CASE WHEN c.n * 64 >= p.n OR starts_with(child, '{{') THEN child ELSE '*' END AS name
  FROM (SELECT host, template, child, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
        FROM here_{i} WHERE child IS NOT NULL GROUP BY ALL) c
  JOIN (SELECT host, template, sum(n) AS n FROM here_{i} GROUP BY ALL) p ON c.host = p.host AND c.template = p.template
), shares_{i} AS (
  SELECT host, template, name, (blocked + 1::DOUBLE) / (labelled + 2::DOUBLE) AS share, labelled + 2::DOUBLE AS weight
  FROM (SELECT host, template, name, sum(labelled) AS labelled, sum(blocked) AS blocked FROM sized_{i} GROUP BY ALL) WHERE labelled > 0
), steps_{i} AS (
  SELECT *, share * (1 - share) / weight AS spread,
    coalesce(share - lag(share) OVER w > sqrt(spread + lag(share * (1 - share) / weight) OVER w), TRUE) AS apart
  FROM shares_{i} WINDOW w AS (PARTITION BY host, template ORDER BY share, name)
), branches_{i} AS (
  SELECT *, sum(apart::INT) OVER (PARTITION BY host, template ORDER BY share, name ROWS UNBOUNDED PRECEDING) AS branch FROM steps_{i}
), named_{i} AS (
  SELECT s.host, s.template, s.child, coalesce(m.branch_name, s.name) AS branch_name FROM sized_{i} s LEFT JOIN (
    SELECT b.host, b.template, b.name, g.branch_name FROM branches_{i} b JOIN (
      SELECT host, template, branch, array_to_string(list_sort(list(name)), '|') AS branch_name FROM branches_{i} GROUP BY ALL) g
    ON b.host = g.host AND b.template = g.template AND b.branch = g.branch) m
  ON s.host = m.host AND s.template = m.template AND s.name = m.name
), leaves_{i + 1} AS (
  SELECT h.host, h.shape, h.template || CASE WHEN d.branch_name IS NULL THEN '' ELSE '/' || d.branch_name END AS template, h.n, h.labelled, h.blocked
  FROM here_{i} h LEFT JOIN named_{i} d ON h.host = d.host AND h.template = d.template AND h.child = d.child
)"""


OP4_SQL = "WITH" + ",".join([OP4_PAGES, *map(_depth, range(4))]) + """, prior AS (
  SELECT (sum(blocked) + 1)::DOUBLE / (sum(labelled) + 2)::DOUBLE AS p FROM leaves_4
), judged AS (
  SELECT host, template, sum(labelled) AS labelled, (sum(blocked) + 2::DOUBLE * any_value(p)) / (sum(labelled) + 2::DOUBLE) AS purity
  FROM leaves_4, prior GROUP BY ALL
)
SELECT s.page_id, s.host, s.path, s.rule, l.template, j.purity,
  CASE WHEN coalesce(s.blocked, j.labelled >= 5 AND j.purity >= 0.8::DOUBLE) THEN 'block' ELSE 'allow' END AS verdict
FROM shaped s JOIN leaves_4 l ON s.host = l.host AND s.shape = l.shape
JOIN judged j ON l.host = j.host AND l.template = j.template
"""

ORACLE: dict[str, str] = {
    "op4_urls": OP4_SQL,
    "op5_lines": OP5_SQL,
}
