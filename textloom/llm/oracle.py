"""The operators' results in SQL, where SQL can express them."""

from __future__ import annotations

_WARC = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS digest
  FROM pages
), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM rows)
SELECT page_id, payload_bytes, digest AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM firsts
"""

_URL = r"(?i)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"

_LISTS = f"""
WITH parts AS (
  SELECT page_id, url, DATE '2020-01-01' + (page_id * 37 % 1461)::INT AS fetched,
    nullif(rtrim(lower(regexp_extract(trim(url), '{_URL}', 1)), '.'), '') AS host,
    list_filter(string_split(regexp_extract(trim(url), '{_URL}', 2), '/'), lambda p: p <> '') AS path
  FROM pages
), keyed AS (
  SELECT page_id, url, fetched, CASE WHEN host IS NULL THEN []::VARCHAR[] ELSE
      [host] || list_transform(range(2, len(l)), lambda i: array_to_string(l[i:], '.'))
      || list_transform(range(1, len(path) + 1), lambda i: host || '/' || array_to_string(path[1:i], '/')) END AS keys
  FROM (SELECT *, string_split(host, '.') AS l FROM parts)
), entries AS (
  SELECT CASE WHEN page_id % 2 = 0 THEN 'ads' ELSE 'malware' END AS list, keys[page_id % 3 + 1] AS entry,
    DATE '2020-01-01' + (page_id * 13 % 1461)::INT AS since,
    CASE WHEN page_id % 7 < 3 THEN 'remove' ELSE 'add' END AS action
  FROM keyed
), moments AS (
  SELECT list, entry, since, min(action) AS action FROM entries WHERE entry IS NOT NULL AND since IS NOT NULL GROUP BY ALL
), asked AS (SELECT page_id, url, fetched, unnest(keys) AS entry FROM keyed
), latest AS (
  SELECT a.page_id, m.list, m.entry, arg_max(m.action, m.since) AS action
  FROM asked a JOIN moments m ON a.entry = m.entry AND m.since <= a.fetched GROUP BY ALL
), found AS (
  SELECT page_id, count(*) AS n, string_agg(list || ':' || entry, '|' ORDER BY list || ':' || entry) AS matches
  FROM latest WHERE action = 'add' GROUP BY page_id
)
SELECT k.page_id, k.url, k.fetched::TIMESTAMP AS fetched, coalesce(n, 0)::INT AS n_matches, coalesce(matches, '') AS matches
FROM keyed k LEFT JOIN found USING (page_id)
"""

_MIX = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('10:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS most, (sum(source_size) OVER ())::DOUBLE AS whole,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS nth
  FROM sources
), filled AS (
  SELECT *, (whole - coalesce(sum(most) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels
), targets AS (
  SELECT source, source_size, CASE weight WHEN 5.0 THEN -0.5 WHEN 2.0 THEN 0.0 ELSE 0.5 END::DOUBLE AS slope,
    least(most, coalesce(max(CASE WHEN level * weight <= most THEN level END) OVER () * weight, most)) AS target
  FROM filled
), placed AS (
  SELECT r.*, t.source_size, t.target, t.slope,
    sum(size) OVER (PARTITION BY r.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, greatest(0.0, least(1.0, middle / nullif(target, 0)))::DOUBLE AS share,
    CASE WHEN source_size > 0 THEN least(3, greatest(0, ceil((target - middle) / source_size)))::BIGINT ELSE 0 END AS times
  FROM placed
)
SELECT doc_id, size, source_size, target, size * times AS taken,
  CASE WHEN times > 0 THEN
    round(least(1.0, 2 * share / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * share))), 9) END AS first_position
FROM counted
"""

_CAPS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), units AS (
  SELECT vec_id, label, v, sqrt(list_inner_product(v, v)) AS norm FROM vectors WHERE list_inner_product(v, v) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.93
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), groups AS (SELECT a, min(b) AS least FROM reached GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(g.least, vec_id)) AS component_id,
  vec_id <= coalesce(g.least, vec_id) AS kept
FROM embeddings e LEFT JOIN groups g ON e.vec_id = g.a LEFT JOIN counts c ON e.vec_id = c.a
"""

_MINHASH = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
), reached(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), groups AS (SELECT a, min(b) AS least FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(g.least, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(g.least, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN groups g ON g.a = d.doc_id
"""

_NEAREST = """
WITH vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])))) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_caps": _CAPS,
    "op3_warc": _WARC,
    "op6_minhash": _MINHASH,
    "op7_curves": _NEAREST,
    "op8_url_lists": _LISTS,
    "op10_mixing": _MIX,
}
