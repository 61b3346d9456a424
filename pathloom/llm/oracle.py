"""DuckDB SQL for the queries that SQL can express."""

_BAD = "spam|pills|casino|bets|porn|viagra|warez"
_SUF = r"(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]*"
_URLS = rf"""
WITH cut AS (
  SELECT page_id, regexp_matches(coalesce(url, '') || coalesce(html, ''), '(?i){_BAD}') AS term, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, term, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
base AS (
  SELECT page_id, term, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (
  SELECT page_id, term, host, path,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM base),
seen AS (
  SELECT host, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 WHEN term THEN 1 ELSE 0 END AS bad FROM ruled),
hosts AS (
  SELECT host,
    CASE WHEN regexp_matches(host, '^[0-9.]*$') OR regexp_extract(host, '(^|\.)([^.]*\.({_SUF}))$', 2) = '' THEN host ELSE regexp_extract(host, '(^|\.)([^.]*\.({_SUF}))$', 2) END AS domain,
    CASE WHEN regexp_matches(host, '^[0-9.]*$') THEN '' ELSE regexp_extract(host, '(^|\.)({_SUF})$', 2) END AS suffix,
    count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM seen GROUP BY host),
doms AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
sufs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM doms GROUP BY suffix),
moments AS (
  SELECT 'host' AS lvl, sum(n) AS n, sum(bad) AS bad, count(*)::DOUBLE AS k, round(sum(bad * bad / n), 6) AS sq FROM hosts
  UNION ALL SELECT 'dom', sum(n), sum(bad), count(*)::DOUBLE, round(sum(bad * bad / n), 6) FROM doms
  UNION ALL SELECT 'suf', sum(n), sum(bad), count(*)::DOUBLE, round(sum(bad * bad / n), 6) FROM sufs),
shares AS (
  SELECT lvl, n, bad, k, CASE WHEN k >= n OR bad = 0 OR bad = n THEN 0.0
    ELSE (sq / n - (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * k / n) / ((bad / n) * (1 - bad / n) * (1 - k / n)) END AS share FROM moments),
strength AS (
  SELECT lvl, CASE WHEN share <= 1.0 / 1001 THEN 1000.0::DOUBLE ELSE round(greatest(1.0::DOUBLE, 1.0 / share - 1), 6) END AS s FROM shares),
pr AS (
  SELECT (SELECT s FROM strength WHERE lvl = 'host') AS sh, (SELECT s FROM strength WHERE lvl = 'dom') AS sd, (SELECT s FROM strength WHERE lvl = 'suf') AS ss,
    (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM sufs) AS m0),
m1 AS (SELECT suffix, (ss * m0 + bad) / (n + ss) AS m FROM sufs, pr),
m2 AS (SELECT domain, doms.suffix AS suffix, (m1.m * sd + bad) / (n + sd) AS m FROM doms JOIN m1 ON doms.suffix = m1.suffix, pr),
m3 AS (SELECT host, n + sh AS t, (m2.m * sh + bad) / (n + sh) AS m FROM hosts JOIN m2 ON hosts.domain = m2.domain AND hosts.suffix = m2.suffix, pr),
posterior AS (SELECT host, m * t AS a, (1 - m) * t AS b FROM m3),
grid AS (SELECT host, a, b, ln(a / b) AS c, sqrt(1 / a + 1 / b) * (8.0::DOUBLE / 200) AS step, ln(a / b) + sqrt(1 / a + 1 / b) * (8.0::DOUBLE / 200) * i AS t FROM posterior, range(-200, 201) AS g(i)),
dens AS (SELECT host, t, step, exp(a * t - (a + b) * (greatest(t, 0.0::DOUBLE) + ln(1 + exp(-abs(t)))) - (a * c - (a + b) * (greatest(c, 0.0::DOUBLE) + ln(1 + exp(-abs(c)))))) AS f FROM grid),
known AS (SELECT host, round(sum(f * least(1.0::DOUBLE, greatest(0.0::DOUBLE, t / step + 0.5))) / sum(f), 6) >= 0.95 AS blocked FROM dens GROUP BY host)
SELECT page_id, ruled.host AS host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN known ON ruled.host = known.host
"""
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTAMINATION = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOW}, '{_WORD}'), []) AS w FROM documents),
spots AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n),
hits AS (
  SELECT doc_id, i, wins.n AS n, item_id FROM spots JOIN wins ON wins.n = spots.n AND wins.win = array_to_string(w[i:i + spots.n - 1], ' ')),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT docs.doc_id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered ON docs.doc_id = covered.doc_id LEFT JOIN listed ON docs.doc_id = listed.doc_id
"""
SQL = {"op4_url_filter": _URLS, "op9_decontamination": _CONTAMINATION}
