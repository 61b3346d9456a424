"""DuckDB SQL with the same rows as the registered queries, written from the definitions."""

_COS = "CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS FLOAT)"
_V = """v AS (SELECT printf('vec-%06d', vec_id) AS id, vec_id AS n, CASE WHEN vec_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS platform,
  'app-' || (vec_id % 3) AS app, vec_id % 5 <> 0 AS success, label::BIGINT AS intent, embedding FROM embeddings)"""


def _top(pairs: str, k: str, more: str = "") -> str:
    return f"""p AS ({pairs}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM p) {more}
SELECT qid, id, round(cos::DOUBLE, 6) AS cos, rank FROM r WHERE rank <= {k}"""


def _one(where: str, k: int) -> str:
    return f"""WITH {_V}, p AS (SELECT b.id AS id, {_COS} AS cos FROM v b, (SELECT embedding FROM v ORDER BY id LIMIT 1) a WHERE {where}),
r AS (SELECT id, cos, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM p)
SELECT id, round(cos::DOUBLE, 6) AS cos, EXTRA rank FROM r WHERE rank <= {k}"""


_EDGES = f"""p AS (SELECT a.id AS qid, b.id AS id, {_COS} AS cos FROM v a JOIN v b ON a.intent = b.intent),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM p),
e AS (SELECT qid, id, cos FROM r WHERE rank <= 10 AND qid <> id AND cos >= 0.35::FLOAT)"""
_RANKED = f"""p AS (SELECT a.id AS qid, b.id AS id, {_COS} AS cos FROM v a JOIN v b ON a.platform = b.platform AND a.app = b.app),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM p),
r2 AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r WHERE rank <= 6 AND id <> qid),
rel AS (SELECT a.id AS qid, b.id AS id FROM v a JOIN v b ON a.intent = b.intent AND a.id <> b.id),
h AS (SELECT r2.qid AS qid, count(*) AS hits, min(rank) AS fr FROM r2 JOIN rel ON r2.qid = rel.qid AND r2.id = rel.id WHERE rank <= 5 GROUP BY r2.qid),
m AS (SELECT t.qid AS qid, relevant, coalesce(hits, 0) AS hits, coalesce(hits, 0) / relevant::DOUBLE AS recall, coalesce(hits, 0) / 5.0::DOUBLE AS precision,
  coalesce(fr, 0) AS first_rank, CASE WHEN fr > 0 THEN 1.0::DOUBLE / fr ELSE 0.0 END AS rr
  FROM (SELECT qid, count(*) AS relevant FROM rel GROUP BY qid) t LEFT JOIN h ON t.qid = h.qid)"""
_PAIRS = f"s AS (SELECT a.id AS left_id, b.id AS right_id, a.intent = b.intent AS duplicate, {_COS} AS cos FROM v a JOIN v b ON a.id < b.id)"


def _sweep(thresholds: str) -> str:
    return f"""WITH {_V}, {_PAIRS}, t AS ({thresholds}),
c AS (SELECT threshold, count(*) FILTER (WHERE duplicate AND cos >= threshold) AS tp, count(*) FILTER (WHERE NOT duplicate AND cos >= threshold) AS fp,
  count(*) FILTER (WHERE NOT duplicate AND cos < threshold) AS tn, count(*) FILTER (WHERE duplicate AND cos < threshold) AS fn FROM s, t GROUP BY threshold),
x AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c),
y AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM x)
SELECT round(threshold::DOUBLE, 6) AS threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM y"""


_ALL = _sweep("SELECT (i / 100.0::DOUBLE)::FLOAT AS threshold FROM range(1, 41) AS r(i)")
_CONV = r"""c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, arg_min(text, turn) AS said FROM conversations WHERE role = 'user' AND regexp_matches(text, '[^\p{Z}\x09-\x0D\x1C-\x1F]') GROUP BY conv_id),
act AS (SELECT conv_id, list(text ORDER BY turn) AS actions FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '[^\p{Z}\x09-\x0D\x1C-\x1F]') GROUP BY conv_id),
t AS (SELECT printf('conv-%06d', u.conv_id) AS id, regexp_replace(said, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS instruction, 'app-' || (u.conv_id % 3) AS app, true AS success,
  coalesce(actions, []) AS actions FROM u LEFT JOIN act ON u.conv_id = act.conv_id)"""
_FAILED = r"""el AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i FROM t WHERE len(actions) >= 3),
par AS (SELECT el.* FROM el, (SELECT count(*) AS n FROM el) c, range(10) AS r(k) WHERE i = (k * n) // 10),
fail AS (SELECT id || '-failed-truncated' AS id, id AS parent, instruction, app, actions[1:greatest(1, least(len(actions) - 1, (len(actions) * 2) // 3))] AS actions FROM par)"""
_TOKENS = r"list_filter(regexp_split_to_array(lower(instruction || ' ' || app), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(f, ''), lambda c: unicode(c)::HUGEINT)), lambda h, u: (xor(h, u) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
_DOC = "d AS (SELECT printf('doc-%06d', doc_id) AS id, text AS instruction, lang AS app FROM documents)"
_FEATURES = f"""{_DOC}, tok AS (SELECT id, {_TOKENS} AS w FROM d),
each AS (SELECT id, unnest(list_transform(w, lambda x: 'instruction:' || x)) AS f, 2.0::DOUBLE AS weight FROM tok
  UNION ALL SELECT id, 'instruction:bigram:' || w[i] || '_' || w[i + 1], 1.0::DOUBLE FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM tok)),
hashed AS (SELECT f, {_FNV} AS h FROM (SELECT DISTINCT f FROM each)),
sums AS (SELECT id, (h % 256)::INTEGER AS bucket, sum(CASE WHEN h < 9223372036854775808::HUGEINT THEN weight ELSE -weight END) AS value FROM each JOIN hashed ON each.f = hashed.f GROUP BY 1, 2)"""
#: Hash embeddings of the documents as (id, bucket, v), floats, and cosines of pairs that share a bucket under a condition.
_HASHED = f"""{_FEATURES}, e0 AS (SELECT id, bucket, value, sqrt(sum(value * value) OVER (PARTITION BY id))::FLOAT AS len FROM sums WHERE value <> 0),
e AS (SELECT id, bucket, (value::FLOAT / len)::DOUBLE AS v FROM e0), norms AS (SELECT id, sqrt(sum(v * v)) AS len FROM e GROUP BY id),
m AS (SELECT printf('doc-%06d', documents.doc_id) AS id, documents.doc_id AS n, lang AS app, coalesce(quality = 1, true) AS success FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)"""


def _near(where: str) -> str:
    return f"""pq AS (SELECT a.id AS qid, b.id AS id FROM m a JOIN m b ON {where}),
dots AS (SELECT qid, pq.id AS id, sum(x.v * y.v) AS dot FROM pq JOIN e x ON x.id = qid JOIN e y ON y.id = pq.id AND y.bucket = x.bucket GROUP BY qid, pq.id),
p AS (SELECT qid, dots.id AS id, (dot / (a.len * b.len))::FLOAT AS cos FROM dots JOIN norms a ON a.id = qid JOIN norms b ON b.id = dots.id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM p)"""


_SAME = f"""WITH RECURSIVE {_HASHED}, {_near("a.app = b.app AND a.success = b.success")}, s AS (SELECT qid AS x, id AS y FROM r WHERE rank <= 10 AND qid <> id AND cos >= 0.92::FLOAT UNION SELECT id, qid FROM r WHERE rank <= 10 AND qid <> id AND cos >= 0.92::FLOAT),
reach(x, y) AS (SELECT x, y FROM s UNION SELECT reach.x, s.y FROM reach JOIN s ON reach.y = s.x), roots AS (SELECT x AS id, least(x, min(y)) AS root FROM reach GROUP BY x)"""
SQL = {
    "q01_search_topk": _one("true", 5).replace("EXTRA", "round(((1.0::DOUBLE + cos::DOUBLE) / 2)::FLOAT::DOUBLE, 6) AS score,"),
    "q02_search_filtered": _one("b.app = 'app-1' AND b.success", 10).replace("EXTRA", ""),
    "q03_search_by_id": f"""WITH {_V}, p AS (SELECT b.id AS id, {_COS} AS cos FROM v b JOIN v a ON a.id = 'vec-000007' AND a.platform = b.platform AND a.app = b.app),
r AS (SELECT *, row_number() OVER (ORDER BY cos DESC, id) AS rank FROM p), s AS (SELECT id, cos, row_number() OVER (ORDER BY rank) AS rank FROM r WHERE rank <= 6 AND id <> 'vec-000007')
SELECT id, round(cos::DOUBLE, 6) AS cos, rank FROM s WHERE rank <= 5""",
    "q04_search_batch": f"WITH {_V}, " + _top(f"SELECT a.id AS qid, b.id AS id, a.n % 7 + 1 AS k, {_COS} AS cos FROM v a JOIN v b ON a.n % 10 = 0 AND (a.n % 20 <> 0 OR a.platform = b.platform) AND (a.n % 30 = 0 OR a.app = b.app) AND (a.n % 40 <> 0 OR b.success)", "k"),
    "q05_knn_unfiltered": f"WITH {_V}, " + _top(f"SELECT a.id AS qid, b.id AS id, {_COS} AS cos FROM v a, v b", "10"),
    "q06_dedup_edges": f"WITH {_V}, {_EDGES} SELECT qid, id, round(cos::DOUBLE, 6) AS cos FROM e",
    "q07_dedup_groups": f"""WITH RECURSIVE {_V}, {_EDGES}, s AS (SELECT qid AS x, id AS y FROM e UNION SELECT id, qid FROM e),
reach(x, y) AS (SELECT x, y FROM s UNION SELECT reach.x, s.y FROM reach JOIN s ON reach.y = s.x), roots AS (SELECT x AS id, least(x, min(y)) AS root FROM reach GROUP BY x),
pairs AS (SELECT a.root AS root, avg({_COS.replace('a.embedding', 'av.embedding').replace('b.embedding', 'bv.embedding')}::DOUBLE) AS mean FROM roots a JOIN roots b ON a.root = b.root AND a.id < b.id JOIN v av ON av.id = a.id JOIN v bv ON bv.id = b.id GROUP BY a.root),
lists AS (SELECT root, string_agg(id, ',' ORDER BY id) AS member_ids FROM roots GROUP BY root)
SELECT lists.root AS canonical_id, member_ids, round(mean, 4) AS mean_cos FROM lists JOIN pairs ON lists.root = pairs.root""",
    "q08_hash_features": f"WITH {_FEATURES} SELECT id, bucket, value FROM sums WHERE value <> 0",
    "q09_hash_embedding": f"WITH {_FEATURES}, lens AS (SELECT id, sqrt(sum(value * value))::FLOAT AS len FROM sums GROUP BY id) SELECT sums.id AS id, bucket, round((value::FLOAT / len)::DOUBLE, 5) AS value FROM sums JOIN lens ON sums.id = lens.id WHERE value <> 0",
    "q10_doc_dedup": f"{_SAME} SELECT id, root FROM roots",
    "q11_doc_group_stats": f"{_SAME}, g AS (SELECT count(*) AS n FROM roots GROUP BY root) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members, coalesce(max(n), 0)::BIGINT AS largest FROM g",
    "q12_conv_parse": f"WITH {_CONV} SELECT id, instruction, app, success, array_to_string(actions, ' | ') AS actions, len(actions)::BIGINT AS n FROM t",
    "q13_embed_text": f"WITH {_CONV} SELECT id, 'Task: ' || instruction || '. App: ' || app || '. Steps: ' || array_to_string(actions, ' ') AS text FROM t",
    "q14_counts": """WITH d AS (SELECT lang, source, coalesce(quality = 1, true) AS ok FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id)
SELECT 'app' AS field, lang AS value, count(*) AS n FROM d GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM d GROUP BY source UNION ALL SELECT 'success', CASE WHEN ok THEN 'true' ELSE 'false' END, count(*) FROM d GROUP BY ok""",
    "q15_retrieval_per_query": f"WITH {_V}, {_RANKED} SELECT qid, relevant, hits, round(recall, 6) AS recall, round(precision, 6) AS precision, first_rank, round(rr, 6) AS rr FROM m",
    "q16_retrieval_summary": f"WITH {_V}, {_RANKED} SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS hit_rate, round(avg(rr), 6) AS mrr FROM m",
    "q17_label_pairs": f"WITH {_V}, {_PAIRS} SELECT left_id, right_id, duplicate, round(cos::DOUBLE, 6) AS cos FROM s",
    "q18_confusion": _sweep("SELECT 0.2::FLOAT AS threshold"),
    "q19_sweep": _ALL,
    "q20_calibrated": _ALL.replace("FROM y", "FROM y ORDER BY y.f1 DESC, y.precision DESC, y.threshold DESC LIMIT 1"),
    "q21_inject": f"WITH {_CONV}, {_FAILED} SELECT id, success, array_to_string(actions, ' | ') AS actions, 'local' AS source, id AS sourceId, 0::INTEGER AS imageCount FROM t UNION ALL SELECT id, false, array_to_string(actions, ' | '), 'controlled-failure-injection', parent, 0::INTEGER FROM fail",
    "q24_percentiles": "SELECT quantile_disc(n_chars, 0.5)::BIGINT AS p50, quantile_disc(n_chars, 0.95)::BIGINT AS p95, quantile_disc(n_chars, 0.99)::BIGINT AS p99 FROM documents",
    "q25_lowest_recall": f"WITH {_V}, {_RANKED} SELECT qid, round(recall, 6) AS recall, hits FROM m ORDER BY m.recall, qid LIMIT 10",
    "q26_sample_even": f"WITH {_V}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM v) SELECT id, k AS ordinal FROM o, (SELECT count(*) AS c FROM v) t, range(57) AS r(k) WHERE i = (k * c) // 57",
    "q27_validate": f"""WITH {_V}, s AS (SELECT CASE WHEN n % 50 = 1 THEN 'vec-000000' ELSE id END AS id, n FROM v),
f AS (SELECT 'instruction' AS rule FROM s WHERE n % 40 = 2 UNION ALL SELECT 'vector' FROM s WHERE n % 60 = 3 UNION ALL SELECT 'dimension' FROM s WHERE n % 60 <> 3 AND n % 70 = 4
  UNION ALL SELECT 'imageCount' FROM s WHERE n % 90 = 5 UNION ALL SELECT 'unique' FROM s GROUP BY id HAVING count(*) > 1)
SELECT rule, count(*) AS n FROM f GROUP BY rule""",
    "q29_image_count": "SELECT conv_id, 0::BIGINT AS images FROM conversations GROUP BY conv_id",
    "q30_report": f"WITH {_V} SELECT count(*) AS trajectories, 64::BIGINT AS dimension, 'feature-hash' AS model, count(*) FILTER (WHERE success) AS successes, sum(n % 4)::BIGINT AS images, count(DISTINCT app) AS apps, 1::BIGINT AS sources FROM v",
    "q31_doc_search": f"WITH {_HASHED}, {_near('a.n % 100 = 0 AND a.app = b.app')}, o AS (SELECT qid, id, cos, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM r WHERE rank <= 6 AND id <> qid) SELECT qid, id, round(cos::DOUBLE, 6) AS cos, rank FROM o WHERE rank <= 5",
}
