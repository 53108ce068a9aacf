"""SQL of the queries in ``graph_queries``."""

from __future__ import annotations

from skillweft.plans.quality_queries import _A8
from skillweft.plans.trend_queries import _Z7
from skillweft.plans.views import with_views

AS_OF = "2001-08-01"
_REQ = with_views("jd", "jd_skill", "requires")
_FREQ = _REQ + "freqs AS (SELECT position_name, count(*) AS freq FROM jd GROUP BY ALL)"
_EV = _REQ + "evidence AS (SELECT skill, source, id AS ref FROM jd_skill)"
_PAN = ", top AS (SELECT * FROM freqs ORDER BY freq DESC, position_name LIMIT {n})"
_TECH = ", deg AS (SELECT skill, count(*) AS degree FROM requires WHERE {where} GROUP BY ALL), ts AS (SELECT * FROM deg ORDER BY degree DESC, skill LIMIT {n})"
_CO = _REQ + "pairs AS (SELECT x.skill AS a, y.skill AS b, count(*) AS weight FROM requires x JOIN requires y ON x.position_name = y.position_name AND x.skill < y.skill GROUP BY ALL)"
_NODE = with_views("snapshots") + "node AS (SELECT version, target AS id, CASE WHEN count(*) > 3 THEN 'core' ELSE 'rare' END AS type, target AS name FROM snapshots GROUP BY ALL)"
_MOD = _CO + ", adj AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs), com AS (SELECT *, substr(a, 7, 1) AS ca, substr(b, 7, 1) AS cb FROM adj), per AS (SELECT ca, sum(weight) AS tot, coalesce(sum(weight) FILTER (ca = cb), 0) AS inside FROM com GROUP BY ALL)"
_RANKS = (
    _REQ
    + "w AS (SELECT split_part(position_name, '/', 2) AS a, skill || '/' || substr(position_name, 1, 1) AS b, sum(weight) AS weight FROM requires GROUP BY ALL), o AS (SELECT a, b FROM w WHERE weight >= (SELECT avg(weight) FROM w)), e AS MATERIALIZED (SELECT a, b FROM o UNION ALL SELECT b, a FROM o), deg AS MATERIALIZED (SELECT a AS id, count(*) AS d FROM e GROUP BY ALL), n AS (SELECT count(*) AS n FROM deg), r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM deg, n)"
    + "".join(f", r{i} AS MATERIALIZED (SELECT e.b AS id, any_value(0.15::DOUBLE / n) + 0.85::DOUBLE * sum(r.rank / g.d) AS rank FROM e JOIN r{i - 1} r ON r.id = e.a JOIN deg g ON g.id = e.a, n GROUP BY e.b)" for i in range(1, 51))
)
_PRE = "WITH RECURSIVE p AS (SELECT 's' || n_nationkey AS src, 's' || CAST(floor(n_nationkey / 2) AS INT) AS dst FROM nation WHERE n_nationkey > 0), c(src, dst) AS (SELECT src, dst FROM p UNION SELECT c.src, p.dst FROM c JOIN p ON c.dst = p.src)"
_PATH = "WITH RECURSIVE one AS (SELECT 'p' || (p_partkey % 40) AS a, 'p' || (p_size % 40) AS b FROM part WHERE p_partkey % 40 <> p_size % 40 AND p_partkey % 40 < p_size % 40 + 6), e AS (SELECT a, b FROM one UNION SELECT b, a FROM one), w(id, path, hops) AS (SELECT 'p0', ['p0'], 0 UNION ALL SELECT id, min(path), max(hops) FROM (SELECT e.b AS id, list_append(path, e.b) AS path, hops + 1 AS hops FROM w JOIN e ON e.a = w.id WHERE hops < 6 AND NOT list_contains(path, e.b)) GROUP BY id)"
_POS = _A8 + """, pos AS (SELECT position_name, skill, CASE WHEN m THEN 'must' ELSE 'nice' END AS necessity, (CASE WHEN m THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END) + hits / 1000 AS weight, ['初级', '中级', '高级', '专家'][hits % 4 + 1] AS proficiency, hits AS source_count FROM (SELECT *, CASE WHEN jd_count >= 3 THEN must / jd_count > 0.5 ELSE must / hits >= 0.5 END AS m FROM agg JOIN st USING (position_name))),
cand AS (SELECT company AS candidate, skill, least(count(*), 3) AS proficiency, max(weight) < 10 AS low FROM jd_skill GROUP BY ALL),
o1 AS (SELECT *, count_if(necessity = 'must') OVER (PARTITION BY position_name) AS n, necessity = 'must' AND NOT (proficiency = '专家' AND source_count >= 30) AS op FROM pos),
o2 AS (SELECT *, row_number() OVER (PARTITION BY position_name, op ORDER BY weight, source_count, skill) AS k FROM o1),
cii AS (SELECT position_name, skill, weight, proficiency, op AND n > 7 AND k <= greatest(1, floor(n * 0.2::DOUBLE)) AS demoted, CASE WHEN op AND n > 7 AND k <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'nice' ELSE necessity END AS necessity FROM o2),
hit AS (SELECT candidate, position_name, count(*) AS hits, row_number() OVER (PARTITION BY candidate ORDER BY count(*) DESC, position_name) AS k FROM cand JOIN pos USING (skill) GROUP BY candidate, position_name)"""
_SCORE = _POS + f""", years AS (SELECT company AS candidate, date_diff('day', min(publish_date), max(publish_date)) / 365 AS total_years FROM jd GROUP BY ALL),
meta AS (SELECT position_name, median(id % 10) AS required, CASE WHEN date_diff('day', max(publish_date), DATE '{AS_OF}') > 365 THEN 0.85 WHEN date_diff('day', max(publish_date), DATE '{AS_OF}') > 180 THEN 0.95 ELSE 1.0 END AS stale FROM jd GROUP BY ALL),
w AS (SELECT hit.candidate, position_name, cii.skill, cii.necessity, cii.weight, coalesce(CASE WHEN low THEN 0.5 WHEN NOT low THEN 1.0 END, 0)::DOUBLE AS sim FROM hit JOIN cii USING (position_name) LEFT JOIN cand ON cand.candidate = hit.candidate AND cand.skill = cii.skill),
w2 AS (SELECT candidate, position_name, coalesce(sum(CASE WHEN necessity = 'must' THEN CASE WHEN sim > 0 THEN sim ELSE 0 END END) / nullif(count_if(necessity = 'must'), 0), 1) AS must_score, coalesce(sum(sim * weight) FILTER (necessity = 'nice') / nullif(sum(weight) FILTER (necessity = 'nice'), 0), 1) AS nice_score, count_if(necessity = 'must') AS musts, coalesce(string_agg(skill, ',' ORDER BY skill) FILTER (necessity = 'must' AND sim = 0), '') AS missing FROM w GROUP BY ALL),
w3 AS (SELECT *, CASE WHEN coalesce(required, 0) <= 0 THEN 1.0::DOUBLE ELSE least(total_years / required, 1.0) END AS exp_score, musts > 0 AND must_score = 0 AS unqualified FROM w2 LEFT JOIN years USING (candidate) LEFT JOIN meta USING (position_name)),
sc AS (SELECT *, CASE WHEN unqualified THEN 0 ELSE (must_score * 0.673 + nice_score * 0.129 + exp_score * 0.198) * stale END AS total_score FROM w3)"""
_GAP = _POS + """, g AS (SELECT hit.candidate, pos.*, CASE WHEN cand.skill IS NULL THEN 'missing' WHEN cand.proficiency < CASE pos.proficiency WHEN '初级' THEN 1 WHEN '中级' THEN 2 ELSE 3 END THEN 'weak' ELSE 'matched' END AS gap FROM hit JOIN pos USING (position_name) LEFT JOIN cand ON cand.candidate = hit.candidate AND cand.skill = pos.skill WHERE k <= 1)"""
_VEC = "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_LAB = "WITH l AS (SELECT labels.*, length(text) AS n FROM labels JOIN documents USING (doc_id))"
_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]{2,}')"

ORACLES = {
    "panorama": _FREQ + _PAN.format(n=10) + " SELECT position_name, skill, weight, freq FROM requires JOIN top USING (position_name)",
    "techstack": _FREQ + _TECH.format(n=5, where="true") + " SELECT position_name, skill, degree FROM requires JOIN ts USING (skill)",
    "graph_view": _FREQ + _PAN.format(n=3) + _TECH.format(n=3, where="true") + " SELECT position_name, skill FROM requires WHERE position_name IN (SELECT position_name FROM top) OR skill IN (SELECT skill FROM ts)",
    "expand_edges": _REQ[:-2] + " SELECT position_name, skill, weight FROM requires WHERE weight >= 2 AND position_name LIKE 'BUILDING%'",
    "reverse_skill": _REQ[:-2] + " SELECT position_name, weight FROM requires WHERE skill = 'Brand#11'",
    "evidence_refs": _EV + ", one AS (SELECT skill, source, min(ref) AS ref FROM evidence GROUP BY ALL), few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY source) AS k FROM one) WHERE k <= 3), n AS (SELECT skill, count(*) AS n FROM few GROUP BY ALL), b AS (SELECT position_name, skill, n, coalesce(sum(n) OVER (PARTITION BY position_name ORDER BY weight DESC, skill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM requires JOIN n USING (skill)) SELECT position_name, skill, source, ref, round(least(n / 8, 1.0), 6) AS confidence FROM b JOIN few USING (skill) WHERE before < 20",
    "skill_detail": _EV + ", p AS (SELECT skill, count(DISTINCT position_name) AS positions FROM requires GROUP BY ALL), e AS (SELECT skill, count(DISTINCT ref) AS evidence FROM evidence GROUP BY ALL) SELECT skill, positions, evidence FROM p JOIN e USING (skill)",
    "cooccurrence": _CO + " SELECT * FROM pairs",
    "degrees": _REQ[:-2] + " SELECT position_name AS id, count(*) AS out_degree, CAST(0 AS BIGINT) AS in_degree FROM requires GROUP BY ALL UNION ALL SELECT skill, 0, count(*) FROM requires GROUP BY ALL",
    "filtered_skills": _REQ + "r AS (SELECT *, count(*) OVER (PARTITION BY skill) AS d FROM requires) SELECT position_name, skill, weight FROM r WHERE skill <> 'Brand#12' AND (skill = 'Brand#13' OR d >= 3)",
    "merge_vertices": _REQ + "m AS (SELECT *, min(position_name) OVER (PARTITION BY split_part(position_name, '/', 1)) AS main FROM requires), k AS (SELECT *, row_number() OVER (PARTITION BY main, skill ORDER BY CASE WHEN position_name = main THEN 0 ELSE 1 END, position_name) AS rn FROM m) SELECT main AS position_name, skill, weight FROM k WHERE rn = 1",
    "relation_edges": "WITH e AS (SELECT p_brand AS src, 'Brand#' || (p_partkey % 60) AS dst FROM part), v AS (SELECT DISTINCT p_brand AS id FROM part), k AS (SELECT * FROM e WHERE src IN (FROM v) AND dst IN (FROM v)) SELECT src, dst FROM k UNION SELECT dst, src FROM k",
    "snapshot_diff": _NODE + ", a AS (FROM node WHERE version = '2000-01'), b AS (FROM node WHERE version = '2000-06') SELECT coalesce(b.id, a.id) AS id, coalesce(b.name, a.name) AS name, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.type <> b.type THEN 'changed' ELSE 'common' END AS state FROM a FULL JOIN b ON a.id = b.id",
    "edge_diff": with_views("snapshots") + "a AS (SELECT source, target FROM snapshots WHERE version = '2000-01'), b AS (SELECT source, target FROM snapshots WHERE version = '2000-06') SELECT *, 'added' AS state FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)",
    "version_counters": _NODE + ", ver AS (SELECT version, lag(version) OVER (ORDER BY version) AS old FROM (SELECT DISTINCT version FROM node)), a AS (SELECT version, count_if(o.id IS NULL) AS added, count_if(o.type <> node.type) AS changed, count(o.id) AS both_, any_value(old) AS old FROM node JOIN ver USING (version) LEFT JOIN node o ON o.version = ver.old AND o.id = node.id GROUP BY version), n AS (SELECT version, count(*) AS n FROM node GROUP BY ALL) SELECT a.version, CAST(added AS BIGINT) AS added, CAST(coalesce(n.n, 0) - both_ AS BIGINT) AS removed, CAST(coalesce(changed, 0) AS BIGINT) AS changed FROM a LEFT JOIN n ON n.version = a.old",
    "type_counts": _NODE + " SELECT version, type, count(*) AS n FROM node GROUP BY ALL",
    "retained_versions": _NODE + " SELECT version, count(*) AS n FROM node WHERE version >= '2001-01' GROUP BY ALL",
    "edit_diff": with_views("jd", "jd_skill") + "x AS (SELECT position_name, skill, max(necessity) AS o FROM jd_skill WHERE publish_date < DATE '2000-01-01' GROUP BY ALL), y AS (SELECT position_name, skill, max(necessity) AS n FROM jd_skill WHERE publish_date >= DATE '2000-01-01' GROUP BY ALL), d AS (SELECT position_name, CASE WHEN o IS NULL THEN '+' WHEN n IS NULL THEN '-' WHEN o <> n THEN '~' END || skill AS m FROM x FULL JOIN y USING (position_name, skill)) SELECT position_name, coalesce(string_agg(m, ',' ORDER BY m), '') AS diff FROM d GROUP BY ALL",
    "evolved_from": "WITH bg AS (SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS n FROM part), sm AS (SELECT DISTINCT p_name AS o FROM part), x AS (SELECT n FROM bg WHERE n NOT IN (FROM sm)), y AS (SELECT o FROM sm WHERE o NOT IN (FROM bg)), g AS (SELECT n, o, len(list_intersect(list_distinct([n[i:i+1] for i in range(1, length(n))]), list_distinct([o[i:i+1] for i in range(1, length(o))]))) AS s FROM x, y) SELECT n AS new, o AS old, CAST(s AS BIGINT) AS shared, CASE WHEN (contains(n, o) OR contains(o, n)) AND abs(length(n) - length(o)) >= 2 THEN 'rename' ELSE 'split' END AS relation FROM g WHERE s >= 4 OR ((contains(n, o) OR contains(o, n)) AND abs(length(n) - length(o)) >= 2)",
    "pagerank": _RANKS + " SELECT id, round(rank, 4) AS rank FROM r50",
    "louvain": "WITH b AS (SELECT DISTINCT p_brand AS id, CAST(substr(p_brand, 7) AS INT) % 5 AS r FROM part), c AS (SELECT count(*) AS size, min(id) AS low, string_agg(id, ',' ORDER BY id) AS members FROM b GROUP BY r) SELECT CAST(row_number() OVER (ORDER BY low) - 1 AS BIGINT) AS community, size, members FROM c",
    "modularity": _MOD + " SELECT round(coalesce(sum(inside / m - (tot / m) ** 2), 0), 6) AS q FROM per, (SELECT sum(weight) AS m FROM adj)",
    "shortest_path": _PATH + " SELECT array_to_string(min(path), '>') AS path FROM w WHERE id = 'p39' AND hops = (SELECT min(hops) FROM w WHERE id = 'p39') HAVING count(*) > 0",
    "prereq_chain": _PRE + " SELECT DISTINCT src, dst FROM c WHERE src <> dst",
    "prereq_order": "WITH RECURSIVE c(k, chain) AS (SELECT 0, '' UNION ALL SELECT n_nationkey, CASE WHEN chain = '' THEN '' ELSE chain || ',' END || 's' || c.k FROM c JOIN nation ON n_nationkey > 0 AND CAST(floor(n_nationkey / 2) AS INT) = c.k) SELECT 's' || k AS skill, chain FROM c WHERE k > 0",
    "cii": _POS + " SELECT position_name, skill, necessity, demoted FROM cii",
    "rough_select": _POS + " SELECT candidate, position_name, hits FROM hit WHERE k <= 5",
    "match_scores": _SCORE + " SELECT candidate, position_name, round(must_score, 6) AS must_score, round(nice_score, 6) AS nice_score, round(exp_score, 6) AS exp_score, round(total_score, 6) AS total_score, unqualified FROM sc",
    "match_topn": _SCORE + ", t AS (SELECT candidate, row_number() OVER (PARTITION BY candidate ORDER BY total_score DESC, position_name) AS rank, position_name, missing FROM sc WHERE NOT unqualified) SELECT * FROM t WHERE rank <= 2",
    "gaps": _GAP + " SELECT candidate, position_name, skill, gap, CASE WHEN gap = 'missing' THEN CASE WHEN necessity = 'must' THEN 'high' ELSE 'medium' END WHEN gap = 'weak' THEN CASE WHEN necessity = 'must' THEN 'medium' ELSE 'low' END ELSE 'low' END AS priority FROM g",
    "learning_hours": _GAP + ", l AS (SELECT *, row_number() OVER (PARTITION BY candidate, position_name ORDER BY weight DESC, CASE WHEN gap = 'missing' THEN 0 ELSE 1 END, skill) AS k FROM g WHERE gap <> 'matched') SELECT candidate, position_name, round(sum(CASE skill WHEN 'Brand#11' THEN 80.0::DOUBLE WHEN 'Brand#22' THEN 12.5::DOUBLE ELSE 30.0::DOUBLE END), 1) AS hours, count(*) AS skills FROM l WHERE k <= 5 GROUP BY ALL",
    "course_ranking": "SELECT * FROM (SELECT p_brand AS skill, p_partkey AS course, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_retailprice > 1000 THEN p_retailprice END DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "staleness": with_views("jd")[:-2] + f" SELECT id, CAST(CASE WHEN date_diff('day', publish_date, DATE '{AS_OF}') > 365 THEN 0.85 WHEN date_diff('day', publish_date, DATE '{AS_OF}') > 180 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS penalty FROM jd",
    "knn": _VEC + ", p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS score FROM v x, v y WHERE x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM p WHERE score >= 0.25) SELECT a, b, round(score, 6) AS score FROM r WHERE k <= 5",
    "nn_align": _VEC + ", p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS score FROM v x, v y WHERE x.id <> y.id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM p WHERE score >= 0.2) SELECT a, b, round(score, 6) AS score FROM r WHERE k = 1",
    "verified_pairs": _VEC + " SELECT x.id AS a, x.id + 1 AS b FROM v x LEFT JOIN v y ON y.id = x.id + 1 WHERE y.id IS NULL OR list_cosine_similarity(x.e, y.e) >= 0.1",
    "hit_merge": "SELECT user_id AS code, max(value) AS score FROM events GROUP BY ALL ORDER BY score DESC, code LIMIT 10",
    "keyword_hits": "SELECT p_partkey AS code, CAST(CASE WHEN contains(lower(p_name), 'o') THEN 1.0 ELSE 0.5 END AS DOUBLE) AS score FROM part WHERE contains(lower(p_name), 'o') OR contains(lower(p_type), 'o')",
    "rag_budget": "WITH RECURSIVE d AS (SELECT source, doc_id, CAST(length(text) % 997 AS DOUBLE) AS score, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS i FROM d WHERE tokens <= 2000), r(source, doc_id, score, tokens, i, used, n, kept) AS (SELECT source, doc_id, score, tokens, i, tokens, CAST(1 AS BIGINT), true FROM o WHERE i = 1 UNION ALL SELECT o.source, o.doc_id, o.score, o.tokens, o.i, CASE WHEN r.used + o.tokens <= 2000 AND r.n < 5 THEN r.used + o.tokens ELSE r.used END, CASE WHEN r.used + o.tokens <= 2000 AND r.n < 5 THEN r.n + 1 ELSE r.n END, r.used + o.tokens <= 2000 AND r.n < 5 FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1) SELECT source, doc_id, score, tokens, CAST(n AS INT) AS rank FROM r WHERE kept",
    "normalize_clusters": "WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x JOIN v y ON y.id < x.id), l AS (SELECT a, b FROM p WHERE s >= 0.3), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), f AS (SELECT id FROM v WHERE id NOT IN (SELECT a FROM l)), c AS (SELECT id, coalesce(min(b), any_value(id)) AS c FROM v LEFT JOIN (SELECT a, b FROM r WHERE b IN (SELECT id FROM f)) q ON q.a = v.id GROUP BY id), t AS (SELECT c.c, avg(list_cosine_similarity(x.e, y.e)) AS m FROM c JOIN v x USING (id) JOIN v y ON y.id = c.c WHERE c.id <> c.c GROUP BY c.c) SELECT CAST(id AS VARCHAR) AS name, CAST(c.c AS VARCHAR) AS standard, round(coalesce(m, 1.0), 4) AS confidence FROM c LEFT JOIN t USING (c)",
    "labelled_pairs": with_views("jd", "jd_skill") + """x AS (SELECT DISTINCT id, skill FROM jd_skill), y AS (SELECT id, skill, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY md5(id || ':' || skill), skill) AS k FROM x),
s AS (SELECT id, list(skill) AS s, string_agg(skill, ',' ORDER BY skill) FILTER (k <= greatest(1, floor(n * 0.6::DOUBLE))) AS own, string_agg(skill, ',' ORDER BY skill) FILTER (k <= greatest(1, floor(n * 0.7::DOUBLE))) AS lent FROM y GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS at, count(*) OVER () AS m FROM s),
p AS (SELECT a.id, a.s, d, (a.at + d) % a.m AS to_ FROM r a, generate_series(1, 256) AS g(d) WHERE d < a.m),
q AS (SELECT p.id, b.id AS other, b.lent, row_number() OVER (PARTITION BY p.id ORDER BY d) AS k FROM p JOIN r b ON b.at = to_ WHERE len(list_intersect(p.s, b.s)) <= 1)
SELECT id AS position, NULL::BIGINT AS other, 1 AS label, own AS candidate_skills FROM r UNION ALL SELECT id, other, 0, lent FROM q WHERE k <= 2""",
    "seed_match": with_views("jd", "chinese") + "s(o, seed, t) AS (VALUES (1, 'goods', 'goods'), (1, 'goods', 'nation_1'), (2, 'house', 'house'), (3, 'build', 'building/nation_10 and more'), (4, '数据', '数据工程师'), (5, '云', '腾讯云计算产品工程师平台')) SELECT name, arg_min(seed, o) AS seed FROM chinese, s WHERE contains(lower(name), t) OR contains(t, lower(name)) GROUP BY ALL",
    "fulltext": f"WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'licensed')) AS f0, len(list_filter(t, lambda x: x = 'the')) AS f1 FROM d), n AS (SELECT count(*) AS n, avg(l) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM c), s AS (SELECT doc_id, ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS score FROM c, n) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0",
    "fulltext_index": f"WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'licensed')) AS f0, len(list_filter(t, lambda x: x = 'the')) AS f1 FROM d), n AS (SELECT count(*) AS n, avg(l) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM c), s AS (SELECT doc_id, ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS score FROM c, n) SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 10) DESC, CAST(doc_id AS VARCHAR) LIMIT 20",
    "fulltext_indexes": f"WITH t AS (SELECT 'part' AS index, CAST(p_partkey AS VARCHAR) AS key, p_name || ' ' || p_type || ' ' || replace(p_brand, '#', ' ') AS text FROM part UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), text FROM documents), d AS (SELECT index, key, {_TOKENS} AS t FROM t), c AS (SELECT index, key, len(t) AS l, len(list_filter(t, lambda x: x = 'building')) AS f0, len(list_filter(t, lambda x: x = 'ring')) AS f1 FROM d), n AS (SELECT index, count(*) AS n, avg(l) AS a, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM c GROUP BY index), s AS (SELECT index, key, ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) AS score FROM c JOIN n USING (index)), r AS (SELECT *, row_number() OVER (PARTITION BY index ORDER BY round(score, 10) DESC, key) AS k FROM s WHERE score > 0) SELECT index, key, round(score, 4) AS score FROM r WHERE k <= 5",
    "occupation_align": with_views("jd", "chinese") + "t AS (SELECT n_nationkey AS code, lower(n_name) AS t FROM nation UNION ALL SELECT n_nationkey, 'x' || lower(n_name) FROM nation UNION ALL SELECT n_nationkey, (['算法', '数据工程', '工程师'])[n_nationkey % 3 + 1] FROM nation) SELECT name, min(code) AS code, CAST(1.0 AS DOUBLE) AS confidence FROM chinese JOIN t ON contains(lower(name), t) AND length(t) >= 3 GROUP BY name",
    "f1": with_views("jd", "jd_skill") + "s AS (SELECT id, coalesce(list(DISTINCT lower(skill)) FILTER (necessity = 'must'), []) AS g, coalesce(list(DISTINCT lower(skill)) FILTER (weight > 20), []) AS p FROM jd_skill GROUP BY ALL), n AS (SELECT CAST(sum(len(list_intersect(p, g))) AS BIGINT) AS tp, CAST(sum(len(p) - len(list_intersect(p, g))) AS BIGINT) AS fp, CAST(sum(len(g) - len(list_intersect(p, g))) AS BIGINT) AS fn FROM s) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM n",
    "confusion": "SELECT quality AS gold, toxic AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
    "recall_fpr": _LAB + " SELECT round(count_if(n > 500 AND quality = 1) / count_if(quality = 1), 6) AS recall, round(count_if(n > 500 AND quality <> 1) / count_if(quality <> 1), 6) AS fpr FROM l",
    "grid": _LAB + ", g AS (SELECT t AS \"limit\", count_if(n > t AND quality = 1) / count_if(quality = 1) AS recall, count_if(n > t AND quality <> 1) / count_if(quality <> 1) AS fpr FROM l, (SELECT CAST(unnest([50, 200, 500, 1000, 2000]) AS BIGINT) AS t) GROUP BY t) SELECT \"limit\", round(recall, 6) AS recall, round(fpr, 6) AS fpr, row_number() OVER (ORDER BY CASE WHEN recall >= 0.8 THEN 0 ELSE 1 END, fpr, recall DESC, \"limit\") AS rank FROM g",
    "spearman": "WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS x, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS y FROM part) SELECT round(corr(x, y), 6) AS rho FROM r",
    "accuracy": _LAB + " SELECT round(avg(CASE WHEN (n / 2000 >= 0.5) = (quality = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM l",
    "top3": _SCORE + ", f AS (SELECT position_name, count(*) % 2 AS label FROM jd GROUP BY ALL), r AS (SELECT candidate, label, row_number() OVER (PARTITION BY candidate ORDER BY round(total_score, 6) DESC, position_name) AS rn FROM sc JOIN f USING (position_name)), e AS (SELECT candidate, count(*) AS n, max(label) AS a, max(label) FILTER (rn <= 3) AS h FROM r GROUP BY ALL) SELECT count(*) AS candidates, round(coalesce(avg(h), 0), 6) AS accuracy FROM e WHERE n >= 3 AND a = 1",
    "kappa": _LAB + ", s AS (SELECT avg(CASE WHEN (n / 2000 >= 0.5) = (quality = 1) THEN 1 ELSE 0 END) AS po, avg(CASE WHEN n / 2000 >= 0.5 THEN 1 ELSE 0 END) AS x, avg(quality) AS y FROM l) SELECT round((po - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 6) AS kappa FROM s",
    "stratified_sample": "WITH k AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY source, doc_id) AS k FROM documents) SELECT doc_id, lang, source FROM k ORDER BY CASE WHEN k <= 3 THEN 0 ELSE 1 END, source, doc_id LIMIT 120",
    "mli": "WITH s AS (SELECT user_id AS skill, CASE event_type WHEN 'click' THEN 'paper' WHEN 'purchase' THEN 'course' WHEN 'view' THEN 'community' ELSE 'jd' END AS class, printf('%d-W%02d', isoyear(ts), weekofyear(ts)) AS period, count(*) / 4 AS value FROM events GROUP BY ALL), l AS (SELECT skill, class, arg_max(value, period) AS v FROM s GROUP BY ALL), m AS (SELECT skill, sum(least(v / CASE class WHEN 'jd' THEN 0.5 ELSE 2.0 END, 1.0) * 0.25) AS mli FROM l GROUP BY ALL) SELECT skill, round(mli, 6) AS mli, mli > 0.6 AS ready FROM m",
    "state_transition": _Z7 + ", s AS (SELECT name, list(z ORDER BY version) AS z FROM z GROUP BY ALL), t AS (SELECT name, x, s.z, CASE name WHEN 'BUILDING' THEN 'declining' WHEN 'MACHINERY' THEN 'stable' ELSE 'emerging' END AS state FROM a JOIN s USING (name)) SELECT name, state, CASE WHEN state = 'emerging' AND coalesce((list_max(x[-2:]) - list_min(x[-2:])) / nullif(list_max(x[-2:]), 0), 0) < 0.25 THEN 'stable' WHEN state <> 'declining' AND coalesce((x[-3] - x[-1]) / nullif(x[-3], 0), 0) > 0.4 THEN 'declining' WHEN state = 'declining' AND z[-1] > 0 AND z[-2] > 0 THEN 'stable' END AS next_state FROM t",
}
