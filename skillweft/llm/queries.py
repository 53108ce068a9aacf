"""The queries of this subpackage, their SQL and what they are applied to."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.llm import decontaminate, exactdup, idfile, jaccard, langid, lattice, licences, merkle, packing, rollups, sharding, vectors
from skillweft.llm import html as html_
from skillweft.llm.common import small, staged, workspace


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document: 5-word n-grams, Jaccard 0.8 or more."""
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"), workspace(spark, "op1"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place in every document where one of ``licences.TEMPLATES`` is covered to 0.8 or more.

    These are short notices, the standard headers of GPL, LGPL, AGPL, Apache and MPL, and the whole texts of MIT, ISC and BSD. Other
    licences (EPL, CC0) and the long texts of Apache, GPL and MPL are not among them.
    """
    return licences.licence_scan(_read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 ids."""
    _, placed = packing.pack(_read(spark, sf_dir, "documents"), workspace(spark, "op3"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(langid.taught(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version after five batches, one of them sent twice.

    All documents are added; the end id revises every count; of equal texts (by their SHA-256; null ones
    are none) all but the smallest id are deleted; then the first batch is sent again.
    """
    work = workspace(spark, "op5")
    docs = staged(rollups.counted(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), f"{work}/counted")
    rollup, version = rollups.Rollup(spark, f"{work}/rollup"), "byte_bpe_50k"
    first = staged(docs.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), f"{work}/first")
    copies = docs.join(small(first), "digest").where("doc_id > first").withColumn("tokens", F.col("tokens") + 1)
    rollup.commit("insert", rollups.changes(docs, version, 1))
    rollup.commit("end-id", rollups.changes(docs, version, 0, F.lit(1)))
    rollup.commit("copies", rollups.changes(copies, version, -1))
    rollup.commit("insert", rollups.changes(docs, version, 1))
    return rollup.totals()


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95 or more."""
    return vectors.near_vectors(_read(spark, sf_dir, "embeddings"), workspace(spark, "op6"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes that keep equal texts together."""
    rows = sharding.shard(_read(spark, sf_dir, "documents"), workspace(spark, "op7"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = html_.main_text(_read(spark, sf_dir, "pages"), workspace(spark, "op8"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from bit-packed files."""
    parts = idfile.write_ids(_read(spark, sf_dir, "documents"), workspace(spark, "op9"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return idfile.read_ids(spark, parts).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 10-word windows of benchmark items."""
    return decontaminate.report(decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), workspace(spark, "op10")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at every step of all their 120 orders, by source."""
    return lattice.filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), workspace(spark, "op11"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that a tampered fifth of them would give."""
    return merkle.manifest(merkle.document_leaves(_read(spark, sf_dir, "documents")), workspace(spark, "op12"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the largest id of its text's rows, from a stream over the table."""
    return exactdup.exact_dedup(spark, f"{sf_dir}/documents.parquet", "op13")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard, op2_licence_scan, op3_packing, op4_language_id, op5_token_rollup, op6_near_vectors, op7_sharding, op8_main_text, op9_token_files, op10_decontamination, op11_filter_audit, op12_merkle_manifest, op13_exact_dedup, pipeline)}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Copies of the windows and their occurrences in SQL; lower() is applied to A-Z only.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP10_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s, least(10, len(w)) AS n FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
place AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc, size, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT r, item, i, n FROM place JOIN win USING (s, n)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN items USING (r)
"""

#: A union of the links cannot be closed in plain SQL at scale, but small tables can: links, then the smallest reachable id.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

#: All pairs that share a word 5-gram, verified by integer arithmetic, and the smallest id that links reach.
OP1_SQL = f"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM documents),
gram AS (SELECT DISTINCT r, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM doc, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0 AND doc_id IS NOT NULL),
size AS (SELECT r, count(*) AS n FROM gram GROUP BY r),
common AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM gram x JOIN gram y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
pair AS (SELECT a, b FROM common JOIN size x ON x.r = a JOIN size y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(a, b) AS (SELECT r, r FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(doc_id) AS class_id FROM reach JOIN doc ON b = r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM doc JOIN low ON low.a = r LEFT JOIN n ON n.a = r
"""

#: The test tables' pages mark their article, and only a few character references occur in it.
OP8_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM b
"""

#: The filters are replayed in every order, document by document.
OP11_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
fails AS (SELECT doc_id, part,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS f FROM doc),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
kinds AS (SELECT part, f, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM fails LEFT JOIN known USING (doc_id) GROUP BY ALL),
steps AS (SELECT filter_order, k AS step, filter_order[k : k] AS letter, filter_order[1 : k - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
met AS (SELECT part, filter_order, step, letter, n, good, toxic, f = letter AS alone, contains(f, letter) AS hit, len(f) > len(translate(f, before, '')) AS gone FROM kinds, steps),
sums AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END) AS toxic_lost FROM met GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM sums
"""


def _enc(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR), '-')"


#: Both trees level by level, each row's siblings, and a fold of the tampered leaves. DuckDB has no crc32: it is worked out over bits, as the ids' decimals are short.
OP12_SQL = f"""
WITH RECURSIVE doc AS (SELECT doc_id, source, {_enc("doc_id")} || {_enc("source")} || {_enc("lang")} || {_enc("n_chars")} AS head, text, CAST(doc_id AS VARCHAR) AS id FROM documents),
leaf AS (SELECT doc_id, source, id, sha256(head || {_enc("text")}) AS leaf, sha256(head || {_enc(f"translate(text, '{_UPPER}', '{_LOWER}')")}) AS bad, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM doc),
crc(doc_id, id, k, c) AS (SELECT doc_id, id, 0, CAST(4294967295 AS BIGINT) FROM leaf UNION ALL
  SELECT doc_id, id, k + 1, list_reduce([xor(c, ord(id[k + 1 : k + 1]))] || [CAST(b AS BIGINT) FOR b IN range(8)], lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END) FROM crc WHERE k < len(id)),
tampered AS (SELECT doc_id FROM crc WHERE k = len(id) AND xor(c, CAST(4294967295 AS BIGINT)) % 5 = 0),
tree(source, level, i, n, h) AS (SELECT source, 0, i, n, leaf FROM leaf UNION ALL
  SELECT source, level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 16),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM tree WHERE n = 1),
top(level, i, n, h) AS (SELECT 0, rank, n, subroot FROM sub UNION ALL
  SELECT level + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 16),
nodes AS (SELECT source, level, i, n, h FROM tree WHERE n > 1 UNION ALL SELECT source, 100 + level, top.i, top.n, h FROM top, (SELECT DISTINCT source FROM sub) WHERE top.n > 1),
path AS (SELECT l.doc_id, nodes.level, nodes.i, nodes.h, nodes.i = place AS mine FROM
  (SELECT leaf.doc_id, leaf.source, g.level, CASE WHEN g.level < 100 THEN leaf.i // CAST(power(16, g.level) AS BIGINT) ELSE sub.rank // CAST(power(16, g.level - 100) AS BIGINT) END AS place
     FROM leaf JOIN sub ON leaf.source IS NOT DISTINCT FROM sub.source JOIN (SELECT DISTINCT source, level FROM nodes) g ON leaf.source IS NOT DISTINCT FROM g.source) l
  JOIN nodes ON nodes.source IS NOT DISTINCT FROM l.source AND nodes.level = l.level AND nodes.i // 16 = place // 16),
steps AS (SELECT doc_id, level, dense_rank() OVER (PARTITION BY doc_id ORDER BY level) AS s, i, h, mine FROM path),
run AS (SELECT doc_id, s, coalesce(string_agg(CASE WHEN i < m THEN h END, '' ORDER BY i), '') AS pre, coalesce(string_agg(CASE WHEN i > m THEN h END, '' ORDER BY i), '') AS post FROM (SELECT *, max(CASE WHEN mine THEN i END) OVER (PARTITION BY doc_id, s) AS m FROM steps) GROUP BY doc_id, s),
proof AS (SELECT doc_id, sha256(string_agg(pre || post, '' ORDER BY s)) AS proof, max(s) AS last FROM run GROUP BY doc_id),
folded(doc_id, s, h) AS (SELECT doc_id, 0, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN bad ELSE leaf END FROM leaf UNION ALL
  SELECT f.doc_id, f.s + 1, sha256(pre || f.h || post) FROM folded f JOIN run ON run.doc_id = f.doc_id AND run.s = f.s + 1)
SELECT l.doc_id, l.leaf, sub.subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaf l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source CROSS JOIN (SELECT h FROM top WHERE n = 1) r LEFT JOIN proof ON proof.doc_id = l.doc_id JOIN folded f ON f.doc_id = l.doc_id AND f.s = coalesce(proof.last, 0)
"""

OP13_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLES: dict[str, str] = {"op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_exact_dedup": OP13_SQL, "op1_ngram_jaccard": OP1_SQL, "op6_near_vectors": OP6_SQL, "op8_main_text": OP8_SQL, "op10_decontamination": OP10_SQL}
