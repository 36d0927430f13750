"""The queries of this subpackage: one per operator, on its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.minhash_dedup import minhash_dedup

    return minhash_dedup(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.language_id import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvid.llm.packing import VOCABULARY, pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvid.llm.token_counts import VOCABULARY, token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.pivot_index import pivot_dedup

    return pivot_dedup(table(spark, sf_dir, "embeddings"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.conversation_repair import damaged, repair, told

    rows = told(table(spark, sf_dir, "conversations"))
    return repair(damaged(rows), rows.select("cid", "conv_id"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvid.llm.source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_decontamination,
        op3_html_extraction,
        op4_language_id,
        op5_suffix_dedup,
        op6_packing,
        op7_pivot_dedup,
        op8_minhash_dedup,
        op9_token_counts,
        op10_toxicity,
        op11_quality,
        op12_conversation_repair,
        op13_source_divergence,
        pipeline,
    )
}

#: Twins in DuckDB's SQL, for the operators whose whole contract SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS lo FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM p JOIN f USING (g) WHERE doc_id > lo),
x AS (SELECT w.doc_id, u.i, u.word FROM w, unnest(ws) WITH ORDINALITY AS u(word, i)),
k AS (SELECT x.doc_id, count(c.i) AS n_removed, string_agg(x.word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op7_pivot_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON m.a = v.vec_id""",
    "op8_minhash_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 75 * (x.n + y.n - i.n)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT w.doc_id, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id FROM w LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id""",
    "op12_conversation_repair": r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i))),
o AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS cid, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT o.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, tab),
d AS (SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
n AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(role) OVER (PARTITION BY cid ORDER BY i) AS before FROM n),
g AS (SELECT cid, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || c NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY cid),
w AS (SELECT cid, 0::BIGINT AS i, {'c': 0, 'a': '', 'r': ''} AS p0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS p1, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS p2, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR) AS p3 FROM g
  UNION ALL
  SELECT cid, i, {'c': p0.c + 2, 'a': p0.a || 'D', 'r': p0.r},
    least(CASE WHEN p1 IS NOT NULL THEN {'c': p1.c + 2, 'a': p1.a || 'D', 'r': p1.r} END, CASE WHEN NOT must AND c = 's' THEN {'c': p0.c + late, 'a': p0.a || 'K', 'r': p0.r || chr(10) || line} END),
    least(CASE WHEN p2 IS NOT NULL THEN {'c': p2.c + 2, 'a': p2.a || 'D', 'r': p2.r} END, CASE WHEN NOT must THEN {'c': q.c + late + 1, 'a': q.a || 'R', 'r': q.r || chr(10) || 'user:' || text} END, CASE WHEN NOT must AND p2 IS NOT NULL THEN {'c': p2.c + late + 6, 'a': p2.a || 'IR', 'r': p2.r || chr(10) || 'assistant:' || chr(10) || 'user:' || text} END,
      CASE WHEN NOT must AND c = 'u' THEN {'c': q.c + late, 'a': q.a || 'K', 'r': q.r || chr(10) || line} END, CASE WHEN NOT must AND c = 'u' AND p2 IS NOT NULL THEN {'c': p2.c + late + 5, 'a': p2.a || 'IK', 'r': p2.r || chr(10) || 'assistant:' || chr(10) || line} END),
    least(CASE WHEN p3 IS NOT NULL THEN {'c': p3.c + 2, 'a': p3.a || 'D', 'r': p3.r} END, CASE WHEN NOT must AND p2 IS NOT NULL THEN {'c': p2.c + late + 1, 'a': p2.a || 'R', 'r': p2.r || chr(10) || 'assistant:' || text} END, CASE WHEN NOT must THEN {'c': q.c + late + 6, 'a': q.a || 'IR', 'r': q.r || chr(10) || 'user:' || chr(10) || 'assistant:' || text} END,
      CASE WHEN NOT must AND c = 'a' AND p2 IS NOT NULL THEN {'c': p2.c + late, 'a': p2.a || 'K', 'r': p2.r || chr(10) || line} END, CASE WHEN NOT must AND c = 'a' THEN {'c': q.c + late + 5, 'a': q.a || 'IK', 'r': q.r || chr(10) || 'user:' || chr(10) || line} END)
  FROM (SELECT w.cid, f.i, p0, p1, p2, p3, least(p0, p1, p3) AS q, f.c, f.text, role || ':' || f.text AS line, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM w JOIN f ON f.cid = w.cid AND f.i = w.i + 1)),
e AS (SELECT cid, least(p0, p3, CASE WHEN p2 IS NOT NULL THEN {'c': p2.c + 5, 'a': p2.a || 'I', 'r': p2.r || chr(10) || 'assistant:'} END, CASE WHEN p1 IS NOT NULL THEN {'c': p1.c + 10, 'a': p1.a || 'II', 'r': p1.r || chr(10) || 'user:' || chr(10) || 'assistant:'} END) AS x FROM w JOIN g USING (cid) WHERE w.i = g.n)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM o) a LEFT JOIN g ON g.cid = a.cid LEFT JOIN e ON e.cid = a.cid""",
    "op13_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM (SELECT lang, source, k, unnest(ws) AS term FROM d) GROUP BY ALL),
t AS (SELECT lang, term, sum(n)::BIGINT AS n FROM w GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM t GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(sum(w.n), 0)::BIGINT AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT w.* FROM w SEMI JOIN t USING (lang, term)) w ON w.lang = s.lang AND w.source = s.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, t.term, coalesce(w.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(w.n, 0) + 1) // (g.n + v.v)) AS p, 1 + (1000000000::HUGEINT * (t.n + 1) // (v.n + v.v)) AS q
  FROM g JOIN v USING (lang) JOIN t USING (lang) LEFT JOIN w ON w.lang = g.lang AND w.source = g.source AND w.term = t.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM v))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 200""",
}
