"""Registered queries of this subpackage: thin calls that derive the result
columns of the contracts from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


@register("op1_simhash")
def op1_simhash(spark, sf_dir):
    from wardline.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents")).drop("fingerprint_bits")


@register("op3_packing")
def op3_packing(spark, sf_dir):
    from wardline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@register("op6_token_files")
def op6_token_files(spark, sf_dir):
    from wardline.llm.token_files import read_token_files, write_token_files

    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents")))


@register("op8_mixing", """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS nth, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w,
                  2.0::DOUBLE * source_size AS cap FROM src),
lvl AS (SELECT first(level ORDER BY ratio, nth) AS level FROM (
  SELECT cap / w AS ratio, nth,
         (1.5 * (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER before, 0))
         / ((SELECT sum(w) FROM ranked) - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE level <= ratio),
tgt AS (SELECT source, source_size, least(cap, level * w) AS target FROM ranked, lvl),
run AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS whole,
               floor(t.target) - floor(t.target / nullif(t.source_size, 0)) * t.source_size
               - coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
        FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(coalesce(whole, 0) * size + greatest(0, least(size, coalesce(room, 0))) AS BIGINT) AS taken FROM run
""")
def op8_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from wardline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source").withColumn("target", F.round("target", 6))


@register("op2_language")
def op2_language(spark, sf_dir):
    from wardline.llm import langid

    docs = table(spark, sf_dir, "documents")
    held_out = (langid.remainder("doc_id", 4) == 2).alias("held_out")
    return langid.predict(docs.select("doc_id", held_out, "text"), langid.learn(docs)).drop("text")


@register("op4_context_mixing")
def op4_context_mixing(spark, sf_dir):
    from wardline.llm.context_mixing import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@register("op5_topk", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5_topk(spark, sf_dir):
    from wardline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@register("op7_near_duplicates", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(a) >= 5 THEN list_slice(a, i, i + 4) ELSE a END AS g
      FROM w, unnest(range(1, greatest(len(a) - 3, 2))) t(i) WHERE len(a) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
""")
def op7_near_duplicates(spark, sf_dir):
    from wardline.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@register("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n >= 1000) ELSE page_id END AS keeper FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to FROM k
""")
def op9_warc(spark, sf_dir):
    from wardline.llm.warc import normalise_archives, read_archives, write_archives

    archives = normalise_archives(spark, write_archives(table(spark, sf_dir, "pages")))
    return read_archives(spark, archives).drop("offset", "length")


@register("op10_personal_data")
def op10_personal_data(spark, sf_dir):
    from wardline.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


@register("op12_whitening")
def op12_whitening(spark, sf_dir):
    from wardline.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@register("op13_ranked_search", """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS a FROM documents),
stat AS (SELECT CAST(count(*) FILTER (WHERE len(a) > 0) AS BIGINT) AS n_docs, CAST(sum(len(a)) AS BIGINT) AS n_terms FROM words),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(a) AS term FROM words) GROUP BY r, term),
asked AS (
  SELECT q, item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY q, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, stat
      WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * CAST(len(a) AS BIGINT) * n_docs) // n_terms) AS m FROM words, stat WHERE len(a) > 0),
scored AS (SELECT q, item_id, m.r, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m.m))) AS BIGINT) AS score
           FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY q, item_id, m.r, m.doc_id),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 20
""")
def op13_ranked_search(spark, sf_dir):
    from wardline.llm.ranked_search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_quality")
def op11_quality(spark, sf_dir):
    from wardline.llm import quality
    from wardline.llm.langid import remainder

    docs = table(spark, sf_dir, "documents")
    net = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text"), net).drop("text")
