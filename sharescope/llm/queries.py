"""One query for each operator, over the whole of its table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .circulant_minhash import near_duplicates
from .clustering import CENTROIDS, ROUNDS, clustering_digest
from .code_search import nearest
from .decontamination import contained
from .hard_negatives import mined
from .ngram_lm import scored
from .packing import packing_digest
from .simhash import simhash_digest
from .substring_dedup import removal_digest
from .token_counts import token_digest
from .toxicity import toxicity_digest
from .url_filter import judge
from .warc import archive_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


@registered(r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS p FROM texts WHERE len(w) >= 35),
windows AS (SELECT s.r, s.p, array_to_string(t.w[s.p : s.p + 34], ' ') AS k FROM starts s JOIN texts t USING (r)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM windows JOIN twice USING (k)),
lost AS (SELECT r, list(i) AS i FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(len(i), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN i IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(i, x)), lambda x: w[x]) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN lost USING (r)""")
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return removal_digest(table(spark, folder, "documents"))


@registered()
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_digest(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@registered()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing_digest(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered()
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_digest(table(spark, folder, "documents"))


@registered(r"""
WITH docs AS (SELECT doc_id, w, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0),
items AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, unnest(s) AS g FROM docs), i AS (SELECT item_id, len(s) AS n_shingles, unnest(s) AS g FROM items)
SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
FROM d JOIN i USING (g) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= n_shingles * 0.8 - 1e-9""")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


LISTED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@registered(r"""
WITH parts AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM urls JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN hits USING (page_id)""")
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    return judge(table(spark, folder, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


@registered(r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, upper(sha1(coalesce(html, ''))) AS x, regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS host,
  regexp_replace(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS rest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS m, row_number() OVER (ORDER BY array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || rest, page_id) AS place FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to, place
FROM k""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_digest(table(spark, folder, "pages"))


@registered(r"""
WITH c AS (SELECT DISTINCT vec_id, array_to_string(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance FROM c q, c WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10""")
def op10_code_search(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


@registered()
def op9_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"))


@registered(r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM docs),
rows AS MATERIALIZED (SELECT r, len(s) AS n, hash(list_sort(s)) AS k FROM sets WHERE len(s) > 0),
one AS MATERIALIZED (SELECT min(r) AS r, k, any_value(n) AS n FROM rows GROUP BY k),
grams AS MATERIALIZED (SELECT r, unnest(s) AS g FROM sets WHERE r IN (SELECT r FROM one)),
pairs AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r JOIN one x ON a.r = x.r JOIN one y ON b.r = y.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM one UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
found AS (SELECT x.r, min(d.doc_id) AS component_id FROM rows x JOIN one o ON x.k = o.k JOIN reach ON reach.a = o.r JOIN one t ON t.r = reach.b JOIN rows y ON y.k = t.k JOIN docs d ON d.r = y.r GROUP BY x.r)
SELECT doc_id, len(s) AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END AS component_id, coalesce(CASE WHEN len(s) = 0 THEN doc_id ELSE component_id END = doc_id, false) AS kept FROM sets LEFT JOIN found USING (r)""")
def op11_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def _rounds() -> str:
    """The rounds of op12 as common table expressions: assignment `a<i>` to centroids `c<i>`, and the centroids after it."""
    assign = """a{0} AS MATERIALIZED (SELECT r, min(d) AS d, arg_min(j, d * 64 + j) AS j FROM (
  SELECT r, j, (list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d FROM kept k, c{0} c) GROUP BY r)"""
    move = """c{1} AS MATERIALIZED (SELECT c.j, coalesce(n.v, c.v) AS v FROM c{0} c LEFT JOIN (SELECT j, list(m ORDER BY i) AS v FROM (
  SELECT j, i, floor(sum(v[i]) / count(*)) AS m FROM a{0} JOIN kept USING (r), range(1, 65) x(i) GROUP BY j, i) GROUP BY j) n USING (j))"""
    return ",\n".join([text.format(i, i + 1) for i in range(ROUNDS) for text in (assign, move)] + [assign.format(ROUNDS)])


@registered(f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v FROM kept ORDER BY sha256('3:' || vec_id) LIMIT {CENTROIDS}),
{_rounds()}
SELECT vec_id, j::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (r) JOIN c{ROUNDS} c USING (j)""")
def op12_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering_digest(table(spark, folder, "embeddings"))


@registered(r"""
WITH k AS MATERIALIZED (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM k a, k b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same),
f AS (SELECT p.a, p.b AS pb, s.b AS nb, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE n <= 5)
SELECT a AS anchor_id, pb AS positive_id, rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM f WHERE rank <= 10""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return mined(table(spark, folder, "embeddings"))
