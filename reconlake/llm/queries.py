"""The queries of this subpackage's operators over whole tables, and the SQL that gives the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconlake.llm.filter_audit import filter_audit
from reconlake.llm.fingerprints import edited_fingerprints
from reconlake.llm.license_scan import scan_licenses
from reconlake.llm.mixing import mix_sources
from reconlake.llm.packing import pack_documents
from reconlake.llm.periodic_runs import find_runs, run_digests
from reconlake.llm.shared import table
from reconlake.llm.simhash import near_duplicates
from reconlake.llm.suffix_dedup import repeated_spans
from reconlake.llm.token_counts import count_tokens
from reconlake.llm.token_files import token_files
from reconlake.llm.topk import exact_top_k
from reconlake.llm.toxicity import score, train
from reconlake.llm.url_filter import judge_urls, rules_table

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "n_words", "weight", "epoch", "block", "block_order", "doc_order")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_table(spark, URL_RULES))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["past"] - x["start"])
    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(find_runs(table(spark, sf_dir, "documents"), planted=True))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = [op1_packing, op2_toxicity, op3_license_scans, op4_token_counts, op5_token_files, op6_exact_top_k, op7_document_fingerprints, op8_source_mixing, op9_simhash, op10_url_filters, op11_suffix_dedup, op12_periodic_runs, op13_filter_audit]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Whole-number inner products of all (query, candidate) pairs, ranked.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

URL_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT u.page_id, u.host, u.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC NULLS LAST) AS n
  FROM u LEFT JOIN rules r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""


#: Words by splitting; every order as a product of its steps' letters.
FILTER_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), w AS (
  SELECT *, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d
), f AS (
  SELECT doc_id, part,
    (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b,
    (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c,
    regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e
  FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), five AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), orders AS (
  SELECT [x1.i, x2.i, x3.i, x4.i, x5.i] AS o FROM five x1, five x2, five x3, five x4, five x5
  WHERE len(list_distinct([x1.i, x2.i, x3.i, x4.i, x5.i])) = 5
), s AS (
  SELECT list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order, five.i AS step, o[five.i] AS own, o[1 : five.i - 1] AS before FROM orders, five
), x AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] = 1 AS own_fails, len(list_filter(before, lambda y: fails[y] = 1)) > 0 AS gone, list_sum(fails) AS total FROM m, s
), r AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT own_fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own_fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (own_fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (own_fails AND total = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (own_fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own_fails AND NOT gone), 0) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    """The other queries need a tokenizer, a trained model or a hash that SQL lacks; brute force in the tests checks them."""
    return {"op6_exact_top_k": TOP_K_SQL, "op10_url_filters": URL_SQL, "op13_filter_audit": FILTER_SQL}
