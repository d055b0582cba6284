"""The queries opN_<name> of the ten operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import table
from lodestrata.llm.html_extract import extract
from lodestrata.llm.line_dedup import line_dedup
from lodestrata.llm.mixing import mixing_digest
from lodestrata.llm.near_dedup import Near, near_dedup
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import quality
from lodestrata.llm.suffix_dedup import suffix_dedup
from lodestrata.llm.topk import integer_vectors, top_k
from lodestrata.llm.toxicity import toxicity
from lodestrata.llm.url_filter import filter_urls


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, text, n_removed = line_dedup(docs)
    kept = F.coalesce(text, F.lit(""))
    return rows.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        n_removed.cast("long").alias("n_removed"),
        F.md5(kept.cast("binary")).alias("kept_md5"),
    )


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), integer_vectors(F.col("embedding"), 64.0).alias("v"))
    return top_k(rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()), F.col("id") % 20 == 0)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), how=Near(words=4))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_digest(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels reach a url through the number that ends its path, the id of the document that the page shows."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    doc = F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)[^/]*$', 1) AS BIGINT)")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False)).alias("blocked")
    labelled = pages.select("url", doc.alias("doc_id")).join(labels.select("doc_id", bad), "doc_id").select("url", "blocked")
    return filter_urls(pages, labelled)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_topk, op3_near_dedup, op4_packing, op5_suffix_dedup, op6_source_mixing, op7_toxicity, op8_quality_rules, op9_url_filter, op10_html_extract)}

ORACLES = {
    "op2_exact_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op1_line_dedup": r"""
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, i - 1 AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), k AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM l),
b AS (
  SELECT key, min(struct_pack(d := doc_id, p := pos)) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT site) >= 10
), r AS (
  SELECT k.*, b.key IS NOT NULL AND NOT (k.doc_id = b.first.d AND k.pos = b.first.p) AS gone FROM k LEFT JOIN b ON k.key = b.key
), t AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
         md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_lines, 0) AS n_lines, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN t USING (doc_id)
""",
}
