"""A training corpus from documents: quality rules, line dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of
documents; none reads anything but its input.

Nulls: a null text has no words and goes with the quality rules; a null source or lang is one of
its own; a null doc_id links with nothing and stays. Empty texts go, very long ones are judged whole,
an empty table gives an empty result. Rows that share an id share their fate. Extra columns
stay until the packing, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import free_names, removed, table, written
from lodestrata.llm.line_dedup import line_dedup
from lodestrata.llm.mixing import mix
from lodestrata.llm.near_dedup import near_dedup
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import quality


def having(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id ``kept`` has; a null id is an id like others."""
    (name,) = free_names(docs.columns, "kept_id")
    return docs.join(kept.select(F.col("doc_id").alias(name)), F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows that share an id go if all of them are rejected."""
    return having(docs, quality(docs).where("kept"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document that this leaves without words goes."""
    rows, text, n_removed = line_dedup(docs)
    new, n = free_names(rows.columns, "new_text", "n_removed")
    out = rows.withColumn(new, text).withColumn(n, n_removed)
    out = out.where((F.col(n) == 0) | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    count = F.when(F.col(n) == 0, F.col("n_chars")).otherwise(F.length(new)).cast("long")
    return out.withColumns({"text": F.col(new), "n_chars": count}).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return having(docs, near_dedup(docs).where("kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus; a document drawn more than once stands there as often."""
    return mix(docs).select(docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, dealt to sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", near_duplicates),
    ("source mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Perplexities, sketches and dynamic programs are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before is not None:
            removed(before)  # the stage after it has been written
        before = docs
    return docs
