"""URL filters: fixed host and path rules first, mined association rules for the rest.

Transactions are the token sets of labelled urls, with the token ``block`` where
the label says so. FP-growth mines their frequent sets; rules that end in
``block`` and pass confidence and support are kept, without those that say no
more than the share of blocked urls (lift 1, unless all are blocked) and those that a
shorter kept rule implies. Matching goes through an inverted index: each
rule hangs on its rarest token, distinct urls meet only the rules of tokens that they have,
and a rule fires when all its tokens are there. The index and what fires are written tables of known size:
where they are small, Spark sends them to the urls, and no common token or url gathers rows in one task; else
it joins by key and may split the partition of a common one.

Null url, url without ``://``: host and path are empty, no rule fits, no token
exists, the verdict is allow. Very long urls are read whole. Repeated rows are judged row by row, a null page_id like any
other. An empty or unlabelled table mines no rule. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ascii_lower, removed, written

#: Fixed values of the contract: verdict, host, path.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
BLOCK = "label=block"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Mining:
    """min_support bounds the rules: a set counts if that share of labelled urls has it."""

    min_support: float = 0.005
    min_confidence: float = 0.6


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def fixed_rule(h: Column, p: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string") if not rules else None
    for v, rh, rp in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((h == rh) | h.endswith(f".{rh}")) & p.startswith(rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: host suffixes, path segments with digits folded, extension, query keys, fragment, scheme."""
    u = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    suffixes = F.transform(labels, lambda x, i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    segments = F.transform(
        F.filter(F.split(path(url), "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, r"\d+", "0")),
    )
    keys = F.transform(F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    more = F.filter(
        F.array(
            F.when(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1) != "", F.concat(F.lit("scheme="), F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            F.when(F.regexp_extract(u, r"#(.+)$", 1) != "", F.lit("fragment")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(u.contains("://"), F.array_distinct(F.concat(suffixes, segments, keys, more))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Rules (rule_id, antecedent, confidence, support) from rows (tokens, blocked)."""
    items = labelled.where(F.size("tokens") > 0).select(
        F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=how.min_support, minConfidence=how.min_confidence).fit(items)
    rules = (
        model.associationRules.where(F.array_contains("consequent", BLOCK) & ((F.col("lift") > 1 + 1e-9) | (F.col("confidence") >= 1)))
        .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
        .dropDuplicates(["antecedent"])
        .withColumn("rule_id", F.array_join("antecedent", " & "))
    )
    # Drop what a shorter rule already fires on; subsets share a token, which keys the join.
    short, key = rules.select(F.col("rule_id").alias("s_id"), F.col("antecedent").alias("s")), "k"
    implied = (
        rules.withColumn(key, F.explode("antecedent"))
        .join(short.withColumn(key, F.col("s")[0]), key)
        .where((F.size("s") < F.size("antecedent")) & (F.size(F.array_except("s", "antecedent")) == 0))
        .select("rule_id").distinct()
    )
    return rules.join(implied, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, n_rules, best_confidence) of urls (id, tokens) on which rules fire; frequency: (token, n)."""
    index = (
        rules.withColumn("token", F.explode("antecedent"))
        .join(frequency, "token", "left")
        .groupBy("rule_id", "antecedent", "confidence")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    )
    index = written(index, "rule_index")
    return (
        urls.select("id", "tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("id")
        .agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))
    )


def filter_urls(pages: DataFrame, labelled: DataFrame, how: Mining = Mining(), rules=HOST_RULES) -> DataFrame:
    """Judge pages (page_id, url); labelled: rows (url, blocked) to mine from.

    Returns page_id, host, path, rule, verdict, n_rules (mined rules that fire), confidence (the best of these).
    """
    url_of = written(labelled.select(tokens(F.col("url")).alias("tokens"), "blocked"), "labelled_urls")
    mined = written(mine(url_of, how), "rules")
    frequency = url_of.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # The verdict depends on the url alone: distinct urls meet the rules once.
    hits = matched(pages.select(F.col("url").alias("id")).where(F.col("id").isNotNull()).distinct().select("id", tokens(F.col("id")).alias("tokens")), mined, frequency)
    hits = written(hits, "fired")
    removed(url_of, mined)
    h, p = host(F.col("url")), path(F.col("url"))
    own = pages.select("page_id", "url", h.alias("host"), p.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        own.withColumns({"rule": rule.cast("string"), "fixed": verdict.cast("string")})
        .join(hits.withColumnRenamed("id", "url"), "url", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("fixed", F.when(F.col("n_rules") > 0, "block").otherwise("allow")).alias("verdict"),
            F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
            F.col("confidence").cast("double").alias("confidence"),
        )
    )
