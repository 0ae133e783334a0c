"""URL filters: a list of host and path rules, and association rules that FP-growth mines from what the list labels.

URLs become sets of tokens (host labels, path segments, query keys). Spark's FP-growth finds frequent combinations in the
labelled URLs; combinations that imply a verdict with enough confidence and support are kept as rules. An inverted index
holds each rule under its rarest token, so a URL meets a rule once, and then checks the rule's other tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import ascii_lower, attach, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, DEFAULT = 0.005, 0.8, "allow"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest; empty for null and for what has no ://."""
    at = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)([^?#]*)(.*)", i), F.lit(""))
    return ascii_lower(at(1)), at(2), at(3)


def url_tokens(host: Column, path: Column, rest: Column) -> Column:
    """The distinct tokens, sorted: host labels, path segments (numbers alike, extensions apart) and query keys; no empty ones."""
    segments = F.flatten(F.transform(F.split(F.regexp_replace(ascii_lower(path), "[0-9]+", "#"), "/"), lambda x: F.split(x, r"\.")))
    keys = F.regexp_extract_all(ascii_lower(rest), F.lit(r"[?&]([^=&#]+)"), 1)
    named = lambda kind, found: F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(kind + ":"), x))
    return F.array_sort(F.array_distinct(F.concat(named("host", F.split(host, r"\.")), named("path", segments), named("query", keys))))


def list_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """tokens, verdict, confidence, support and anchor of each rule, from rows (tokens, verdict). No rows give no rules."""
    schema = "tokens array<string>, verdict string, confidence double, support double, anchor string"
    if labelled.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("verdict=")).where(~F.exists("antecedent", lambda x: x.startswith("verdict=")))
    rules = rules.select(F.col("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    rarest = rules.withColumn("token", F.explode("tokens")).join(single, "token").groupBy("tokens").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return written(rules.join(rarest, "tokens").select("tokens", "verdict", "confidence", "support", "anchor"), "url-rules")


def filter_urls(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict and mined (the tokens of the mined rule that decided, else null) of each row.

    A list rule decides where one fits (its rule is the column rule). Elsewhere the mined rule decides with the highest
    confidence, then support, then most tokens (it says the most about the URL), then `block`; without one the verdict is
    DEFAULT. Rows with null urls have an empty host and path. URLs are matched once for each distinct set of tokens.
    """
    host, path, rest = url_parts(F.col("url"))
    found = list_rule(F.col("host"), F.col("path"), rules)
    base = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"), rest.alias("rest")).withColumns({"tokens": url_tokens(F.col("host"), F.col("path"), F.col("rest")), "found_rule": found}).drop("rest")
    base = written(base.withColumn("key", F.to_json("tokens")), "urls")  # tokens can hold any character
    mined = mine(base.where("found_rule is not null").select("tokens", F.col("found_rule.verdict").alias("verdict")), support, confidence)
    sets = written(base.groupBy("key", F.col("tokens").alias("all")).agg(F.count("*").alias("n")), "url-token-sets")
    met = sets.withColumn("anchor", F.explode("all")).join(mined, "anchor")
    met = met.where(F.size(F.array_except("tokens", "all")) == 0)
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (-F.size("tokens")).alias("k"), (F.col("verdict") != "block").alias("a"), F.array_join(F.array_sort("tokens"), " ").alias("mined"), "verdict")
    best = met.groupBy("key").agg(F.min(rank).alias("best"), F.first("n").alias("n")).select("key", "n", "best.mined", "best.verdict")
    out = attach(base, written(best, "url-verdicts"), "key", "n", base.count(), "row")
    listed = F.col("found_rule").isNotNull()
    return out.select("page_id", "host", "path", F.col("found_rule.rule").alias("rule"), F.coalesce("found_rule.verdict", "found.verdict", F.lit(DEFAULT)).alias("verdict"), F.when(~listed, F.col("found.mined")).alias("mined"))
