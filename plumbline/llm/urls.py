"""URL filters: listed rules, and association rules mined from labels.

FP-growth mines combinations of URL tokens that go with bad labels: each labelled page is a transaction of its URL's
distinct tokens and its class. Of the rules whose consequent is the class ``block`` those of enough support and
confidence stay, without those that a shorter rule of no less confidence implies. Pages are matched through an
inverted index: a rule is filed under its rarest token, a page's tokens are looked up in it, and the rule then
has to be contained in the page's tokens. Listed rules decide first.

Support is a share of the labelled pages, but ``min_rows`` of them at least, so the number of rules does not
grow with the pages; the rule table is joined like any table, broadcast only if Spark finds it small.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and no token but what its text
has; very long urls are read whole, all of their tokens count (bad urls that are equal, or
whose tokens no good page has, make a rule a token; many tokens that good pages have too, each in pages of its own, still make
many combinations, as these have no bound on their length); of listed rules of equal length that fit the later one
decides, of mined ones the highest confidence is reported; repeated pages are judged one by one; without labels no association rules are mined and pages without a
listed rule are allowed; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Work, ascii_lower, table

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is the outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct runs of letters and digits, lower-cased, apart from the scheme; numbers are one token."""
    bare = ascii_lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z]+://", ""))
    parts = F.regexp_extract_all(bare, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    return F.array_distinct(F.transform(parts, lambda t: F.when(t.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(t)))


def _baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad) of labelled pages. labels: (doc_id, quality, toxic) of pages by page_id; bad (1 or 0) are those
    of quality 0 or toxic 1."""
    bad = (F.coalesce(F.max("toxic"), F.lit(0)) == 1) | (F.coalesce(F.min("quality"), F.lit(1)) == 0)
    classes = labels.groupBy("doc_id").agg(bad.cast("int").alias("bad"))
    return pages.select("page_id", "url").join(classes, F.col("page_id") == F.col("doc_id")).select("page_id", "url", "bad")


NO_RULES = "tokens array<string>, confidence double, support double"


def _rules(baskets: DataFrame, least: float, min_confidence: float) -> DataFrame:
    """FP-growth's rules for the class block. baskets: items with a class; least: a share of them."""
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets.select("items"))
    rules = model.associationRules.where(F.array_contains("consequent", "=block") & ~F.array_contains("antecedent", "=allow"))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")


def _class(bad: Column) -> Column:
    return F.when(bad == 1, "=block").otherwise("=allow")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_rows: int = 8, min_confidence: float = 0.6) -> DataFrame:
    """(tokens, confidence, support): all rules for the class block. Labelled bad urls of n equal tokens have 2^n - 1 of
    them; ``needed`` finds those that ``pruned`` leaves without listing the others."""
    baskets = _baskets(pages, labels).select(F.array_append(tokens(F.col("url")), _class(F.col("bad"))).alias("items"))
    n = baskets.count()
    if not n:
        return pages.sparkSession.createDataFrame([], NO_RULES)
    return _rules(baskets, min(1.0, max(min_support, min_rows / n)), min_confidence)


def needed(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_rows: int = 8, min_confidence: float = 0.6) -> DataFrame:
    """The rules of pruned(mine(...)), of which FP-growth sees only what can matter: tokens in too few bad pages are part of
    none, a token without a good page is a rule that makes all longer ones with it needless, and of tokens that lie
    in the same pages no two are in one rule, so one stands for all of them until the rules are pruned."""
    baskets = _baskets(pages, labels).groupBy("page_id", "url", "bad").agg(F.count("*").alias("copies"))
    n = baskets.agg(F.sum("copies")).first()[0] or 0
    if not n:
        return pages.sparkSession.createDataFrame([], NO_RULES)
    least = math.ceil(min(1.0, max(min_support, min_rows / n)) * n)
    held = baskets.select("*", F.explode(tokens(F.col("url"))).alias("t"))
    mark = lambda k: F.sum(F.xxhash64(F.lit(k), "page_id", "url").cast("decimal(20,0)") * F.col("copies")).alias(f"mark{k}")
    counted = held.groupBy("t").agg(F.sum("copies").alias("n"), F.sum(F.col("bad") * F.col("copies")).alias("n_bad"), mark(1), mark(2)).where(F.col("n_bad") >= least)
    work = Work(pages.sparkSession, "urls")
    counted = work.save(counted.withColumn("rep", F.min("t").over(Window.partitionBy("n", "n_bad", "mark1", "mark2"))), "tokens")
    pure = counted.where("n = n_bad").select(F.array("t").alias("tokens"), F.lit(1.0).alias("confidence"), (F.col("n_bad") / n).alias("support"))
    some = held.join(counted.where("n > n_bad and t = rep").select("t"), "t").groupBy("page_id", "url", "bad", "copies").agg(F.collect_list("t").alias("own"))
    some = some.select(F.array_append("own", _class(F.col("bad"))).alias("items"), F.explode(F.expr("sequence(1, copies)")))
    some = work.save(some.select("items"), "baskets")
    m = some.count()
    if m < least:
        return pure
    # half a page below the least count: a share of m pages, rounded up, is that count again
    rules = pruned(_rules(some, (least - 0.5) / m, min_confidence)).withColumn("support", F.round(F.col("support") * m) / n)
    members = counted.where("n > n_bad").groupBy("rep").agg(F.collect_list("t").alias("members"))
    named = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("rep")).join(members, "rep")
    named = named.groupBy("tokens", "confidence", "support").agg(F.collect_list("members").alias("members"))
    longer = lambda acc, own: F.flatten(F.transform(acc, lambda x: F.transform(own, lambda t: F.array_append(x, t))))
    every = F.aggregate("members", F.array(F.array().cast("array<string>")), longer)
    return pure.unionByName(named.select(F.explode(every).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens")))


def pruned(rules: DataFrame) -> DataFrame:
    """Without the rules that a rule on a part of their tokens, with no less confidence, makes needless."""
    part = F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("shorter")
    wide = rules.where(F.size("tokens") > 1).select("tokens", "confidence", part)
    short = rules.select(F.col("tokens").alias("shorter"), F.col("confidence").alias("c"))
    needless = wide.join(short, "shorter").where("c >= confidence").select("tokens").distinct()
    return rules.join(needless, "tokens", "left_anti")


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, n_mined (association rules that match), confidence (the best of them)."""
    host, path = host_path(F.col("url"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "listed": verdict})
    mined = needed(pages, labels, **settings)
    uses = mined.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    filed = mined.select("tokens", "confidence", F.explode("tokens").alias("t")).join(uses, "t")
    filed = filed.groupBy("tokens", "confidence").agg(F.min(F.struct("n", "t")).alias("_f")).select("tokens", "confidence", F.col("_f.t").alias("t"))
    urls = judged.where("listed is null").select("url").distinct().withColumn("own", tokens(F.col("url")))
    hits = urls.select("url", "own", F.explode("own").alias("t")).join(filed, "t").where(F.size(F.array_except("tokens", "own")) == 0)
    hits = hits.groupBy("url").agg(F.count("*").alias("n_mined"), F.max("confidence").alias("confidence"))
    out = judged.join(hits, "url", "left")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("n_mined") > 0, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n_mined", F.lit(0)).alias("n_mined"), "confidence",
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def judge_sql(min_support: float = 0.002, min_rows: int = 8, min_confidence: float = 0.6) -> str:
    """DuckDB SQL of judge() with the listed rules: every combination of a labelled page's tokens is counted."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = "(host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)"
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS rid, page_id, url, {lower("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_distinct(list_transform(regexp_extract_all({lower("regexp_replace(coalesce(url, ''), '^[A-Za-z]+://', '')")}, '{words}'), lambda t: CASE WHEN regexp_full_match(t, '[0-9]+') THEN '#' ELSE t END))) AS own FROM pages),
listed AS (
  SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM u JOIN (VALUES {rules}) r(h, p, verdict) ON {fits} GROUP BY rid),
classes AS (SELECT doc_id, CAST(coalesce(max(toxic), 0) = 1 OR coalesce(min(quality), 1) = 0 AS INTEGER) AS bad FROM labels GROUP BY doc_id),
basket AS (SELECT rid, own, bad FROM u JOIN classes ON page_id = doc_id),
least AS (SELECT ceil(least(1.0::DOUBLE, greatest({min_support}::DOUBLE, {min_rows}::DOUBLE / count(*))) * count(*)) AS n FROM basket),
part AS (
  SELECT rid, own, bad, [own[i]] AS s, i FROM (SELECT *, unnest(generate_series(1, len(own))) AS i FROM basket)
  UNION ALL SELECT rid, own, bad, list_append(s, own[j]), j FROM (SELECT *, unnest(generate_series(i + 1, len(own))) AS j FROM part)),
rule AS (SELECT s, sum(bad) / count(*)::DOUBLE AS confidence FROM part, least GROUP BY s, n HAVING sum(bad) >= n AND sum(bad) / count(*)::DOUBLE >= {min_confidence}::DOUBLE),
needless AS (
  SELECT DISTINCT a.s FROM (SELECT s, confidence, unnest(s) AS t FROM rule) a JOIN rule b ON b.s = list_filter(a.s, lambda x: x <> a.t) AND b.confidence >= a.confidence),
kept AS (SELECT * FROM rule ANTI JOIN needless USING (s)),
mined AS (SELECT rid, count(*) AS n_mined, max(confidence) AS confidence FROM u JOIN kept ON list_has_all(own, s) WHERE rid NOT IN (SELECT rid FROM listed) AND url IS NOT NULL GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN n_mined > 0 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(n_mined, 0) AS n_mined, confidence
FROM u LEFT JOIN listed USING (rid) LEFT JOIN mined USING (rid)
"""


OP6_SQL = judge_sql()
