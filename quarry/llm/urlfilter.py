"""URL filters: fixed host and path rules, and association rules mined by FP-growth.

A url's tokens are the labels of its host, the words of its path, its file
extension and the keys of its query.  FP-growth finds the token combinations
that are frequent among labelled urls; a combination that, with a label,
reaches the least confidence and support becomes a rule, unless a part of it
is at least as sure.  Rules are matched through an inverted index: each rule
stands under its rarest token, a url looks up the rules of its own tokens, and
a rule counts if the url has all of its tokens.  The surest match gives the
verdict; ties go to the larger support, then to block; without a match the
url is allowed.

In the query the labels are the verdicts of the fixed rules on the pages they
judge, and the mined rules decide the other pages.

All of it is DataFrame operations and Spark's own FP-growth.  A common host
repeats the same tokens, so equal token sets are counted before rules are
matched.  Tokens may stand in any share of the labelled urls, in all of them too.

Defined results: a rule rests on ``LEAST_ROWS`` labelled urls at least; urls of
any length are read whole; null urls and urls without ``://`` have an empty host and
path, no tokens and no rule, and are allowed; repeated rows count each; without
labelled urls nothing is mined; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUPPORT, CONFIDENCE, LONGEST = 0.002, 0.8, 3
LEAST_ROWS = 5  # labelled urls that a rule needs whatever the support


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(h: Column, p: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith("/" + rule_path)
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def fixed_verdict(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    return reduce(lambda w, r: w.when(rule == r[0], F.lit(r[1])), rules, F.when(F.lit(False), F.lit("")))


def tokens(url: Column, h: Column, p: Column) -> Column:
    """The distinct tokens of a url; numbers tell nothing and are left out."""
    words = lambda c, mark: F.transform(F.filter(c, lambda x: x.rlike("[^0-9]")), lambda x: F.concat(F.lit(mark), x))
    small = F.translate(p, UPPER, LOWER)
    query = F.regexp_extract(rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    every = F.concat(
        words(F.split(h, r"[.\-:@]"), "h:"),
        words(F.split(F.regexp_replace(small, r"\.[a-z0-9]+$", ""), r"[/\-_.]"), "p:"),
        words(F.array(F.regexp_extract(small, r"\.([a-z0-9]+)$", 1)), "x:"),
        words(keys, "q:"),
    )
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(every, F.array().cast("array<string>")), lambda x: F.length(x) > 2)))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int | None = LONGEST) -> DataFrame:
    """Rules (items, label, confidence, rows, key) from labelled(tokens, label), of at most longest tokens, or of any number if it is None."""
    spark = labelled.sparkSession
    schema = "items array<string>, label string, confidence double, rows long, key string"
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], schema)
    single = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    support = max(support, LEAST_ROWS / n) if n >= LEAST_ROWS else 1.0
    single = single.filter(F.col("n") >= support * n)
    frequent = [r["t"] for r in single.select("t").orderBy(F.desc("n"), "t").collect()]  # at most mean tokens / support
    if not frequent:
        return spark.createDataFrame([], schema)
    kept = F.array_intersect("tokens", F.lit(frequent))
    baskets = materialize(labelled.select(F.concat(kept, F.array(F.concat(F.lit("="), "label"))).alias("items")), "baskets")
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(baskets).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq").filter(F.lit(True) if longest is None else F.size("items") <= longest + 1), "itemsets")
    parts = sets.select(
        F.filter("items", lambda x: ~x.startswith("=")).alias("items"), F.get(F.filter("items", lambda x: x.startswith("=")), F.lit(0)).alias("label"), "freq"
    )
    whole = parts.filter("label is null and size(items) > 0").select("items", F.col("freq").alias("all"))
    rules = parts.filter("label is not null and size(items) > 0").join(whole, "items")
    rules = rules.select("items", F.substring("label", 2, 99).alias("label"), (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("rows"))
    rules = materialize(rules.filter(F.col("confidence") >= confidence), "rules")
    # a rule goes if a rule on a part of its tokens is as sure
    lesser = rules.select(F.col("items").alias("part"), F.col("label").alias("l"), F.col("confidence").alias("c"))
    weak = (
        rules.select("items", "label", "confidence", F.explode("items").alias("t"))
        .join(lesser.withColumn("t", F.get("part", F.lit(0))), "t")
        .filter((F.col("l") == F.col("label")) & (F.col("c") >= F.col("confidence")) & (F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
        .select("items", "label")
        .distinct()
    )
    rarest = F.lit(frequent[::-1])
    key = F.get(F.array_intersect(rarest, F.col("items")), F.lit(0))
    return materialize(rules.join(weak, ["items", "label"], "left_anti").withColumn("key", key), "rules")


def match(sets: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """The verdict of the surest rule for each token set that has one; sets: (tokens)."""
    found = sets.select("tokens", F.explode("tokens").alias("key")).join(broadcast_if_small(rules, n_rules), "key")
    found = found.filter(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", "rows", (F.col("label") == "block").alias("b"), "label"))
    return found.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.label").alias("mined"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, **options) -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict; rules of any number of tokens."""
    url = F.col("url")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), "url")
    rows = rows.withColumn("rule", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(url, F.col("host"), F.col("path")))
    rows = materialize(rows.drop("url"), "urls")
    labelled = rows.filter("rule is not null").select("tokens", fixed_verdict(F.col("rule"), rules).alias("label"))
    mined = mine(labelled, **{"longest": None} | options)
    n_rules = mined.count()
    sets = rows.filter("rule is null").select("tokens").distinct()
    verdicts = materialize(match(sets, mined, n_rules), "verdicts")
    named = rows.withColumn("own", F.when(F.col("rule").isNull(), F.to_json("tokens")))
    # pages with a rule have no part in the join, so their null keys meet nowhere
    mined_of = verdicts.select(F.to_json("tokens").alias("own"), "mined")
    joined = named.filter("rule is null").join(mined_of, "own", "left").unionByName(named.filter("rule is not null").withColumn("mined", F.lit(None).cast("string")))
    verdict = F.coalesce(fixed_verdict(F.col("rule"), rules), "mined", F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
