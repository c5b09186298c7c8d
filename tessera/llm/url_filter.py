"""URL filters: fixed host/path rules, and association rules mined by FP-growth; DataFrame functions only.

A url becomes a set of typed tokens (scheme, host labels and their last two, path
segments with digits masked, extension, query keys).  Spark's FP-growth mines token
combinations over the labelled pages, with the label as one more item; rules that
conclude "block" are kept by support, confidence and lift, and a rule goes if a
more general one is at least as confident.  A url is matched through an inverted
index: each rule is filed under its rarest token, and only rules filed under one
of the url's tokens are compared with it.  Fixed rules outrank mined ones.

Before mining, tokens that all labelled pages hold are left out (a rule with one is never
more confident than the rule without), and of tokens that always occur together one stands
for all; the rules that are kept are written out for each of them again.  So tokens that
say the same don't multiply itemsets.

Plan: matching works on distinct urls, so a page that is stored a million times is
looked at once; rules meet urls in a join on one token (a third of all urls may
share a host: that host is the rarest token of few rules, and the join may be split
by AQE).  The number of rules is bounded by the support threshold, not by the data.

Defined cases: null url or one without ``://`` has empty host and path, no tokens
and the verdict allow unless a fixed rule fits; labels with null in both columns or
of unknown pages are left out, a page labelled more than once is bad if any label
says so; a label's doc_id is the page_id that it speaks of; without labelled pages there are no mined rules; repeated pages are
judged alike; incoming columns beyond page_id and url are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, rule); a rule is host and path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Share of the labelled pages, and number of them, that a rule's tokens and label hold at least.
MIN_SUPPORT, MIN_COUNT = 0.002, 5
MIN_CONFIDENCE, MIN_LIFT = 0.5, 1.5
_BAD = "=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """The distinct typed tokens of a url; empty for null and for what isn't a url."""
    host = F.regexp_replace(host_of(url), r":\d*$", "")
    labels = F.split(host, r"\.")
    path = F.lower(path_of(url))
    masked = F.regexp_replace(path, r"\d+", "0")
    parts = F.filter(F.split(masked, "/"), lambda p: p != "")
    keys = F.transform(F.split(F.coalesce(F.regexp_extract(url, _URL, 4), F.lit("")), "&"), lambda p: F.substring_index(p, "=", 1))
    tagged = lambda tag, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    found = F.array_distinct(F.concat(
        tagged("scheme:", F.array(F.lower(F.regexp_extract(url, _URL, 1)))),
        tagged("label:", labels),
        tagged("site:", F.array(F.when(F.size(labels) > 1, F.substring_index(host, ".", -2)).otherwise(F.lit("")))),
        tagged("path:", parts),
        tagged("type:", F.array(F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1))),
        tagged("key:", keys),
    ))
    return F.when(F.coalesce(url.contains("://"), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def together(baskets: DataFrame) -> DataFrame:
    """(token, stands, size) of the tokens of baskets (row, t): the least of those that occur in just the same baskets."""
    seen = baskets.select("row", F.explode("t").alias("token"))
    mark = F.struct(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x"),
    )
    per = seen.groupBy("token").agg(mark.alias("mark"))
    least = per.groupBy("mark").agg(F.min("token").alias("stands"))
    return per.join(least, "mark").select("token", "stands", F.col("mark.n").alias("size"))


def mine_rules(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """(tokens, key, confidence, support): token combinations that announce a bad page; key is the rarest."""
    spark = pages.sparkSession
    marks = (
        labels.where("doc_id is not null and coalesce(quality, toxic) is not null")
        .groupBy("doc_id")
        .agg(
            F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int"))
            .alias("bad")
        )
    )
    seen = pages.select("page_id", url_tokens(F.col("url")).alias("t")).join(marks, F.col("page_id") == F.col("doc_id"))
    baskets = cut(seen.where(F.size("t") > 0).select("t", "bad", F.monotonically_increasing_id().alias("row")))
    total = baskets.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    none = spark.createDataFrame([], "tokens array<string>, key string, confidence double, support double")
    if total["bad"] == 0:
        return none
    least = max(min_support * total["n"], min_count - 0.5)
    alike = cut(together(baskets).where(F.col("size") >= least))
    mined = alike.where((F.col("token") == F.col("stands")) & (F.col("size") < total["n"])).select("token")
    short = (
        baskets.select("row", "bad", F.explode("t").alias("token"))
        .join(mined, "token")
        .groupBy("row", "bad")
        .agg(F.collect_list("token").alias("t"))
    )
    items = F.when(F.col("bad") == 1, F.array_append("t", F.lit(_BAD))).otherwise(F.col("t"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total["n"]), minConfidence=min_confidence)
    # Baskets without a token count towards the support, as empty ones.
    empty = (
        baskets.select("row", "bad")
        .join(short.select("row"), "row", "left_anti")
        .select("row", "bad", F.array().cast("array<string>").alias("t"))
    )
    model = model.fit(cut(short.unionByName(empty).select(items.alias("items"))))
    base = total["bad"] / total["n"]
    rules = (
        model.associationRules
        .where(F.element_at("consequent", 1) == _BAD)
        .where((F.col("confidence") >= min_lift * base) & (F.size("antecedent") > 0))
    )
    rules = cut(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    always = [r["token"] for r in alike.where(F.col("size") == total["n"]).collect()] if base >= max(min_confidence, min_lift * base) else []
    single = alike.select("token", F.col("size").alias("freq"))
    filed = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(single, "token")
    filed = cut(
        filed.groupBy("tokens")
        .agg(
            F.min(F.struct("freq", "token"))["token"].alias("key"),
            F.max("confidence").alias("confidence"),
            F.max("support").alias("support"),
        )
    )
    general = filed.select(F.col("tokens").alias("less"), F.col("key").alias("token"), F.col("confidence").alias("c"))
    vain = (
        filed.select("tokens", "confidence", F.explode("tokens").alias("token"))
        .join(general, "token")
        .where(
            (F.size("less") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (
                F.size(F.array_except("less", "tokens")) == 0
            )
        )
    )
    kept = filed.join(vain.select("tokens").distinct(), "tokens", "left_anti").withColumn("rule", F.monotonically_increasing_id())
    # Each token that stands for others is replaced by every one of them.
    names = alike.groupBy(F.col("stands").alias("token")).agg(F.collect_list("token").alias("names"), F.first("size").alias("freq"))
    spelled = cut(kept).select("rule", "confidence", "support", F.explode("tokens").alias("token")).join(names, "token")
    spelled = spelled.groupBy("rule", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("freq", "names"))).alias("parts"))
    start = F.array(F.array().cast("array<string>"))
    grow = lambda acc, p: F.flatten(F.transform(acc, lambda a: F.transform(p["names"], lambda n: F.array_append(a, n))))
    every = spelled.select("confidence", "support", F.explode(F.aggregate("parts", start, grow)).alias("own"))
    out = every.select(F.array_sort("own").alias("tokens"), F.element_at("own", 1).alias("key"), "confidence", "support")
    if always:  # bad pages are so many that any page is taken for one
        whole = spark.createDataFrame([([t], t, float(base), float(base)) for t in always], out.schema)
        out = out.where(F.col("confidence") > base).unionByName(whole)
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the most confident mined rule) and confidence."""
    mined = cut(mine_rules(pages, labels, **mining))
    urls = pages.where("url is not null").select("url").distinct().withColumn("t", url_tokens(F.col("url")))
    hits = urls.select("url", "t", F.explode("t").alias("key")).join(mined, "key").where(F.size(F.array_except("tokens", "t")) == 0)
    best = (
        hits.groupBy(F.col("url").alias("_url"))
        .agg(F.max(F.struct("confidence", "support", F.array_join("tokens", " ").alias("tokens"))).alias("best"))
    )
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    out = (
        pages.select("page_id", "url")
        .join(best, F.col("url") == F.col("_url"), "left")
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    )
    method = F.when(F.col("best").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, method).alias("verdict"),
        F.col("best.tokens").alias("mined"),
        F.col("best.confidence").alias("confidence"),
    )
