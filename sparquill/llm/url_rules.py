"""URL filtering by association rules.

The tokens of each labelled URL, with its label as one more item, are mined by FP-growth. Tokens that occur in just the
same labelled URLs are one item, as each of them stands for any other in a rule; so a template that many URLs share
doesn't multiply the item sets. Rules that lead to the bad label are kept if they have the support and confidence
wanted, and if no shorter rule within them is as confident. An inverted index from a rule's rarest item to the rule
finds, for each URL, the rules all of whose tokens it has.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_side

BAD = "label=bad"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.35
#: Bad URLs that a rule must hold for at least, however few are labelled.
MIN_COUNT = 10
#: The confidence has to be above the share of bad URLs by so many standard errors, as its own number of URLs has them.
MIN_SIGMA = 2.0


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL: scheme, host, words of the host, top domain, words of the path, extension, query keys.

    Numbers are left out, as they name single pages.
    """
    u = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    words = lambda c, mark: F.transform(F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit(mark), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_replace(x, "=.*", "")))
    scheme = F.filter(F.array(F.concat(F.lit("s:"), F.regexp_extract(u, r"^([a-z][a-z0-9+.-]*)://", 1))), lambda x: x != "s:")
    whole = F.filter(F.array(F.concat(F.lit("host:"), host)), lambda x: x != "host:")
    part = F.filter(F.array(F.when(u.contains("#"), F.lit("fragment"))), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(scheme, whole, words(host, "h:"), words(path, "p:"), keys, part)))


def token_items(labelled: DataFrame, least: int) -> DataFrame:
    """(t, item): tokens of at least so many of the (row, tokens), and the least of those that occur in just the same rows."""
    said = labelled.select("row", F.explode("tokens").alias("t"))
    seen = said.groupBy("t").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7919), "row")).alias("x2")).where(F.col("n") >= least)
    return seen.join(seen.groupBy("n", "x1", "x2").agg(F.min("t").alias("item")), ["n", "x1", "x2"]).select("t", "item")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_sigma: float = MIN_SIGMA) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, n_items, confidence, support), and the (t, item) of their tokens, from (tokens, bad) rows.

    All rows are mined. A rule stands for every choice of one token of each of its items.
    """
    spark = labelled.sparkSession
    rows = cut(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", F.coalesce("bad", F.lit(False)).alias("bad")))
    none = spark.createDataFrame([], "rule_id long, items array<string>, n_items int, confidence double, support double"), spark.createDataFrame([], "t string, item string")
    n, bad = rows.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    if n < min_count or not bad:
        return none
    base = bad / n
    least = max(1, min_count, math.ceil(min_support * n - 1e-9))
    names = cut(token_items(rows, least))
    said = rows.select("row", "bad", F.explode("tokens").alias("t")).join(small_side(names), "t").groupBy("row").agg(F.first("bad").alias("bad"), F.collect_set("item").alias("items"))
    mined = cut(said.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    there = mined.count()
    if not there:
        return none
    # FP-growth rounds the product of support and rows up; half a row less comes to the count, however it is rounded.
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / there), minConfidence=min_confidence).fit(mined)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    c, of = F.col("confidence"), F.round(F.col("support") * there / F.col("confidence"))
    sure = c - F.lit(base) >= F.lit(min_sigma) * F.sqrt(F.lit(base * (1 - base)) / of)
    rules = cut(found.where(sure).select(F.array_sort("antecedent").alias("items"), c, (F.col("support") * there / n).alias("support")).withColumn("n_items", F.size("items")).withColumn("rule_id", F.monotonically_increasing_id()))
    # A rule within which a shorter one is as confident says nothing more. Rules with a part share each of its items.
    parts = rules.select(F.explode("items").alias("t"), F.col("rule_id").alias("r"), F.col("items").alias("pt"), F.col("n_items").alias("pn"), c.alias("pc"))
    wider = rules.select(F.explode("items").alias("t"), "rule_id", "items", "n_items", "confidence")
    idle = wider.join(parts, "t").where("pn < n_items and pc >= confidence").where(F.size(F.array_except("pt", "items")) == 0).select("rule_id").distinct()
    kept = cut(rules.join(idle, "rule_id", "left_anti").select("rule_id", "items", "n_items", "confidence", "support"))
    used = cut(names.join(kept.select(F.explode("items").alias("item")).distinct(), "item", "left_semi"))
    release(rows, names, mined, rules)
    return kept, used


def match_rules(urls: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """(key, rule_id, confidence, n) for the (key, tokens) rows that have a token of each item of a rule; n is the number of such choices."""
    said = urls.select("key", F.explode("tokens").alias("t")).join(small_side(names), "t").groupBy("key", "item").agg(F.count("*").alias("n"))
    said = cut(said)
    # A rule is looked up by that item which fewest URLs have; ties go to the lower one.
    rare = said.groupBy("item").agg(F.count("*").alias("df"))
    first = rules.select("rule_id", F.explode("items").alias("item")).join(rare, "item", "left").groupBy("rule_id").agg(F.min_by("item", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "item")).alias("item"))
    index = cut(first.join(rules, "rule_id").select("item", "rule_id", F.col("items").alias("rule"), "confidence"))
    held = said.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("held"))
    probes = held.select("key", "held", F.explode(F.map_keys("held")).alias("item")).join(small_side(index), "item")
    whole = probes.where(F.forall("rule", lambda i: F.map_contains_key("held", i)))
    return whole.select("key", "rule_id", "confidence", F.aggregate("rule", F.lit(1).cast("long"), lambda acc, i: acc * F.element_at("held", i)).alias("n"))


def filter_urls(pages: DataFrame, labels: DataFrame, page_col: str = "page_id", url_col: str = "url", label_id_col: str = "doc_id", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_sigma: float = MIN_SIGMA) -> DataFrame:
    """(page_id, url, n_rules, confidence, blocked) for every page.

    A labelled page is bad if its quality is 0 or it is toxic; labels carry the page's id. Of several labels of a page
    the worst counts, and null labels count as good. ``confidence`` is that of the surest rule that matches, which ties
    don't change; a page without one has null, isn't blocked, and n_rules 0. Rules may have any number of tokens, and
    URLs any length. A null or empty URL has no tokens. Null ids stay and match no label. Repeated rows are judged
    alike. If either table is empty, or nothing is bad, there are no rules. Extra columns aren't read.
    """
    src = pages.select(F.col(f"`{page_col}`").alias("page"), F.col(f"`{url_col}`").alias("url")).withColumn("tokens", url_tokens(F.col("url")))
    bad = labels.select(F.col(f"`{label_id_col}`").alias("page"), (F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce((F.col("toxic") == 1), F.lit(False))).alias("bad"))
    bad = bad.groupBy("page").agg(F.max("bad").alias("bad"))
    rules, names = mine_rules(src.join(bad, "page"), min_support, min_confidence, min_count, min_sigma)
    # URLs that have equal tokens are matched once.
    key = F.struct(F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(104729), "tokens").alias("b"))
    kinds = src.withColumn("key", key).select("key", "tokens").dropDuplicates(["key"])
    hits = match_rules(kinds, rules, names).groupBy("key").agg(F.sum("n").cast("int").alias("n_rules"), F.max("confidence").alias("confidence"))
    out = src.withColumn("key", key).join(hits, "key", "left")
    return out.select(F.col("page").alias("page_id"), "url", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.round("confidence", 6).alias("confidence"), F.col("n_rules").isNotNull().alias("blocked"))
