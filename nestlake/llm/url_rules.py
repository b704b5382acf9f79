"""URL filtering: a fixed rule list first, then association rules over URL tokens.

Labelled URLs become transactions of tokens (host labels, path segments, query keys;
digits collapse to ``#``) plus the label. Spark's FP-growth mines them; rules whose
consequent is a label are pruned by support, confidence and redundancy (a rule goes if
a part of its antecedent already gives the label with no less confidence).

Matching uses an inverted index: each rule is filed under its rarest token, so a URL
meets only the rules filed under one of its tokens, and each candidate is verified on
the whole antecedent. URLs with the same token set are judged once, which also folds
a host that holds a third of all rows.

Defined results: a null URL, or one without ``://``, has an empty host and path, no
tokens and the default verdict (allow); rows that repeat come back as often as they
came; very long URLs are read whole; of several labels for a page, allow is before block by
name and the last by name counts; a tie of confidence is allowed; an empty table gives no
rows; other columns are ignored. Without labels there are no mined rules.

The query has no labels of its own for pages: it takes ``quality`` of the document with the
page's number, which says nothing about the URL. Outside the list its mined rules are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Verdict, host, path prefix.
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
#: Index rows up to which the index is sent to all executors; beyond it Spark shuffles.
BROADCAST_ROWS = 20_000


def _rest(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))


def host_of(url: Column) -> Column:
    return common.lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)


def first_rule(host: Column, path: Column, rules=BASE_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest ends up outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column, query: Column) -> Column:
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    full = lambda a: F.filter(a, lambda x: x != "")
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(full(F.split(host, r"\.")), lambda x: F.concat(F.lit("h:"), shape(x))),
                F.transform(full(F.split(path, "/")), lambda x: F.concat(F.lit("p:"), shape(x))),
                F.transform(full(F.split(query, "[&;]")), lambda x: F.concat(F.lit("q:"), shape(F.regexp_extract(x, "^([^=]*)", 1)))),
            )
        )
    )


def judge_by_list(pages: DataFrame, rules=BASE_RULES) -> DataFrame:
    """page_id, host, path, rule, listed (verdict of the list or null), items."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), F.coalesce(tokens_of(F.col("host"), F.col("path"), F.col("query")), F.array().cast("array<string>")).alias("items")
    )


def index_of(rules: DataFrame, frequency: DataFrame) -> DataFrame:
    """Each rule filed under the rarest token of its antecedent."""
    token = rules.select("rule_id", F.explode("antecedent").alias("token")).join(frequency, "token", "left")
    key = token.groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rules.join(key, "rule_id")


def match(sets: DataFrame, index: DataFrame, small: bool) -> DataFrame:
    """items, and every rule whose antecedent they contain."""
    index = F.broadcast(index) if small else index
    probe = sets.select("items", F.explode("items").alias("token"))
    return probe.join(index, "token").filter(F.size(F.array_except("antecedent", "items")) == 0).drop("token")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, bool]:
    """labelled: items, label. Returns the pruned index and whether it is small."""
    from pyspark.ml.fpm import FPGrowth

    goal = F.concat(F.lit("="), F.col("label"))
    baskets = labelled.select(F.array_append("items", goal).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    frequency = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("n"))
    rules = (
        model.associationRules.filter(F.col("consequent")[0].startswith("=")).filter(F.size(F.filter("antecedent", lambda x: x.startswith("="))) == 0)
        .select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 1000).alias("label"), "confidence", "support")
        .withColumn("rule_id", F.concat_ws("\x1f", "label", F.concat_ws("\x1f", "antecedent")))
    )
    rules, frequency = common.settle(rules, "url-rules"), common.settle(frequency, "url-tokens")
    index = index_of(rules, frequency)
    whole = rules.select(F.col("antecedent").alias("items"), F.col("label").alias("of"), F.col("confidence").alias("reached"), F.col("rule_id").alias("longer"))
    parts = (
        whole.withColumn("token", F.explode("items")).join(index, "token")
        .filter((F.size(F.array_except("antecedent", "items")) == 0) & (F.col("label") == F.col("of")) & (F.col("rule_id") != F.col("longer")) & (F.col("confidence") >= F.col("reached")))
    )
    index = common.settle(index.join(parts.select(F.col("longer").alias("rule_id")).distinct(), "rule_id", "left_anti"), "url-index")
    return index, index.count() <= BROADCAST_ROWS


def judge(pages: DataFrame, labels: DataFrame, rules=BASE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, n_rules. labels: page_id, label (allow or block).

    Mined rules learn from the list's own verdicts and from ``labels`` where the list is silent.
    """
    known = judge_by_list(pages, rules)
    named = labels.filter("page_id is not null and label is not null").groupBy("page_id").agg(F.max("label").alias("label"))
    narrow = known.select("page_id", "listed", "items")
    labelled = (
        narrow.filter("listed is not null").select("items", F.col("listed").alias("label"))
        .unionByName(narrow.filter("listed is null").join(named, "page_id").select("items", "label"))
    )
    index, small = mine(labelled)
    sets = known.filter("listed is null").select("items").distinct()
    best = lambda v: F.max(F.when(F.col("label") == v, F.col("confidence")))
    found = match(sets, index, small).groupBy("items").agg(best("block").alias("block"), best("allow").alias("allow"), F.count(F.lit(1)).alias("n_rules"))
    found = common.settle(found, "url-verdicts")
    blocked = F.coalesce(F.col("block"), F.lit(0.0)) > F.coalesce(F.col("allow"), F.lit(0.0))
    return known.join(found, "items", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("listed").isNull(), F.greatest("block", "allow")).alias("confidence"),
        F.when(F.col("listed").isNull(), F.coalesce("n_rules", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_rules"),
    )


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, "block").otherwise("allow").alias("label"))
    return judge(common.table(spark, sf_dir, "pages"), labels)
