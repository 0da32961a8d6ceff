"""URL filters: listed host/path rules first, mined token rules for the rest.

FP-growth over the tokens of labelled urls finds token combinations that go with
bad pages; rules pruned by support and confidence are matched by an inverted
index on each rule's rarest token. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host + path) of the listed rules.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
MAX_RULES = 1000
BAD = "label:bad"


def _rest(url: Column) -> Column:
    return F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest listed rule that fits, as host + path, or null. At most
    MAX_RULES rules, since they become one expression."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels and their hyphenated words, path segments
    with digits folded, query keys and the fragment."""
    host, path = host_of(url), F.lower(path_of(url))
    labels = F.split(host, r"\.")
    words = F.split(host, r"[.\-]")
    segments = F.split(F.regexp_replace(path, r"\d+", "0"), r"[/.]+")
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), 1)
    mark = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(
        F.concat(
            mark("h:", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))),
            mark("t:", F.slice(labels, -1, 1)),
            mark("w:", words),
            mark("p:", segments),
            mark("q:", keys),
        )
    )


def mine_rules(
    labelled: DataFrame,
    url_col: str = "url",
    bad_col: str = "bad",
    min_support: float = 0.002,
    min_rows: int = 5,
    min_confidence: float = 0.7,
    max_share: float = 0.5,
) -> DataFrame:
    """(antecedent, anchor, confidence, support): token sets that go with bad urls.

    Tokens in more than max_share of the urls can't tell pages apart and are left
    out; a rule is dropped if a rule on a subset of its tokens is as confident.
    anchor is the rule's rarest token. No labelled rows give no rules; null urls
    and labels are left out.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "antecedent array<string>, anchor string, confidence double, support double")
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(bad_col).isNotNull()).select(
        url_tokens(F.col(url_col)).alias("tokens"), F.col(bad_col).cast("boolean").alias("bad")
    )
    n = rows.count()
    if not n:
        return none
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # At most (mean tokens per url) / max_share tokens can be that common.
    common = [r["token"] for r in counts.where(F.col("n") > max_share * n).collect()]
    items = F.array_except("tokens", F.array(*map(F.lit, common)).cast("array<string>"))
    items = F.when(F.col("bad"), F.array_append(items, F.lit(BAD))).otherwise(items)
    model = FPGrowth(minSupport=max(min_support, min(1.0, min_rows / n)), minConfidence=min_confidence).fit(
        rows.select(items.alias("items"))
    )
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "support"
    )
    token = found.select("*", F.explode("antecedent").alias("token"))
    anchored = (
        token.join(counts, "token")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    )
    # A subset rule contains fewer tokens; its anchor is one of the larger rule's tokens.
    small = anchored.select(F.col("antecedent").alias("sub"), F.col("anchor").alias("token"), F.col("confidence").alias("c"))
    redundant = (
        token.join(small, "token")
        .where(
            (F.size("sub") < F.size("antecedent"))
            & (F.col("c") >= F.col("confidence"))
            & (F.size(F.array_except("sub", "antecedent")) == 0)
        )
        .select("antecedent")
        .distinct()
    )
    return anchored.join(redundant, "antecedent", "left_anti").select("antecedent", "anchor", "confidence", "support")


def judge(
    pages: DataFrame,
    mined: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Each row of pages with host, path, rule, verdict and mined (confidence of
    the best mined rule that fits, else null). A listed rule decides; else a
    mined rule blocks; else the url is allowed. Null and empty urls and urls
    without :// have empty host and path and fit no rule. Repeated rows stay."""
    rows = pages.select(id_col, F.col(url_col).alias("_url"))
    tokens = rows.where("_url is not null").select("_url").distinct().select("_url", url_tokens(F.col("_url")).alias("tokens"))
    hits = (
        tokens.select("_url", "tokens", F.explode("tokens").alias("anchor"))
        .join(mined, "anchor")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("_url")
        .agg(F.max("confidence").alias("mined"))
    )
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    verdict = F.lit(None).cast("string")
    for said, rule in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(said)).otherwise(verdict)
    by_method = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise("allow")
    return (
        rows.join(hits, "_url", "left")
        .withColumns({"host": host, "path": path})
        .withColumn("rule", listed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("verdict", F.coalesce(verdict, by_method))
        .select(id_col, "host", "path", "rule", "verdict", "mined")
    )
