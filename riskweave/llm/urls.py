"""URL filtering by association rules.

Fixed host and path rules come first. For the other urls, FP-growth mines the sets of url tokens that
go with a label; rules are kept by support and confidence, less those that a shorter rule says as
well. Tokens that labelled urls have only together are mined as one item, so a template of many tokens
does not give a set for each of its parts. A rule is indexed under its rarest token, and tried on the
urls that have this token.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, shuffle_width

#: Verdict, host, path.
Rule = tuple[str, str, str]
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: The fixed rules stand in the plan as a literal; more are an error.
MAX_RULES = 1000

#: Least share of the labelled urls that have a rule's tokens and label.
SUPPORT = 0.002
#: And at least so many of them, lest chance make rules of a few urls.
LEAST_URLS = 20
#: Least share of the urls with a rule's tokens that have its label.
CONFIDENCE = 0.8
#: Tokens in more than this share of the labelled urls tell nothing.
COMMON = 0.9

BLOCK, ALLOW = "=block", "=allow"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with ``host`` and ``path`` of column ``url``; both are empty if it is null or has no ``://``."""
    rest = "CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END"
    host = "regexp_extract(_rest, '^[^/?#]*', 0)"
    return (
        pages.withColumn("_rest", F.expr(f"coalesce({rest}, '')"))
        .withColumn("host", F.expr(f"translate({host}, '{_UPPER}', '{_UPPER.lower()}')"))
        .withColumn("path", F.expr(f"regexp_extract(substring(_rest, length({host}) + 1), '^[^?#]*', 0)"))
        .drop("_rest")
    )


def with_rule(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``urls(host, path)`` with ``rule`` and ``rule_verdict`` of the longest rule that fits, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    ordered = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r))
    if not ordered:
        return urls.selectExpr("*", "cast(null as string) rule", "cast(null as string) rule_verdict")
    known = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("verdict", "host", "path"), strict=True)]) for r in ordered])
    fits = F.filter(
        known,
        lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"])))
        & F.startswith(F.col("path"), r["path"]),
    )
    first = F.try_element_at(fits, F.lit(1))
    return (
        urls.withColumn("_rule", first)
        .withColumn("rule", F.concat("_rule.host", "_rule.path"))
        .withColumn("rule_verdict", F.col("_rule.verdict"))
        .drop("_rule")
    )


def tokens() -> F.Column:
    """Distinct tokens of host and path in order, without numbers: ``h:`` and a host label, ``p:`` and a path word."""
    return F.expr(
        "array_sort(array_distinct(concat("
        "transform(filter(split(host, '[.]'), x -> x <> ''), x -> concat('h:', x)),"
        "transform(filter(split(path, '[^\\\\p{L}\\\\p{N}]+'), x -> x <> '' and not x rlike '^[0-9]+$'),"
        " x -> concat('p:', x)))))"
    )


def token_classes(labelled: DataFrame) -> DataFrame:
    """``token, item`` of the tokens in ``labelled(tokens, bad)`` that stand for another: ``item`` is the least of those in the same urls.

    Sets of urls are equal if their size and two hash sums are. Only tokens of LEAST_URLS urls or more can be in a rule.
    """
    spark = labelled.sparkSession
    known = labelled.where("bad is not null").select("tokens", F.monotonically_increasing_id().alias("url"))
    each = materialise(known, "url-numbers").select(F.explode(F.array_distinct("tokens")).alias("token"), "url")
    support = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("url")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("s2")]
    sums = materialise(each.groupBy("token").agg(*support).where(f"n >= {LEAST_URLS}"), "url-supports")
    least = sums.groupBy("n", "s1", "s2").agg(F.min("token").alias("item"))
    return materialise(sums.join(least, ["n", "s1", "s2"]).where("token <> item").select("token", "item"), "url-classes")


def as_items(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """``tokens, items`` of the distinct ``tokens`` of ``sets``, each token replaced by what stands for it."""
    distinct = sets.select("tokens").distinct()
    if classes.isEmpty():
        return distinct.withColumn("items", F.col("tokens"))
    each = distinct.select("tokens", F.explode_outer("tokens").alias("token")).join(classes, "token", "left")
    # one list for the tokens of one url
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set(F.coalesce("item", "token"))).alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules ``items, verdict, confidence, support, probe`` from ``labelled(tokens, bad boolean)``.

    ``probe`` is the rarest token of the rule. Fewer than LEAST_URLS labelled rows give no rules.
    """
    schema = "items array<string>, verdict string, confidence double, support double, probe string"
    spark = labelled.sparkSession
    known = materialise(labelled.where("bad is not null").select("tokens", "bad"), "url-labels")
    total = known.count()
    if total < LEAST_URLS:
        return spark.createDataFrame([], schema)
    support = max(support, LEAST_URLS / total)
    counts = known.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # at most 1 / support tokens per token of an url are this frequent
    counts = materialise(counts.where(F.col("n") >= support * total), "url-tokens")
    common = [r[0] for r in counts.where(F.col("n") > COMMON * total).collect()]
    label = F.when(F.col("bad"), BLOCK).otherwise(ALLOW)
    usable = F.filter("tokens", lambda t: ~t.isin(common)) if common else F.col("tokens")
    sets = known.select(F.array_append(usable, label).alias("items"))
    growth = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=shuffle_width(spark))
    found = (
        growth.fit(sets)
        .associationRules.select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support")
        .where(F.col("label").isin(BLOCK, ALLOW))
        .where(~F.array_contains("antecedent", BLOCK) & ~F.array_contains("antecedent", ALLOW))
        .select(
            F.array_sort("antecedent").alias("items"),
            F.expr(f"if(label = '{BLOCK}', 'block', 'allow')").alias("verdict"),
            "confidence",
            "support",
        )
    )
    rules = materialise(found, "url-rules")
    # a rule adds nothing if a shorter one with the same verdict is as sure
    subsets = rules.select(
        "items",
        "verdict",
        "confidence",
        F.explode(F.expr("transform(items, x -> array_remove(items, x))")).alias("less"),
    )
    shorter = rules.select(
        F.col("items").alias("less"), F.col("verdict").alias("verdict"), F.col("confidence").alias("sure")
    )
    told = subsets.join(shorter, ["less", "verdict"]).where("sure >= confidence").select("items", "verdict").distinct()
    kept = rules.join(told, ["items", "verdict"], "left_anti")
    rarest = (
        kept.select("items", "verdict", F.explode("items").alias("token"))
        .join(counts, "token")
        .groupBy("items", "verdict")
        .agg(F.min_by("token", F.struct("n", "token")).alias("probe"))
    )
    return kept.join(rarest, ["items", "verdict"]).select("items", "verdict", "confidence", "support", "probe")


def judge_tokens(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens, method_verdict`` of each distinct token set that a rule fits: that of the surest rule."""
    probes = sets.select("tokens", F.explode("tokens").alias("probe"))
    hits = probes.join(rules, "probe").where(F.size(F.array_except("items", "tokens")) == 0)
    order = F.struct("confidence", "support", F.size("items"), F.concat_ws(" ", "items"), "verdict")
    return hits.groupBy("tokens").agg(F.max_by("verdict", order).alias("method_verdict"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    ``labels(doc_id, quality, toxic)`` label the urls whose path ends in the number of a document:
    bad if of low quality or toxic. An url that neither a fixed nor a mined rule fits is allowed. Null
    and malformed urls have empty host and path. Other columns are ignored, repeated rows stay.
    """
    urls = with_rule(parsed(pages.select("page_id", "url")), rules).withColumn("tokens", tokens())
    urls = materialise(urls.drop("url"), "urls")
    number = F.expr("try_cast(regexp_extract(path, '([0-9]{1,18})([.][A-Za-z]+)?/?$', 1) as long)")
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality = 0 or toxic = 1")).alias("bad"))
    labelled = urls.select("tokens", number.alias("doc_id")).join(bad, "doc_id")
    named = materialise(as_items(urls, token_classes(labelled)), "url-items")
    rules = mine(labelled.join(named, "tokens").select(F.col("items").alias("tokens"), "bad"))
    found = judge_tokens(named.select(F.col("items").alias("tokens")).distinct(), rules)
    verdicts = named.join(found.withColumnRenamed("tokens", "items"), "items").select("tokens", "method_verdict")
    return (
        urls.join(verdicts, "tokens", "left")
        .withColumn("verdict", F.coalesce("rule_verdict", "method_verdict", F.lit("allow")))
        .select("page_id", "host", "path", "rule", "verdict")
    )
