"""Operator 2: URL filter: rules by host and path, and gradient-boosted trees for all other URLs.

Features are lexical: lengths, depth, digit ratio, character entropy, counts of parameters and separators, and statistics of the host's last label without its port
(how many labelled URLs have it, and how many of those are blocked; a labelled URL doesn't count itself). The trees are trained on labelled URLs, at most ``TRAINED_ON`` of them, picked by hash. Where no labels
are given, the URLs that a rule judges are the labelled ones. Without two classes of labels every other URL is allowed.

A null URL, or one without ``://``, has an empty host and path. Repeated rows are judged each. Only DataFrame functions and Spark's own learner are used.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwise.llm.store import table, written

#: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TRAINED_ON = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "params", "query", "entropy", "host_entropy", "suffix_seen", "suffix_blocked"]


def host_and_path(url: str) -> tuple[Column, Column]:
    """Of the URL in the named column: host in lower case, and path."""
    rest = F.expr(f"case when locate('://', {url}) > 0 then substring({url}, locate('://', {url}) + 3) end")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits, as (rule, verdict)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, start = rule.split("/", 1)
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return -F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda acc, c: acc + share(c) * F.log2(share(c)))


def lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need the URL alone. rows: url, host, path."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return rows.withColumns({
        "suffix": F.substring_index(F.regexp_replace("host", ":[0-9]*$", ""), ".", -1), "n_url": F.length(url).cast("double"), "n_host": F.length("host").cast("double"), "n_path": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), r"\."), "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "hyphens": count(F.col("host"), "-"), "params": count(url, "[?&][^=&#]+="), "query": (F.instr(url, "?") > 0).cast("double"), "entropy": entropy(url), "host_entropy": entropy(F.col("host")),
    })


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url) to (page_id, host, path, rule, verdict, score). labels: (url, blocked 0 or 1)."""
    host, path = host_and_path("url")
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    judged = lexical(rows)
    if labels is None:
        known = judged.where("hit is not null").withColumn("label", (F.col("hit.verdict") == "block").cast("double"))
    else:
        own, start = host_and_path("url")
        known = lexical(labels.select("url", F.col("blocked").cast("double").alias("label")).withColumn("host", own).withColumn("path", start))
    known = written(known.select("url", "suffix", "label", *FEATURES[:-2]).distinct(), "labelled")
    # One row for each top-level domain.
    stats = written(known.groupBy("suffix").agg(F.count(F.lit(1)).alias("suffix_n"), F.sum("label").alias("suffix_sum")), "suffixes")

    def with_stats(rows: DataFrame, own_n: Column, own_label: Column) -> DataFrame:
        n, blocked = F.coalesce("suffix_n", F.lit(0)) - own_n, F.coalesce("suffix_sum", F.lit(0.0)) - own_label
        return rows.join(stats, "suffix", "left").withColumns({"suffix_seen": F.log1p(n), "suffix_blocked": (blocked + 1) / (n + 2)})

    n = known.count()
    share = min(1_000_000, max(1, TRAINED_ON * 1_000_000 // max(n, 1)))
    picked = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < share)
    picked = with_stats(picked, F.lit(1), F.col("label"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = with_stats(judged, F.lit(0), F.lit(0.0))
    if known.select("label").distinct().count() < 2:
        scored = rows.withColumn("score", F.lit(0.0))
    else:
        train = written(assembler.transform(picked).select("label", "features").repartition(2).sortWithinPartitions("label"), "trained_on")
        fitted = GBTClassifier(maxIter=12, maxDepth=4, seed=7, stepSize=0.2).fit(train)
        scored = fitted.transform(assembler.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
