"""URL filters: host and path rules, and gradient-boosted trees on lexical features for
the URLs that no rule decides. DataFrame functions and Spark's own trees only."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch, unused

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most about so many distinct labelled URLs are learned from; more are thinned out by a hash.
TRAIN_ROWS = 50_000
#: Parts of the labelled URLs; what is known of a suffix while learning comes from the other parts.
PARTS = 5
FEATURES = ("url_len", "host_len", "path_len", "host_depth", "path_depth", "digit_ratio", "hyphen_ratio", "entropy", "params", "has_fragment", "is_https", "suffix_log_n", "suffix_rate", "tld_rate", "section_rate")
STATISTICS = {"suffix": ("suffix_rate", "suffix_log_n"), "tld": ("tld_rate",), "section": ("section_rate",)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to /, ? or #, A-Z lower-cased, and the path from
    there up to ? or #. Both are empty for null or where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(rules: tuple[tuple[str, str], ...], host: Column, path: Column, value: int) -> Column:
    """Of the longest rule that fits: the rule (value 0) or its verdict (1); null without one."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        at = rule[0].find("/")
        own, start = rule[0][:at], rule[0][at:]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` with the features of its ``url`` that need no other row, and its suffixes."""
    u = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.split(u, "")
    shares = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    labels = F.split(F.col("host"), r"\.")
    return pages.withColumns({
        "url_len": F.length(u).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "host_depth": F.size(labels).cast("double"), "path_depth": (F.size(F.split(F.col("path"), "/")) - 1).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / n, "hyphen_ratio": F.regexp_count(F.col("host"), F.lit("-")) / n, "entropy": F.when(F.length(u) > 0, entropy).otherwise(0.0),
        "params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")), "has_fragment": u.contains("#").cast("double"), "is_https": u.startswith("https:").cast("double"),
        "section": F.coalesce(F.get(F.split("path", "/"), 1), F.lit("")), "tld": F.element_at(labels, -1), "suffix": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
    })


def _rates(known: DataFrame, key: str, prior: float = 5.0) -> DataFrame:
    """Smoothed share of blocked URLs by ``key`` among the labelled ones, and their number: of all (part
    null), and of those outside each part."""
    sums = known.groupBy(key, "part").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("b"))
    whole = sums.groupBy(key).agg(F.sum("n").alias("n_all"), F.sum("b").alias("b_all"))
    parts = sums.join(whole, key).select(key, "part", (F.col("n_all") - F.col("n")).alias("n"), (F.col("b_all") - F.col("b")).alias("b"))
    both = parts.unionByName(whole.select(key, F.lit(None).cast("int").alias("part"), F.col("n_all").alias("n"), F.col("b_all").alias("b")))
    return both.select(key, "part", *(x.alias(n) for n, x in ((f"{key}_rate", (F.col("b") + 0.5 * prior) / (F.col("n") + prior)), (f"{key}_log_n", F.log1p("n"))) if n in STATISTICS[key]))


def _with_statistics(rows: DataFrame, tables: tuple[DataFrame, ...], own_part: bool = False) -> DataFrame:
    """``rows`` with what is known of their suffix, top-level domain and first part of the path, without their own part's labels if ``own_part``."""
    for key, known in zip(STATISTICS, tables, strict=True):
        rows = rows.join(known, [key, "part"], "left") if own_part else rows.join(known.where("part is null").drop("part"), key, "left")
    return rows.fillna({n: 0.0 if n.endswith("log_n") else 0.5 for own in STATISTICS.values() for n in own})


def labelled(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct URLs with a verdict (0/1 in ``label``), how often each stands, and a part by a hash of the URL."""
    known = rows.where("label is not null and url is not null")
    same = [F.first(c).alias(c) for c in ("label", *STATISTICS, *(f for f in FEATURES if not f.startswith(tuple(STATISTICS))))]
    return scratch.keep(known.groupBy("url").agg(F.count("*").cast("double").alias("n"), *same).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")), "labelled")


def train(rows: DataFrame, scratch: Scratch, limit: int = TRAIN_ROWS, trees: int = 12, depth: int = 4) -> tuple[GBTClassificationModel | None, tuple[DataFrame, ...], float]:
    """Trees, the tables of statistics and the share of blocked URLs among the labelled rows.

    The statistics of suffixes and of the path's first part are of all labelled URLs; only the trees are fit on at most about
    ``limit`` distinct ones, chosen by a hash, each weighing as often as it stands. A URL that is learned
    from is given the statistics of the other parts, so that none is told by its own label.
    Labels of one kind only give no trees."""
    known = labelled(rows, scratch)
    tables = tuple(scratch.keep(_rates(known, key), f"rate-{key}") for key in STATISTICS)
    n, blocked, distinct = known.agg(F.sum("n"), F.sum(F.col("n") * F.col("label")), F.count("*")).first()
    share = float(blocked or 0) / n if n else 0.0
    if not 0 < share < 1:
        return None, tables, share
    some = known if distinct <= limit else known.where(F.pmod(F.xxhash64("url", F.lit(3)), F.lit(1 << 40)) < int(limit / distinct * 2**40))
    own = scratch.keep(_with_statistics(some, tables, own_part=True).select("label", "n", *FEATURES), "train")
    if own.select("label").distinct().count() < 2:
        return None, tables, share
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(own).select("label", "n", "features")
    return GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=7, weightCol="n").fit(vectors), tables, share


def judge(pages: DataFrame, scratch: Scratch, rules: tuple[tuple[str, str], ...] = RULES, limit: int = TRAIN_ROWS) -> DataFrame:
    """Every row of ``pages`` (url, ...) with host, path, rule, verdict and score.

    verdict is the longest fitting rule's, else the trees': block where their probability,
    ``score``, is above a half. The URLs that rules decide are what the trees learn from;
    what is known of suffixes is of those too. A null or hostless URL has empty
    host and path and is judged by the trees on the features of an empty text. Where
    all labels are alike or there is none, the rest get the more common label (allow on a
    tie). Other columns of ``pages`` stay, save those named host, path, rule, verdict or score."""
    made = ("host", "path", "rule", "verdict", "score", "label", *STATISTICS, "features", "part", "n", *FEATURES)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    held = {c: unused(pages, f"_kept_{c}") for c in kept if c in made or c.lower() in {"rawprediction", "probability", "prediction"}}
    said = unused(pages, "_said")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(*kept).withColumnsRenamed(held).withColumns({"host": host, "path": path})
    rows = rows.withColumns({"rule": rule_column(rules, F.col("host"), F.col("path"), 0), said: rule_column(rules, F.col("host"), F.col("path"), 1)})
    rows = lexical(rows.withColumn("label", F.when(F.col(said) == "block", 1.0).when(F.col(said) == "allow", 0.0)))
    model, tables, share = train(rows, scratch, limit)
    if model is None:
        scored = rows.withColumn("score", F.lit(share))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_statistics(rows, tables))
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select(*(F.col(held.get(c, c)).alias(c) for c in kept), "host", "path", "rule", F.coalesce(said, own).alias("verdict"), "score")
