"""URL filters: domain rules, and gradient-boosted trees on lexical features.

Rules decide the URLs they fit; these are also the labelled URLs on which the
trees are trained, and the trees judge the rest.  Features: lengths, path
depth, digit ratio, character entropy, parameter counts, and the statistics of
the host's suffix over all pages (its share of the pages and, from labelled
pages, how often it is blocked).  Everything is DataFrame expressions and
Spark's own tree learner.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_unique, sampled, written

#: (verdict, rule): host and path joined, as in a filter list.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/")]

TRAIN_ROWS = 100_000     # bound of the labelled sample the trees are fitted on
TREES, DEPTH, SEED = 20, 4, 7

FEATURES = ["url_length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio",
            "entropy", "parameters", "fragment", "hyphens", "longest_digits", "suffix_share", "suffix_block"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  The
    rules become one expression: meant for lists of up to some thousands."""
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):    # the longest is tested first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character: one pass over the sorted characters."""
    chars = F.sort_array(F.split(text, ""))
    n = F.length(text)
    nlogn = lambda k: F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.when(
        a["c"] == c, F.struct(c.alias("c"), (a["k"] + 1).alias("k"), a["s"].alias("s"))
    ).otherwise(F.struct(c.alias("c"), F.lit(1).alias("k"), (a["s"] + nlogn(a["k"])).alias("s")))
    return F.when(n > 0, F.aggregate(chars, start, step, lambda a: F.log2(n.cast("double")) - (a["s"] + nlogn(a["k"])) / n)).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with the lexical features and the suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x)))).cast("double")
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    runs = F.split(F.regexp_replace(url, "[^0-9]+", " "), " ")
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": count(F.col("path"), "/"),
        "labels": count(F.col("host"), "."),
        "digit_ratio": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(F.lit(0.0)),
        "entropy": entropy(url),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(F.lit(0.0)),
        "fragment": url.contains("#").cast("double"),
        "hyphens": count(F.col("host"), "-"),
        "longest_digits": F.array_max(F.transform(runs, F.length)).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               train_rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_score.

    The rule's verdict holds where a rule fits (``rule`` not null); otherwise
    the trees block where they give block at least 0.5.  If the rules label
    only one class there is nothing to separate and it is the verdict of all;
    with no labelled page at all everything is allowed with score 0.  Null
    URLs and URLs without ``://`` have empty host and path and are judged by
    the trees.  Repeated rows are judged alike.  An empty table gives no rows;
    other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumn("host", host).withColumn("path", path)
    urls = urls.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
    urls = lexical(urls.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given")))
    blocked = (F.col("given") == "block").cast("double")
    base = written(urls.withColumn("label", blocked).drop("url"), "url-features")

    stats = base.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("blocked"))
    stats = written(stats, "url-suffixes")
    total, labelled, bad = stats.agg(F.sum("n"), F.sum("labelled"), F.sum("blocked")).first()
    if not labelled or bad in (0, labelled):
        score = 1.0 if labelled and bad else 0.0
        return _result(base.withColumn("block_score", F.lit(score)))
    prior = bad / labelled
    stats = stats.select("suffix", "n", (F.col("n") / total).alias("suffix_share"),
                         ((F.coalesce("blocked", F.lit(0.0)) + 10 * prior) / (F.col("labelled") + 10)).alias("suffix_block"))
    rows = join_unique(base, stats, "suffix", "n", F.col("page_id")).drop("n")
    rows = written(rows.withColumn("features", F.array(*FEATURES)).select("page_id", "host", "path", "rule", "given", "label", "features"), "url-rows")

    part = sampled(min(1.0, train_rows / labelled), "page_id", "host", "path")
    train = rows.where(F.col("label").isNotNull() & part).select(array_to_vector("features").alias("features"), "label")
    train = written(train, "url-train").coalesce(4)
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        return _result(rows.withColumn("block_score", F.lit(prior)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=SEED, featuresCol="features", labelCol="label").fit(train)
    scored = model.transform(rows.withColumn("features", array_to_vector("features")))
    return _result(scored.withColumn("block_score", vector_to_array("probability")[1]))


def _result(rows: DataFrame) -> DataFrame:
    by_trees = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("given", by_trees).alias("verdict"), "block_score")
