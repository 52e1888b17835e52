"""URL filter: rules first, then gradient-boosted trees on lexical features.

The trees are trained from labelled URLs. Besides lengths, depth, ratios, entropy
and parameter counts they see suffix statistics: how often URLs with the same end
of the host, or the same first part of the path, were labelled to be blocked.
The trees are fitted to a bounded sample; the statistics are of all labelled URLs.

Only DataFrame functions and Spark's own trees are used. Defined results: a null
URL, or one without `://`, has an empty host and path and is judged by the trees;
with labels of one kind only, or none, every URL without a rule gets that kind,
or allow; an empty table gives an empty result.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import packed, stored, unpacked
from parlance.llm.urls import host_of, path_of, query_of


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains, where the path starts with `path`."""

    host: str
    path: str
    block: bool

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class UrlModel:
    """Training takes at most `max_labelled` labelled URLs, by a hash of the URL;
    suffixes are counted over all of them."""

    max_labelled: int = 20_000
    smoothing: float = 5.0
    trees: int = 20
    depth: int = 3
    threshold: float = 0.5
    seed: int = 3


SUFFIXES = ("last_label", "last_labels", "section")
FEATURES = (
    "n_chars", "host_chars", "path_chars", "n_labels", "depth", "digit_ratio", "host_digits",
    "n_hyphens", "n_params", "query_chars", "entropy", "secure", "fragment",
    *(f"{s}_{kind}" for s in SUFFIXES for kind in ("rate", "count")),
)


def matched_rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits (host, path), as (rule, block); null if none does."""
    found = F.lit(None).cast("struct<rule:string,block:boolean>")
    # The longest is tested first; ties go by name.
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        on_host = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
        fits = on_host & F.startswith("path", F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.block).alias("block"))).otherwise(found)
    return found


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.length(text).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size,
    )
    total = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(size > 0, total).otherwise(0.0)


def with_lexical(urls: DataFrame) -> DataFrame:
    """Add host, path, the lexical features and the suffixes to a table with `url`."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_query": query_of(F.col("url"))})
    labels = F.split("host", r"\.")
    return parts.withColumns({
        "n_chars": F.length(url),
        "host_chars": F.length("host"),
        "path_chars": F.length("path"),
        "n_labels": F.size(labels),
        "depth": _count(F.col("path"), "/"),
        "digit_ratio": _count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": _count(F.col("host"), "0123456789"),
        "n_hyphens": _count(url, "-"),
        "n_params": F.when(F.col("_query") == "", 0).otherwise(1 + _count(F.col("_query"), "&")),
        "query_chars": F.length("_query"),
        "entropy": _entropy(url),
        "secure": F.startswith(url, F.lit("https://")).cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "last_label": F.element_at(labels, -1),
        "last_labels": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)),
        "section": F.regexp_extract("path", r"^/([^/]*)", 1),
    }).drop("_query")


FOLDS = 5


def _fold(how: UrlModel) -> Column:
    return F.pmod(F.xxhash64(F.lit(how.seed + 1), F.col("url")), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame, how: UrlModel) -> DataFrame:
    """(suffix, value, fold, n, blocked) for each suffix that is labelled; the null fold has all."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("suffix"), F.col(s).alias("value")) for s in SUFFIXES)))
    folds = stored(
        labelled.select(each.alias("at"), _fold(how).alias("fold"), "block").groupBy("at.suffix", "at.value", "fold")
        .agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("blocked"))
    )
    every = folds.groupBy("suffix", "value").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
    return folds.unionByName(every.withColumn("fold", F.lit(None).cast("int")))


def with_statistics(urls: DataFrame, counts: DataFrame, how: UrlModel, training: bool = False) -> DataFrame:
    """Add each suffix's smoothed share of blocked URLs and its count.

    A training row's fold is taken out of the counts. To take out its own label
    alone would show the label: the share is lower for each blocked row. The
    counts are stored, and their size decides whether they are broadcast.
    """
    out = urls
    for s in SUFFIXES:
        mine = counts.where(F.col("suffix") == s)
        for part, kept in (("all", F.col("fold").isNull()), *([("own", F.col("fold").isNotNull())] if training else [])):
            found = mine.where(kept).select(
                F.col("value").alias(s), *([F.col("fold").alias("_fold")] if part == "own" else []),
                F.col("n").alias(f"_n_{part}"), F.col("blocked").alias(f"_b_{part}"),
            )
            on = [s, "_fold"] if part == "own" else [s]
            out = (out.withColumn("_fold", _fold(how)) if part == "own" else out).join(found, on, "left")
        n, b = F.coalesce("_n_all", F.lit(0)), F.coalesce("_b_all", F.lit(0))
        if training:
            n, b = n - F.coalesce("_n_own", F.lit(0)), b - F.coalesce("_b_own", F.lit(0))
        out = out.withColumns({
            f"{s}_rate": (b + how.smoothing / 2) / (n + how.smoothing),
            f"{s}_count": F.log1p(n.cast("double")),
        }).drop("_n_all", "_b_all", "_n_own", "_b_own", "_fold")
    return out


def judged_urls(
    urls: DataFrame, labelled: DataFrame | None = None, rules: Sequence[Rule] = (), how: UrlModel = UrlModel()
) -> DataFrame:
    """Add host, path, rule and verdict to a table with a column `url`.

    `labelled` has (url, block); without it, the URLs that a rule fits are the
    labelled ones.
    """
    lexical = with_lexical(packed(urls, url="url")).withColumn("fit", matched_rule(rules))
    if labelled is None:
        known = lexical.where("fit IS NOT NULL").withColumn("block", F.col("fit.block"))
    else:
        known = with_lexical(labelled.where("block IS NOT NULL").select("url", "block"))
    sample = stored(
        known.select(*(f for f in FEATURES if not f.endswith(("_rate", "_count"))), *SUFFIXES, "block", "url")
        .orderBy(F.xxhash64(F.lit(how.seed), "url"), "url", "block").limit(how.max_labelled)
    )
    kinds = {r["block"] for r in sample.select("block").distinct().collect()}
    if len(kinds) < 2:
        scored = lexical.withColumn("_block", F.lit(True in kinds))
    else:
        counts = stored(suffix_counts(known, how))
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        trees = GBTClassifier(
            featuresCol="_features", labelCol="_label", predictionCol="_predicted",
            maxIter=how.trees, maxDepth=how.depth, seed=how.seed,
        ).setRawPredictionCol("_raw").setProbabilityCol("_p")
        # The sample is bounded; a few partitions keep the many small training jobs short.
        rows = with_statistics(sample, counts, how, training=True).withColumn("_label", F.col("block").cast("double"))
        model = trees.fit(assembler.transform(rows.coalesce(2)).select("_features", "_label"))
        every = assembler.transform(with_statistics(lexical, counts, how))
        scored = model.transform(every).withColumn("_block", vector_to_array("_p")[1] >= how.threshold)
    block = F.coalesce(F.col("fit.block"), F.col("_block"))
    done = scored.withColumn("rule", F.col("fit.rule")).withColumn(
        "verdict", F.when(block, F.lit("block")).otherwise(F.lit("allow"))
    )
    return unpacked(done, urls.columns, ["host", "path", "rule", "verdict"])
