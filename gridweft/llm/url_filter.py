"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

Features of a URL: lengths, depth, digit ratio, entropy, parameter counts, hyphens, and statistics of the host's suffix
among all labelled URLs. Trees are fitted on a bounded sample of labelled URLs: features are cut into bins, gradients are
summed by node, feature and bin in one aggregation a level, and the driver, which sees those sums alone, picks splits.
A fitted model is one column expression. Everything runs as DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweft import storage

#: Labelled URLs that the trees are fitted on, at most: those with the smallest hashes.
SAMPLE = 5000
TREES, LEVELS, BINS, RATE, PENALTY = 8, 3, 16, 0.4, 1.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_entropy", "parameters", "hyphens", "suffix_rate", "suffix_count")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and for paths with a prefix."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

#: Words in a host that label a URL as unwanted, for want of rated URLs in the tables.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case for A-Z, and path; both empty without ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    after = url.substr(F.locate("://", url) + 3, F.length(url))
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the columns host and path; null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    units = F.split(text, "")
    size = F.length(text).cast("double")
    part = lambda c: F.size(F.filter(units, lambda x: x == c)) / size
    return F.when(size > 0, F.aggregate(F.array_distinct(units), F.lit(0.0), lambda s, c: s - part(c) * F.log2(part(c)))).otherwise(0.0)


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Rows with url, host and path, and the features; ``suffixes``: suffix, suffix_rate, suffix_count."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    plain = urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": F.regexp_count("path", F.lit("/[^/]+")).cast("double"),
            "host_labels": F.regexp_count("host", F.lit("[^.]+")).cast("double"),
            "digit_ratio": F.when(F.length(url) > 0, F.regexp_count(url, F.lit("[0-9]")) / F.length(url)).otherwise(0.0),
            "host_entropy": _entropy(F.col("host")),
            "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
            "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "suffix": suffix("host"),
        }
    )
    rows = plain.join(suffixes, "suffix", "left")  # as many rows as there are suffixes: Spark broadcasts few, and splits a frequent one of many
    return rows.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})


def suffix(host: str) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


@dataclass
class Tree:
    """Splits by node (root 1, children 2n and 2n + 1) as (feature, threshold), and the values of leaves."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, leaf, node: int = 1) -> Column:
        if node in self.splits:
            name, cut = self.splits[node]
            return F.when(F.col(name) <= F.lit(cut), self.walk(leaf, 2 * node)).otherwise(self.walk(leaf, 2 * node + 1))
        return leaf(node)

    def node(self) -> Column:
        return self.walk(lambda n: F.lit(n))

    def value(self) -> Column:
        return self.walk(lambda n: F.lit(self.leaves.get(n, 0.0)))


@dataclass
class Model:
    """Boosted trees over with_features() of the suffix statistics they were fitted with."""

    base: float
    trees: list[Tree]
    suffixes: DataFrame

    def probability(self) -> Column:
        score = F.lit(self.base)
        for tree in self.trees:
            score = score + tree.value()
        return 1 / (1 + F.exp(-score))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, levels: int = LEVELS) -> Model:
    """Trees from rows (url, unwanted 0/1), at most ``sample`` of them; null urls and labels are left out.

    Suffix statistics count all labelled urls, whether the trees are fitted on them or not.
    Repeats of a url count once, as unwanted if any of them is. Without rows of both kinds the model is their share
    alone (one in two without rows).
    """
    spark = labelled.sparkSession
    host, path = host_path(F.col("url"))
    once = labelled.where("url IS NOT NULL AND unwanted IS NOT NULL").groupBy("url").agg(F.max("unwanted").cast("double").alias("y"))
    once = storage.stored(once.withColumns({"host": host, "path": path}), "url-labelled")
    chosen = storage.stored(once.orderBy(F.xxhash64("url"), "url").limit(sample), "url-sample")
    # A row is left out of its own suffix statistics by shrinking them towards one half.
    stats = once.groupBy(suffix("host").alias("suffix")).agg(((F.sum("y") + 5) / (F.count(F.lit(1)) + 10)).alias("suffix_rate"), F.count(F.lit(1)).cast("double").alias("suffix_count"))
    stats = storage.stored(stats, "url-suffixes")
    rows = storage.stored(with_features(chosen, stats).select("url", "y", *FEATURES), "url-features")
    quantiles = [i / BINS for i in range(1, BINS)]
    found = rows.agg(F.count(F.lit(1)), F.coalesce(F.avg("y"), F.lit(0.5)), *[F.percentile_approx(f, quantiles, 2000) for f in FEATURES]).first()
    share = min(max(found[1], 1e-3), 1 - 1e-3)
    model = Model(math.log(share / (1 - share)), [], stats)
    if not found[0] or found[1] in (0.0, 1.0):
        return model
    cuts = {f: sorted(set(q)) for f, q in zip(FEATURES, found[2:], strict=True)}
    for _ in range(trees):
        tree, p = Tree(), model.probability()
        graded = rows.withColumns({"g": F.col("y") - p, "h": p * (1 - p)})
        for level in range(levels):
            bins = F.array(*[F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in FEATURES])
            sums = graded.select("g", "h", tree.node().alias("node"), F.explode(bins).alias("fb")).groupBy("node", "fb.f", "fb.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            for node in {r["node"] for r in sums if r["node"] >= 2**level}:
                split, parts = _best([r for r in sums if r["node"] == node], cuts)
                if split:
                    tree.splits[node] = split
                for child, (g, h) in zip((2 * node, 2 * node + 1) if split else (node,), parts, strict=True):
                    tree.leaves[child] = RATE * g / (h + PENALTY)
        model.trees.append(tree)
    return model


def _best(sums: list, cuts: dict[str, list[float]]) -> tuple[tuple[str, float] | None, list[tuple[float, float]]]:
    """The split of the highest gain among the sums of one node, and the sums of its parts; without one, of the node.

    Ties go to the first feature and the lower threshold.
    """
    best, found, parts = 1e-6, None, []
    for f in FEATURES:
        own = sorted((r["b"], r["g"], r["h"]) for r in sums if r["f"] == f)
        g, h = sum(x[1] for x in own), sum(x[2] for x in own)
        parts = parts or [(g, h)]
        left_g = left_h = 0.0
        for b, own_g, own_h in own[:-1]:
            left_g, left_h = left_g + own_g, left_h + own_h
            gain = left_g**2 / (left_h + PENALTY) + (g - left_g) ** 2 / (h - left_h + PENALTY) - g**2 / (h + PENALTY)
            if gain > best + 1e-9:
                best, found, parts = gain, (f, float(cuts[f][b])), [(left_g, left_h), (g - left_g, h - left_h)]
    return found, parts


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Verdicts on all urls: (id_col, host, path, rule, verdict, score), one row per row of ``pages``.

    A rule fits its host and all subdomains if the path starts with its own; the longest that fits decides, else the
    model's score: ``threshold`` or more is block. A url that is null or has no ``://`` has an empty host and path and
    no rule; the model judges it by what is left. Rows repeated with the same id are judged on their own, a null id is
    kept, other columns are not read, an empty table gives no rows.
    """
    host, path = host_path(F.col("url"))
    text, verdict = rule_of(rules)
    rows = with_features(pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path}), model.suffixes)
    scored = rows.withColumn("score", model.probability())
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("row_id").alias(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")


def weak_labels(pages: DataFrame) -> DataFrame:
    """URLs labelled by words of their host: unwanted where a label of the host is or has, beside a hyphen, such a word."""
    host, _ = host_path(F.col("url"))
    pattern = r"(^|[.-])(" + "|".join(UNWANTED) + r")([.-]|$)"
    return pages.where(F.col("url").isNotNull()).select("url", F.regexp_like(host, F.lit(pattern)).cast("int").alias("unwanted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: verdicts on all pages by the five rules and trees trained on labelled urls."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, train(weak_labels(pages))).select("page_id", "host", "path", "rule", "verdict")
