"""URL filter: host and path rules first, then gradient-boosted trees on lexical
features of the URL.

The labelled URLs are those that a rule decides. Their features are gathered for a
bounded sample, the trees are grown on the driver from that sample, and scoring is
one SQL expression over the trees: the executors run DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import hash_sample

# The rules, each a host and the start of a path with its verdict.
RULES = {
    "com/": "allow",
    "example.com/en/": "block",
    "www.example.com/en/": "allow",
    "net/es/": "block",
    "net/fr/": "block",
}

FEATURES = ["url_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "host_length", "longest_label", "hyphens", "suffix_block_rate"]
FOLDS = 5
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?=&%#"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from
    there up to ? # or the end. Both empty without a ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits the host (or a parent of it) and the path's start."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is tested first
        at = rule.index("/")
        fits = ((host == rule[:at]) | F.endswith(host, F.lit("." + rule[:at]))) & F.startswith(path, F.lit(rule[at:]))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def lexical_features(pages: DataFrame) -> DataFrame:
    """pages (url, host, path) with the lexical columns of FEATURES and `suffix`, the
    last two labels of the host."""
    url = F.coalesce(F.col("url"), F.lit(""))
    low, n = F.lower(url), F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda c, text=low: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    others = F.length(F.translate(low, _ALPHABET, "")).cast("double")  # all other characters count as one
    entropy = F.lit(0.0)
    for share in [*(count(c) / n for c in _ALPHABET), others / n]:
        entropy = entropy + F.when(share > 0, -share * F.log2(share)).otherwise(0.0)
    labels = F.split(F.col("host"), r"\.")
    return pages.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("path").cast("double").alias("path_length"),
        count("/", F.col("path")).alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_ratio"),
        entropy.alias("entropy"),
        F.when(F.locate("?", url) > 0, 1.0 + count("&", url)).otherwise(0.0).alias("parameters"),
        F.size(labels).cast("double").alias("host_labels"),
        F.length("host").cast("double").alias("host_length"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        count("-", url).alias("hyphens"),
        F.array_join(F.reverse(F.slice(F.reverse(labels), 1, 2)), ".").alias("suffix"),
    )


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def sql(self) -> str:
        if self.low is None:
            return repr(self.value) + "D"
        return f"CASE WHEN {FEATURES[self.feature]} <= {self.cut!r}D THEN {self.low.sql()} ELSE {self.high.sql()} END"

    def add_to(self, x: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
        if self.low is None:
            out[at] += self.value
            return
        left = x[at, self.feature] <= self.cut
        self.low.add_to(x, out, at[left])
        self.high.add_to(x, out, at[~left])


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, depth: int, rate: float, bins: int, ridge: float) -> Node:
    """A tree for gradients g and curvatures h, split at quantile cuts by gain."""
    best, gs, hs = (1e-6, -1, 0.0), g[at].sum(), h[at].sum()
    if depth and len(at) > 10:
        for f in range(x.shape[1]):
            values = x[at, f]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            cuts = cuts[cuts < values.max()]
            if not len(cuts):
                continue
            slot = np.searchsorted(cuts, values, side="left")
            gl = np.cumsum(np.bincount(slot, g[at], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(slot, h[at], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(cuts[k]))
    if best[1] < 0:
        return Node(value=float(-rate * gs / (hs + ridge)))
    left = x[at, best[1]] <= best[2]
    return Node(feature=best[1], cut=best[2], low=_grow(x, g, h, at[left], depth - 1, rate, bins, ridge), high=_grow(x, g, h, at[~left], depth - 1, rate, bins, ridge))


@dataclass
class UrlModel:
    prior: float
    trees: list[Node]
    suffix_rates: dict[str, float]
    base_rate: float

    def with_suffix_rate(self, rows: DataFrame) -> DataFrame:
        rates = F.lit(None).cast("double")
        for suffix, rate in self.suffix_rates.items():
            rates = F.when(F.col("suffix") == suffix, F.lit(rate)).otherwise(rates)
        return rows.withColumn("suffix_block_rate", F.coalesce(rates, F.lit(self.base_rate)))

    def margin(self) -> Column:
        return F.expr(" + ".join([repr(self.prior) + "D", *(f"({t.sql()})" for t in self.trees)]))


def _suffix_rates(suffixes: list[str], y: np.ndarray, base: float, most: int) -> dict[str, float]:
    """The commonest suffixes' shares of block, drawn towards the base rate."""
    count: dict[str, list[float]] = {}
    for s, label in zip(suffixes, y, strict=True):
        c = count.setdefault(s, [0.0, 0.0])
        c[0], c[1] = c[0] + 1, c[1] + float(label)
    top = sorted(count, key=lambda s: (-count[s][0], s))[:most]
    return {s: (count[s][1] + 5 * base) / (count[s][0] + 5) for s in top}


def train_trees(x: np.ndarray, y: np.ndarray, suffixes: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 16, ridge: float = 1.0, max_suffixes: int = 50) -> UrlModel:
    """Logistic gradient boosting, y = 1 for block. x has all features but the last,
    which is the smoothed block rate of a URL's suffix; at most max_suffixes of the
    commonest suffixes are kept, all others have the base rate. The trees see rates from
    the other FOLDS - 1 parts of the rows, so that no row's label is in its own feature."""
    if not len(y):
        return UrlModel(-1.0, [], {}, 0.0)
    base = float(y.mean())
    fold = np.arange(len(y)) % FOLDS
    rates = _suffix_rates(suffixes, y, base, max_suffixes)
    others = [_suffix_rates([s for s, f in zip(suffixes, fold, strict=True) if f != k], y[fold != k], base, max_suffixes) for k in range(FOLDS)]
    x = np.column_stack([x, [others[f].get(s, base) for s, f in zip(suffixes, fold, strict=True)]])
    p = min(max(base, 1e-3), 1 - 1e-3)
    model = UrlModel(math.log(p / (1 - p)), [], rates, base)
    margin = np.full(len(y), model.prior)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(x, q - y, q * (1 - q), np.arange(len(y)), depth, rate, bins, ridge)
        tree.add_to(x, margin, np.arange(len(y)))
        model.trees.append(tree)
    return model


def fit(featured: DataFrame, rules: dict[str, str], max_rows: int = 5000) -> UrlModel:
    """Train on at most max_rows URLs that a rule decides, those with the smallest
    hash: the documented bound of what reaches the driver."""
    blocked = F.col("rule").isin([r for r, v in rules.items() if v == "block"])
    decided = featured.filter(F.col("rule").isNotNull()).select("page_id", "url", "suffix", *FEATURES[:-1], blocked.cast("int").alias("y"))
    sample = hash_sample(decided, ["page_id", "url"], max_rows).drop("page_id", "url").collect()
    x = np.array([[r[f] for f in FEATURES[:-1]] for r in sample], np.float64).reshape(len(sample), len(FEATURES) - 1)
    return train_trees(x, np.array([r["y"] for r in sample], np.float64), [r["suffix"] for r in sample])


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, max_rows: int = 5000) -> DataFrame:
    """page_id, host, path, rule, verdict and block_probability (null where a rule
    decides) for every row of pages.

    A null url, or one without ://, has an empty host and path, fits no rule and is
    judged by the trees on empty features. Repeated rows are judged each; a null
    page_id stays null; long URLs count whole; other columns are ignored; an empty
    table gives an empty result. Without any URL that a rule
    decides, there are no trees and every verdict is allow.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = lexical_features(rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)))
    model = fit(rows, rules, max_rows)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    scored = model.with_suffix_rate(rows).withColumn("margin", F.when(F.col("rule").isNull(), model.margin()))
    return scored.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule",
        F.coalesce(by_rule, F.when(F.col("margin") > 0, "block").otherwise("allow")).alias("verdict"),
        (1 / (1 + F.exp(-F.col("margin")))).alias("block_probability"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
