"""URL filtering: rules first, then gradient-boosted trees on lexical features; DataFrame functions only.

Rules (host, path, verdict) label the URLs that they fit. Trees are grown on a bounded sample of those
labelled URLs: features are binned at the sample's quantiles, each level of a tree is one aggregation of
gradients by node, feature and bin, and the finished trees are column expressions, so scoring is one
narrow projection. Suffix statistics (how often URLs under a host's last label are blocked or allowed) count
all URLs in SUFFIXES hash buckets, a table of bounded size; a labelled URL does not count in its own.

`held_out` says what the trees are worth: they are fitted without a fifth of the hosts and judge these.

Nulls: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by the
trees like any other. Very long URLs are judged whole. Repeated rows are judged each. Ties: of rules of equal
length the first counts, of equal gains the feature named first and its smaller bound; a margin of 0 says allow.
Extra columns stay in `judge`, except for those with the new columns' names. Without labels of both
kinds the trees say what there is, or allow. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, fresh, scratch

SAMPLE, TREES, DEPTH, BINS, RATE, SUFFIXES = 20_000, 8, 3, 16, 0.4, 4096
NEW = ("host", "path", "rule", "verdict", "margin")


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def rule_column(h: Column, p: Column, rules: list[tuple[str, str, str]], out) -> Column:
    """out(rule) of the longest rule (host, path, verdict) that fits, else null."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*(F.when(((h == r[0]) | h.endswith("." + r[0])) & p.startswith(r[1]), F.lit(out(r))) for r in ordered), F.lit(None).cast("string"))


def lexical(url: Column, h: Column, p: Column) -> dict[str, Column]:
    """The lexical features of a whole URL, as doubles."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    count = lambda c, s: F.length(c) - F.length(F.replace(c, F.lit(s)))
    each = F.transform(F.array_distinct(F.filter(F.split(u, ""), lambda c: c != "")), lambda c: F.length(u) - F.length(F.replace(u, c)))
    entropy = F.when(n > 0, F.log2(n) - F.aggregate(each, F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n).otherwise(0.0)
    features = {
        "length": n,
        "host_length": F.length(h),
        "path_length": F.length(p),
        "depth": count(p, "/"),
        "labels": count(h, "."),
        "digits": F.when(n > 0, F.length(F.regexp_replace(u, "[^0-9]", "")) / n).otherwise(0.0),
        "entropy": entropy,
        "parameters": F.when(u.contains("?"), 1).otherwise(0) + count(u, "&"),
        "hyphens": count(h, "-"),
        "fragment": F.when(u.contains("#"), 1).otherwise(0),
    }
    return {k: v.cast("double") for k, v in features.items()}


def suffix_bucket(h: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring_index(h, ".", -1)), F.lit(SUFFIXES)).cast("int")


class Trees:
    """Boosted trees as expressions: splits are (feature, threshold), nodes are numbered as in a heap."""

    def __init__(self, names: list[str], base: float):
        self.names, self.base, self.trees = names, base, []

    def node(self, splits: dict[int, tuple[int, float]], value, depth: int, k: int = 1) -> Column:
        """The node that a row reaches at a depth: its number, or value(number)."""
        if depth == 0 or k not in splits:
            return F.lit(value(k))
        feature, bound = splits[k]
        return F.when(F.col(self.names[feature]) <= bound, self.node(splits, value, depth - 1, 2 * k)).otherwise(self.node(splits, value, depth - 1, 2 * k + 1))

    def over(self, names: dict[str, str]) -> "Trees":
        """The same trees over columns of other names."""
        other = Trees([names[x] for x in self.names], self.base)
        other.trees = self.trees
        return other

    def margin(self) -> Column:
        total = F.lit(self.base)
        for splits, leaves in self.trees:
            total = total + self.node(splits, lambda k, v=leaves: float(v.get(k, 0.0)), DEPTH)
        return total


def grow(sample: DataFrame, names: list[str]) -> Trees:
    """Second-order boosting of the logistic loss over sample's columns names and y (1: block)."""
    n, positive = sample.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        return Trees(names, 5.0 if n and positive == n else -5.0)
    model = Trees(names, math.log(positive / (n - positive)))
    shares = [k / BINS for k in range(1, BINS)]
    cuts = [sorted(set(c)) for c in sample.agg(*(F.percentile_approx(x, shares, 1000).alias(x) for x in names)).first()]
    bins = [sum((F.col(x) > c).cast("int") for c in cut) if cut else F.lit(0) for x, cut in zip(names, cuts, strict=True)]
    sample = scratch(sample.select("y", *names, F.array(*(F.struct(F.lit(i).alias("f"), b.alias("b")) for i, b in enumerate(bins))).alias("cells")).coalesce(2), "binned-urls")
    probability = lambda: 1 / (1 + F.exp(-model.margin()))
    for _ in range(TREES):
        splits: dict[int, tuple[int, float]] = {}
        leaves: dict[int, float] = {}
        p = probability()
        for depth in range(DEPTH):
            rows = sample.select(model.node(splits, int, depth).alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), "cells")
            found = rows.select("node", "g", "h", F.explode("cells").alias("c")).groupBy("node", "c.f", "c.b").agg(F.sum("g"), F.sum("h")).collect()  # nodes x features x BINS rows
            table: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
            for node, f, b, g, h in found:
                table.setdefault(node, {}).setdefault(f, {})[b] = (g, h)
            for node, by in sorted(table.items()):
                g, h = (sum(v[i] for v in by[0].values()) for i in (0, 1))
                leaves[node] = RATE * g / (h + 1)
                best = (1e-6, None)
                for f, hist in sorted(by.items()):
                    gl = hl = 0.0
                    for b in range(len(cuts[f])):
                        x = hist.get(b, (0.0, 0.0))
                        gl, hl = gl + x[0], hl + x[1]
                        if hl > 1 and h - hl > 1:
                            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cuts[f][b], gl, hl))
                if best[1] and node >= 1 << depth:
                    f, bound, gl, hl = best[1]
                    splits[node] = (f, float(bound))
                    leaves[2 * node], leaves[2 * node + 1] = RATE * gl / (hl + 1), RATE * (g - gl) / (h - hl + 1)
        model.trees.append((splits, leaves))
    return model


def fit(labelled: DataFrame, sample: int = SAMPLE) -> tuple[Trees, DataFrame]:
    """The trees and the suffixes' counts (bucket, n, b, a) from rows (url, host, path, label): label may be null."""
    by_suffix = labelled.groupBy(suffix_bucket(F.col("host")).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("b"), F.count_if(F.col("label") == "allow").alias("a"))
    counts = scratch(by_suffix, "suffixes")  # at most SUFFIXES rows
    chosen = labelled.where("label is not null").select("url", "host", "path", (F.col("label") == "block").cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("url"), "url").limit(sample)
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | suffix_features(F.col("y"))
    train = chosen.withColumn("bucket", suffix_bucket(F.col("host"))).join(F.broadcast(counts), "bucket").select("y", *(v.alias(k) for k, v in features.items()))
    return grow(scratch(train, "labelled-urls"), list(features)), counts


def suffix_features(y: Column | None = None) -> dict[str, Column]:
    """From a suffix's counts: how far its URLs are blocked rather than allowed, and how many they are. With y, the label
    of a URL that the counts hold, without that URL."""
    own, one = (F.lit(0.0), F.lit(0)) if y is None else (2 * y - 1, F.lit(1))
    n = F.coalesce("n", F.lit(0)) - one
    return {"suffix_odds": (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0)) - own) / (n + 2), "suffix_rows": F.log1p(n)}


def scored(urls: DataFrame, model: Trees, counts: DataFrame) -> DataFrame:
    """urls (with url, host, path) and the margin, the log-odds of block."""
    bucket, n, b, a = fresh(urls, "bucket", "n", "b", "a")
    counts = counts.select(*(F.col(c).alias(x) for c, x in zip(("bucket", "n", "b", "a"), (bucket, n, b, a), strict=True)))
    joined = urls.withColumn(bucket, suffix_bucket(F.col("host"))).join(F.broadcast(counts), bucket, "left")
    lex = lexical(F.col("url"), F.col("host"), F.col("path"))
    total = F.coalesce(n, F.lit(0))
    values = lex | {"suffix_odds": (F.coalesce(b, F.lit(0)) - F.coalesce(a, F.lit(0))) / (total + 2), "suffix_rows": F.log1p(total)}
    names = dict(zip(values, fresh(joined, *(f"__{k}" for k in values)), strict=True))
    joined = joined.withColumns({names[k]: v for k, v in values.items()})
    return joined.withColumn("margin", Trees.over(model, names).margin()).select(*urls.columns, "margin")


def labelled(urls: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    h, p = host(F.col("url")), path(F.col("url"))
    rows = urls.select("url", h.alias("host"), p.alias("path"))
    return rows.withColumn("label", rule_column(F.col("host"), F.col("path"), rules, lambda r: r[2]))


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE) -> DataFrame:
    """urls with host, path, rule, margin (log-odds of block) and verdict."""
    model, counts = fit(labelled(urls, rules), sample)
    kept = [c for c in urls.columns if c not in NEW]
    rows = urls.select(*kept).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    out = scored(rows, model, counts).withColumn("rule", rule_column(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1]))
    verdict = F.coalesce(rule_column(F.col("host"), F.col("path"), rules, lambda r: r[2]), F.when(F.col("margin") > 0, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).select(*kept, *NEW)


def held_out(urls: DataFrame, rules: list[tuple[str, str, str]], sample: int = SAMPLE) -> DataFrame:
    """One row: labelled URLs of the fifth of hosts that the fit did not see, how many the trees judge as their rule
    does, and how many the more frequent label alone would."""
    rows = labelled(urls, rules).withColumn("out", F.pmod(F.xxhash64("host"), F.lit(5)) == 0)
    model, counts = fit(rows.where(~F.col("out")).drop("out"), sample)
    test = scored(rows.where(F.col("out") & F.col("label").isNotNull()), model, counts)
    block = F.col("label") == "block"
    return test.agg(F.count("*").alias("n"), F.count_if(block == (F.col("margin") > 0)).alias("right"), F.greatest(F.count_if(block), F.count_if(~block)).alias("base"))
