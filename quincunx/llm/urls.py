"""URL filters: rules by host and path first, boosted trees over lexical features for the rest.

Trees are grown with aggregations over a bounded sample and become one SQL expression, so
every url is judged inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quincunx.llm.common import written

TRAINING_ROWS = 20_000
HALVES = 5  # seed of the hash that parts the urls of the trees from those of the suffix statistics
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
    "suffix_share", "suffix_pages",
)


def parsed(pages: DataFrame, key: str, url: str) -> DataFrame:
    """(page_id, url, host, path): after the first ``://``; both empty without one."""
    value = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(value, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(value, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(key).alias("page_id"), value.alias("url"), host.alias("host"), path.alias("path"))


def rule_column(rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``host/path`` that fits a row, as {rule, verdict}; null if none does."""
    longest = sorted(rules, key=lambda r: (-len(r[0]), r))
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(longest):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)

    def part(c: Column) -> Column:
        share = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return -share * F.log2(share)

    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a + part(c))


def with_features(rows: DataFrame) -> DataFrame:
    """Adds the lexical features; those of the suffix come from all rows.

    ``suffix_share`` is the share of blocked ones among the suffix's labelled rows, drawn to
    one half where there are few, and ``suffix_pages`` the log of its pages.  Half of all urls,
    by a hash, give that share and the others (``learns``) teach the trees, so that no url
    learns from its own label.
    """
    rows = rows.withColumns({
        "_suffix": F.regexp_extract("host", r"([^.]*)$", 1),
        "learns": F.pmod(F.xxhash64(F.lit(HALVES), "url"), F.lit(2)) == 1,
    })
    verdict = F.when(~F.col("learns"), F.col("label.verdict"))
    suffixes = rows.groupBy("_suffix").agg(
        ((F.count_if(verdict == "block") + 5) / (F.count(verdict) + 10)).alias("suffix_share"),
        F.log(F.count("*") + 1.0).alias("suffix_pages"),
    )
    size = F.greatest(F.length("url"), F.lit(1))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return rows.join(suffixes, "_suffix").withColumns({
        "url_length": F.length("url").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
        "labels": F.regexp_count("host", F.lit("[.]")).cast("double"),
        "digit_ratio": F.regexp_count("url", F.lit("[0-9]")) / size,
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "entropy": entropy(F.col("host")),
        "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
    }).drop("_suffix")


def _best_splits(sums: list, nodes: list[int], ridge: float, least: float) -> dict[int, tuple[str, int]]:
    """For each node the (feature, bin) with the greatest gain; bins up to it go left."""
    cells: dict[int, dict[str, list]] = {}
    for r in sums:
        cells.setdefault(r.node, {}).setdefault(r.feature, []).append((r.bin, r.g, r.h))
    score = lambda g, h: g * g / (h + ridge)
    chosen = {}
    for node in nodes:
        best = 1e-3
        for feature, bins in sorted(cells.get(node, {}).items()):
            bins.sort()
            g, h = sum(b[1] for b in bins), sum(b[2] for b in bins)
            gl = hl = 0.0
            for number, bg, bh in bins[:-1]:
                gl, hl = gl + bg, hl + bh
                gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                if 4 * min(hl, h - hl) >= least and gain > best + 1e-9:
                    best, chosen[node] = gain, (feature, number)
    return chosen


def fit_trees(
    sample: DataFrame, label: str, features: tuple[str, ...], *, trees: int = 8, depth: int = 3, bins: int = 16,
    rate: float = 0.4, ridge: float = 1.0, least: float = 8.0,
) -> Column:
    """Log-odds of ``label`` = 1 as an expression over the features.

    Each level of a tree is one aggregation of gradients by (node, feature, bin); what comes
    to the driver has at most nodes x features x bins rows, whatever the sample.
    """
    shares = [k / bins for k in range(1, bins)]
    stats = sample.agg(F.avg(label).alias("y"), *[F.percentile(f, F.array(*map(F.lit, shares))).alias(f) for f in features]).first()
    share = min(max(stats.y if stats.y is not None else 0.5, 1e-3), 1 - 1e-3)
    margin = F.lit(math.log(share / (1 - share)))
    if stats.y in (None, 0.0, 1.0):
        return margin
    cuts = {f: sorted(set(stats[f])) for f in features}
    bin_of = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in features}
    binned = sample.select(label, *features, *[b.alias(f"_b_{f}") for f, b in bin_of.items()])
    for _ in range(trees):
        p = 1 / (1 + F.exp(-margin))
        graded = binned.withColumns({"_g": p - F.col(label), "_h": p * (1 - p)})
        splits: dict[int, tuple[str, float]] = {}
        nodes = [1]
        node = F.lit(1)
        for _ in range(depth):
            cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_b_{f}").alias("bin")) for f in features])
            sums = (
                graded.select(node.alias("node"), F.explode(cells).alias("c"), "_g", "_h")
                .groupBy("node", "c.feature", "c.bin").agg(F.sum(F.round("_g", 9)).alias("g"), F.sum(F.round("_h", 9)).alias("h"))
                .collect()
            )
            found = _best_splits(sums, nodes, ridge, least)
            splits |= {n: (f, cuts[f][b]) for n, (f, b) in found.items()}
            node = _node(splits)
            nodes = [m for n in found for m in (2 * n, 2 * n + 1)]
            if not nodes:
                break
        weights = {
            r.node: -rate * r.g / (r.h + ridge)
            for r in graded.select(node.alias("node"), "_g", "_h").groupBy("node").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()
        }
        margin = margin + _leaf(splits, weights, 1)
    return margin


def _node(splits: dict[int, tuple[str, float]], at: int = 1) -> Column:
    if at not in splits:
        return F.lit(at)
    feature, cut = splits[at]
    return F.when(F.col(feature) <= cut, _node(splits, 2 * at)).otherwise(_node(splits, 2 * at + 1))


def _leaf(splits: dict[int, tuple[str, float]], weights: dict[int, float], at: int) -> Column:
    if at not in splits:
        return F.lit(float(weights.get(at, 0.0)))
    feature, cut = splits[at]
    return F.when(F.col(feature) <= cut, _leaf(splits, weights, 2 * at)).otherwise(_leaf(splits, weights, 2 * at + 1))


def judged_urls(
    pages: DataFrame, rules: list[tuple[str, str]], *, most: int = TRAINING_ROWS, seed: int = 11, key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    Urls that a rule fits are the labelled ones; the trees learn from at most ``most``
    different ones of half of them, those with the smallest hashes, and judge the others:
    block where the log-odds ``score`` are positive.  Without both labels among them the one
    there is holds, and allow without any.  Null, empty and odd urls have empty host and path and are judged by
    their features too.
    """
    rows = parsed(pages, key, url).withColumn("label", rule_column(rules))
    ready = written(with_features(rows), "urls")
    labelled = ready.where("label IS NOT NULL AND learns").withColumn("y", (F.col("label.verdict") == "block").cast("double"))
    different = labelled.select("url", "y", *FEATURES).distinct()
    sample = different.orderBy(F.xxhash64(F.lit(seed), "url"), "url").limit(most).select("y", *FEATURES)
    score = fit_trees(written(sample, "sample"), "y", FEATURES)
    method = F.when(score > 0, "block").otherwise("allow")
    return ready.select(
        "page_id", "host", "path", F.col("label.rule").alias("rule"),
        F.coalesce(F.col("label.verdict"), method).alias("verdict"), score.alias("score"),
    )
