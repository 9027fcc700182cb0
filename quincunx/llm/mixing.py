"""Mixing sources to target weights by hierarchical budgets and seeded token prefixes.

Budgets flow down a tree, such as domain - language - source.  At each node they are dealt
to the children by weight; what a child can't use, since its tokens times the allowed
epochs are less, goes to its siblings by their weights, and only what no sibling can use
stays with the parent's level above.  Each leaf then takes whole epochs and a prefix, in
tokens, of one more epoch in a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quincunx.llm.common import WORD, written

SLOT_ROWS = 10_000  # documents of a leaf whose order is decided together

ORDER_HEX = 12  # hexadecimal digits of the number that orders a leaf's documents


def words(text: str = "text") -> Column:
    """A token count that needs no vocabulary: the words of the text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def order_number(seed: int, epoch: Column, key: Column) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")))
    return F.conv(F.substring(digest, 1, ORDER_HEX), 16, 10).cast("long")


def weight_of(levels: list[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The weight of a node among its siblings, 1 unless given."""
    weight = F.lit(1.0)
    for path, value in weights.items():
        if len(path) == len(levels):
            here = F.lit(True)
            for name, part in zip(levels, path, strict=True):
                here = here & (F.col(name) == part)
            weight = F.when(here, F.lit(float(value))).otherwise(weight)
    return weight


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget`` to the children ``nodes``(parent..., name, weight, capacity, given).

    Children in order of capacity per weight: each is filled if what is left at that point
    would give it at least its capacity; the others share the rest by weight.
    """
    by = Window.partitionBy(*parent).orderBy("_need", name)
    whole = Window.partitionBy(*parent)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("given") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    nodes = nodes.withColumn("_need", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    nodes = nodes.withColumn("_full", (F.col("weight") > 0) & (F.col("_need") * F.sum("weight").over(after) <= left))
    rest = F.col("given") - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0.0)).over(whole)
    open_weight = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(whole)
    share = F.when(F.col("weight") > 0, rest * F.col("weight") / open_weight).otherwise(0.0)
    return nodes.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(share)).drop("_need", "_full")


def budgets(
    leaves: DataFrame, levels: list[str], weights: Mapping[tuple[str, ...], float], total: float, epochs: float
) -> DataFrame:
    """(levels..., tokens, docs, budget) from one row per leaf; a node of weight 0 gets nothing.

    The tree is small: one row for each leaf, dealt level by level from the root.
    """
    usable = leaves.withColumn("capacity", F.col("tokens") * F.lit(float(epochs)))
    for depth in range(1, len(levels) + 1):  # a branch of weight 0 can't lend its tokens
        usable = usable.withColumn("capacity", F.when(weight_of(levels[:depth], weights) > 0, F.col("capacity")).otherwise(0.0))
    given = None
    for depth, name in enumerate(levels):
        nodes = usable.groupBy(*levels[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", F.when(F.col("capacity") > 0, weight_of(levels[: depth + 1], weights)).otherwise(0.0))
        if given is None:
            held = F.least(F.lit(float(total)), F.sum("capacity").over(Window.partitionBy()))
            nodes = nodes.withColumn("given", held)
        else:
            nodes = nodes.join(given.select(*levels[:depth], F.col("budget").alias("given")), levels[:depth])
        given = deal(nodes, levels[:depth], name).select(*levels[: depth + 1], "budget")
    return leaves.join(given, levels).withColumn("budget", F.floor(F.col("budget") + 1e-6))


def mix(
    docs: DataFrame, levels: Mapping[str, str], weights: Mapping[tuple[str, ...], float], *, share: float, epochs: int,
    seed: int, tokens: Column | None = None, key: str = "doc_id",
) -> DataFrame:
    """(doc_id, levels..., tokens, epochs, taken, mixed_tokens) of the rows with a part in the mix.

    ``levels`` maps the tree's levels, root first, to SQL over ``docs``; a null level is the
    node ''.  ``share`` is the size of the mix against all tokens.  ``epochs`` whole passes
    take a row entirely; ``taken`` counts the tokens of one more, partial pass, where the
    last row of a leaf may be cut.  Rows with equal keys are ordered by their tokens, and
    rows without tokens have no part.  The running sums of a leaf go over slots of its
    seeded order, so a leaf may hold any share of the corpus.
    """
    names = list(levels)
    count = words() if tokens is None else tokens
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        *[F.coalesce(F.expr(sql).cast("string"), F.lit("")).alias(n) for n, sql in levels.items()],
        count.cast("long").alias("tokens"),
    )
    rows = written(rows.where("tokens > 0"), "rows")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = written(leaves, "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, names, weights, float(int(total * share)), epochs).select(
        *names,
        F.floor(F.col("budget") / F.col("tokens")).alias("epochs"),
        (F.col("budget") % F.col("tokens")).alias("partial"),
        F.ceil(F.col("docs") / SLOT_ROWS).alias("_slots"),
    )
    plan = written(plan, "plan")
    placed = rows.join(plan, names).withColumn("_at", order_number(seed, F.col("epochs"), F.col("doc_id")))
    placed = placed.withColumn("_slot", F.floor(F.col("_at") * F.col("_slots") / float(16**ORDER_HEX)))
    sums = placed.groupBy(*names, "_slot").agg(F.sum("tokens").alias("_sum"))
    over = Window.partitionBy(*names).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, "_slot", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*names, "_slot").orderBy("_at", "doc_id", "tokens")
    inner = inner.rowsBetween(Window.unboundedPreceding, -1)
    done = F.col("_before") + F.coalesce(F.sum("tokens").over(inner), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("partial") - done))
    chosen = placed.join(sums, [*names, "_slot"]).withColumn("taken", taken)
    mixed = F.col("epochs") * F.col("tokens") + F.col("taken")
    return chosen.select("doc_id", *names, "tokens", "epochs", "taken", mixed.alias("mixed_tokens")).where("mixed_tokens > 0")


def mixed(
    docs: DataFrame, levels: Mapping[str, str], weights: Mapping[tuple[str, ...], float], *, share: float, seed: int,
    key: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` with a part in a mix of one epoch at most, whole, with all columns.

    Rows without tokens or without a key have no part.
    """
    chosen = mix(docs, levels, weights, share=share, epochs=1, seed=seed, key=key)
    return docs.join(chosen.select(F.col("doc_id").alias(key)).distinct(), key, "left_semi").select(*docs.columns)
