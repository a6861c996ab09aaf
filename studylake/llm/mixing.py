"""Operator 2: mixing sources to target weights by hierarchical budgeting.

A token budget flows down the tree domain - language - source. Siblings share their parent's budget by weight; what one
cannot supply goes to its siblings, and only what the whole subtree lacks goes to the parent's siblings. Each leaf then
takes its budget from seeded epochs: whole passes, and a prefix of the next pass in that epoch's own order.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEVELS = ("domain", "lang", "source")
#: Leaf tables up to so many rows (about 300 bytes each) go to the documents by broadcast; larger ones are joined by shuffle.
BROADCAST_LEAVES = 50_000


@dataclass(frozen=True)
class Plan:
    """Weights by name for each level (others weigh `default`; 0 leaves a node out), the budget as a share of all
    tokens, how often a leaf may be repeated, and the seed of the epochs' orders."""

    weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    default: int = 1
    share: tuple[int, int] = (1, 2)
    epochs: int = 1
    seed: int = 0


def words(text: Column) -> Column:
    """The token measure used unless another is given: runs of characters other than white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def leaf_columns(domain: Column, lang: Column, source: Column) -> list[Column]:
    """The tree's columns; null counts as a name of its own, the empty one."""
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEVELS, (domain, lang, source))]


def order_key(plan: Plan, epoch: Column, id_text: Column) -> Column:
    """A document's place in an epoch of its leaf: pseudo-random, distinct for distinct ids."""
    return F.concat(F.md5(F.concat_ws(":", F.lit(plan.seed), epoch.cast("string"), id_text)), F.lit(":"), id_text)


def _share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add `budget` to siblings (`parents`, `name`, cap, weight, parent_budget): min(cap, rate x weight) at the rate that spends it.

    In the order of cap / weight a node is full if its cap is within its part of what the nodes before it left over.
    Integer arithmetic, rounded down: at most one token a sibling is left unspent.
    """
    by = Window.partitionBy(*parents)
    line = by.orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = nodes.where("weight > 0").withColumn("full", F.col("cap") * onward <= (F.col("parent_budget") - before) * F.col("weight"))
    left = F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))
    spread = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    return marked.withColumn("left", left).withColumn("spread", spread).withColumn("budget", F.expr("if(full, cap, greatest(left, 0) * weight div spread)")).drop("full", "left", "spread")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Budgets of leaves (domain, lang, source, supply): the same columns and budget. Leaves of weight 0 are left out."""
    def weight(level: str) -> Column:
        given = [x for name, w in plan.weights.get(level, {}).items() for x in (F.lit(name), F.lit(int(w)))]
        found = F.create_map(*given)[F.col(level)] if given else F.lit(None)
        return F.coalesce(found, F.lit(plan.default)).cast("long")

    # subtrees whose path holds a node of weight 0 supply nothing; the budget is a share of all the same
    usable = weight("domain") * weight("lang") * weight("source") > 0
    marked = leaves.withColumn("cap", F.when(usable, F.col("supply") * plan.epochs))
    capped = marked.where("cap is not null")
    # the domains have no parent to be grouped by: all of them are children of one root
    level = marked.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("all")).withColumn("root", F.lit(0)).withColumn("weight", weight("domain"))
    total = F.sum("all").over(Window.partitionBy("root"))
    level = level.withColumn("total", total).withColumn("parent_budget", F.expr(f"total * {plan.share[0]} div {plan.share[1]}")).where("cap is not null")
    level = _share_out(level, ["root"], "domain").select("domain", F.col("budget").alias("parent_budget"))
    level = capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).withColumn("weight", weight("lang")).join(level, "domain")
    level = _share_out(level, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    level = capped.withColumn("weight", weight("source")).join(level, ["domain", "lang"])
    return _share_out(level, ["domain", "lang"], "source").select(*LEVELS, "supply", "budget")


def leaf_cuts(measured: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf: supply, budget, passes (whole epochs), cut (the last order key of the prefix), part_key, part_tokens.

    `measured` has domain, lang, source, id_text, n_tokens. Leaves are cut in 4,096 buckets of their order, so that
    running sums are taken over bucket totals and within the one bucket where the budget ends, however large a leaf is.
    """
    leaves = measured.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply"))
    plans = written(
        budgets(leaves, plan).withColumn("passes", F.expr("if(supply > 0, budget div supply, 0)")).withColumn("rest", F.expr("if(supply > 0, budget % supply, 0)")), "mix-leaves"
    )
    many = plans.count() > BROADCAST_LEAVES
    side = plans if many else F.broadcast(plans)
    keyed = measured.join(side, list(LEVELS)).where("rest > 0").withColumn("key", order_key(plan, F.col("passes"), F.col("id_text"))).withColumn("bucket", F.substring("key", 1, 3))
    totals = keyed.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    up_to = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = totals.withColumn("end", F.sum("n").over(up_to)).withColumn("begin", F.col("end") - F.col("n")).where("begin < rest and rest <= end").select(*LEVELS, "bucket", "begin")
    inside = keyed.join(ends if many else F.broadcast(ends), [*LEVELS, "bucket"])
    place = Window.partitionBy(*LEVELS, "bucket").orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.withColumn("end", F.col("begin") + F.sum("n_tokens").over(place)).withColumn("start", F.col("end") - F.col("n_tokens"))
    cut = placed.groupBy(*LEVELS).agg(
        F.coalesce(F.max(F.when(F.col("end") <= F.col("rest"), F.col("key"))), F.first("bucket")).alias("cut"),
        F.min(F.when((F.col("start") < F.col("rest")) & (F.col("end") > F.col("rest")), F.struct("key", F.expr("rest - start").alias("n")))).alias("part"),
    )
    return plans.join(cut, list(LEVELS), "left").select(*LEVELS, "supply", "budget", "passes", F.coalesce("cut", F.lit("")).alias("cut"), F.col("part.key").alias("part_key"), F.col("part.n").alias("part_tokens"))


def mix(df: DataFrame, plan: Plan, domain: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """What each document gives to the mix: all columns of `df` and mix_domain, mix_tokens, mix_copies, mix_part.

    mix_copies says how often the whole document is taken, mix_part how many of its first tokens once more (the
    document where a leaf's prefix ends). Rows that give nothing are left out. Null texts have no tokens; documents
    without tokens go with the prefix that their order key falls into, and a leaf without any token gives nothing. Rows with equal ids share an order key and go
    the same way. An empty table gives no rows. Columns of `df` that have these four names are replaced. Of a very long text only words
    are counted; it goes in whole or with its first words.
    """
    tokens = words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) if tokens is None else tokens
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    leaf = leaf_columns(domain, F.col(lang_col), F.col(source_col))
    measured = written(df.select(*leaf, id_text.alias("id_text"), tokens.cast("long").alias("n_tokens")), "mix-measured")
    cuts = written(leaf_cuts(measured, plan), "mix-cuts")
    side = cuts.select(F.struct(*LEVELS).alias("__leaf"), F.struct("passes", "cut", "part_key", "part_tokens").alias("__cut"))
    if cuts.count() <= BROADCAST_LEAVES:
        side = F.broadcast(side)
    made = ("mix_domain", "mix_tokens", "mix_copies", "mix_part")
    own = [c for c in df.columns if c not in made]
    rows = df.select(*own, F.struct(*leaf).alias("__leaf"), id_text.alias("__id"), tokens.cast("long").alias("mix_tokens")).join(side, "__leaf")
    key = order_key(plan, F.col("__cut.passes"), F.col("__id"))
    rows = rows.withColumn("__key", key)
    copies = F.col("__cut.passes") + F.when(F.col("__key") <= F.col("__cut.cut"), 1).otherwise(0)
    part = F.when((F.col("__key") == F.col("__cut.part_key")) & (F.col("__key") > F.col("__cut.cut")), F.col("__cut.part_tokens")).otherwise(0)
    return rows.select(*own, F.col("__leaf.domain").alias("mix_domain"), "mix_tokens", copies.alias("mix_copies"), part.alias("mix_part")).where("mix_copies > 0 or mix_part > 0")
