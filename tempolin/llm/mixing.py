"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source); every node of that tree has a weight among its
siblings.  The token budget of the root goes down the tree.  Siblings share their
parent's budget by weight; one that cannot use its share (its subtree holds fewer
tokens than that, ``max_epochs`` times) takes what it can, and the rest is shared among
its siblings.  Only what no sibling can use leaves the subtree, as the subtree's own
shortage among the siblings of its parent.

A leaf takes a prefix of its tokens, in seeded order, from as many epochs as its budget
needs: whole epochs take every document, the last one those that begin before the
budget ends (so a leaf exceeds its budget by less than its last document).  Every epoch
has an order of its own.  Tokens are runs of characters other than white space.

All of it is DataFrame functions on whole numbers, products of them with 38 digits.  Leaf
totals are summed before any shuffle; order within a leaf comes from a hash, cut into as
many slices as a slice has documents, about, so that the largest leaf is spread over many
tasks and so is the sum over its slices.  The children of one node of the tree are put in
order in one task, which keeps running sums only.

Defined results: null text has 0 tokens and null keys are values of their own;
documents without tokens come with whole epochs or where the budget has not ended; rows
of one id in one leaf are taken together; a node of weight 0 gets nothing, also where its
siblings run short, and a negative weight is an error; an empty table, or a budget of 0,
gives an empty result.  Whole documents are carried in a struct, so columns can have any
name.  Which domain a source belongs to is a parameter: any expression of the source.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

LEVELS = ("domain", "language", "source")
#: Leaves whose plan is broadcast at most: about 20 MB.
MAX_BROADCAST_LEAVES = 100_000


#: The domain that a source belongs to, as an expression of the source.
DomainOf = Callable[[Column], Column]


def one_domain(source: Column) -> Column:
    """All sources belong to one domain."""
    return F.lit("all")


def weight_of(weights: Mapping[str, int], key: Column) -> Column:
    """Whole-number weight of a node among its siblings; 1 for those not named."""
    if any(int(w) < 0 for w in weights.values()):
        raise ValueError(f"a weight is not negative: {dict(weights)}")
    out = F.lit(1).cast("long")
    for name, weight in weights.items():
        out = F.when(key == name, F.lit(int(weight)).cast("long")).otherwise(out)
    return out


def share(children: DataFrame, parents: DataFrame, parent_keys: list[str], key: str) -> DataFrame:
    """Fill ``children`` (capacity, weight) up with the ``budget`` of their parents.

    Exact water filling in whole numbers: in the order of capacity by weight, a child
    that holds less than its share of what is left takes its capacity; the first that
    doesn't, and all after it, share the rest by weight.  A child of weight 0 has no
    capacity.  Every sum is a running one, in one order.
    """
    same = [F.col(f"c_{k}").eqNullSafe(F.col(f"p_{k}")) for k in parent_keys]
    held = children.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long")))
    joined = held.join(F.broadcast(parents) if not same else parents, same or F.lit(True))  # the root is one row
    per_parent = [f"c_{k}" for k in parent_keys]
    order = [F.try_divide(F.col("capacity"), F.col("weight")).asc_nulls_first(), F.col(f"c_{key}").asc_nulls_first()]
    ordered = Window.partitionBy(*per_parent).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*per_parent)
    sum_before = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    ranked = joined.withColumn("left", F.col("budget") - sum_before("capacity")).withColumn("weights", F.sum("weight").over(whole) - sum_before("weight"))
    # 38 digits: a budget of 19 digits times weights of as many
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    ranked = ranked.withColumn("fills", wide("left") * wide("weight") >= wide("capacity") * wide("weights"))
    # left and weights at the first child that isn't filled hold for it and all after it
    first = lambda c: F.first(F.when(~F.col("fills"), F.col(c)), ignorenulls=True).over(running)
    ranked = ranked.withColumn("rest", first("left")).withColumn("rest_weights", first("weights"))
    ranked = ranked.withColumn("upto", F.sum(F.when(~F.col("fills"), F.col("weight")).otherwise(0)).over(running))
    # the difference of rounded sums, so that the shares add up to the rest
    part = F.expr(
        "cast((cast(rest as decimal(19,0)) * cast(upto as decimal(19,0))) div cast(rest_weights as decimal(19,0)) as bigint)"
        " - cast((cast(rest as decimal(19,0)) * cast(upto - weight as decimal(19,0))) div cast(rest_weights as decimal(19,0)) as bigint)"
    )
    return ranked.withColumn("given", F.when(F.col("fills"), F.col("capacity")).otherwise(F.least(part, F.col("capacity"))))


def budgets(leaves: DataFrame, total: DataFrame, weights: Mapping[str, Mapping[str, int]], max_epochs: int) -> DataFrame:
    """Leaves (LEVELS, tokens, docs) with their ``budget``: three rounds of :func:`share`.

    ``total`` is one row with the ``budget`` of the root.
    """
    held = leaves.select(*LEVELS, "tokens", "docs", (F.col("tokens") * max_epochs).alias("capacity"))
    parents = total
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = held.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.select(*[F.col(k).alias(f"c_{k}") for k in keys], "capacity", weight_of(weights.get(level, {}), F.col(level)).alias("weight"))
        given = share(nodes, parents, keys[:-1], level)
        parents = given.select(*[F.col(f"c_{k}").alias(f"p_{k}") for k in keys], F.col("given").alias("budget"))
    return held.join(parents, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in LEVELS]).select(*LEVELS, "tokens", "docs", "budget")


def leaf_columns(id_col: str, lang_col: str, source_col: str, domain_of: DomainOf) -> list[Column]:
    """The leaf of a document, and its id as text."""
    return [
        domain_of(F.col(source_col)).alias("domain"),
        F.col(lang_col).cast("string").alias("language"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
    ]


def rank_of(seed: int, epoch: Column, id_text: Column) -> Column:
    """Place of a document in the order of an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_text))


def light_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain_of: DomainOf = one_domain) -> DataFrame:
    """doc_id, leaf and tokens of every row, in the shared folder; texts are read once."""
    tokens = F.size(F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    return cut(docs.select(F.col(id_col).alias("doc_id"), *leaf_columns(id_col, lang_col, source_col, domain_of), tokens.alias("tokens")), "mixing-rows")


def plan_mix(light: DataFrame, fraction_percent: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int, seed: int) -> DataFrame:
    """For each leaf with a budget: ``whole`` epochs, and the last ``rank`` that the epoch after them takes.

    Rows of one id share a rank and are summed before the shuffle.  A slice is a range
    of ranks; its offset is the sum of the slices before it.
    """
    leaves = cut(light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mixing-leaves")
    total = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {int(fraction_percent)}) div 100").alias("budget"))
    planned = budgets(leaves, total, weights, max_epochs).where("budget > 0").select(
        *[F.col(k).alias(f"p_{k}") for k in LEVELS],
        F.expr("budget div tokens").alias("whole"),
        F.expr("budget % tokens").alias("rest"),
        F.ceil(F.sqrt("docs")).alias("slices"),
    )
    planned = cut(planned, "mixing-budgets")
    part = _with_plan(light, planned.where("rest > 0"), "inner")
    part = part.withColumn("rank", rank_of(seed, F.col("whole"), F.col("id")))
    part = part.withColumn("slice", F.expr("(cast(conv(substring(rank, 1, 8), 16, 10) as bigint) * slices) div 4294967296"))
    keys = [f"p_{k}" for k in LEVELS]
    ranks = part.groupBy(*keys, "rest", "whole", "slice", "rank").agg(F.sum("tokens").alias("tokens"))
    within = Window.partitionBy(*keys, "slice").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranks.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = part.groupBy(*keys, "slice").agg(F.sum("tokens").alias("sum"))
    slices = slices.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("slice").alias("o_slice"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("offset"))
    same = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys] + [F.col("slice") == F.col("o_slice")]
    taken = placed.join(slices, same).where(F.col("before") + F.col("offset") < F.col("rest"))
    last = taken.groupBy(*keys).agg(F.max("rank").alias("rank")).select(*[F.col(k).alias(f"l_{k}") for k in keys], "rank")
    return cut(planned.join(last, [F.col(k).eqNullSafe(F.col(f"l_{k}")) for k in keys], "left").select(*keys, "whole", "rank"), "mixing-plan")


def _with_plan(rows: DataFrame, plan: DataFrame, how: str) -> DataFrame:
    """Rows joined to the plan of their leaf; broadcast only if the plan is known to be small."""
    small = plan.count() <= MAX_BROADCAST_LEAVES
    return rows.join(F.broadcast(plan) if small else plan, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in LEVELS], how)


def take(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows that have LEVELS and ``id``, once for each epoch that takes them, with ``epoch``."""
    joined = _with_plan(rows, plan, "inner")
    partly = F.coalesce(rank_of(seed, F.col("whole"), F.col("id")) <= F.col("rank"), F.lit(False))
    epochs = joined.withColumn("epochs", F.col("whole") + F.when(partly, 1).otherwise(0)).where("epochs > 0")
    return epochs.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))


def mix(
    docs: DataFrame, fraction_percent: int, weights: Mapping[str, Mapping[str, int]], max_epochs: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain_of: DomainOf = one_domain,
) -> DataFrame:
    """The rows of ``docs`` that the budgets take, with their own columns, once an epoch.

    The total budget is ``fraction_percent`` of the tokens of ``docs``.
    """
    plan = plan_mix(light_rows(docs, id_col, text_col, lang_col, source_col, domain_of), fraction_percent, weights, max_epochs, seed)
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *leaf_columns(id_col, lang_col, source_col, domain_of))
    return take(rows, plan, seed).select("doc.*")
