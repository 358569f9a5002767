"""Mixing sources to target weights by hierarchical budgets; DataFrame functions only.

The leaves of the tree domain -> language -> source hold tokens. A total budget goes down the
tree: the children of a node share its budget by their weights, no child gets more than its
leaves can give (tokens times epochs), and what a full child leaves goes to its siblings by
their weights before any goes back up, since a node's own limit is the sum of its children's.
Each level has a closed form over children sorted by limit/weight: with S the limits and W the
weights from a child on, level = max of (budget - limits before) / W, share = min(limit, weight * level).

A leaf's budget is whole epochs and a token-prefix of one more. An epoch is the order of
md5(seed:epoch:doc_id). The prefix ends in one slice of that order (a prefix of the md5, so
slices are small at any size); only that slice is sorted. Applying the plan is a filter on the
md5, so texts never move.

Null keys count as ''. Texts without words have no tokens and are never taken. Rows with
the same doc_id in a leaf share a place in the order: they are taken, or not, together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights are whole numbers; "*" is for names that aren't listed.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 40, "books": 30, "papers": 20, "code": 10, "*": 5},
    "lang": {"en": 50, "de": 20, "fr": 20, "*": 10},
    "source": {"*": 1},
}
LEVELS = ["domain", "lang", "source"]
#: Per cent of the tokens that there are.
BUDGET_PERCENT = 60
MAX_EPOCHS = 2
SEED = 17
#: Rows that one slice of an epoch's order may hold on average.
SLICE_ROWS = 4_000
#: More leaves than this are joined by a shuffle instead of broadcast.
BROADCAST_LEAVES = 20_000


def domain_of(source: Column) -> Column:
    """Fixed rule for sources that carry a number: its remainder by 4 names the domain."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("bigint")
    return F.when(number.isNull(), "other").otherwise(F.element_at(F.array(*map(F.lit, ("web", "books", "papers", "code"))), (number % 4 + 1).cast("int")))


def leaf_rows(docs: DataFrame, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source and n_tokens of each row of docs."""
    keys = _keys() | ({} if domain is None else {"domain": domain})
    return docs.select("doc_id", *[e.alias(c) for c, e in keys.items()], (n_words(F.col("text")) if tokens is None else tokens).alias("n_tokens"))


def _keys() -> dict[str, Column]:
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return {"domain": domain_of(F.col("source")), "lang": key("lang"), "source": key("source")}


def place(epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(weights[level].get("*", 0))
    for name, w in weights[level].items():
        if name != "*":
            out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """nodes with ``share``: how the budget of each parent goes to its children."""
    w = Window.partitionBy(*parent)
    order = w.orderBy(F.col("most") / F.col("weight"), level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("most").over(order) - F.col("most")
    weight_on = F.sum("weight").over(w) - F.sum("weight").over(order) + F.col("weight")
    rate = (F.col("budget") - before) / weight_on
    out = nodes.withColumn("rate", rate).withColumn("rate", F.max("rate").over(w))
    return out.withColumn("share", F.least(F.col("most"), F.floor(F.col("weight") * F.col("rate"))).cast("long"))


def plan_mixture(rows: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row for each leaf: tokens, budget (share), full (whole epochs), rest (tokens of one
    more), last (place of the last document of the prefix) and last_take (tokens left for it).

    rows: leaf_rows, best held somewhere, as they are read three times.
    """
    rows = rows.filter("n_tokens > 0")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    leaves = cut(leaves.withColumn("most", F.col("tokens") * max_epochs))
    total = leaves.agg(F.floor(F.sum("tokens") * budget_percent / 100).cast("long").alias("budget"))
    nodes = total.withColumn("one", F.lit(1))
    parents = ["one"]
    for depth, level in enumerate(LEVELS):
        down = [*LEVELS[: depth + 1]]
        live = leaves.withColumn("one", F.lit(1))
        for above in LEVELS[depth:]:
            live = live.filter(_weight(above, weights) > 0)
        limits = live.groupBy("one", *down).agg(F.sum("most").alias("most")).withColumn("weight", _weight(level, weights))
        held = _share(limits.join(nodes, parents), parents, level)
        nodes = held.select("one", *down, F.col("share").alias("budget"))
        parents = ["one", *down]
    plan = leaves.join(nodes.drop("one").withColumnRenamed("budget", "share"), LEVELS, "left").withColumn("share", F.coalesce("share", F.lit(0).cast("long")))
    plan = plan.withColumn("full", F.floor(F.col("share") / F.col("tokens")).cast("long")).withColumn("rest", F.col("share") - F.col("full") * F.col("tokens"))
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_rows") / SLICE_ROWS) / F.log(F.lit(16.0)))).cast("int")
    plan = cut(plan.withColumn("digits", digits))
    # the prefix ends in the first slice of the order where the running tokens reach the rest
    asked = small(plan.filter("rest > 0").select(*LEVELS, "full", "rest", "digits"))
    placed = rows.join(asked, LEVELS).withColumn("at", place(F.col("full") + 1, seed)).withColumn("slice", F.expr("substring(at, 1, digits)"))
    per = placed.groupBy(*LEVELS, "rest", "slice").agg(F.sum("n_tokens").alias("held"))
    run = F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))
    ends = per.withColumn("before", run - F.col("held")).filter("before < rest and before + held >= rest").select(*LEVELS, "slice", "before")
    inside = placed.join(ends, [*LEVELS, "slice"]).groupBy(*LEVELS, "rest", "before", "at").agg(F.sum("n_tokens").alias("held"))
    run = F.sum("held").over(Window.partitionBy(*LEVELS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("start", F.col("before") + run - F.col("held")).filter("start < rest and start + held >= rest")
    return plan.join(last.select(*LEVELS, F.col("at").alias("last"), (F.col("rest") - F.col("start")).alias("last_take")), LEVELS, "left")


def small(leaves: DataFrame) -> DataFrame:
    """Broadcast while the count of leaves is checked to be small; a plain join beyond."""
    few = leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return F.broadcast(leaves) if few else leaves


def mixture(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each time that a document is taken: epoch (from 1) and take_tokens."""
    plan = small(plan.select(*LEVELS, "full", "last", "last_take"))
    got = rows.filter("n_tokens > 0").join(plan, LEVELS).withColumn("at", place(F.col("full") + 1, seed))
    part = F.when(F.col("at") <= F.col("last"), F.col("full") + 1)
    epochs = F.array_compact(F.concat(F.when(F.col("full") > 0, F.sequence(F.lit(1).cast("long"), F.col("full"))).otherwise(F.array().cast("array<bigint>")), F.array(part)))
    got = got.withColumn("epoch", F.explode(epochs))
    take = F.when((F.col("epoch") > F.col("full")) & (F.col("at") == F.col("last")), F.least("n_tokens", "last_take")).otherwise(F.col("n_tokens"))
    return got.select("doc_id", *LEVELS, "n_tokens", "epoch", take.alias("take_tokens"))


def keep_mixture(docs: DataFrame, seed: int = SEED, **plan_args) -> DataFrame:
    """The rows of docs that a plan of one epoch takes, whole, with the columns of docs."""
    rows = cut(leaf_rows(docs))
    plan = small(plan_mixture(rows, seed=seed, max_epochs=1, **plan_args).select(*LEVELS, "full", "last"))
    keys = [e.alias(f"k_{c}") for c, e in _keys().items()]
    wrapped = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", (n_words(F.col("text")) > 0).alias("some"), *keys)
    got = wrapped.join(plan, [wrapped[f"k_{c}"] == plan[c] for c in LEVELS]).withColumn("at", place(F.col("full") + 1, seed))
    return got.filter("some and (full > 0 or at <= last)").select("row.*")
