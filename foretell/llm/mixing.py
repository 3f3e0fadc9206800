"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree of domains, languages and sources in
proportion to their weights. A node that can't use its part (its supply, over
at most a given number of epochs, is too small) leaves the rest to its
siblings; only what a whole subtree can't use reaches the subtree's siblings.
Each source then gives the token prefix that its budget covers of a stream of
epochs, each a differently seeded order of its documents. DataFrame functions
only; no source's documents are ever sorted as a whole: digests deal them into
ordered buckets, the bucket in which the prefix ends is dealt again until it
holds few rows, and only those are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foretell.llm.common import WORD, checkpointed, join_unique

#: Production parameters of the query and the pipeline.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANGUAGE_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 3}
#: Weight of a name that isn't listed.
OTHER_WEIGHT = 1
#: Budget as a share of the corpus's tokens, and how often a source may be repeated.
BUDGET_SHARE, MAX_EPOCHS = 0.75, 3
SEED = 7
#: Parts (first character, characters) of a document's place in an epoch by which its source is dealt, round by round: the
#: digest of its id, then, for ids that repeat, the hash of its text. A source has 4,096 buckets in a round, whatever its size.
ROUNDS = [(1, 3), (4, 3), (33, 3), (36, 3)]
#: Rounds end when no source has more rows in the bucket in which its budget ends: so many are sorted as they are.
SORTED_ROWS = 1_000
_LEVELS = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """The documents table names no domains; the number at the end of a source's name gives one of four."""
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.right(number, F.lit(6)).cast("int") % 4).cast("string"))).otherwise(F.lit("other"))


def _weight(name: Column, weights: dict[str, int]) -> Column:
    found = F.lit(OTHER_WEIGHT)
    for key, w in weights.items():
        found = F.when(name == key, w).otherwise(found)
    return found


def _share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``budget`` of every node from its parent's ``above``: in proportion to weight, none over its ``cap``.

    With siblings by rising cap / weight, the level that the budget reaches if
    all before a sibling are full is largest at the first one that isn't full.
    """
    around = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = around.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.col("above") - full) / (F.sum("weight").over(around) - used)
    levels = nodes.where("weight > 0").withColumn("level", level).withColumn("level", F.max("level").over(around))
    return levels.withColumn("budget", F.least(F.col("cap"), F.floor(F.col("level") * F.col("weight")))).drop("level", "above")


def budgets(supply: DataFrame, weights: dict[str, dict[str, int]], budget: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` for each leaf of ``supply (domain, lang, source, tokens)``.

    ``budget`` tokens in all, or BUDGET_SHARE of the supply. Budgets are rounded
    down to whole tokens. A leaf of weight 0 gets none and is left out. The
    tree has a row for each source, not for each document.
    """
    leaves = supply.select(*_LEVELS, "tokens", (F.col("tokens") * max_epochs).alias("cap"))
    leaves = leaves.select("*", *[_weight(F.col(c), weights.get(c, {})).alias(f"w_{c}") for c in _LEVELS]).where(" AND ".join(f"w_{c} > 0" for c in _LEVELS))
    total = supply.agg(F.lit(budget).cast("long").alias("above") if budget is not None else F.floor(F.sum("tokens") * BUDGET_SHARE).alias("above"))
    above, parents = None, []
    for depth, name in enumerate(_LEVELS):
        keys = _LEVELS[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w_{name}").alias("weight"), F.sum("tokens").alias("tokens"))
        nodes = nodes.crossJoin(F.broadcast(total)) if above is None else nodes.join(above, parents)  # total: one row
        shared = _share_out(nodes, parents, name)
        above, parents = shared.select(*keys, F.col("budget").alias("above")), keys
    return shared.select(*_LEVELS, "tokens", "budget")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The selected copies of ``docs``: all its columns, ``domain, epoch, n_tokens, taken_tokens``.

    A token is a word. ``taken_tokens`` is n_tokens but for the one copy in
    which a source's budget ends, which gives its first tokens only. Rows of
    null or wordless texts have no tokens and are never taken; null languages
    and sources are leaves named ``none``. Rows with one doc_id (or none) are
    ordered by the hash of their text; rows equal in both count one after the
    other. Columns of ``docs`` with the new names give way; all others are
    returned as they are, whatever their names.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANGUAGE_WEIGHTS, "source": SOURCE_WEIGHTS}
    docs = docs.drop("domain", "epoch", "n_tokens", "taken_tokens")
    leaf = _LEVELS
    place = [
        domain_of(F.coalesce(F.col("source"), F.lit(""))).alias("domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id"),
        F.xxhash64("text").alias("h"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    ]
    counted = checkpointed(docs.select(*place).where("n_tokens > 0"))  # numbers only: texts are read once more at the end
    supply = checkpointed(counted.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    total = supply.agg(F.sum("n")).first()[0] or 0
    plan = budgets(supply.select(*leaf, "tokens"), weights, budget, max_epochs).where("budget > 0").join(supply.select(*leaf, "n"), leaf)
    plan = checkpointed(plan.select(*leaf, "n", F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")))

    def keyed(rows: DataFrame, ends: DataFrame) -> DataFrame:
        """Rows with their leaf's plan and their place in the epoch that its budget cuts."""
        text = F.lpad(F.lower(F.hex("h")), 16, "0")
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs"), F.col("id")).cast("binary"))
        return join_unique(rows, ends, leaf, total).withColumn("key", F.concat(digest, text))

    # Round by round: the bucket of the cut epoch in which the budget ends, and the tokens before it.
    ends = plan.select("*", F.col("n").alias("size"), F.lit("").alias("upto"), F.lit(0).cast("long").alias("before"))
    path, known = F.lit(""), ["size", "epochs", "rest", "upto", "before"]
    for start, size in ROUNDS:
        inside = keyed(counted, ends).where(path == F.col("upto")).select(*leaf, *known, F.substring("key", start, size).alias("bucket"), "n_tokens")
        # Written before the window, so that rows are summed by bucket before those of one leaf meet.
        buckets = checkpointed(inside.groupBy(*leaf, *known, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
        running = buckets.withColumn("to", F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("bucket"))).where("before + to > rest")
        cut = running.groupBy(*leaf).agg(F.min(F.struct("bucket", (F.col("before") + F.col("to") - F.col("tokens")).alias("earlier"), "rows", *known)).alias("c"))
        upto, before = F.concat("c.upto", "c.bucket").alias("upto"), F.col("c.earlier").alias("before")
        ends = checkpointed(cut.select(*leaf, F.col("c.size").alias("n"), "c.size", "c.epochs", "c.rest", upto, before, "c.rows"))
        path = F.concat(path, F.substring("key", start, size))
        most = ends.agg(F.max("rows")).first()[0] or 0
        ends = ends.drop("rows")
        if most <= SORTED_ROWS:
            break

    rows = keyed(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *place).where("n_tokens > 0"), ends).withColumn("path", path)
    taken = F.when(F.col("path") < F.col("upto"), F.col("n_tokens")).otherwise(0)
    whole = rows.where("path != upto").withColumn("taken", taken)
    ahead = Window.partitionBy(*leaf).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where("path = upto").withColumn("taken", F.least("n_tokens", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))))
    taken_rows = whole.unionByName(cut)
    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: F.struct(e.alias("epoch"), F.when(e < F.col("epochs"), F.col("n_tokens")).otherwise(F.col("taken")).alias("taken_tokens"))), lambda c: c["taken_tokens"] > 0)
    chosen = taken_rows.select("own", "domain", "n_tokens", F.explode(copies).alias("c"))
    return chosen.select("own.*", "domain", F.col("c.epoch").alias("epoch"), "n_tokens", F.col("c.taken_tokens").alias("taken_tokens"))
