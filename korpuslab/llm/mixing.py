"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

Leaves are the paths of a tree (domain, language, source). A budget of tokens goes
down the tree: at each node it is shared among the children by weight, and no child
gets more than its leaves can give in the allowed epochs. What a child cannot take
goes to its siblings, again by weight; only what all siblings together cannot take
shows up one level higher, as the smaller capacity of their parent. Shares are whole
tokens and add up exactly.

Each leaf then takes whole seeded epochs of its documents, and of the next epoch's
seeded order the longest prefix of documents whose tokens fit the rest. The prefix
is found as one cut for each leaf by sums over digest buckets, twice refined, so no
leaf is ever sorted as a whole; the cut then decides every document by itself.

Tokens are words separated by ASCII white space. Null parts of a path count as the
empty string, null texts have no tokens. Rows that agree in id and tokens are taken
or left together, and are summed up before they are sorted: null ids, which share one
digest, are as many sort rows as they have token counts. A leaf without tokens has its
documents taken at no cost. An empty table gives an empty result; documents' own columns
come back whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.llm.common import cut, field, whole

PATH = ["domain", "lang", "source"]
#: Fixed example weights of the query: by domain and language; sources count alike.
DOMAIN_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
EPOCHS, SEED = 4, 17
#: Leaves up to this many go to every task; with more, rows meet them by a join spread over salts.
SMALL, SALTS = 50_000, 64


def domain_of(source: Column) -> Column:
    """The domain of a source: by the number it ends in, modulo 3; ``other`` if it has none."""
    number = F.regexp_extract(F.coalesce(source.cast("string"), F.lit("")), "([0-9]{1,9})$", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (F.when(number != "", number).cast("bigint") % 3).cast("string")))


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The weight of a node by its name at its level; 1 if the level or the name has none."""
    known = weights.get(level, {})
    out = F.lit(1)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("decimal(10,0)")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``_given`` among its nodes by ``_w``, none above its ``_cap``: column ``budget``."""
    order = W.partitionBy(*parent).orderBy(F.col("_cap").cast("double") / F.col("_w").cast("double"), name)
    before, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parent)
    zero = F.lit(0).cast("decimal(20,0)")
    d20 = lambda c: c.cast("decimal(20,0)")
    nodes = nodes.withColumn("_pre", d20(F.coalesce(F.sum("_cap").over(before), zero))).withColumn("_left", d20(F.sum("_w").over(all_)) - d20(F.coalesce(F.sum("_w").over(before), zero)))
    nodes = nodes.withColumn("_full", F.col("_cap") * d20(F.col("_left")) <= d20(F.col("_given") - F.col("_pre")) * F.col("_w"))
    nodes = nodes.withColumn("_rest", d20(F.col("_given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_), zero))).withColumn("_open", d20(F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_), zero)))
    nodes = nodes.withColumn("_part", F.when(F.col("_full"), F.col("_cap")).otherwise(d20(F.expr("(_rest * _w) DIV if(_open = 0, 1, _open)"))))
    nodes = nodes.withColumn("_odd", d20(F.col("_rest") - F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_part"))).over(all_), zero)))
    turn = F.row_number().over(W.partitionBy(*parent, "_full").orderBy(name))
    return nodes.withColumn("budget", d20(F.col("_part") + F.when(~F.col("_full") & (turn <= F.col("_odd")), 1).otherwise(0)))


def budgets(leaves: DataFrame, path: list[str], weights: dict[str, dict[str, int]], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (path, ``available`` tokens) with the tokens each may give: ``budget``."""
    caps = leaves.withColumn("_cap", F.col("available").cast("decimal(20,0)") * epochs)
    for level in path:  # a weight of 0 anywhere on the path shuts the leaf
        caps = caps.withColumn("_cap", F.when(_weight(level, weights) > 0, F.col("_cap")).otherwise(0).cast("decimal(20,0)"))
    given = None
    for i, level in enumerate(path):
        here, parent = path[: i + 1], path[:i]
        nodes = caps.groupBy(*here).agg(F.sum("_cap").cast("decimal(20,0)").alias("_cap")).withColumn("_w", F.greatest(_weight(level, weights), F.lit(1).cast("decimal(10,0)")))
        if given is None:
            nodes = nodes.withColumn("_given", F.lit(budget).cast("decimal(20,0)"))
        else:
            nodes = nodes.join(given.select(*parent, F.col("budget").alias("_given")), parent)
        given = _share(nodes, parent, level).select(*here, "budget")
    return leaves.join(given, path)


def _with_leaf(rows: DataFrame, plan: DataFrame, on: list[str], few: bool) -> DataFrame:
    """Rows with their leaf's columns; no leaf, however large, comes to one task."""
    if few:
        return rows.join(F.broadcast(plan), on)
    spread = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_tokens", F.spark_partition_id()), F.lit(SALTS)).cast("int")).join(spread, [*on, "_salt"]).drop("_salt")


def _digest(seed: int) -> Column:
    """The order of an epoch: it depends on the seed, the epoch and the document's id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"))


def _edge(sums: DataFrame, path: list[str], bucket: str) -> DataFrame:
    """The bucket of each leaf in which the rest runs out, and what is taken before it."""
    w = W.partitionBy(*path).orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = sums.withColumn("_upto", F.sum("_sum").over(w) + F.col("_taken"))
    first = sums.where(F.col("_upto") > F.col("_rest")).groupBy(*path).agg(F.min(F.struct(bucket, (F.col("_upto") - F.col("_sum")).alias("taken"))).alias("_first"))
    return first.select(*path, F.col(f"_first.{bucket}").alias(bucket), F.col("_first.taken").alias("_taken"))


def mixing_plan(light: DataFrame, path: list[str], weights: dict[str, dict[str, int]], budget: int | None, epochs: int, seed: int) -> tuple[DataFrame, bool]:
    """For each leaf its budget, whole epochs, and the cut in the order of the epoch after them.

    ``light`` has the path, _id and _tokens. Without a budget the corpus's own size is shared out.
    """
    leaves = cut(light.groupBy(*path).agg(F.sum("_tokens").alias("available"), F.count(F.lit(1)).alias("documents")))
    few = leaves.count() <= SMALL
    if budget is None:
        budget = leaves.agg(F.sum("available")).first()[0] or 0
    plan = budgets(leaves, path, weights, budget, epochs).withColumn("budget", F.col("budget").cast("bigint"))
    one = F.expr("if(available = 0, 1, available)")
    plan = cut(plan.withColumn("_epoch", F.expr("budget DIV if(available = 0, 1, available)")).withColumn("_rest", F.col("budget") % one))
    rows = _with_leaf(light, plan.select(*path, "_epoch", "_rest"), path, few).withColumn("_digest", _digest(seed))
    rows = rows.withColumn("_b1", F.substring("_digest", 1, 2)).withColumn("_b2", F.substring("_digest", 3, 2))
    sums = rows.groupBy(*path, "_rest", "_b1").agg(F.sum("_tokens").alias("_sum")).withColumn("_taken", F.lit(0).cast("bigint"))
    one_ = cut(_edge(sums, path, "_b1"))
    inner = _with_leaf(rows, one_, [*path, "_b1"], few)
    sums = inner.groupBy(*path, "_rest", "_taken", "_b2", "_b1").agg(F.sum("_tokens").alias("_sum"))
    two = cut(_edge(sums, path, "_b2").join(one_.select(*path, "_b1"), path))
    last = _with_leaf(rows, two, [*path, "_b1", "_b2"], few)
    # rows that agree in id and tokens are one before they are sorted: null and repeated ids share a digest
    alike = last.groupBy(*path, "_digest", "_id", "_tokens", "_taken", "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = W.partitionBy(*path).orderBy(F.struct("_digest", "_id", "_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    fit = alike.withColumn("_upto", F.sum("_sum").over(upto) + F.col("_taken")).where(F.col("_upto") <= F.col("_rest"))
    cuts = fit.groupBy(*path).agg(F.max(F.struct("_digest", "_id", "_tokens")).alias("_cut"))
    plan = plan.join(two.select(*path, F.concat("_b1", "_b2").alias("_edge")), path, "left").join(cuts, path, "left")
    return cut(plan), few


def copies(rows: DataFrame, plan: DataFrame, path: list[str], seed: int, few: bool) -> DataFrame:
    """``rows`` with the number of times each is taken: ``copies``."""
    rows = _with_leaf(rows, plan.select(*path, "budget", "_epoch", "_edge", "_cut"), path, few).withColumn("_digest", _digest(seed))
    lead = F.substring("_digest", 1, 4)
    inside = F.when(F.col("_edge").isNull(), True).when(lead != F.col("_edge"), lead < F.col("_edge")).otherwise(F.coalesce(F.struct("_digest", "_id", "_tokens") <= F.col("_cut"), F.lit(False)))
    return rows.withColumn("copies", (F.col("_epoch") + inside.cast("int")).cast("int")).drop("_digest", "_edge", "_cut", "_epoch")


def _keys() -> list[Column]:
    """What the mixture needs to know of a document: _id, its path, _tokens."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return [F.col("doc_id").cast("bigint").alias("_id"), domain_of(F.col("source")).alias("domain"), blank("lang").alias("lang"), blank("source").alias("source"), tokens_of(F.col("text")).alias("_tokens")]


def mix_documents(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """doc_id, its leaf, tokens, the leaf's budget, and copies: how often the mixture takes it (0: not at all)."""
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    light = cut(docs.select(*_keys()))
    plan, few = mixing_plan(light, PATH, weights, budget, epochs, seed)
    return copies(light, plan, PATH, seed, few).select(F.col("_id").alias("doc_id"), *PATH, F.col("_tokens").alias("tokens"), F.col("budget").alias("leaf_budget"), "copies")


def mixed_rows(docs: DataFrame, budget: int | None = None, epochs: int = EPOCHS, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """The documents themselves, each as many times as the mixture takes it, with their own columns.

    Texts are not shuffled: each row is decided by its leaf's cut.
    """
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    plan, few = mixing_plan(cut(docs.select(*_keys())), PATH, weights, budget, epochs, seed)
    taken = copies(docs.select(whole(docs), *_keys()), plan, PATH, seed, few).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(field("_row", c) for c in docs.columns))
