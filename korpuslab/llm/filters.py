"""Operator 11: what each filter of a chain removes, in every order of the chain.

Documents are judged once, by a mask of the filters they fail. From then on only counts by part and mask matter: these
cells are unpivoted against the steps of all orders, a running bit-or over the steps before tells whether an earlier
filter had removed a cell, and conditional sums and totals over a filter's rows make the figures.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.llm.common import SPACES

#: Filters in the order of their bits.
FILTERS = "ABCDE"


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: too few words, too few distinct words, too many capitals, odd characters."""
    words = F.filter(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), lambda w: w != "")

    def judged(bound: Column) -> Column:
        n, distinct = bound["n"], bound["d"]
        return (n < 200).cast("int") + (100 * distinct < 50 * n).cast("int") * 2

    counted = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    odd = F.translate(text, "#$%&*|", "") != text
    return F.transform(counted, judged)[0] + (100 * capitals > 3 * F.length(text)).cast("int") * 4 + odd.cast("int") * 8


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, and the documents of both: all, good and toxic ones.

    Only digests of texts are dealt out. Rows of one digest and kind are counted where they are read, so copies meet as
    few rows; the least id of a digest is what all its other ids repeat.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"),
    ).select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), text_mask(F.col("t")).alias("mask"))
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.coalesce(F.max(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic"))
    key = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))  # rows without an id meet nothing, each somewhere else
    rows = rows.withColumn("key", key).groupBy("key", "id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(judged, "key", "left").select("id", "part", "digest", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(W.partitionBy("digest"))
    stays = F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    split = kinds.withColumn("stays", stays).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct("mask", F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))).alias("c"),
    )
    n = F.col("c.n")
    return split.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Figures of every step of every order of ``filters``, from counts by part and mask."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = cells.select("*", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit = F.element_at(F.create_map(*(x for k, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << k)))), F.col("filter"))
    steps = steps.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "filter_order", "mask").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("gone", F.coalesce(F.bit_or("fails").over(before), F.lit(0)) != 0)
    here, fails = ~F.col("gone") & (F.col("fails") != 0), F.col("fails") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    rows = steps.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "filter").agg(
        total(~F.col("gone") & ~fails)("kept"), total(here)("removed"), total(F.col("gone") & fails)("redundant"),
        total(F.col("mask") == F.col("bit"))("unique_fails"), total(here, "good")("good_lost"), total(here, "toxic")("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "filter")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures: one row for each, zeros included.

    Null texts are empty, null languages the empty part. An id with several labels is good, or toxic, if one of them
    says so. Rows without an id carry no label, repeat nothing and are repeated by nothing; rows that share an id do
    not repeat each other. An empty table has no part, so no row. Other columns are ignored.
    """
    return audit(mask_cells(docs, labels)).drop("filter")
