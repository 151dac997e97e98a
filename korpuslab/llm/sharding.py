"""Sharding by proportional stratified interleaving, in DataFrame operations alone.

Within each stratum rows are ranked in a seeded shuffle (the order of a keyed
digest of their id). A row's fractional rank is (rank - 1/2) / rows of its
stratum; in the order of fractional ranks every stretch holds each stratum in its
share of the whole, so cutting that order into runs of equal length gives shards
that all have the mixture, with row counts at most one apart (law ``rows``).

Both orders are taken over the whole table at once, dealt by sampled ranges of the order
itself: a stratum with a third of all rows is many partitions, and a hundred thousand
strata of one row each, whose fractions are all the same, are too. A stratum's ranks are
places less its first place. Null ids share one digest and a null stratum is a stratum;
rows of equal id go by the carried columns, and rows that agree in everything may change
places. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import cut, numbered, quoted


def shuffle_key(seed: int, key: Column) -> Column:
    """The digest whose order is the seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def interleave(df: DataFrame, key: str, stratum: str, shards: int, seed: int = 0, carry: dict[str, Column] | None = None) -> DataFrame:
    """key, the carried columns, ``shard`` (from 0) and ``slot`` (from 0, gapless in its shard) of every row."""
    carry = carry or {}
    key_, stratum_ = F.col(quoted(key)), F.col(quoted(stratum))
    rows = cut(df.select(key_.alias("_key"), F.when(stratum_.isNull(), "").otherwise(F.concat(F.lit("="), stratum_.cast("string"))).alias("_stratum"), shuffle_key(seed, key_).alias("_digest"), *(c.alias(f"_c_{n}") for n, c in carry.items()), F.monotonically_increasing_id().alias("_row")))
    shuffled = numbered(rows, ["_stratum", "_digest", "_key", *(f"_c_{n}" for n in carry), "_row"], "_at")
    sizes = cut(shuffled.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first")))
    total = sizes.agg(F.sum("_rows")).first()[0] or 0
    ranked = _with_sizes(shuffled, sizes).withColumn("_rank", F.col("_at") - F.col("_first"))
    ranked = ranked.withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_rows")).cast("double")).drop("_digest", "_at", "_first", "_rows", "_row")
    placed = numbered(ranked, ["_fraction", "_stratum", "_rank"], "_at")
    shard = f"(_at * {shards}) DIV {max(1, total)}"
    first = f"({shard} * {total} + {shards - 1}) DIV {shards}"
    return placed.select(F.col("_key").alias(key), *(F.col(f"_c_{n}").alias(n) for n in carry), F.expr(shard).cast("int").alias("shard"), F.expr(f"_at - {first}").alias("slot"))


#: Strata counts up to this many go to every task; with more, rows meet them by a join spread over salts.
SMALL, SALTS = 50_000, 64


def _with_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    if sizes.count() <= SMALL:
        return rows.join(F.broadcast(sizes), "_stratum")
    spread = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod("_at", F.lit(SALTS)).cast("int")).join(spread, ["_stratum", "_salt"]).drop("_salt")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Documents in shards with the mixture of their sources.

    size is the text's UTF-8 bytes plus 8 (a null text has no bytes), text_crc32 that of
    those bytes; grown_shard is null, as the law ``rows`` moves rows when a shard is added.
    """
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 8
    placed = interleave(docs, "doc_id", "source", shards, seed, {"size": size, "text_crc32": F.crc32(F.coalesce(text, F.lit("")))})
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
