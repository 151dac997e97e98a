"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case; keys shorter than ``min_chars`` code points do not count. A run is a table of
128-bit key hashes, dealt into buckets by hash and sorted in them, each key once. Batches
come in falling order of ids. A new batch is merge-anti-joined with the runs: a key that
no run has becomes an *entry* of the batch's own run, with the largest id of the batch
that holds it, which no later batch can exceed; of a key that some run has only the number
of documents is noted (an *echo*). So every key has one entry in all runs. When a level
has ``FANOUT`` runs they are merged into one of the next level, where echoes join their
entry. All runs share the number of buckets, so neither step shuffles a run.

Keys in at least ``min_docs`` documents, by their entry and its echoes, lose their lines
everywhere except in the document the entry names. What is removed from each document is
found by a join on the hash, which may be skewed and may be split, then gathered by document.

A null text is one empty line and stays null; a document without an id holds
nothing and keeps everything. Rows that share an id are one document; equal rows are
treated alike. Texts of any length count whole; an empty table gives an empty result;
other columns are carried whatever their names. What is written stays in the shared
scratch folder, as results read it, until ``common.release``. With 128 bits two different
keys meet with a chance of about n * n / 2 ** 129.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuslab.llm import common
from korpuslab.llm.common import SPACES, field, scratch_path, whole

FANOUT, BATCHES = 2, 4
HASH = ["hi", "lo"]


def key_of(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None if the key is too short to count."""
    line = line.strip(SPACES)
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").lower()) if len(line) >= min_chars else None


def _line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, hi, lo: each key once for each row that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, digests = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = {k for line in (text.as_py() or "").split("\n") if (k := key_of(line, min_chars))}
                ids.append(doc)
                counts.append(len(found))
                digests.extend(found)
            pairs = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            docs_ = np.repeat(np.array(ids, np.int64), counts)
            for i in range(0, max(1, len(docs_)), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(docs_[i : i + 50_000]), pa.array(pairs[i : i + 50_000, 0]), pa.array(pairs[i : i + 50_000, 1])], names=["doc_id", *HASH])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, hi bigint, lo bigint")


class LineRuns:
    """The runs below one shared folder; batches may be added at any time, largest ids first."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or scratch_path(spark, "lines"), fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"korpuslab_run_{uuid.uuid4().hex}"
        run.select(*HASH, "n", "holder").write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        common._made.append(("table", name))
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            common.remove(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[DataFrame]:
        """The runs, oldest first."""
        return [self.spark.table(name) for level in reversed(self.levels) for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of distinct (doc_id, hi, lo); its ids are smaller than those of all batches before."""
        own = batch.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
        for run in self.runs():
            own = self._known(own, run)
        self._push(0, self._write(own))

    def _known(self, own: DataFrame, run: DataFrame) -> DataFrame:
        """``own`` without the holders of keys that the run has: what the anti-join leaves keeps its entry, the rest is an echo."""
        new = own.join(run.hint("merge"), HASH, "left_anti")
        old = own.join(run.hint("merge"), HASH, "left_semi").withColumn("holder", F.lit(None).cast("bigint"))
        return new.unionByName(old)

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self.spark.table(old[0])
            for other in old[1:]:
                merged = merge(merged, self.spark.table(other))
            name = self._write(merged)
            self._drop(old)
            self._push(level + 1, name)

    def verdict(self) -> DataFrame:
        """Every key once, by its entry: hi, lo, n, holder."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "hi bigint, lo bigint, n bigint, holder bigint")
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        entries = every.where("holder IS NOT NULL")
        if len(runs) == 1:  # each echo has met its entry
            return entries
        echoes = every.where("holder IS NULL").groupBy(*HASH).agg(F.sum("n").alias("_more"))
        return entries.join(echoes, HASH, "left").select(*HASH, (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"), "holder")


def merge(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Two sorted runs as one. An entry of the older run stands; echoes add to it."""
    late = newer.select(*HASH, F.col("n").alias("_n"), F.col("holder").alias("_holder"))
    both = older.join(late.hint("merge"), HASH, "full")
    return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("holder", "_holder").alias("holder"))


def _batch_of(docs: DataFrame, batches: int) -> Column:
    """The number of a document's batch: ranges of ids with about as many rows each, largest ids first."""
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [k / batches for k in range(batches - 1, 0, -1)], 1000)).first()[0] if batches > 1 else None
    out = F.lit(batches - 1)
    for k, bound in reversed(list(enumerate(bounds or []))):
        out = F.when(F.col("doc_id") > bound, k).otherwise(out)
    return out.cast("int")


def stripped(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """(``_row``, ``_new``): each row as it was, and its text without repeated lines with n_lines and n_dropped."""
    spark = docs.sparkSession
    store = LineRuns(spark)
    hashes = f"{store.folder}/hashes"
    found = _line_hashes(docs, min_chars)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = found.distinct()  # rows that share an id hold a key once
    found.withColumn("batch", _batch_of(docs, batches)).write.parquet(hashes, partitionBy="batch")
    lines = spark.read.schema("doc_id bigint, hi bigint, lo bigint, batch int").parquet(hashes)
    for i in range(batches):
        store.add(lines.where(F.col("batch") == i).drop("batch"))
    dead = store.verdict().where(F.col("n") >= min_docs).select(*HASH, "holder")
    gone = lines.join(dead, HASH).where("doc_id <> holder").groupBy("doc_id").agg(F.collect_set(F.struct(*HASH)).alias("_gone"))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def strip(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for text, drop in zip(texts, gone, strict=True):
            if drop is None or not len(drop):
                rows.append((text, text.count("\n") + 1 if text else 1, 0))
                continue
            drop = {np.array([d["hi"], d["lo"]], ">i8").tobytes() for d in drop}
            all_ = text.split("\n")
            kept = [line for line in all_ if key_of(line, min_chars) not in drop]
            rows.append(("\n".join(kept), len(all_), len(all_) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    rows = docs.select(whole(docs), F.col("doc_id").cast("bigint").alias("_id"))
    met = rows.join(gone.withColumnRenamed("doc_id", "_id"), "_id", "left")
    return met.select("_row", strip(F.col("_row.text").cast("string"), F.col("_gone")).alias("_new"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``docs`` with its text without repeated lines, and ``n_lines``, ``n_dropped`` (before, and how many went).

    Columns of these two names that ``docs`` has itself give way.
    """
    kept = [F.col("_new.text").alias(c) if c == "text" else field("_row", c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return stripped(docs, min_chars, min_docs, batches).select(*kept, "_new.n_lines", "_new.n_dropped")


def with_lines_dropped(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with all its columns as they were but ``text``, and ``n_chars`` where it has one, which follows the text."""

    def column(name: str, kind: str) -> Column:
        return F.col("_new.text").alias(name) if name == "text" else F.length("_new.text").cast(kind).alias(name) if name == "n_chars" else field("_row", name)

    return stripped(docs, min_chars, min_docs).select(*(column(c, t) for c, t in docs.dtypes))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what is kept."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
