"""Approximate nearest neighbours by cosine with balanced posting lists.

Centroids are fitted on a bounded sample by k-means whose assignment charges full
clusters; there are about sqrt(n) of them, ``MOST_LISTS`` at most, and they live in
memory with a neighbour graph. Every vector is indexed: it goes to the list of its
nearest centroid, and a vector near a boundary also to the next few, unless that centroid
is nearer to one already chosen than to the vector. A query walks the graph from fixed
entries, always opening the nearest centroids it has met, as long as these are within a
distance ratio of the nearest one; those are its lists. It goes on only while they could
not fill its answer. So what a query reads follows from the data: few lists of clustered
vectors, most of them where all directions are alike (the README has figures).

Lists are read in blocks: a long list is split over salts, many queries over blocks,
so no task holds more than one part of one list and one block of queries. Vectors of one
direction are one index entry with their least ids: each is divided by its largest
component, so they agree in every bit; of n such vectors only the k + 1 least ids can be
among k nearest. The score is the cosine in double precision, in one fixed way, of these
vectors; all entries whose score may tie with the last are kept until ids decide.

Vectors that are null, zero, hold a null or non-finite component, or have another
length than most take no part, neither do rows without an id. Repeated rows count once;
an id with several vectors is as near as the best of them. Without queries or candidates
the result is empty; other columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.llm.common import cut, quoted

#: Vectors that fit centroids, the most centroids, and the rounds of k-means.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 12
#: Lists a vector may be in, and how much farther than the nearest centroid they may be.
REPLICAS, REACH = 4, 1.10
#: How much farther than the nearest centroid a query's lists may be, and centroids it opens in any case.
RATIO, BEAM = 1.35, 16
#: Neighbours of a centroid in the graph, nearest and random; vectors of a part of a list, and queries of a block.
NEAR, FAR, PART, BLOCK = 24, 8, 20_000, 20_000
#: Scores of BLAS and of the fixed way differ by less; pairs scored in the fixed way at once.
MARGIN, PAIRS = 1e-9, 100_000


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Centroids:
    """Unit centroids and their neighbour graph; small, and sent to every task."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 0):
        rng, x = np.random.default_rng(seed), unit(sample)
        lists = min(lists, len(x))
        at = x[rng.permutation(len(x))[:lists]]
        full = len(x) / lists
        sizes = np.full(lists, full)
        for _ in range(ROUNDS):
            owner = np.empty(len(x), np.int64)
            counts = np.zeros(lists)
            for i in range(0, len(x), 1024):  # what a block adds is charged to the next
                part = x[i : i + 1024]
                cost = -(part @ at.T) + 0.05 * (np.maximum(sizes, counts) / full - 1.0)
                owner[i : i + 1024] = cost.argmin(1)
                counts += np.bincount(owner[i : i + 1024], minlength=lists)
            sizes = counts
            sums = np.zeros_like(at)
            np.add.at(sums, owner, x)
            norms = np.linalg.norm(sums, axis=1)
            at = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], at)
        self.at = at
        near = min(NEAR, lists - 1)
        order = np.empty((lists, near), np.int64)
        for i in range(0, lists, 512):
            close = -(at[i : i + 512] @ at.T)
            close[np.arange(len(close)), np.arange(i, i + len(close))] = np.inf
            order[i : i + 512] = np.argsort(close, 1, kind="stable")[:, :near]
        self.graph = np.concatenate([order, rng.integers(lists, size=(lists, min(FAR, lists)))], 1)
        self.entries = np.unique(rng.integers(lists, size=16))

    def walk(self, x: np.ndarray, ratio: float) -> np.ndarray:
        """Distances (queries by centroids) to the centroids that queries meet in the graph, infinite to others.

        All queries walk at once. Each opens the nearest few it has met and not opened, while these are within
        ``ratio`` of the nearest met, or it has opened fewer than ``BEAM``.
        """
        n, lists = len(x), len(self.at)
        far = np.full((n, lists), np.inf)
        opened = np.zeros((n, lists), bool)
        far[:, self.entries] = np.sqrt(np.maximum(2.0 - 2.0 * (x @ self.at[self.entries].T), 0.0))
        rows, wide = np.arange(n), min(8, lists)
        while len(rows):
            here = np.where(opened[rows], np.inf, far[rows])
            next_ = np.argpartition(here, wide - 1, axis=1)[:, :wide] if wide < lists else np.broadcast_to(np.arange(lists), here.shape)
            value = np.take_along_axis(here, next_, 1)
            few = (opened[rows].sum(1) < BEAM)[:, None]
            go = np.isfinite(value) & ((value <= ratio * far[rows].min(1, keepdims=True)) | (few & (value <= value.min(1, keepdims=True))))
            at, which = np.nonzero(go)
            if not len(at):
                break
            row, node = rows[at], next_[at, which]
            opened[row, node] = True
            seen = np.zeros((n, lists), bool)
            np.logical_or.at(seen, (row[:, None], self.graph[node]), True)
            r, c = np.nonzero(seen & ~np.isfinite(far))
            for i in range(0, len(r), PAIRS):
                a, b = r[i : i + PAIRS], c[i : i + PAIRS]
                far[a, b] = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("nd,nd->n", x[a], self.at[b]), 0.0))
            rows = rows[np.unique(at)]
        return far

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``x`` and the lists they go to: the nearest, and close ones across a boundary."""
        far = np.sqrt(np.maximum(2.0 - 2.0 * (x @ self.at.T), 0.0))
        most = min(4 * REPLICAS, far.shape[1])
        order = np.argpartition(far, most - 1, axis=1)[:, :most]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(far, order, 1), 1, kind="stable"), 1)
        far = np.take_along_axis(far, order, 1)
        rows, lists = [np.arange(len(x))], [order[:, 0]]
        chosen = np.full((len(x), REPLICAS), -1)
        chosen[:, 0], count = order[:, 0], np.ones(len(x), int)
        for j in range(1, most):
            c = order[:, j]
            ok = (count < REPLICAS) & (far[:, j] <= REACH * far[:, 0])
            for i in range(REPLICAS):
                other = np.maximum(chosen[:, i], 0)
                between = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("nd,nd->n", self.at[c], self.at[other]), 0))
                ok &= (chosen[:, i] < 0) | (between > far[:, j])
            r = np.flatnonzero(ok)
            chosen[r, count[r]] = c[r]
            count[r] += 1
            rows.append(r)
            lists.append(c[r])
        return np.concatenate(rows), np.concatenate(lists)

    def probes(self, x: np.ndarray, k: int, sizes: np.ndarray, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the lists they read. ``sizes``: entries of each list; an entry is in ``REPLICAS`` lists at most."""
        ratio = RATIO if ratio is None else ratio
        far = self.walk(x, ratio)
        take = far <= ratio * far.min(1, keepdims=True)
        need = REPLICAS * (k + 1)
        for i in np.flatnonzero(take @ sizes < need):  # small lists: the next nearest, as many as can fill the answer
            order = np.argsort(-(self.at @ x[i]), kind="stable")
            take[i, order[: int(np.searchsorted(np.cumsum(sizes[order]), need)) + 1]] = True
        return np.nonzero(take)


def _valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of usable rows, each once; all of the length that most have, divided by their largest component."""
    rows = df.select(F.col(quoted(key)).cast("bigint").alias("id"), F.col(quoted(vector)).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("v") == (most[0] if most else 0)).withColumn("_most", F.expr("array_max(transform(v, x -> abs(x)))"))
    return rows.select("id", F.expr("transform(v, x -> x / _most + 0.0D)").alias("v")).dropDuplicates(["id", "v"])


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """One row for each distinct direction: v and its k + 1 least ids, ascending; e is the least.

    A direction that very many rows share is ranked within each task first.
    """
    first = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("e", F.col("ids")[0])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fit(index: DataFrame, lists: int, sample: int) -> Centroids:
    """Centroids of a bounded sample, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(b.column("e")), _matrix(b.column("v"))) for b in batches if b.num_rows]
        if held:
            e, x = (np.concatenate(c) for c in zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Centroids(x[np.argsort(e, kind="stable")], lists))], pa.binary())], names=["model"])

    picked = index.orderBy(F.xxhash64("e"), "e").limit(sample).select("e", "v")
    return pickle.loads(picked.repartition(1).mapInArrow(run, "model binary").first()["model"])


def best_pairs(query: np.ndarray, q: np.ndarray, first: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k nearest ids of entries, others than its own: query ids, ids, scores; ties to smaller ids.

    Entry j has the vector v[j] and the ids from first[j] to first[j + 1]. Rows of q and v are vectors, not unit ones.
    """
    q_norm, norm = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    near = (q / q_norm[:, None]) @ (v / norm[:, None]).T
    most = min(k + 1, len(v))
    edge = -np.partition(-near, most - 1, axis=1)[:, most - 1] - MARGIN
    hits = near >= edge[:, None]  # the query's own entry may be one, and every tie is
    out: list[tuple] = []
    ends = np.searchsorted(np.cumsum(hits.sum(1)), np.arange(PAIRS, hits.sum() + PAIRS, PAIRS), "left") + 1
    for a, b in zip(np.append(0, ends[:-1]), np.minimum(ends, len(q)), strict=True):
        i, j = np.nonzero(hits[a:b])
        i += a
        score = (q[i] * v[j]).sum(1) / (q_norm[i] * norm[j])
        times = first[j + 1] - first[j]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[j], times)
        i, score, id_ = np.repeat(i, times), np.repeat(score, times), ids[at]
        other = id_ != query[i]
        i, score, id_ = i[other], score[other], id_[other]
        order = np.lexsort((id_, -score, i))
        i, score, id_ = i[order], score[order], id_[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((query[i[rank < k]], id_[rank < k], score[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (query[:0], ids[:0], near[:0, 0])


def nearest(df: DataFrame, key: str, vector: str, is_query: str, k: int, sample: int = SAMPLE, ratio: float | None = None) -> DataFrame:
    """For each row that satisfies ``is_query`` (SQL on ``id``): query_id, rank, vec_id and score of its k nearest others."""
    spark = df.sparkSession
    rows = cut(_valid(df, key, vector))
    index = cut(_entries(rows, k))
    n, queries = index.count(), rows.where(is_query).count()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not queries:
        return spark.createDataFrame([], result)
    centroids = spark.sparkContext.broadcast(_fit(index, min(MOST_LISTS, int(np.ceil(np.sqrt(n)))), sample))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, list_ = centroids.value.lists_of(unit(_matrix(part.column("v"))))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), *(part.column(c).take(take) for c in ("e", "ids", "v"))], names=["l", "e", "ids", "v"])

    filed = cut(index.select("e", "ids", "v").mapInArrow(file, "l int, e bigint, ids array<bigint>, v array<double>"))
    counts = filed.groupBy("l").count().toPandas()  # a row for each list
    sizes = np.zeros(len(centroids.value.at), np.int64)
    sizes[counts["l"]] = counts["count"]
    parts = np.maximum(1, -(-sizes // PART)).astype(np.int32)
    blocks = max(1, -(-queries // BLOCK))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, list_ = centroids.value.probes(unit(_matrix(part.column("v"))), k, sizes, ratio)
                times = parts[list_]
                row, list_ = np.repeat(row, times), np.repeat(list_, times)
                salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                ids = part.column("id").take(take)
                block = pa.array((np.asarray(ids) % blocks).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(list_.astype(np.int32)), pa.array(salt.astype(np.int32)), block, ids, part.column("v").take(take)], names=["l", "s", "b", "id", "v"])

    asked = rows.where(is_query).select("id", "v").repartition("id").mapInArrow(aim, "l int, s int, b int, id bigint, v array<double>")
    salts = spark.createDataFrame(pd.DataFrame({"l": np.arange(len(sizes), dtype=np.int32), "_parts": parts}))
    held = filed.join(F.broadcast(salts), "l").select("l", F.pmod(F.xxhash64("e"), F.col("_parts")).cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "e", "ids", "v")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            lists = right.column("ids").combine_chunks()
            first, ids = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))), lists.flatten().to_numpy()
            v, q, query = _matrix(right.column("v")), _matrix(left.column("v")), left.column("id").to_numpy()
            found += [best_pairs(query[at : at + 256], q[at : at + 256], first, ids, v, k) for at in range(0, len(q), 256)]
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    met = asked.groupBy("l", "s", "b").cogroup(held.groupBy("l", "s", "b")).applyInArrow(look, "query_id bigint, vec_id bigint, score double")
    pairs = met.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
