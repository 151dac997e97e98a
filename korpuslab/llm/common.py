"""What the corpus operators share: table access, token rules, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import warnings
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words here.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a local one only where none is configured, which suits one machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if root is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            warnings.warn("spark.checkpoint.dir is not set: on a cluster it must name a shared folder", stacklevel=2)
        context.setCheckpointDir(tempfile.mkdtemp(prefix="korpuslab-"))
    return root or context.getCheckpointDir()


#: Folders and tables made below the shared folder by this process, oldest first, until they are released.
_made: list[tuple[str, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared scratch folder."""
    path = f"{scratch_root(spark)}/korpuslab-{name}-{uuid.uuid4().hex}"
    _made.append(("path", path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def made() -> int:
    """A mark for ``release``: how much intermediate data this process holds now."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete intermediate data made after the mark ``since``; no result that still reads it may be used afterwards."""
    for kind, name in _made[since:]:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        elif name not in keep:
            remove(spark, name)
    _made[since:] = [x for x in _made[since:] if x[1] in keep]


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder; its partitioning stays known."""
    scratch_root(df.sparkSession)
    done = df.checkpoint(eager=True)
    file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        _made.append(("path", file.get()))
    return done


def numbered(rows: DataFrame, order: list[str], into: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of columns that tell all rows apart: ``into``.

    Rows are dealt by ranges of that order, sampled, so partitions are even however values repeat; places inside a
    partition come with the rows, and only a count for each partition is summed up in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_place", 33)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_before")


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole(docs: DataFrame, into: str = "_row") -> Column:
    """All columns of ``docs`` in one struct, out of the way of names an operator uses inside."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias(into)


def field(row: str, name: str) -> Column:
    """One column of such a struct under its own name."""
    return F.col(f"{row}.{quoted(name)}").alias(name)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, separated by ASCII white space only.

    ``bytes.lower`` and ``bytes.split`` touch ASCII alone, which is the rule.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fold_of(doc_id: int | None, folds: int) -> int:
    """crc32 of the id written in decimal, modulo the number of folds; a null id is in fold 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def fold(column: str | Column, folds: int) -> Column:
    """The same fold as a column."""
    return F.coalesce(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % folds, F.lit(0))
