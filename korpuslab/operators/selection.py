"""A reproducible sample of clips from a corpus folder, with pseudonymous speakers.

Rows are filtered and resolved against the folder's files by joins; the sample is the
first ``limit`` rows in the order of a keyed digest of the clip id, so it depends on
the seed and the ids alone, not on row order or partitions (and is not the order that
a sequential shuffle with the same seed would give). Only selected files are hashed.
"""

from __future__ import annotations

import posixpath
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from korpuslab.functions.text import pseudonym, stem
from korpuslab.sources.files import Store, folder_of, header_of, listing, read_tsv, selected_checksums

SCHEMA_VERSION = "korpuslab-selection/v1"


#: The keys of the manifest are its fields.
@dataclass(frozen=True)
class SelectionManifest:
    source_version: str
    metadata_checksum: str
    seed: int
    filters: dict[str, Any]
    selected_clips: list[dict[str, str]]
    speaker_distribution: dict[str, int]
    source_checksums: dict[str, str]
    replacement_policy: dict[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {"schema_version": SCHEMA_VERSION, **asdict(self)}


def metadata_file(store: Store, split: str | None = None) -> str:
    """The name of the first of the split's own table, the validated one and the general one that exists."""
    for name in [*([split] if split else []), "validated", "metadata"]:
        if store.exists(f"{name}.tsv"):
            return f"{name}.tsv"
    raise FileNotFoundError(f"{store.root} has no clip table")


def wanted_rows(df: DataFrame, split: str | None = None, locale: str = "tr") -> DataFrame:
    """Rows of the locale and split with a path and a client. Without a locale column every row has it."""
    if "locale" in df.columns:
        df = df.where(F.col("locale") == locale)
    if split is not None and "split" in df.columns:
        df = df.where(F.col("split").isNull() | (F.col("split") == "") | (F.col("split") == split))
    return df.withColumn("path", F.trim("path")).where((F.col("path") != "") & (F.trim("client_id") != ""))


def sample_order(seed: int, key: str | Column) -> Column:
    """A digest whose order is a fixed shuffle for each seed."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key) if isinstance(key, str) else key), 256)


def hash_sample(df: DataFrame, key: str, limit: int, seed: int) -> DataFrame:
    """``limit`` rows in seeded order; a top-k, so no full sort. ``rank`` counts from 1."""
    if limit <= 0:
        raise ValueError("a sample has at least one row")
    first = df.withColumn("_order", sample_order(seed, key)).orderBy("_order", key).limit(limit)
    return first.withColumn("rank", F.row_number().over(W.orderBy("_order", key))).drop("_order")


def stratified_sample(df: DataFrame, stratum: list[str], key: str, each: int, seed: int) -> DataFrame:
    """Up to ``each`` rows of every stratum in seeded order."""
    order = W.partitionBy(*stratum).orderBy("_order", key)
    return df.withColumn("_order", sample_order(seed, key)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).drop("_order")


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its folder once dots are resolved, or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(1)).alias("low")))
    return path.startswith("/") | (depth["low"] < 0)


def plain_path(path: Column) -> Column:
    """A relative path without empty and single-dot parts, double dots resolved; what leaves its folder keeps its first dots."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.when(path.rlike("(^|/)\\.{0,2}(/|$)"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")).otherwise(path)


def resolve_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Each row with ``found``: its path if such a file exists, or the same below ``clips``; null if neither does.

    ``files`` is a listing (path) of the corpus folder.
    """
    files = files.distinct()
    direct = rows.join(files.select(F.col("path").alias("_p"), F.lit(True).alias("_direct")), F.col("path") == F.col("_p"), "left").drop("_p")
    under = direct.join(files.select(F.col("path").alias("_p"), F.lit(True).alias("_under")), F.concat(F.lit("clips/"), F.col("path")) == F.col("_p"), "left").drop("_p")
    found = F.when(F.col("_direct"), F.col("path")).when(F.col("_under"), F.concat(F.lit("clips/"), F.col("path")))
    return under.withColumn("found", found).drop("_direct", "_under")


def clips_of(rows: DataFrame, source_version: str) -> DataFrame:
    """What a manifest says of a clip. The client id is hashed as it is, spaces included."""
    return rows.select(stem("path").alias("clip_id"), F.col("found").alias("path"), F.coalesce("sentence", F.lit("")).alias("sentence"), pseudonym(source_version, "client_id").alias("speaker_id"))


def select_clips(spark: SparkSession, root: str | Path, *, limit: int, seed: int, source_version: str, split: str | None = None) -> SelectionManifest:
    if limit <= 0:
        raise ValueError("a sample has at least one clip")
    if not source_version:
        raise ValueError("a source version is needed")
    root = folder_of(root)
    table = metadata_file(Store(spark, root, make=False), split)
    names = header_of(spark, f"{root}/{table}")
    df = read_tsv(spark, f"{root}/{table}")
    for name in ("client_id", "path", "sentence"):
        if name not in names:
            df = df.withColumn(name, F.lit("" if name == "sentence" else None).cast("string"))
    rows = wanted_rows(df, split)
    if not rows.where(escapes(F.col("path"))).isEmpty():
        raise ValueError("an audio path leaves the corpus folder")
    rows = rows.withColumn("path", plain_path(F.col("path")))
    resolved = resolve_files(rows, listing(spark, root).select("path"))
    missing = resolved.where("found IS NULL").count()
    chosen = hash_sample(clips_of(resolved.where("found IS NOT NULL"), source_version), "clip_id", limit, seed).orderBy("rank").collect()
    sums = selected_checksums(spark, root, [table, *(r["path"] for r in chosen)])
    metadata_checksum = sums[table] if table in {r["path"] for r in chosen} else sums.pop(table)
    speakers: dict[str, int] = {}
    for r in chosen:
        speakers[r["speaker_id"]] = speakers.get(r["speaker_id"], 0) + 1
    return SelectionManifest(
        source_version=source_version,
        metadata_checksum=metadata_checksum,
        seed=seed,
        filters={"locale": "tr", "split": split, "limit": limit},
        selected_clips=[{k: r[k] for k in ("clip_id", "path", "sentence", "speaker_id")} for r in chosen],
        speaker_distribution=speakers,
        source_checksums=sums,  # by path: file names alone may repeat
        replacement_policy={"missing_source": "excluded", "missing_count": missing},
    )


def changed_clips(selected: DataFrame, now: DataFrame) -> DataFrame:
    """path and verdict of selected files (path, checksum) that are ``missing`` now or ``changed``; a file without a checksum counts as changed."""
    met = selected.select("path", F.col("checksum").alias("_old")).join(now.select("path", F.col("checksum").alias("_new")), "path", "left")
    verdict = F.when(F.col("_new").isNull(), "missing").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return met.select("path", verdict.alias("verdict")).where("verdict IS NOT NULL")


def verify_selection(spark: SparkSession, root: str | Path, manifest: SelectionManifest) -> None:
    """Raise if the clip table or a selected file is not as it was."""
    root = folder_of(root)
    store = Store(spark, root, make=False)
    table, paths = metadata_file(store, manifest.filters.get("split")), [c["path"] for c in manifest.selected_clips]
    for path in paths:
        leaves = posixpath.normpath(path).startswith(("../", "/")) or ("://" not in root and Path(root) not in (Path(root) / path).resolve().parents)
        if leaves or not store.exists(path):
            raise ValueError(f"a selected file is not there: {path}")
    now = selected_checksums(spark, root, [table, *paths])
    if now[table] != manifest.metadata_checksum:
        raise ValueError("the clip table changed since the selection")
    table_of = lambda sums: spark.createDataFrame([(p, sums.get(p)) for p in paths], "path string, checksum string")
    if paths and (bad := changed_clips(table_of(manifest.source_checksums), table_of(now)).orderBy("path").first()) is not None:
        raise ValueError(f"a selected file changed: {bad['path']}")
