"""File sources and sinks: tab-separated tables, checksummed folders, JSON, JSON lines."""

from __future__ import annotations

import hashlib
import json
import os
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HASH_BLOCK = 1 << 20


class Store:
    """A folder on any file system Spark can reach, for the few small things that are not tables."""

    def __init__(self, spark: SparkSession, root: str | Path, make: bool = True):
        root = str(root)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self._fs.makeQualified(self._path(root)).toString().rstrip("/")
        if make:
            self._fs.mkdirs(self._path(self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(n for x in self._fs.listStatus(self._path(self.path(folder))) if not (n := x.getPath().getName()).endswith(".claim"))

    def create(self, name: str, text: str) -> bool:
        """Write a small new file; False if it is there already, whoever made it.

        The claim on the name is a file of its own beside it; the text is published by renaming, so no reader sees
        half of it. One who finds the name claimed but no text yet is told that it is there.
        """
        at, claim = self._path(self.path(name)), self._path(self.path(f"{name}.claim"))
        if self._fs.exists(at) or not self._fs.createNewFile(claim):
            return False
        part = self._path(self.path(f".{name.replace('/', '-')}.{uuid.uuid4().hex}"))
        with_text = self._fs.create(part, True)
        with_text.write(bytearray(text.encode()))
        with_text.close()
        self._fs.mkdirs(at.getParent())
        return bool(self._fs.rename(part, at))

    def read(self, name: str) -> str:
        at = self._path(self.path(name))
        stream = self._fs.open(at)
        try:
            return bytes(stream.readNBytes(int(self._fs.getFileStatus(at).getLen()))).decode()
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        """Rename a file or folder below the root; what is not there (any more) is left alone."""
        if self.exists(old):
            self._fs.mkdirs(self._path(self.path(new)).getParent())
            self._fs.rename(self._path(self.path(old)), self._path(self.path(new)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.path(name)), True)
        self._fs.delete(self._path(self.path(f"{name}.claim")), True)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a tab-separated file."""
    lines = spark.read.text(path, wholetext=False).limit(1).collect()
    return lines[0][0].lstrip("﻿").split("\t") if lines else []


def read_tsv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A tab-separated table with a header, all strings; columns come by name, missing ones of ``schema`` are null.

    Columns the schema does not name are carried along. Quotes follow the usual CSV rules;
    a short row ends in nulls. ``row_number_in_file`` keeps the order of a small file's rows.
    """
    names = header_of(spark, path)
    layout = StructType.fromDDL(", ".join(f"`{n}` string" for n in names)) if names else StructType()
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, schema=layout, enforceSchema=True, encoding="UTF-8") if names else spark.createDataFrame([], "row_number_in_file bigint")
    for field in schema.fields if schema else []:
        if field.name not in names:
            df = df.withColumn(field.name, F.lit(None).cast("string"))
    return df if "row_number_in_file" in df.columns else df.withColumn("row_number_in_file", F.monotonically_increasing_id())


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="")


def checksum(content: bytes) -> str:
    return f"sha256:{hashlib.sha256(content).hexdigest()}"


def file_checksum(path: str | Path) -> str:
    """The checksum of one local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(HASH_BLOCK):
            digest.update(block)
    return f"sha256:{digest.hexdigest()}"


def folder_of(root: str | Path) -> str:
    """A folder as readers take it: a URI as it is, a local path made absolute."""
    return str(root).rstrip("/") if "://" in str(root) else str(Path(root).expanduser().resolve())


def _file_system(root: str):
    """The file system of a folder, and the folder's path there; in a worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _entries(system, top: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Path below ``top``, whether it is a folder, and size, of what a folder holds; local links to folders are not followed."""
    from pyarrow import fs

    within = f"{folder}/" if folder else ""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(f"{top}/{folder}") as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield within + x.name, True, 0
                elif x.is_file():
                    yield within + x.name, False, x.stat().st_size
    else:
        for x in system.get_file_info(fs.FileSelector(f"{top}/{folder}")):
            if x.type != fs.FileType.NotFound:
                yield within + x.base_name, x.type == fs.FileType.Directory, x.size or 0


def _cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder the session names; a local one only where none is, on one machine."""
    context = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="korpuslab-"))
    return df.checkpoint()


def listing(spark: SparkSession, root: str | Path) -> DataFrame:
    """path (relative) and size of every file below a folder, whatever its name or its folders' names start with.

    Executors list the folders of a level, level by level; the driver learns only whether there is another. A
    folder's own entries are listed by one task. Folders may be on any file system that Arrow opens by URI.
    """
    root = folder_of(root)

    def run(batches):
        import pandas as pd

        system, top = _file_system(root)
        for part in batches:
            for folder in part["path"]:
                rows = []
                for row in _entries(system, top, folder):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["path", "folder", "size"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "folder", "size"]).astype({"path": str, "folder": bool, "size": "int64"})

    frontier, files = spark.createDataFrame([("",)], "path string").coalesce(1), None
    while files is None or not frontier.isEmpty():
        level = _cut(frontier.mapInPandas(run, "path string, folder boolean, size long"))
        here = level.where("NOT folder").select("path", "size")
        files = here if files is None else files.unionByName(here)
        frontier = level.where("folder").select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files


def _hashed(files: DataFrame, root: str) -> DataFrame:
    """path and checksum of files (path) below a folder, read in blocks, so a file may be larger than a task's memory."""

    def run(batches):
        import pandas as pd

        system, top = _file_system(root)

        def one(name: str) -> str:
            digest = hashlib.sha256()
            with system.open_input_stream(f"{top}/{name}", compression=None) as stream:
                while block := stream.read(HASH_BLOCK):
                    digest.update(block)
            return f"sha256:{digest.hexdigest()}"

        for part in batches:
            yield pd.DataFrame({"path": part["path"], "checksum": [one(n) for n in part["path"]]}).astype(str)

    spread = files.select("path").repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), files.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInPandas(run, "path string, checksum string")


def checksums(spark: SparkSession, root: str | Path) -> DataFrame:
    """path (relative) and checksum of all files below a folder but those whose name starts with a dot."""
    files = listing(spark, root)
    return _hashed(files.where(~F.regexp_extract("path", "([^/]*)$", 1).startswith(".")), folder_of(root))


def selected_checksums(spark: SparkSession, root: str | Path, paths: list[str]) -> dict[str, str]:
    """Checksums of a selection's files; no other is read."""
    if not paths:
        return {}
    return {r["path"]: r["checksum"] for r in _hashed(spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string"), folder_of(root)).collect()}


def canonical_json(value: Any, ascii_only: bool = False) -> str:
    """JSON with sorted keys and without spaces."""
    return json.dumps(value, ensure_ascii=ascii_only, sort_keys=True, separators=(",", ":"))


def write_json(path: str | Path, value: Any) -> None:
    """One JSON document, published by renaming, so no reader sees half of it."""
    target = Path(path).expanduser().resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2) + "\n")
    os.replace(temporary, target)


def write_json_lines(path: str | Path, rows: Iterable[dict]) -> None:
    """Rows as JSON lines as they come, keys sorted, published by renaming."""
    target = Path(path).expanduser().resolve()
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, temporary = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
        f.writelines(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows)
    os.replace(temporary, target)


def publish_lines(lines: DataFrame, path: str) -> None:
    """One text file of the one string column, in the order of its partitions.

    Executors write the parts; their bytes pass through a buffer into a file beside ``path``, which is renamed.
    """
    spark = lines.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    at = fs.makeQualified(at)
    parts, whole = (spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}.{kind}") for kind in ("parts", "whole"))
    lines.write.text(parts.toString())
    out = fs.create(whole, True)
    try:
        for name in sorted(x.getPath().getName() for x in fs.listStatus(parts)):
            if name.startswith("part-"):
                stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(parts, name))
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, HASH_BLOCK, False)
                finally:
                    stream.close()
    finally:
        out.close()
    fs.delete(at, False)
    fs.rename(whole, at)
    fs.delete(parts, True)


def append_json_line(path: str | Path, row: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(row, sort_keys=True) + "\n")
