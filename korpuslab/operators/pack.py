"""Benchmark packs: four tables with rules between them, frozen by checksum.

Rules are queries that return violations (rule, key, detail, place); the loader raises
for the first in the order of rules and rows, a caller may look at all of them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuslab.errors import FreezeError
from korpuslab.functions.text import parse_bool
from korpuslab.schemas import LEXICON, PROMPTS, SENTENCES, TERMS
from korpuslab.sources.files import canonical_json, checksums, folder_of, read_tsv

SCHEMA_VERSION = "korpuslab-freeze/v1"
SPLITS = ("tech_dev", "tech_test_frozen")
STAGES = ("pre_recording", "release")


@dataclass(frozen=True)
class BenchmarkPack:
    terms: DataFrame
    lexicon: DataFrame
    sentences: DataFrame
    prompts: DataFrame
    families: dict[str, set[str]]


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _violation(df: DataFrame, rule: str, key: str, detail: str | Column = "", place: str = "row_number_in_file") -> DataFrame:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    where = F.col(place).cast("bigint") if place in df.columns else F.lit(0).cast("bigint")
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"), where.alias("place"))


def lexicon_violations(lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """Lexicon rows of unknown terms, without receipts, or not frozen before authoring."""
    known = terms.select("canonical_term").distinct()
    unknown = lexicon.join(known, "canonical_term", "left_anti").unionByName(lexicon.where(F.col("canonical_term") == "").join(known, "canonical_term", "left_semi"))
    return reduce(DataFrame.unionByName, [
        _violation(unknown, "1-unknown-term", "canonical_term"),
        _violation(lexicon.where(blank("source_id") | blank("source_uri")), "2-no-receipt", "canonical_term"),
        _violation(lexicon.where(~parse_bool("frozen_before_authoring")), "3-not-frozen", "canonical_term"),
    ])


def families_by_split(sentences: DataFrame) -> DataFrame:
    """Families of each split; sentences without a family (controls) do not count."""
    return sentences.where(~blank("term_family")).groupBy("split").agg(F.collect_set("term_family").alias("families"))


def leaking_families(sentences: DataFrame) -> DataFrame:
    """Families that are in more than one split."""
    return sentences.where(~blank("term_family")).groupBy("term_family").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def family_mismatches(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """Sentences whose family is not that of their term; of a term's several rows the last counts, unknown terms pass."""
    last = terms.withColumn("_at", F.col("row_number_in_file") if "row_number_in_file" in terms.columns else F.monotonically_increasing_id())
    last = last.groupBy("term_id").agg(F.max_by("term_family", "_at").alias("_family"))
    return sentences.where(~blank("term_id")).join(last, "term_id").where(~F.coalesce("term_family", F.lit("")).eqNullSafe(F.coalesce("_family", F.lit(""))))


def sentence_violations(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        _violation(sentences.where(~F.coalesce("split", F.lit("")).isin(*SPLITS)), "4-unknown-split", "sentence_id", F.coalesce("split", F.lit(""))),
        _violation(family_mismatches(sentences, terms), "5-family-mismatch", "sentence_id", F.col("term_id")),
        _violation(leaking_families(sentences), "6-family-leak", "term_family"),
    ])


def load_pack(spark: SparkSession, root: str | Path) -> BenchmarkPack:
    root = folder_of(root)
    tables = {name: read_tsv(spark, f"{root}/{name}.tsv", schema) for name, schema in (("terms", TERMS), ("operational_lexicon", LEXICON), ("sentences", SENTENCES), ("spontaneous_prompts", PROMPTS))}
    for name, table in tables.items():
        if table.isEmpty():
            raise ValueError(f"{name} has no rows")
    terms, lexicon, sentences, prompts = tables.values()
    bad = lexicon_violations(lexicon, terms).unionByName(sentence_violations(sentences, terms)).orderBy("rule", "place", "key").first()
    if bad is not None:
        raise ValueError(f"{bad['rule'][2:]}: {bad['key']} {bad['detail']}".strip())
    lexicon = lexicon.withColumn("frozen_before_authoring", parse_bool("frozen_before_authoring"))
    sentences = sentences.withColumn("negative_control", parse_bool("negative_control"))
    found = {r["split"]: set(r["families"]) for r in families_by_split(sentences).collect()}  # two splits
    return BenchmarkPack(terms, lexicon, sentences, prompts, {s: found.get(s, set()) for s in SPLITS})


def content_id(files: dict[str, str]) -> str:
    return f"content-{hashlib.sha256(canonical_json(files, ascii_only=True).encode()).hexdigest()[:24]}"


def freeze(spark: SparkSession, root: str | Path, *, content_version: str, stage: str) -> dict[str, Any]:
    """A manifest that pins every file of a folder."""
    if not content_version or stage not in STAGES:
        raise ValueError("a content version and a known stage are needed")
    files = {r["path"]: r["checksum"] for r in checksums(spark, root).collect()}  # a pack is a few files
    return {"schema_version": SCHEMA_VERSION, "content_version": content_version, "stage": stage, "content_id": content_id(files), "files": files}


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose checksum is not the same in two checksum tables, or that only one of them has."""
    both = old.select("path", F.col("checksum").alias("old")).join(new.select("path", F.col("checksum").alias("new")), "path", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def verify_frozen(spark: SparkSession, root: str | Path, manifest: dict[str, Any]) -> None:
    old = spark.createDataFrame(list((manifest.get("files") or {}).items()), "path string, checksum string")
    if (bad := changed_files(old, checksums(spark, root)).orderBy("path").first()) is not None:
        raise FreezeError(f"frozen content changed: {bad['path']}; give it a new version")


def table_digest(df: DataFrame, key: str, by: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's rows that does not depend on their order; rows are hashed before they are gathered."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    return df.groupBy(*by).agg(F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(row))), 256).alias(key))
