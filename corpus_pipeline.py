"""A corpus pipeline: each stage works on all that the stage before it kept.

Documents in no learned language go; lines that repeat across documents go; of each
group of near-duplicates one document stays; the rest is mixed to target weights;
what is left is encoded. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuslab.llm import bpe, langid, lines, mixing, simhash
from korpuslab.llm.common import made, release, scratch_path, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejects texts in no learned language, and ambiguous ones (far from every codeword, or without a majority).

    Null texts and texts without a letter go. Repeated rows share their fate. Where nothing can be learned all goes.
    """
    return langid.identified_rows(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines of 40 characters or more in 5 documents or more stay in the one of largest id; n_chars follows the text.

    Null texts stay null; rows without an id keep all their lines; rows that share an id are one document.
    """
    return lines.with_lines_dropped(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, over 5-word shingles and a similarity of 0.8 by fingerprints of 1,152 bits: one row of each component stays.

    That is the one of least id; ties among rows of one id, and rows without an id, go by a digest of the row.
    Empty and null texts are copies of each other.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document as many times as its leaf's budget takes it, up to four.

    Null parts of the path count as empty; rows that agree in id and tokens are taken alike; texts without tokens cost nothing.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token counts and digests of every row that is left; a null text counts as empty, repeated rows are repeated."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing_weights", mix_sources),
    ("bpe", encode),
]

#: Language models, fingerprints and BPE are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next.

    What a stage held, and the output before it, is deleted once its own output is written. Columns of
    documents may have any names beside the five that stages use; an empty table gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        rows = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        release(spark, before, keep=(path,))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
