"""Operator 12: fill-in-the-middle forms of whole texts.

The kernel takes an Arrow batch as it lies in memory, offsets and UTF-8 bytes, and cuts all its rows together: a table
tells the class of each byte, the classes of neighbouring bytes tell where a unit begins, a running sum over the batch
that starts anew with each document numbers the units, and one binary search in it finds every cut of every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks the parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of documents that stay plain, and of the others that put the suffix first.
PLAIN, SPM, SEED = 10, 20, 1
#: Bytes of texts cut at a time; a longer text is cut alone.
SLICE = 4 << 20

_CONTINUES, _SPACE, _OTHER = 0, 1, 2
#: The class of each byte: 0 inside a character, 1 white space, 2 the start of any other character.
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[0x80:0xC0] = _CONTINUES
CLASSES[[0x20, *range(0x09, 0x0E)]] = _SPACE
#: Whether a unit begins at a byte, by the class before it and its own: each character, or each run of spaces or of others.
BEGINS = {
    "characters": np.array([[False, True, True]] * 3),
    "words": np.array([[False, True, False], [False, False, True], [False, True, False]]),
}


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str = "characters") -> np.ndarray:
    """A mask of bytes where a unit begins; the first byte of a document always does."""
    kind = CLASSES[data]
    begins = np.empty(len(data), bool)
    begins[1:] = BEGINS[unit][kind[:-1], kind[1:]]
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return begins


def cut_points(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "characters") -> tuple[np.ndarray, ...]:
    """For each document: its units, units before the first and before the second cut, and the bytes where both cuts are."""
    count = np.cumsum(unit_starts(data, offsets, unit), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    upto = np.concatenate([[0], count])
    base = upto[offsets[:-1]].astype(np.int64)  # units of the documents before: where a document's own sum starts anew
    n = upto[offsets[1:]] - base
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = np.minimum(a, b), np.maximum(a, b)
    places = np.searchsorted(count, np.concatenate([base + a, base + b]) + 1)  # the byte that starts the next unit
    places = np.minimum(places, np.tile(offsets[1:], 2))  # a cut after the last unit is the document's end
    return n, a, b, places[: len(n)], places[len(n) :]


def found(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Where the mark stands first in each document, as a place in ``data``; -1 where it does not."""
    k, mark_ = len(mark), np.frombuffer(mark, np.uint8)
    hits = np.ones(max(0, len(data) - k + 1), bool)
    for i, byte in enumerate(mark_):
        hits &= data[i : len(data) - k + 1 + i] == byte
    at = np.concatenate([np.flatnonzero(hits), [len(data) + k]])
    first = at[np.searchsorted(at, offsets[:-1])]
    return np.where(first + k <= offsets[1:], first, -1)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls, offsets from 0."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in runs of at most ``SLICE`` bytes of text, or one row."""
    offsets = _buffers(batch.column(text))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _strings(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary()).cast(pa.string())


def _transform(unit: str, plain: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in _slices(b, 1)):
            data, offsets = _buffers(batch.column(1))
            h1, h2, h3, h4 = (batch.column(k).to_numpy() for k in range(2, 6))
            n, a, b, x, y = cut_points(data, offsets, h1, h2, unit)
            marked = np.maximum.reduce([found(data, offsets, m) for m in (PREFIX, SUFFIX, MIDDLE)]) >= 0
            is_plain = (n == 0) | marked | (h3 % 100 >= 100 - plain)
            first = h4 % 100 < spm
            raw, out = data.tobytes(), []
            for p, s, i, u, v, j in zip(is_plain.tolist(), first.tolist(), offsets[:-1].tolist(), x.tolist(), y.tolist(), offsets[1:].tolist(), strict=True):
                if p:
                    out.append(raw[i:j])
                elif s:
                    out.append(b"".join((SUFFIX, raw[v:j], PREFIX, raw[i:u], MIDDLE, raw[u:v])))
                else:
                    out.append(b"".join((PREFIX, raw[i:u], SUFFIX, raw[v:j], MIDDLE, raw[u:v])))
            form = np.where(is_plain, "plain", np.where(first, "spm", "psm"))
            yield pa.record_batch([
                batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64(), mask=is_plain), pa.array(b - a, pa.int64(), mask=is_plain), _strings(out),
            ], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in _slices(b, b.schema.get_field_index("output"))):
        at = batch.schema.names.index("output")
        data, offsets = _buffers(batch.column(at))
        p, s, m = (found(data, offsets, x).tolist() for x in (PREFIX, SUFFIX, MIDDLE))
        raw, texts = data.tobytes(), []
        for form, i, j, p_, s_, m_ in zip(batch.column(batch.schema.names.index("form")).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), p, s, m, strict=True):
            if form == "psm":
                texts.append(b"".join((raw[p_ + 3 : s_], raw[m_ + 3 : j], raw[s_ + 3 : m_])))
            elif form == "spm":
                texts.append(b"".join((raw[p_ + 3 : m_], raw[m_ + 3 : j], raw[s_ + 3 : p_])))
            else:
                texts.append(raw[i:j])
        yield pa.record_batch([*batch.columns, _strings(texts)], names=[*batch.schema.names, "restored"])


def draws(doc: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits that the seed and the id fix; rows without an id share theirs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "characters", plain: int = PLAIN, spm: int = SPM, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null where plain) and output of every document.

    Texts that are empty, null or hold a mark stay plain. Rows that share id and text get the same form; rows without
    an id draw the same numbers. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), seed))
    return rows.mapInArrow(_transform(unit, plain, spm), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` with the text, ``restored``, that their ``output`` was made from, told by it and ``form`` alone."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_restore, f"{fields}, restored string")


def middle_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows = restore(fill_in_middle(docs))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
