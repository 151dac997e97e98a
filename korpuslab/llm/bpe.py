"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

A text is first split where the tokenizer itself splits it. A piece is encoded by
the tokenizers library, once for each piece a task meets. A piece longer than two
leaves (a run of letters, digits, signs or white space that the tokenizer does
not split) is cut into a power of two of leaves; leaves are encoded in parallel,
on any executor, and neighbours are joined level by level. A join encodes a window
of the tokens around the seam again and doubles it until its outer tokens agree
with those of both sides; since BPE output is valid exactly when each pair of
neighbouring tokens is, the result then equals the encoding of the whole piece.

Texts hold any characters. Those outside the range whose classes all Unicode
versions agree on are split by the library itself. A null text counts as empty;
an empty text has no tokens. Repeated rows give repeated results; rows need an id
only to be put together again, and only documents with long pieces are.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from korpuslab.llm.common import cut

#: A worker is one task; its encoder starts no threads of its own.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the split pattern of the vocabulary (see the vocabulary's own documentation).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes do not depend on the Unicode version of a regular-expression library.
UNSURE = regex.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
#: Characters of a leaf; what is longer than two leaves goes through the tree.
LEAF = 1024
#: Pieces that a worker keeps encoded, in two halves by age.
MEMO = 300_000
#: Tokens that must agree on each side of a window.
AGREE = 3


def default_vocabulary() -> str:
    """The public 50k byte-level vocabulary; read where the library is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write byte b as a printable character: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary file as an encoder and decoder. Made once per worker process and file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        signs = _byte_of_sign()
        self.bytes_of = {i: bytes(signs[c] for c in word) for word, i in spec["model"]["vocab"].items() if all(c in signs for c in word)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: word.encode() for word, i in self.special.items()}
        self.bytes_of_decimal = {str(i): b for i, b in self.bytes_of.items()}
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PATTERN).findall
        self.start = {str(word): str(i) for word, i in self.special.items()}
        self.memo, self.older = dict(self.start), {}

    def encode(self, text: str) -> list[int]:
        """The library's own ids of a text."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str]:
        """The pieces between which no token reaches; special tokens are pieces too."""
        if self.cuts is None or not (found := list(self.cuts.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += self._plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not UNSURE.search(text):
            return self.pieces(text)
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        parts = [text[a:b] for a, b in spans]
        if "".join(parts) != text:
            raise ValueError("the tokenizer's pieces do not cover the text")
        return parts

    def decimals(self, pieces: list[str]) -> list[str]:
        """For each piece its ids in decimal, joined by commas."""
        memo = self.memo
        missing = {p for p in pieces if p not in memo}
        if missing:
            if len(memo) + len(missing) > MEMO // 2:  # the younger half becomes the older; what is met again moves on
                self.older, self.memo = memo, dict(self.start)
                memo = self.memo
                missing = {p for p in pieces if p not in memo}
            for p in missing & self.older.keys():
                memo[p] = self.older[p]
            new = [p for p in missing if p not in memo]
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                for piece, got in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    memo[piece] = ",".join(map(str, got.ids))
        return [memo[p] for p in pieces]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_decimal(self, joined: str) -> str:
        """The same for ids in decimal, joined by commas."""
        return b"".join(map(self.bytes_of_decimal.__getitem__, joined.split(","))).decode("utf-8", "replace") if joined else ""


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def join_ids(left: list[int], right: list[int], encode: Callable[[str], list[int]], bytes_of: dict[int, bytes], window: int = 4) -> list[int]:
    """The encoding of an unsplit text from the encodings of its two parts.

    The window grows until it starts with the left part's tokens and ends with the
    right part's, or takes in all of a side. Its ends lie between characters.
    """
    starts = lambda i: bytes_of[i][0] & 0xC0 != 0x80
    if not left or not right:
        return left or right
    k = max(window, AGREE)
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        while a > 0 and not starts(left[a]):
            a -= 1
        while b < len(right) and not starts(right[b]):
            b += 1
        ids = encode(b"".join(bytes_of[i] for i in [*left[a:], *right[:b]]).decode("utf-8"))
        if (a == 0 or ids[:AGREE] == left[a : a + AGREE]) and (b == len(right) or ids[-AGREE:] == right[b - AGREE : b]):
            return [*left[:a], *ids, *right[b:]]
        k *= 2


def leaves(piece: str, leaf: int = LEAF) -> list[str]:
    """A long piece in a power of two of parts of nearly equal length, each of a leaf at most."""
    n = 1
    while n * leaf < len(piece):
        n *= 2
    return [piece[len(piece) * i // n : len(piece) * (i + 1) // n] for i in range(n)]


def encode_tree(text: str, coder: ByteBPE, leaf: int = LEAF) -> list[int]:
    """The whole encoding in one process; what the distributed form computes level by level."""
    out: list[int] = []
    for piece in coder.split(text):
        if piece in coder.special:
            out.append(coder.special[piece])
            continue
        level = [coder.encode(p) for p in (leaves(piece, leaf) if len(piece) > 2 * leaf else [piece])]
        while len(level) > 1:
            level = [join_ids(level[i], level[i + 1], coder.encode, coder.bytes_of) for i in range(0, len(level), 2)]
        out += level[0]
    return out


def _digest(joined: str, coder: ByteBPE) -> tuple[int, str, str]:
    return joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(coder.decode_decimal(joined).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, leaf: int = LEAF, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; with_ids adds the ids themselves.

    Needs doc_id and text; other columns play no part. Rows of the same id are told apart.
    """
    path = path or default_vocabulary()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 4 + with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids]
    parts_kind = pa.list_(pa.struct([("seq", pa.int32()), ("leaf", pa.int32()), ("n", pa.int32()), ("text", pa.string()), ("decimals", pa.string())]))
    done_schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def finish(doc: int | None, joined: str, coder: ByteBPE) -> tuple:
        row = (doc, *_digest(joined, coder))
        return (*row, [int(x) for x in joined.split(",")] if joined else []) if with_ids else row

    def parts_of(pieces: list[str], coder: ByteBPE) -> list[dict]:
        """Runs of short pieces, encoded, and the leaves of long ones, to be encoded, ``n`` of a piece."""
        parts, run = [], []
        for seq, piece in enumerate([*pieces, None]):
            long = piece is not None and len(piece) > 2 * leaf
            if run and (long or piece is None):
                parts.append({"seq": seq - 1, "leaf": 0, "n": 1, "text": None, "decimals": ",".join(coder.decimals(run))})
                run = []
            if long:
                cut_ = leaves(piece, leaf)
                parts += [{"seq": seq, "leaf": i, "n": len(cut_), "text": x, "decimals": None} for i, x in enumerate(cut_)]
            elif piece is not None:
                run.append(piece)
        return parts

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pieces = coder.split(text.as_py() or "")
                if len(pieces) and max(map(len, pieces)) > 2 * leaf:
                    rows.append((doc, None, None, None, *[None] * with_ids, parts_of(pieces, coder)))
                else:
                    rows.append((*finish(doc, ",".join(coder.decimals(pieces)), coder), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * (len(kinds) + 1), [*kinds, parts_kind], strict=True)], names=[*names, "parts"])

    found = cut(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(first, done_schema + ", parts array<struct<seq:int,leaf:int,n:int,text:string,decimals:string>>"))
    plain = found.where("parts IS NULL").drop("parts")
    if found.where("parts IS NOT NULL").limit(1).count() == 0:
        return plain

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            got = [",".join(map(str, coder.encode(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.string())], names=[*batch.schema.names[:-1], "decimals"])

    def join_pair(pair: pd.DataFrame) -> pd.DataFrame:
        coder = vocabulary(path)
        left, right = ([int(x) for x in s.split(",")] if s else [] for s in pair.sort_values("leaf")["decimals"])
        ids = join_ids(left, right, coder.encode, coder.bytes_of)
        return pair.iloc[:1].assign(leaf=pair["leaf"].min() // 2, n=pair["n"].iloc[0] // 2, decimals=",".join(map(str, ids)))

    schema = "row_key bigint, doc_id bigint, seq int, leaf int, n int, decimals string"
    columns = ["row_key", "doc_id", "seq", "leaf", "n"]
    # leaves of the same text are the same rows, so equal texts under one id get keys of their own
    long = cut(found.where("parts IS NOT NULL").select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "parts"))
    long = long.select("row_key", "doc_id", F.explode("parts").alias("p")).select("row_key", "doc_id", "p.*")
    done = long.where("text IS NULL").select(*columns, "decimals")
    active = cut(long.where("text IS NOT NULL").select(*columns, "text").repartition("row_key", "seq", "leaf").mapInArrow(encode_leaves, schema))
    while active.limit(1).count():  # a level of the tree: whole pieces are set aside and not moved again
        level = cut(active.groupBy("row_key", "seq", F.expr("leaf DIV 2")).applyInPandas(join_pair, schema))
        done, active = done.union(level.where("n = 1")), level.where("n > 1")

    def put_together(row: pd.DataFrame) -> pd.DataFrame:
        joined = ",".join(x for x in row.sort_values("seq")["decimals"] if x)
        return pd.DataFrame([finish(None if pd.isna(row["doc_id"].iloc[0]) else int(row["doc_id"].iloc[0]), joined, vocabulary(path))], columns=names).astype({"doc_id": "Int64"})

    return plain.unionByName(done.groupBy("row_key").applyInPandas(put_together, done_schema))


def decode_column(df: DataFrame, ids: str, into: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the text of an array column of ids; null ids give a null text."""
    path = path or default_vocabulary()

    @F.pandas_udf("string")
    def decode(cells: pd.Series) -> pd.Series:
        coder = vocabulary(path)
        return cells.map(lambda x: None if x is None else coder.decode(list(x)))

    return df.withColumn(into, decode(F.col(ids)))
