"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit for each bit position that more than half of the text's
shingle hashes set. It is cut into segments of 32 bits. Every distinct fingerprint is
filed under each segment as it is and under the small Hamming ball of radius 1 around
it; what meets under a key is compared in full, by all bits.

Of two segments one bit apart exactly one has the zero, so each is filed under itself
and under its zero bits set to one. Segments meet if they differ in one bit, or in two
of which each has one.

``NARROW`` (the query's law) has 64 bits, two segments, and links at 3 or fewer
differing bits: all links are found.

``WIDE`` (the pipeline's) has 1,152 bits over 5-word shingles. The angle between shingle
counts says 175 differing bits for a similarity of 0.8, with a deviation of 12; it links
at 194, so that nearly all pairs at 0.8 are within, and few below 0.7. Two fingerprints
meet in one of 36 segments for certain up to 71 differing bits (similarity 0.92 or so),
and more than nine in ten times at 0.8; see the README for measured shares.

A first shuffle carries keys and numbers of fingerprints alone, under the wide law packed
by buckets of keys; only keys where two
different values meet, or one value twice, are looked at further. No pair is listed beyond a spanning forest of the links
of a key, each found component a star around its least member. Where very many meet
under a key of the narrow law, links are found by looking up the ball of 3 bits around
each in the other half, so work grows with the members, not their pairs. A key's
members come to one task: they are distinct fingerprints within a small ball, not rows.

Links of distinct fingerprints become components by star contraction, each round cut
by a reliable checkpoint. Equal texts share one fingerprint and never multiply. A hot
fingerprint only meets joins that may split.

A null text has no words, like an empty one: fingerprint zero. Documents without an
id get a component but never name one; a component of only such has a null id. Texts
of any length count whole. An empty table gives an empty result; of other columns,
whatever their names, only ``one_of_each`` takes notice.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import cut, field, quoted, whole, words_of

SEED = 42
#: Shingles whose bits are summed at once.
BLOCK = 16_384
#: Members of a key from which the ball is looked up.
MANY = 20_000
#: Fingerprints whose keys are packed at once, and keys of a bucket at most, on average.
SLICE, BUCKET = 2_048, 1 << 17


@dataclass(frozen=True)
class Law:
    """Words of a shingle, 64-bit words of a fingerprint, and the bits that may differ."""

    shingle: int
    words: int
    radius: int

    @property
    def bits(self) -> str:
        return f"binary of {8 * self.words} bytes"


NARROW, WIDE = Law(3, 1, 3), Law(5, 18, 194)


def _more(h: np.ndarray, words: int) -> np.ndarray:
    """Rows of ``words`` 64-bit words: the hash itself, and mixtures of it with fixed odd numbers."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, law: Law = NARROW) -> bytes:
    """The fingerprint of a text, most significant byte first."""
    words = words_of(text)
    if not words:
        return bytes(8 * law.words)
    size = law.shingle
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = [x - 1 for x in itertools.accumulate(len(w) + 1 for w in words)]
    spans = zip(itertools.chain((0,), (e + 1 for e in ends)), ends[min(size, len(words)) - 1 :], strict=False)
    digest, sums = xxhash.xxh64_intdigest, np.zeros(64 * law.words, np.int64)
    while block := [digest(joined[a:b], SEED) for a, b in itertools.islice(spans, BLOCK)]:
        h = _more(np.array(block, np.uint64), law.words).astype(">u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * sums > n).tobytes()


def fingerprints(rows: DataFrame, law: Law = NARROW, text: str = "text") -> DataFrame:
    """``rows`` with the column ``text`` replaced by the fingerprint ``fp``, binary."""
    others = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [fingerprint(t.as_py(), law) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.binary())], names=[*others, "fp"])

    return rows.mapInArrow(run, ", ".join(f"{quoted(c)} {t}" for c, t in rows.dtypes if c != text) + ", fp binary")


_FLIPS = np.append(np.uint64(0), np.uint64(1) << np.arange(32, dtype=np.uint64))


def _keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of rows (node, fp), with their nodes and flips. A key is the place of the segment and its value or a neighbour's.

    ``flip`` is 0 for the value itself, else one more than the place of the bit that differs.
    """
    segments = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u4").astype(np.uint64).reshape(part.num_rows, -1)
    place = np.arange(segments.shape[1], dtype=np.uint64) << np.uint64(32)
    row, at, flip = np.nonzero((segments[:, :, None] & _FLIPS) == 0)
    return (segments[row, at] | _FLIPS[flip]) | place[at], part.column(0).to_numpy()[row], flip.astype(np.int8)


def _filed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, flip) of rows (node, fp)."""
    for batch in rows:
        for at in range(0, batch.num_rows, 1024):
            key, node, flip = _keys(batch.slice(at, 1024))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(flip)], names=["key", "node", "flip"])


#: An odd number: multiplication by it moves 32-bit values around without meeting, and its inverse moves them back.
SPREAD = 0x9E3779B1
_BACK = pow(SPREAD, -1, 1 << 32)


def _packed(bits: int):
    """Rows (bucket, payload) of rows (node, fp): all keys of a slice that fall into a bucket.

    A bucket is a place and the first ``bits`` bits of the spread values. A payload holds the values, nodes and flips
    of its keys by byte planes, values as differences: most planes hardly change, and compression takes them away.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, SLICE):
                key, node, flip = _keys(batch.slice(at, SLICE))
                value = (key & np.uint64(0xFFFFFFFF)) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)
                key = key >> np.uint64(32) << np.uint64(32) | value
                order = np.argsort(key)
                bucket = (key[order] >> np.uint64(32 - bits)).view(np.int64)
                cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                value = value[order].astype("<u4")
                steps = np.diff(value, prepend=value[:1])
                steps[cuts] = value[cuts]
                planes = np.concatenate([steps.view(np.uint8).reshape(-1, 4), node[order].astype("<i8").view(np.uint8).reshape(-1, 8), flip[order, None].view(np.uint8)], axis=1)
                payload = [zlib.compress(planes[a:b].T.tobytes(), 1) for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    return run


def _unpacked(bits: int, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, flip) of rows (bucket, payload) sorted by bucket, a batch for each bucket, sorted by key."""
    cells = (cell for batch in rows for cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    for bucket, group in itertools.groupby(cells, lambda cell: cell[0]):
        parts = [np.frombuffer(zlib.decompress(payload), np.uint8).reshape(13, -1).T for _, payload in group]
        value = np.concatenate([np.ascontiguousarray(part[:, :4]).view("<u4").ravel().cumsum(dtype=np.uint64) for part in parts])
        planes = np.concatenate(parts)
        order = np.argsort(value, kind="stable")
        key = (value[order] * np.uint64(_BACK) & np.uint64(0xFFFFFFFF)) | np.uint64(bucket >> bits << 32)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.ascontiguousarray(planes[order, 4:12]).view("<i8").ravel()), pa.array(planes[order, 12].astype(np.int8))], names=["key", "node", "flip"])


_BALL = np.array([sum(1 << b for b in bits) for r in range(NARROW.radius + 1) for bits in itertools.combinations(range(32), r)], np.uint64)


def _far(members: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.bitwise_count(members ^ at).sum(-1)


def _stars(members: np.ndarray, exact: np.ndarray, law: Law, shift: int) -> list[tuple[int, int]]:
    """Links that connect what is connected under one key, as (place, place of the first of its component).

    ``members`` are rows of words. Under the narrow law those that are not ``exact`` do not link to each other
    here (they meet under another key); ``shift`` places the half that may still differ.
    """
    if law.words == 1 and len(members) > MANY:
        return _stars_by_ball(members[:, 0], exact, shift)
    left, edges = np.append(np.flatnonzero(exact), np.flatnonzero(~exact)), []
    while len(left) > 1 and exact[left[0]]:
        first, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            at, wave = wave[0], wave[1:]
            ok = _far(members[left], members[at]) <= law.radius
            if not exact[at]:
                ok &= exact[left]
            hit = left[ok]
            edges += [(int(h), int(first)) for h in hit]
            left, wave = left[~ok], np.concatenate([wave, hit])
    return edges


def _stars_by_ball(members: np.ndarray, exact: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """The same by lookups: for each member the ball of the other half among the values that are there."""
    half = (members >> np.uint64(shift)) & np.uint64(0xFFFFFFFF)
    order = np.argsort(half, kind="stable")
    values = half[order]
    open_, edges = np.ones(len(members), bool), []
    for start in np.flatnonzero(exact):
        if not open_[start]:
            continue
        open_[start] = False
        wave = [start]
        while wave:
            at = wave.pop()
            probe = _BALL ^ half[at]
            lo, hi = np.searchsorted(values, probe), np.searchsorted(values, probe, "right")
            near = np.concatenate([order[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)])
            near = near[open_[near] & (np.bitwise_count(members[near] ^ members[at]) <= NARROW.radius)]
            if not exact[at]:
                near = near[exact[near]]
            open_[near] = False
            edges += [(int(h), int(start)) for h in near]
            wave += near.tolist()
    return edges


def _whole_keys(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows that come key by key in batches that end where a key does, with the places where keys start and end."""
    held: list[pa.RecordBatch] = []

    def ready(part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        key = part.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return part, cuts, np.append(cuts[1:], len(key))

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in rows:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        other = np.flatnonzero(key != key[-1])
        at = int(other[-1]) + 1 if len(other) else 0
        if at or (held and held[0].column(0)[0].as_py() != key[0]):  # what is held is closed by this batch
            held.append(batch.slice(0, at))
            held = [x for x in held if x.num_rows]
            if held:
                yield ready(joined())
            held = []
        held.append(batch.slice(at))
    if held:
        yield ready(joined())


def _met(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, flip) that come key by key those whose key says something, under the narrow law.

    A key says nothing if one node alone has it, or if none has it as it is: exactly one side of a bit has.
    If all its nodes have the same value one bit off they meet under that value too.
    """
    for part, cuts, ends in _whole_keys(rows):
        flip = part.column(2).to_numpy()
        some = (ends - cuts > 1) & (np.minimum.reduceat(flip, cuts) == 0)
        keep = part.filter(pa.array(np.repeat(some, ends - cuts)))
        yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1), pa.array(keep.column(2).to_numpy() == 0)], names=["key", "node", "exact"])


def _moved(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same under the wide law, where all that meet may link.

    The nodes of a key have one value or several, by their flips. Those of most nodes stay where they are,
    under that value's own key, and the others move there. So the many nodes of one value are not listed again
    for each neighbour of it: of two values the fewer nodes move. What met under the key meets there.
    """
    for part, cuts, ends in _whole_keys(rows):
        key, node, flip = (part.column(i).to_numpy() for i in range(3))
        run = np.repeat(np.arange(len(cuts)), ends - cuts)
        order = np.lexsort((flip, run))
        key, node, flip, run = key[order], node[order], flip[order], run[order]
        start = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (flip[1:] != flip[:-1])))
        size = np.diff(np.append(start, len(key)))
        best = np.lexsort((flip[start], -size, run[start]))
        best = best[np.flatnonzero(np.append(True, np.diff(run[start][best])))]  # one value for each key
        group = np.repeat(np.arange(len(start)), size)
        mixed = (np.bincount(run[start], minlength=len(cuts)) > 1)[run]
        off = flip[start][best].astype(np.int64)
        to = key[start][best] ^ np.where(off > 0, np.int64(1) << np.maximum(off - 1, 0), 0)
        stay = (flip == 0) & (size[group] > 1)
        move = mixed & ~stay & ((group != best[run]) | (size[group] == 1))
        also = mixed & stay & (group != best[run])  # many that are not most: listed in both places
        at = np.concatenate([key[stay], to[run[move]], to[run[also]]])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([node[stay], node[move], node[also]])), pa.array(np.ones(len(at), bool))], names=["key", "node", "exact"])


def _links(law: Law):
    """Links (u, v) of rows (key, node, exact, fp) that come sorted by key."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cuts, ends in _whole_keys(rows):
            key, node, exact = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = np.frombuffer(b"".join(part.column(3).to_pylist()), ">u8").astype(np.uint64).reshape(len(key), -1)
            any_ = exact | (law.words > 1)  # under the wide law all that meet may link
            some = np.maximum.reduceat(any_, cuts)
            twos = cuts[some & (ends - cuts == 2)]  # most keys: one comparison, all at once
            twos = twos[_far(fp[twos], fp[twos + 1]) <= law.radius]
            u, v = [node[twos]], [node[twos + 1]]
            for a, b in zip(cuts[some & (ends - cuts > 2)], ends[some & (ends - cuts > 2)], strict=True):
                edges = _stars(fp[a:b], any_[a:b], law, 0 if key[a] < 1 << 32 else 32)  # the other half than the key's
                if edges:
                    x, y = np.array(edges).T + a
                    u.append(node[x])
                    v.append(node[y])
            u, v = np.concatenate(u), np.concatenate(v)
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)  # the same two meet under many keys
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def links(nodes: DataFrame, law: Law = NARROW) -> DataFrame:
    """Links (u, v), u > v, that connect what is connected among rows (node, fp) with distinct fingerprints."""
    filed = nodes.select("node", "fp")
    if law.words == 1:
        met = filed.mapInArrow(_filed, "key bigint, node bigint, flip tinyint").repartition("key").sortWithinPartitions("key").mapInArrow(_met, "key bigint, node bigint, exact boolean")
    else:
        bits = min(31, max(6, (17 * filed.count() // BUCKET).bit_length()))  # 17 keys a segment, on average
        packed = filed.mapInArrow(_packed(bits), "bucket bigint, payload binary").repartition("bucket").sortWithinPartitions("bucket")
        met = packed.mapInArrow(lambda rows: _moved(_unpacked(bits, rows)), "key bigint, node bigint, exact boolean")
    full = cut(met).join(nodes.select("node", "fp"), "node").select("key", "node", "exact", "fp")
    return full.repartition("key").sortWithinPartitions("key").mapInArrow(_links(law), "u bigint, v bigint")


#: A node that many point to is looked up from as many parts.
SALTS = 8


def stars(edges: DataFrame) -> DataFrame:
    """Components: each node that has an edge (u), except the least of its component (v), once.

    Edges lead from larger to smaller nodes. In a round each edge moves on to the least node its
    smaller end leads to (large star), then all that a node leads to meet in the least of them
    (small star). Edges are dealt by their larger end, which has few; the smaller end may have very
    many, so that lookup is salted. A round after which nothing moved is the last.
    """
    up, down = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = cut(edges.where("u <> v").select(up, down).repartition("u").distinct())
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int").alias("_salt")
    while True:
        ways = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("_way"))
        ways = ways.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = edges.select("u", "v", salt("u")).join(ways, ["v", "_salt"], "left").select("u", F.coalesce("_way", "v").alias("v"), F.col("_way").isNotNull().alias("_moved")).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("_low"), F.max("_moved").alias("_moved"))
        ends = large.select("u", "v").distinct().join(low, "u")
        small = ends.select("u", F.col("_low").alias("v"), "_moved").union(ends.where("v <> _low").select(F.col("v").alias("u"), F.col("_low").alias("v"), F.lit(True).alias("_moved")))
        now = cut(small.repartition("u").groupBy("u", "v").agg(F.max("_moved").alias("_moved")))
        if not now.agg(F.max("_moved")).first()[0]:
            return now.select("u", "v")
        edges = now.select("u", "v")


def _components(prints: DataFrame, low: Column, law: Law) -> DataFrame:
    """(fp, low) for each distinct fingerprint: the least ``low`` of its component. ``prints`` are read twice."""
    groups = prints.groupBy("fp").agg(F.min(low).alias("low"))
    nodes = cut(groups.select(F.conv(F.hex("fp"), 16, -10).cast("bigint").alias("node") if law.words == 1 else F.monotonically_increasing_id().alias("node"), "fp", "low"))
    tied = stars(links(nodes, law))
    rooted = nodes.join(tied.withColumnRenamed("u", "node"), "node", "left").select("fp", "low", F.coalesce("v", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("low"))
    return rooted.select("fp", "root").join(lowest, "root").select("fp", "low")


def near_duplicates(docs: DataFrame, law: Law = NARROW) -> DataFrame:
    """doc_id, fingerprint (hex digits) and component_id, the least id reachable over links, of every row."""
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text")), law))
    named = _components(prints, F.col("doc_id"), law)
    return prints.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("low").alias("component_id"))


def one_of_each(docs: DataFrame, law: Law = WIDE) -> DataFrame:
    """``docs`` with exactly one row of each component, all columns as they were.

    The row with the least id stays; rows without an id come after all others, and rows of one id in
    the order of a 128-bit digest of all their columns. So of repeated rows one stays, and of copies
    without ids one. Columns may have any names.
    """
    cells = [F.to_json(quoted(c)) if "map<" in t or t == "variant" else F.col(quoted(c)) for c, t in docs.dtypes]
    key = [F.xxhash64(*cells).alias("_a"), F.xxhash64(F.lit(1), *cells).alias("_b")]
    prints = cut(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("_id"), *key, F.col("text").cast("string").alias("_text")), law, "_text"))
    kept = _components(prints, F.struct(F.col("_id").isNull(), "_id", "_a", "_b"), law).select(F.col("low._a").alias("_a"), F.col("low._b").alias("_b")).distinct()
    often = prints.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    kept = cut(kept.join(often, ["_a", "_b"]))
    rows = docs.select(whole(docs), *key)
    alone = rows.join(kept.where("_n = 1").hint("shuffle_hash"), ["_a", "_b"], "left_semi")  # keys are hashed, texts not sorted
    again = rows.join(kept.where("_n > 1").hint("shuffle_hash"), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"])
    return alone.unionByName(again).select(*(field("_row", c) for c in docs.columns))
