"""LM scoring by Brown class-based bigrams.

Words are counted over all training documents. Exchange clustering starts from
units: the ``CORE`` most frequent words, and for the others the ``ENDINGS`` hashed
groups of last bytes. Round by round each unit moves to the class that raises the
likelihood of all class bigrams most, from counts of unit bigrams over all training
text. A round reads each unit's neighbours by class, which is bounded by units times
classes, and is kept only if the exact likelihood rose.

Then every other training word, however rare, makes an exchange move of its own, from
its own counts of classes after and before it: these are grouped by word over all
tasks, and tasks move random parts of the words side by side. The moves are
kept only if the exact likelihood, counted again over all training text, rose. Classes
of words are a column beside their counts, so they grow with the input. Only unknown
words go by their ending: to the class that holds most known words of that ending.

The model is P(w | v) = WEIGHT * P(class w | class v) * P(w | class w) + (1 - WEIGHT) * base.
Transitions are smoothed towards the class's own share; rare words are discounted
and what that frees goes to the unknown endings of the same class, so probabilities over
all words and unknown endings add up to 1. A text is the words and one end mark; the
mark also stands before the first word.

Exact counts of all words are needed for scoring and have no bound, so documents are
dealt into blocks of bounded text; each block's distinct words meet counts and classes
in a join, and texts are written as classes and counts with the block's own small
dictionary. Class bigrams and scores are read from those. Blocks and parts of words are
groups, which a task takes one after another: the session's number of partitions is the
number of tasks at every size. Contexts of a frequent word are shuffled as class counts.

Null and empty texts are an end mark alone. Repeated rows and ids count and are scored each;
rows that agree in everything are in one block only if they come from one input split. A
text of any length counts whole, in one block. Without training text every score is 0; an
empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import cut, fold

#: The end mark; no word holds white space.
END = b"\n"
FOLDS, HELD = 7, 2
CORE, ENDINGS, TAIL, CLASSES, ROUNDS = 2048, 512, 3, 64, 6
#: The class model's share of the mixture, and the weight of a class's own share in its transitions.
WEIGHT, PRIOR = 0.95, 20.0
#: Bytes of text in a block, the fewest blocks, bytes of text split at a time.
BLOCK, LEAST, SLICE = 12 << 20, 24, 16 << 20
#: A class and a count in one number.
COUNT_BITS = 47
#: Rows of a part held before they are summed, words that move in a part, and at a time.
HELD_ROWS, MOVING, TOGETHER = 200_000, 10_000, 256


def ending(word: bytes) -> int:
    return zlib.crc32(word[-TAIL:]) % ENDINGS


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows in runs of at most ``SLICE`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, side="right")))
            yield batch.slice(a, b - a)
            a = b


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, all their words as numbers into these, and how many each text has.

    As ``words_of`` has them: A-Z lower-cased, white space of ASCII alone.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    some = pc.not_equal(flat, "")  # white space at an end leaves an empty piece
    if not pc.all(some, min_count=0).as_py():
        row = np.repeat(np.arange(len(sizes)), sizes)[some.to_numpy(zero_copy_only=False)]
        flat, sizes = flat.filter(some), np.bincount(row, minlength=len(sizes))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(zero_copy_only=False), sizes


def _row(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of words of all texts in a row, with a 0, the end mark, before the first text and after each."""
    out = np.zeros(len(ids) + len(sizes) + 1, np.int64)
    out[np.arange(len(ids)) + 1 + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in _texts(batches):
        words, ids, sizes = _split(some.column("text"))
        words = pa.concat_arrays([words, pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.append(np.bincount(ids, minlength=len(words) - 1), len(sizes)))], names=["word", "n"])


class Units:
    """Which unit a word belongs to: 0 for the end mark, then the core words, then the endings."""

    def __init__(self, core: list[bytes]):
        self.core = {END: 0} | {w: i + 1 for i, w in enumerate(core)}
        self.first = len(self.core)
        self.n = self.first + ENDINGS

    def of(self, word: bytes) -> int:
        unit = self.core.get(word)
        return self.first + ending(word) if unit is None else unit

    def inside(self, words: pa.Array) -> np.ndarray:
        """Units of the core words among some, -1 for others."""
        names = pa.array(list(self.core), pa.binary())  # in the order of their numbers
        return pc.index_in(words, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_bigrams(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(units.n**2, np.int64)  # its size depends on the parameters alone
        for some in _texts(batches):
            words, ids, sizes = _split(some.column("text"))
            of = units.inside(words)
            rest = np.flatnonzero(of < 0)
            of[rest] = [units.first + ending(w) for w in words.take(pa.array(rest)).to_pylist()]
            row = _row(of[ids], sizes)
            total += np.bincount(row[:-1] * units.n + row[1:], minlength=len(total))
        after = total.reshape(units.n, units.n)
        some = np.flatnonzero(after.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_squeezed(after[u]) for u in some], pa.binary())], names=["u", "after"])

    return run


def _squeezed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _counts(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell, 8 * n, codec="zstd"), "<i8")


#: Tasks that hold what follows each unit; each gives sums of units by classes to the driver.
HOLDERS = 8


def _neighbours(bigrams: DataFrame, n: int) -> DataFrame:
    """For each unit how often each unit comes after it, packed; as large as units by units."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(_counts(cell.as_py(), n) for cell in rows.column("after"))
        return pa.table({"u": rows.column("u")[:1], "after": pa.array([_squeezed(total)], pa.binary())})

    return bigrams.groupBy("u").applyInArrow(add, "u int, after binary")


def _by_class(neighbours: DataFrame, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each unit how often what comes after it, and before it, is of each class, and how often it follows itself."""
    n = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = np.zeros((k, n)), []
        for batch in batches:
            for u, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                after = _counts(cell.as_py(), n).astype(float)
                before[classes[u]] += after
                rows.append((u, np.bincount(classes, after, minlength=k).tobytes(), float(after[u])))
        rows.append((-1, before.tobytes(), 0.0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.float64()), strict=True)], names=["u", "r", "w"])

    right, left, own = np.zeros((n, k)), np.zeros((n, k)), np.zeros(n)
    for row in neighbours.mapInArrow(run, "u int, r binary, w double").toLocalIterator():  # units x classes numbers, from each holder
        if row["u"] < 0:
            left += np.frombuffer(row["r"]).reshape(k, n).T
        else:
            right[row["u"]], own[row["u"]] = np.frombuffer(row["r"]), row["w"]
    return right, left, own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(joint: np.ndarray) -> float:
    """The part of the class bigram likelihood that depends on the classes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(1)).sum() - _xlogx(joint.sum(0)).sum())


def exchange(right: np.ndarray, left: np.ndarray, own: np.ndarray, classes: np.ndarray, k: int) -> np.ndarray:
    """One round: every unit but the end mark in turn moves to the class with the largest gain.

    ``right`` and ``left`` are the counts of classes after and before each unit, ``own`` of the unit after itself.
    """
    classes = classes.copy()
    joint = np.zeros((k, k))
    np.add.at(joint, classes, right)
    start = classes.copy()
    order = np.argsort(-right.sum(1), kind="stable")
    for u in order[right[order].sum(1) > 0]:
        if u == 0:
            continue
        s, r, l, w = classes[u], right[u].copy(), left[u].copy(), own[u]
        r[start[u]] -= w
        l[start[u]] -= w
        joint[s] -= r
        joint[:, s] -= l
        joint[s, s] -= w
        np.maximum(joint, 0, out=joint)
        rows, cols, diag, at = joint.sum(1), joint.sum(0), np.diag(joint), np.arange(k)
        gain = (_xlogx(joint + r) - _xlogx(joint)).sum(1) + (_xlogx(joint + l[:, None]) - _xlogx(joint)).sum(0)
        gain += _xlogx(diag + r[at] + l[at] + w) - _xlogx(diag + r[at]) - _xlogx(diag + l[at]) + _xlogx(diag)
        gain -= _xlogx(rows + r.sum() + w) - _xlogx(rows) + _xlogx(cols + l.sum() + w) - _xlogx(cols)
        gain[0] = -np.inf  # the end mark keeps its class to itself
        t = int(gain.argmax())
        if gain[t] <= gain[s] + 1e-9:
            t = s
        classes[u] = t
        joint[t] += r
        joint[:, t] += l
        joint[t, t] += w
    return classes


def cluster(bigrams: DataFrame, n: int, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of units, and the counts of class bigrams."""
    neighbours = cut(_neighbours(bigrams, n).coalesce(HOLDERS))
    classes = 1 + np.arange(n) % max(1, k - 1)
    classes[0] = 0
    best, best_value = None, -np.inf
    for _ in range(rounds + 1):
        right, left, own = _by_class(neighbours, classes, k)
        joint = np.zeros((k, k))
        np.add.at(joint, classes, right)
        value = likelihood(joint)
        if value <= best_value + 1e-9 * abs(best_value):
            break
        best, best_value = (classes, joint), value
        classes = exchange(right, left, own, classes, k)
    return best


def move_words(right: np.ndarray, left: np.ndarray, start: np.ndarray, joint: np.ndarray, weight: float, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words that are a random part, one in ``weight``, of all words that move from ``start``.

    A few words at a time go where their class bigrams are likeliest, and the class bigrams follow as if the
    other parts moved alike; else all would crowd into the same classes.
    """
    joint, classes = joint.copy(), start.copy()
    for _ in range(rounds):
        for at in range(0, len(classes), TOGETHER):
            r, l, s = right[at : at + TOGETHER], left[at : at + TOGETHER], classes[at : at + TOGETHER]
            held = np.maximum(joint, 0) + 0.5
            log = np.log(held)
            gain = r @ (log - np.log(held.sum(1, keepdims=True))).T + l @ (log - np.log(held.sum(0)))
            gain[:, 0] = -np.inf  # the end mark keeps its class to itself
            t = gain.argmax(1)
            go = gain[np.arange(len(t)), t] > gain[np.arange(len(t)), s] + 1e-9
            change = weight * (np.eye(len(joint))[t[go]] - np.eye(len(joint))[s[go]])
            joint += change.T @ r[go] + l[go].T @ change
            classes[at : at + TOGETHER][go] = t[go]
    return classes


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary cells that follow each other in ``data``."""
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _contexts(units: Units, classes: np.ndarray, k: int):
    """For words outside the core the class before and after each occurrence: a byte each, or counts of both by class where these are shorter."""
    core = classes[: units.first].astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _texts(batches):
            distinct, ids, sizes = _split(some.column("text"))
            of = units.inside(distinct)
            rest = np.flatnonzero(of < 0)
            if not len(rest):
                continue
            words = distinct.take(pa.array(rest))
            of[rest] = units.first + np.arange(len(rest))
            table = np.append(core, classes[[units.first + ending(w) for w in words.to_pylist()]].astype(np.uint8))
            ids = _row(of[ids], sizes)
            cls = table[ids]
            at = np.flatnonzero(ids >= units.first)
            own = ids[at] - units.first
            order = np.argsort(own, kind="stable")
            near = np.stack([cls[at - 1], cls[at + 1]], 1)[order]
            counts = np.bincount(own, minlength=len(words))
            ends = np.cumsum(counts)
            long = counts > 8 * k
            short = ~np.repeat(long, counts)
            plain = words.filter(pa.array(~long))
            yield pa.RecordBatch.from_arrays([plain, _binaries(near[short], 2 * np.cumsum(counts[~long])), pa.array(np.zeros(len(plain), bool))], names=["word", "near", "summed"])
            if long.any():
                sums = [_tally(near[ends[i] - counts[i] : ends[i]].ravel(), k).astype("<i8").tobytes() for i in np.flatnonzero(long)]
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(long)), pa.array(sums, pa.binary()), pa.array(np.ones(len(sums), bool))], names=["word", "near", "summed"])

    return run


def _tally(near: np.ndarray, k: int) -> np.ndarray:
    """Counts of classes before, then after."""
    return np.append(np.bincount(near[::2], minlength=k), np.bincount(near[1::2], minlength=k))


class _Part:
    """What is known of one part's words: counts of classes before and after each."""

    def __init__(self, k: int):
        self.k, self.place, self.both = k, {}, np.zeros((0, 2 * k))

    def add(self, rows: pa.RecordBatch) -> None:
        coded = rows.column("word").dictionary_encode()
        at = np.array([self.place.setdefault(w, len(self.place)) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        if len(self.place) > len(self.both):
            self.both = np.concatenate([self.both, np.zeros((max(len(self.place), 2 * len(self.both)) - len(self.both), 2 * self.k))])
        cells, summed = rows.column("near").to_pylist(), rows.column("summed").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(summed):
            self.both[at[i]] += np.frombuffer(cells[i], "<i8")
        plain = np.flatnonzero(~summed)
        lengths = np.array([len(cells[i]) // 2 for i in plain], np.int64)
        own = np.repeat(at[plain], lengths) * self.k
        sides = np.frombuffer(b"".join([cells[i] for i in plain]), np.uint8).reshape(-1, 2)
        n = len(self.place)
        for first, side in ((0, sides[:, 0]), (self.k, sides[:, 1])):
            self.both[:n, first : first + self.k] += np.bincount(own + side, minlength=n * self.k).reshape(n, self.k)


def _moves(units: Units, classes: np.ndarray, joint: np.ndarray, parts: int):
    """Count, class and class before the move of each word, from its contexts; rows come by part, a part's words move together."""
    k = len(joint)

    def moved(part: _Part) -> pa.RecordBatch:
        words = sorted(sorted(part.place), key=zlib.crc32)
        both = part.both[[part.place[w] for w in words]]
        start = np.array([classes[units.of(w)] for w in words], np.int64)
        to = move_words(both[:, k:].astype(np.float32), both[:, :k].astype(np.float32), start, joint, parts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(both[:, :k].sum(1).astype(np.int64)), pa.array(to.astype(np.int32)), pa.array(start.astype(np.int32))], names=["word", "n", "class", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_, held, size = _Part(k), None, [], 0

        def add() -> None:
            if held:
                part.add(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if number[a] != open_ and open_ is not None:
                    add()
                    yield moved(part)
                    part, size = _Part(k), 0
                open_ = number[a]
                held.append(batch.slice(a, b - a))
                size += b - a
                if size > HELD_ROWS:  # a part holds its words' counts, not all that came
                    add()
                    size = 0
        add()
        if part.place:
            yield moved(part)

    return run


class ClassModel:
    """Everything the scoring tasks need besides counts and classes of words; its size depends on the parameters alone.

    ``types`` counts the words outside the core by ending and class; ``classes`` are of units, before words moved.
    """

    def __init__(self, units: Units, classes: np.ndarray, joint: np.ndarray, types: np.ndarray, total: int, distinct: int, discount: float):
        self.units, self.total, self.distinct = units, total, distinct
        k = len(joint)
        self.home = np.where(types.sum(1) > 0, types.argmax(1), classes[units.first :])
        size = joint.sum(0) + np.bincount(self.home, minlength=k)  # each ending may show one more unknown word
        share = size / size.sum()
        self.step = (joint + PRIOR * share) / (joint.sum(1, keepdims=True) + PRIOR)
        self.size = size
        part = types.sum(1) + 1.0
        within = part / np.bincount(self.home, part, minlength=k)[self.home]
        self.discount = np.where(np.bincount(self.home, minlength=k) > 0, discount, 0.0)  # a class without an ending has none to give to
        self.unknown = (self.discount[self.home] * types.sum(0)[self.home] * within + 1.0) / size[self.home]
        self.least = 1.0 / (total + distinct + 1)

    def word(self, word: bytes, n: int) -> tuple[int, float, float]:
        """Class, P(word | class) and base probability of a word with its ``n`` of the vocabulary, 0 for an unknown word."""
        cls, code = self.code(word, n)
        return int(cls), *(float(x[0]) for x in self.chances(np.array([cls]), np.array([code])))

    def code(self, word: bytes, n: int) -> tuple[int, int]:
        """Class, and twice the count with a bit for words outside the core, or -1 less the ending of an unknown word."""
        if not n:
            e = ending(word)
            return self.home[e], -1 - e
        return n >> COUNT_BITS, (n & ((1 << COUNT_BITS) - 1)) << 1 | (word not in self.units.core)

    def chances(self, cls: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(word | class) and base probability."""
        known, count = code >= 0, code >> 1
        inside = np.where(known, (count - self.discount[cls] * (code & 1)) / self.size[cls], self.unknown[np.where(known, 0, -1 - code)])
        return inside, np.where(known, (count + 1) * self.least, self.least / ENDINGS)

    def score(self, cls: np.ndarray, code: np.ndarray) -> tuple[int, float, float]:
        """n_known, base_score and score of a text."""
        if not self.total:
            return 0, 0.0, 0.0
        inside, base = self.chances(cls, code)
        p = WEIGHT * self.step[np.append(0, cls[:-1]), cls] * inside + (1 - WEIGHT) * base
        return int((code >= 0).sum()), float(np.log10((np.maximum(code >> 1, 0) + 1) * self.least).sum()), float(np.log10(p).sum())


CODED = "doc_id bigint, held_out boolean, n_tokens bigint, codes binary"


def _pack(cls: np.ndarray, code: np.ndarray) -> bytes:
    """Classes and codes of a text; bytes of like weight lie together, so most are zeros in a row."""
    return pa.compress(cls.astype(np.uint8).tobytes() + code.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(codes: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(codes, 9 * n, codec="zstd"), np.uint8)
    return raw[:n].astype(np.int64), np.ascontiguousarray(raw[n:].reshape(8, n).T).view("<i8")[:, 0]


def _class_bigrams(coded: DataFrame, k: int) -> np.ndarray:
    """Counts of class bigrams over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = np.zeros(k * k, np.int64)
        for batch in batches:
            for n, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cls, _ = _unpack(codes.as_py(), n)
                joint += np.bincount(np.append(0, cls[:-1]) * k + cls, minlength=k * k)
        at = np.flatnonzero(joint)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(joint[at])], names=["at", "n"])

    joint = np.zeros(k * k)
    for row in coded.where(~F.col("held_out")).select("n_tokens", "codes").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():  # classes x classes numbers
        joint[row["at"]] = row["n"]
    return joint.reshape(k, k)


def train(docs: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model of the training documents (their ``text``), and all their words, each with its count and class in one number."""
    return fit(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit(False).alias("held_out")))[:2]


def fit(docs: DataFrame) -> tuple[ClassModel, DataFrame, DataFrame]:
    """The same from rows that are not held out, and all rows with their texts as classes and codes."""
    texts = docs.where(~F.col("held_out")).select("text")
    vocabulary = cut(texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    facts = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    words = vocabulary.where(F.col("word") != F.lit(END))
    core = [(bytes(r["word"]), r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(CORE).collect()]
    units = Units([w for w, _ in core])
    bigrams = texts.mapInArrow(_count_bigrams(units), "u int, after binary")
    classes, joint = cluster(bigrams, units.n)
    near = texts.mapInArrow(_contexts(units, classes, len(joint)), "word binary, near binary, summed boolean")
    parts = max(1, -(-facts[1] // MOVING))
    near = near.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(parts))).repartition("part").sortWithinPartitions("part")
    moved = near.mapInArrow(_moves(units, classes, joint, parts), "word binary, n bigint, class int, start int")
    ends = vocabulary.where(F.col("word") == F.lit(END)).select("word", "n", F.lit(0).alias("class"), F.lit(0).alias("start"))
    own = [(bytearray(w), n, c, c) for w, n in core for c in [int(classes[units.core[w]])]]
    every = cut(moved.union(ends).union(docs.sparkSession.createDataFrame(own, "word binary, n bigint, class int, start int")))

    core_words = docs.sparkSession.createDataFrame([(bytearray(w),) for w in units.core], "word binary")
    rare = every.join(F.broadcast(core_words), "word", "left_anti").withColumn("e", F.expr(f"crc32(substring(word, -{TAIL}, {TAIL})) % {ENDINGS}"))

    for column in ("class", "start"):
        known = every.select("word", F.shiftleft(F.col(column).cast("bigint"), COUNT_BITS).bitwiseOR(F.col("n")).alias("n"))
        types, once, twice = np.zeros((ENDINGS, len(joint))), 0, 0
        for row in rare.groupBy("e", F.col(column).alias("c"), F.least("n", F.lit(3)).alias("n")).agg(F.count(F.lit(1)).alias("types")).collect():  # three for each ending and class
            types[row["e"], row["c"]] += row["types"]
            once, twice = once + row["types"] * (row["n"] == 1), twice + row["types"] * (row["n"] == 2)
        discount = min(once / (once + 2 * twice) if once else 0.5, 0.95)
        rest = types, facts[0] or 0, facts[1], discount
        coded = cut(_coded(docs, known, ClassModel(units, classes, joint, *rest)))
        now = _class_bigrams(coded, len(joint))
        if likelihood(now) >= likelihood(joint):
            break
    return ClassModel(units, classes, now, *rest), known, coded


def _coded(docs: DataFrame, vocabulary: DataFrame, model: ClassModel) -> DataFrame:
    """All rows with their texts as classes and codes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST, -(-size // BLOCK))
    # both uses of the dealt documents read all its columns, so they share one shuffle of the texts
    place = F.xxhash64("doc_id", "text", F.spark_partition_id())  # repeated ids and equal rows are dealt apart
    dealt = docs.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).repartition("block")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct words of each block; rows come block by block, and no more than a block's words are held."""
        open_, held = None, []

        def flush() -> pa.RecordBatch:
            words = pa.concat_arrays([*held, pa.array([END], pa.binary())]).unique()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), open_, np.int32)), words], names=["block", "word"])

        for some in _texts(batches):
            number = some.column("block").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(number))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and number[a] != open_:
                    yield flush()
                    held = []
                open_ = number[a]
                held.append(_split(some.column("text").slice(a, b - a))[0])
        if held:
            yield flush()

    met = dealt.sortWithinPartitions("block").mapInArrow(distinct, "block int, word binary").join(vocabulary, "word").select("block", "word", "n")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        known, packed = right.column("word").combine_chunks(), right.column("n").to_numpy()
        outside = (model.units.inside(known) < 0).astype(np.int64)
        cls, codes = (packed >> COUNT_BITS).astype(np.uint8), (packed & ((1 << COUNT_BITS) - 1)) << 1 | outside
        end = pc.index_in(pa.array([END], pa.binary()), value_set=known)[0].as_py()
        out, tokens = [], []
        if end is None:  # training had no text
            cls, codes, end = np.append(cls, np.uint8(model.code(END, 0)[0])), np.append(codes, model.code(END, 0)[1]), len(cls)
        for some in _texts(left.select(["text"]).to_batches()):
            words, ids, sizes = _split(some.column("text"))
            at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.array([model.code(w, 0) for w in words.filter(pa.array(at < 0)).to_pylist()], np.int64).reshape(-1, 2)  # words that training did not have
            at[at < 0] = len(cls) + np.arange(len(new))
            cls_, codes_ = np.append(cls, new[:, 0].astype(np.uint8)), np.append(codes, new[:, 1])
            for own in np.split(at[ids], np.cumsum(sizes)[:-1]):
                own = np.append(own, end)
                out.append(_pack(cls_[own], codes_[own]))
                tokens.append(len(own))
        return pa.table([left.column("doc_id"), left.column("held_out"), pa.array(tokens, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "held_out", "n_tokens", "codes"])

    return dealt.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(code, CODED)


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, token counts, base_score, score (log10) and perplexity of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (fold("doc_id", FOLDS) == HELD).alias("held_out"))
    model, _, coded = fit(docs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("n_tokens")
            found = [model.score(*_unpack(codes.as_py(), n)) for n, codes in zip(tokens.to_pylist(), batch.column("codes"), strict=True)]
            known, base, own = zip(*found, strict=True) if found else ([], [], [])
            n = tokens.to_numpy()
            with np.errstate(over="ignore"):
                perplexity = 10.0 ** (-np.array(own) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), tokens, pa.array(known, pa.int64()), pa.array(np.full(len(n), model.total)), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(perplexity, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return coded.mapInArrow(score, SCORED)
