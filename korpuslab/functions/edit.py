"""Edit scripts and counts between token sequences.

The script is a shortest one, read from the front, that prefers a match, then a
substitution, then a deletion, then an insertion. Short pairs are aligned many at a time:
one table over suffixes for all pairs of a batch, then one walk over all of them. Long
pairs, such as whole documents, are aligned by bits that say how neighbouring cells differ:
those alike in length together, in words of 64 rows and only near the diagonal. A script that
costs no more than the band allows cannot leave it, so it is the script of the whole table; what
costs more is aligned again over all cells. There a column is two whole numbers; only every so
many columns are kept, and those between are made again when the walk comes by. Memory then is
the longer text times the root of the other in bits: about 20 MB for 100,000 tokens. Scripts
leave a task in pieces of so many steps, however many rows an Arrow batch has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATIONS = ("equal", "substitute", "delete", "insert")
#: Cells of alignment tables, and of rows of tables, held at once.
CELLS, ROW_CELLS = 8_000_000, 200_000
#: Cells of a pair from which it is aligned by bits; bytes of masks that are kept rather than made at every use.
LONG, MASKS = 40_000, 64 << 20
#: Of pairs aligned in a band: edits allowed at first for a token of the longer side, words of 64 rows handled by a step, and bytes held.
SHARE, LANES, BAND_BYTES = 1 / 5, 8192, 32 << 20
#: Steps of scripts that leave a task at once; a row's script is not divided.
STEPS_OUT = 1 << 16


def _encode(sequences: list[list], width: int, known: dict, pad: int) -> np.ndarray:
    """Sequences as rows of numbers, last token first, padded at the end."""
    out = np.full((len(sequences), width), pad, np.int32)
    for row, sequence in zip(out, sequences, strict=True):
        row[: len(sequence)] = [known.setdefault(x, len(known)) for x in reversed(sequence)]
    return out


def align(references: list[list], hypotheses: list[list]) -> np.ndarray:
    """For each pair the operations of its script in order, as numbers into ``OPERATIONS``; -1 after the end."""
    n, m = max(map(len, references), default=0), max(map(len, hypotheses), default=0)
    known: dict = {}
    r, h = _encode(references, n, known, -1), _encode(hypotheses, m, known, -2)
    a, b = np.array([len(x) for x in references]), np.array([len(x) for x in hypotheses])
    across = np.arange(m + 1, dtype=np.int32)
    table = np.empty((n + 1, len(references), m + 1), np.int32)  # [i][pair][j]: cost of the last i and the last j
    table[0] = across
    for i in range(1, n + 1):
        before = table[i - 1]
        table[i, :, 0] = i
        np.minimum(before[:, :-1] + (r[:, i - 1, None] != h), before[:, 1:] + 1, out=table[i, :, 1:])
        table[i] = np.minimum.accumulate(table[i] - across, axis=1) + across
    steps = np.full((len(references), n + m), -1, np.int8)
    pair = np.arange(len(references))
    for t in range(n + m):
        go = (a > 0) | (b > 0)
        if not go.any():
            break
        i, j = np.maximum(a - 1, 0), np.maximum(b - 1, 0)
        both = (a > 0) & (b > 0)
        same = both & ((r[pair, i] == h[pair, j]) if n and m else False)
        here = table[a, pair, b]
        swap = both & ~same & (here == table[i, pair, j] + 1)
        drop = ~same & ~swap & (a > 0) & (here == table[i, pair, b] + 1)
        step = np.where(same, 0, np.where(swap, 1, np.where(drop, 2, 3)))
        steps[go, t] = step[go]
        a = a - (go & (step != 3))
        b = b - (go & (step != 2))
    return steps


def count(references: list[list], hypotheses: list[list]) -> np.ndarray:
    """Insertions, deletions and substitutions of each pair's script, from two rows of the table at a time.

    A cell's substitutions are those of the cell its first step leads to; a run of
    insertions in a row takes over what stands before it. Lengths and cost give the rest.
    """
    n, m = max(map(len, references), default=0), max(map(len, hypotheses), default=0)
    known: dict = {}
    r, h = _encode(references, n, known, -1), _encode(hypotheses, m, known, -2)
    a, b = np.array([len(x) for x in references]), np.array([len(x) for x in hypotheses])
    across, pair = np.arange(m + 1, dtype=np.int32), np.arange(len(references))
    cost, swaps = np.broadcast_to(across, (len(references), m + 1)).copy(), np.zeros((len(references), m + 1), np.int32)
    out = np.stack([cost[pair, b], swaps[pair, b]], 1)
    for i in range(1, n + 1):
        same = r[:, i - 1, None] == h
        now = np.empty_like(cost)
        now[:, 0] = i
        np.minimum(cost[:, :-1] + ~same, cost[:, 1:] + 1, out=now[:, 1:])
        now = np.minimum.accumulate(now - across, axis=1) + across
        swap = ~same & (now[:, 1:] == cost[:, :-1] + 1)
        drop = ~same & ~swap & (now[:, 1:] == cost[:, 1:] + 1)
        took = np.zeros_like(swaps)
        took[:, 1:] = np.where(drop, swaps[:, 1:], swaps[:, :-1] + swap)
        came = np.zeros_like(swaps)
        came[:, 1:] = np.where(same | swap | drop, across[1:], 0)
        swaps = np.take_along_axis(took, np.maximum.accumulate(came, axis=1), 1)
        cost = now
        ends = a == i
        out[ends, 0], out[ends, 1] = cost[ends, b[ends]], swaps[ends, b[ends]]
    other, longer = out[:, 0] - out[:, 1], b - a
    return np.stack([(other + longer) // 2, (other - longer) // 2, out[:, 1]], 1).astype(np.int32)


class _Columns:
    """Columns of the table of costs of two sequences, from the first on: ``down`` and ``up`` have a bit for each row.

    A bit of ``down`` says that the cell is one more than the cell above it, of ``up`` that it is one less. The cell
    equals its upper left neighbour where ``same`` has a bit.
    """

    def __init__(self, rows: Sequence):
        self.rows, self.places, self.kept, self.room = len(rows), {}, {}, MASKS
        for i, x in enumerate(rows):
            self.places.setdefault(x, []).append(i)
        self.every = (1 << self.rows) - 1

    def mask(self, x) -> int:
        """Bits of the rows that hold ``x``."""
        if (found := self.kept.get(x)) is None:
            bits = bytearray(self.rows // 8 + 1)
            for i in self.places.get(x, ()):
                bits[i >> 3] |= 1 << (i & 7)
            found = int.from_bytes(bits, "little")
            if self.room > 0:
                self.kept[x] = found
                self.room -= 64 + self.rows // 8
        return found

    def after(self, x, down: int, up: int) -> tuple[int, int, int, int, int]:
        """The next column, for the value ``x`` of the other sequence: same, down, up; and rows where it is one more or less than the last."""
        equal = self.mask(x)
        same = ((((equal & down) + down) ^ down) | equal | up) & self.every
        more, less = up | (self.every & ~(same | down)), same & down
        right = (more << 1) | 1
        return same, ((less << 1) | ~(same | right)) & self.every, right & same, more, less


def distance(reference: Sequence, hypothesis: Sequence) -> int:
    """The number of substitutions, deletions and insertions of a shortest script."""
    a, b = 0, min(len(reference), len(hypothesis))
    while a < b and reference[a] == hypothesis[a]:
        a += 1
    z = 0
    while z < b - a and reference[-1 - z] == hypothesis[-1 - z]:
        z += 1
    left, right = reference[a : len(reference) - z], hypothesis[a : len(hypothesis) - z]
    if len(left) < len(right):
        left, right = right, left
    if not right:
        return len(left)
    columns, allowed = _Columns(left), _allowed(len(left), len(right))
    while (found := _within(columns, right, allowed)) is None:
        allowed = min(2 * allowed, len(left))
    return found


def _allowed(a: int, b: int) -> int:
    """Edits a first band is made for."""
    return min(max(a, b), max(int(max(a, b) * SHARE) + 16, abs(a - b)))


def _within(columns: _Columns, others: Sequence, allowed: int) -> int | None:
    """The distance of the rows from a sequence that is not longer, if it is not over ``allowed``.

    Only cells that a script of so many edits can come by are held. Every few columns rows at either end are left out or
    taken in, by the least that a script through their cells costs: the cost so far, and what is left between the lengths.
    """
    longer = columns.rows - len(others)
    spare, step = (allowed - longer) // 2, max(64, allowed // 8)
    base = bottom = cost = down = up = 0
    for j in range(0, len(others), step):
        if j:
            over, end = base, bottom + 1  # rows up to ``over`` are not needed, those from ``end`` on are
            while end - over > 1:
                i = (over + end) // 2
                here = cost - (down >> (i - base)).bit_count() + (up >> (i - base)).bit_count()
                over, end = (i, end) if here + longer + j - i > allowed else (over, i)
            if over == bottom:
                return None
            over = min(bottom - 1, max(over, j - spare))
            down, up, base = down >> (over - base), up >> (over - base), over
        room = (allowed + 2 * step - (cost + bottom - j - longer)) // 2
        more = max(0, min(columns.rows - bottom, j + step + longer + spare - bottom, room if j else columns.rows))
        down |= ((1 << more) - 1) << (bottom - base)
        bottom, cost = bottom + more, cost + more
        last, every, masks = bottom - base - 1, (1 << (bottom - base)) - 1, {}
        for x in others[j : j + step]:
            if (equal := masks.get(x)) is None:
                equal = masks[x] = (columns.mask(x) >> base) & every
            same = ((((equal & down) + down) ^ down) | equal | up) & every
            rise, less = up | (every ^ (same | down)), same & down
            cost += (rise >> last) - (less >> last)
            rise = ((rise << 1) | 1) & every
            down = ((less << 1) | (every ^ (same | rise))) & every
            up = rise & same
    cost += columns.rows - bottom
    return cost if cost <= allowed else None


def walk(reference: Sequence, hypothesis: Sequence) -> bytearray:
    """The operations of one pair's script in order, as numbers into ``OPERATIONS``."""
    start, short = 0, min(len(reference), len(hypothesis))
    while start < short and reference[start] == hypothesis[start]:
        start += 1
    out = bytearray(start)
    rows, others = reference[start:][::-1], hypothesis[start:][::-1]  # costs are those of suffixes, so the last comes first
    a, b = len(rows), len(others)
    columns, step = _Columns(rows), isqrt(b) + 1
    down, up, marks = (1 << a) - 1, 0, []
    for k, x in enumerate(others):
        if k % step == 0:
            marks.append((down, up))
        _, down, up, _, _ = columns.after(x, down, up)
    while a and b:
        first = (b - 1) // step * step
        down, up = marks[first // step]
        held = []
        for x in others[first:b]:
            same, down, up, _, _ = columns.after(x, down, up)
            held.append((same, down))
        while a and b > first:
            same, down = held[b - 1 - first]
            if rows[a - 1] == others[b - 1]:
                op = 0
            elif not same >> (a - 1) & 1:
                op = 1
            else:
                op = 2 if down >> (a - 1) & 1 else 3
            out.append(op)
            a, b = a - (op != 3), b - (op != 2)
    return out + bytes([2]) * a + bytes([3]) * b


class _Band:
    """Tables of costs of several pairs near their diagonals, 64 rows in a word; ``allowed`` edits of a pair keep its script inside.

    Pairs get a common end that brings all to the same rows, which changes no cost. Word k handles column t - k at step t,
    so the words above have handled that column just before. Beyond the band costs only rise: they are never too low.
    """

    def __init__(self, rows: list[np.ndarray], others: list[np.ndarray], allowed: np.ndarray, keep: bool):
        a, b = np.array([len(x) for x in rows]), np.array([len(x) for x in others])
        spare = (allowed - abs(a - b)) // 2
        self.pairs, words = len(rows), -(-int(a.max()) // 64)
        below, above = int((np.maximum(a - b, 0) + spare).max()), int((np.maximum(b - a, 0) + spare).max())
        ends = b + words * 64 - a
        columns = int(ends.max())
        codes, masks = self._codes(rows, others, words, columns)
        self._run(codes, masks, words, columns, ends, below, above, keep)

    def _codes(self, rows: list[np.ndarray], others: list[np.ndarray], words: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the masks of a column's values start, last column first; masks by value, word and pair. Value 0 is in no row, 1 is the common end."""
        at, to = np.ones((words * 64, self.pairs), np.int64), np.ones((columns, self.pairs), np.int64)
        most = 0
        for p, (r, o) in enumerate(zip(rows, others, strict=True)):
            if (end := int(r.max()) + 1) <= 4096:
                found = np.zeros(end + 1, np.int64)
                found[r] = 1
                known = np.flatnonzero(found)
                found[known] = np.arange(len(known)) + 2
                at[: len(r), p], to[: len(o), p] = found[r], found[np.minimum(o, end)]
            else:
                known, place = np.unique(r, return_inverse=True)
                at[: len(r), p] = place + 2
                place = np.minimum(np.searchsorted(known, o), len(known) - 1)
                to[: len(o), p] = np.where(known[place] == o, place + 2, 0)
            most = max(most, len(known))
        masks = np.zeros((most + 2, words, self.pairs), np.uint64)
        word, pair = np.arange(words)[:, None], np.arange(self.pairs)
        for bit in range(64):
            masks[at[bit::64], word, pair] |= np.uint64(1 << bit)
        return (to[::-1] * (words * self.pairs)).ravel(), masks.ravel()

    def _run(self, codes: np.ndarray, masks: np.ndarray, words: int, columns: int, ends: np.ndarray, below: int, above: int, keep: bool) -> None:
        n, one, top = self.pairs, np.uint64(1), np.uint64(63)
        first = [max(0, 64 * k - below) for k in range(words)] + [columns + words]
        last = [64 * k + 63 + above for k in range(words)]
        down, up = np.full(words * n, ~np.uint64(0)), np.zeros(words * n, np.uint64)
        more, less = np.zeros((words + 1) * n, np.uint64), np.zeros((words + 1) * n, np.uint64)  # of the row above a word, from the last column
        more[:n] = 1
        here, width = np.arange(words * n), min(words, (below + above + 64) // 65 + 2)
        index, x, y, z, right = np.empty(width * n, np.int64), *(np.empty(width * n, np.uint64) for _ in range(4))
        self.cost, early = np.full(n, words * 64), int(ends.min())
        if keep:
            self.lows = []
            self.same, self.down = (np.empty((columns + words - 1, width * n), np.uint64) for _ in range(2))
        low, high = 0, 0
        for t in range(columns + words - 1):
            while last[low] + low < t and low < words - 1:
                low += 1
            while first[high + 1] + high + 1 <= t:
                high += 1
            k = max(low, t - columns + 1)
            if k and t - k == last[k - 1] + 1:
                more[k * n : k * n + n], less[k * n : k * n + n] = 1, 0
            size = (high + 1 - k) * n
            s, after, row = slice(k * n, k * n + size), slice(k * n + n, k * n + n + size), (columns - 1 - t + k) * n
            d, u, i, e, f, g, r = down[s], up[s], index[:size], x[:size], y[:size], z[:size], right[:size]
            np.add(codes[row : row + size], here[s], out=i)
            np.take(masks, i, out=e, mode="clip")
            e |= less[s]
            np.bitwise_and(e, d, out=f)
            f += d
            f ^= d
            f |= e
            f |= u  # the cell equals its upper left neighbour
            np.bitwise_or(f, d, out=r)
            np.invert(r, out=r)
            r |= u  # one more than the cell on the left
            np.bitwise_and(f, d, out=g)  # one less
            np.left_shift(r, one, out=e)
            e |= more[s]
            np.left_shift(g, one, out=u)
            u |= less[s]
            np.right_shift(r, top, out=more[after])
            np.right_shift(g, top, out=less[after])
            np.bitwise_or(f, e, out=d)
            np.invert(d, out=d)
            d |= u
            np.bitwise_and(e, f, out=u)
            if keep:
                self.lows.append(k)
                self.same[t, :size], self.down[t, :size] = f, d
            if t - high < first[high + 1]:
                step = more[-n:] if high == words - 1 else more[(high + 1) * n : (high + 2) * n]
                step = step.astype(np.int64) - less[(high + 1) * n : (high + 2) * n].astype(np.int64)
                self.cost += step if t - high < early else step * (t - high < ends)

    def walk(self, p: int, rows: list, others: list) -> np.ndarray:
        """The operations of the script of pair ``p`` from the ends of its sequences on."""
        a, b, n, wide, out = len(rows), len(others), self.pairs, self.same.shape[1], bytearray()
        same, down, lows = memoryview(self.same.reshape(-1)), memoryview(self.down.reshape(-1)), self.lows
        while a and b:
            a -= 1
            b -= 1
            if rows[a] == others[b]:
                out.append(0)
                continue
            word = a >> 6
            at = (b + word) * wide + (word - lows[b + word]) * n + p
            if not same[at] >> (a & 63) & 1:
                out.append(1)
            elif down[at] >> (a & 63) & 1:
                out.append(2)
                b += 1
            else:
                out.append(3)
                a += 1
        return np.frombuffer(out + bytes([2]) * a + bytes([3]) * b, np.int8)


def _lanes(long: int, allowed: int) -> int:
    """Words of a step for a pair whose longer side has so many tokens."""
    return min(long // 64 + 1, allowed // 64 + 3)


def _held(long: int, allowed: int, keep: bool) -> int:
    """Bytes for such a pair, but for masks."""
    return 24 * long + (keep and 20 * long * _lanes(long, allowed))


def _bands(sizes: list[int], allowed: dict[int, int], keep: bool) -> Iterator[list[int]]:
    """Places of pairs that are aligned in one band: alike in length, bounded in words of a step and in bytes. ``sizes``: of the longer sides."""
    some, long, wide = [], 0, 0
    for k in sorted(allowed, key=lambda k: -sizes[k]):
        wide, n = max(wide, allowed[k]), len(some) + 1
        if some and (sizes[k] < 0.8 * long or n * _lanes(long, wide) > LANES or n * _held(long, wide, keep) > BAND_BYTES):
            yield some
            some, wide = [], allowed[k]
        long = long if some else sizes[k]
        some.append(k)
    if some:
        yield some


def _values(x: np.ndarray) -> int:
    return np.count_nonzero(np.bincount(x)) if x.max() < 4096 else len(np.unique(x))


def _worth(pairs: list[tuple[np.ndarray, np.ndarray]], allowed: int, keep: bool) -> bool:
    """Whether a band of these pairs is quicker than one pair after another over whole columns, and its tables can be held."""
    n, long = len(pairs), max(max(len(r), len(h)) for r, h in pairs)
    alone = 3 + long / 1500 if keep else 1.45 + long / 25_000  # both in microseconds a column
    if 26 + 0.015 * n * _lanes(long, allowed) > n * alone or n * _held(long, allowed, keep) > 2 * BAND_BYTES:
        return False
    return n * (max(_values(r) for r, _ in pairs) + 2) * (long // 64 + 1) * 8 <= 2 * BAND_BYTES


def _banded(pair: Callable[[int], tuple[np.ndarray, np.ndarray]], sizes: list[tuple[int, int]], keep: bool) -> Iterator[tuple[int, _Band, int]]:
    """Place, band and place in the band of pairs. One that costs more than its first band allows gets one that allows the cost found there."""
    longer = [max(x) for x in sizes]
    allowed = {k: _allowed(*x) for k, x in enumerate(sizes) if min(x) and max(x) - min(x) <= max(x) * SHARE}
    for _ in range(2):
        wider = {}
        for some in _bands(longer, allowed, keep):
            limits, pairs = np.array([allowed[k] for k in some]), [pair(k) for k in some]
            if _worth(pairs, int(limits.max()), keep):
                band = _Band([r for r, _ in pairs], [h for _, h in pairs], limits, keep)
                for p, k in enumerate(some):
                    if band.cost[p] <= limits[p]:
                        yield k, band, p
                    else:
                        wider[k] = int(band.cost[p])
        allowed = wider


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``distance`` of each pair of texts; those alike in length are aligned together."""
    out, left = np.zeros(len(pairs), np.int32), []
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    for k, (r, h) in enumerate(pairs):
        if r != h:
            x, y = points(r), points(h)
            short = min(len(x), len(y))
            start = int(np.argmax(differ)) if (differ := x[:short] != y[:short]).any() else short
            short -= start
            end = int(np.argmax(differ)) if (differ := x[::-1][:short] != y[::-1][:short]).any() else short
            left.append((k, r[start : len(r) - end], h[start : len(h) - end]))
    rest = np.ones(len(left), bool)
    for k, band, p in _banded(lambda k: (points(left[k][1]), points(left[k][2])), [(len(r), len(h)) for _, r, h in left], False):
        out[left[k][0]], rest[k] = band.cost[p], False
    for k in np.flatnonzero(rest):
        out[left[k][0]] = distance(*left[k][1:])
    return out


def walks(references: list[np.ndarray], hypotheses: list[np.ndarray]) -> list[np.ndarray]:
    """``walk`` of each pair of sequences of numbers; those alike in length are aligned together."""
    out: list = [None] * len(references)
    last_first = lambda k: (references[k][::-1], hypotheses[k][::-1])
    for k, band, p in _banded(last_first, [(len(r), len(h)) for r, h in zip(references, hypotheses, strict=True)], True):
        out[k] = band.walk(p, *(x.tolist() for x in last_first(k)))
    for k in (k for k, steps in enumerate(out) if steps is None):
        out[k] = np.frombuffer(walk(references[k].tolist(), hypotheses[k].tolist()), np.int8)
    return out


def _batches(references: list, hypotheses: list, row_only: bool) -> Iterator[list[int]]:
    """Places of pairs that are aligned together: alike in length, bounded in cells."""
    order = sorted((k for k in range(len(references)) if not _is_long(references[k], hypotheses[k])), key=lambda k: (len(references[k]), len(hypotheses[k])))
    some, n, m = [], 0, 0
    for k in order:
        n_, m_ = max(n, len(references[k]) + 1), max(m, len(hypotheses[k]) + 1)
        if some and (m_ * (len(some) + 1) > ROW_CELLS if row_only else n_ * m_ * (len(some) + 1) > CELLS):
            yield some
            some, n_, m_ = [], len(references[k]) + 1, len(hypotheses[k]) + 1
        some.append(k)
        n, m = n_, m_
    if some:
        yield some


def _is_long(reference: Sequence, hypothesis: Sequence) -> bool:
    return (len(reference) + 1) * (len(hypothesis) + 1) > LONG


def _numbers(*columns: pa.Array) -> list[list[np.ndarray]]:
    """Rows of array columns with a number for each value, the same for the same one in all columns; a null row is an empty one."""
    flat = [c.flatten() for c in columns]
    if len({x.type for x in flat}) == 1:
        codes = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices.to_numpy()
    else:
        known: dict = {}
        codes = np.array([known.setdefault(x, len(known)) for c in flat for x in c.to_pylist()], np.int32)
    cuts = np.cumsum([0, *map(len, flat)])
    return [np.split(codes[i:j], _offsets(c)[1:-1]) if len(c) else [] for c, i, j in zip(columns, cuts, cuts[1:], strict=False)]


def _offsets(column: pa.Array) -> np.ndarray:
    return np.cumsum([0, *pc.list_value_length(column).fill_null(0).to_pylist()])


COUNTS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("insertions", "deletions", "substitutions")])
STEP = T.StructType([*(T.StructField(c, T.StringType()) for c in ("operation", "reference", "hypothesis")), *(T.StructField(c, T.IntegerType()) for c in ("reference_index", "hypothesis_index"))])


@F.arrow_udf(COUNTS)
def _counts(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    r, h = _numbers(reference, hypothesis)
    out = np.zeros((len(r), 3), np.int32)
    for some in _batches(r, h, True):
        out[some] = count([r[k].tolist() for k in some], [h[k].tolist() for k in some])
    long = [k for k in range(len(r)) if _is_long(r[k], h[k])]
    for k, steps in zip(long, walks([r[k] for k in long], [h[k] for k in long]), strict=True):
        out[k] = [(steps == x).sum() for x in (3, 2, 1)]
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], COUNTS.names)


def _steps(steps: Sequence, r: list, h: list) -> list[dict]:
    i = j = 0
    script = []
    for step in steps:
        script.append({"operation": OPERATIONS[step], "reference": r[i] if step != 3 else None, "hypothesis": h[j] if step != 2 else None, "reference_index": i, "hypothesis_index": j})
        i, j = i + (step != 3), j + (step != 2)
    return script


def scripts(reference: pa.Array, hypothesis: pa.Array) -> Iterator[pa.Array]:
    """The scripts of two array columns in pieces of ``STEPS_OUT`` steps, or of one row."""
    r, h = _numbers(reference, hypothesis)
    ops: list = [None] * len(r)
    for some in _batches(r, h, False):
        for k, steps in zip(some, align([r[k].tolist() for k in some], [h[k].tolist() for k in some]), strict=True):
            ops[k] = steps[steps >= 0]
    long = [k for k in range(len(r)) if _is_long(r[k], h[k])]
    for k, steps in zip(long, walks([r[k] for k in long], [h[k] for k in long]), strict=True):
        ops[k] = steps
    sizes = np.cumsum([0, *map(len, ops)])
    start = 0
    while start < len(ops):
        end = max(start + 1, int(np.searchsorted(sizes, sizes[start] + STEPS_OUT, "right")) - 1)
        yield _script_rows(ops[start:end], reference.slice(start, end - start), hypothesis.slice(start, end - start))
        start = end


def _script_rows(ops: list[np.ndarray], reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    steps, sizes = np.concatenate(ops), np.array([len(x) for x in ops])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    fields = [pa.array(OPERATIONS).take(pa.array(steps))]
    places = []
    for column, without in ((reference, 3), (hypothesis, 2)):
        has = steps != without
        place = np.cumsum(has) - has  # in all values of the piece, whose rows are used up one after the other
        fields.append(column.flatten().take(pa.array(place, mask=~has)).cast(pa.string()))
        places.append(pa.array((place - np.repeat(_offsets(column)[:-1], sizes)).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([*fields, *places], STEP.names))


@F.arrow_udf(T.ArrayType(STEP))
def _script(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for reference, hypothesis in batches:
        yield from scripts(reference, hypothesis)


@F.arrow_udf(T.IntegerType())
def _distance(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return pa.array(distances([(r or "", h or "") for r, h in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True)]))


def char_distance(reference: Column, hypothesis: Column) -> Column:
    """Edits between two texts by characters; a null text is an empty one. Whole documents may be compared."""
    return _distance(reference, hypothesis)


def edit_counts(reference: Column, hypothesis: Column) -> Column:
    """Insertions, deletions and substitutions of the script; a null sequence is an empty one."""
    return _counts(reference, hypothesis)


def edit_script(reference: Column, hypothesis: Column) -> Column:
    """The script itself; indexes are the places the step starts from."""
    return _script(reference, hypothesis)


@F.udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), *STEP.fields]))
class EditSteps:
    """The script as rows, for lateral joins in SQL."""

    def eval(self, reference: list, hypothesis: list):
        r, h = list(reference or ()), list(hypothesis or ())
        for place, step in enumerate(_steps(walk(r, h), r, h)):
            yield place, *step.values()


def script_counts(script: Column) -> Column:
    """Counts of a script column by built-in functions."""
    count = lambda name: F.size(F.filter(script, lambda o: o["operation"] == name))
    return F.struct(count("insert").alias("insertions"), count("delete").alias("deletions"), count("substitute").alias("substitutions"))


def error_rate(edits: Column, length: Column) -> Column:
    """Edits per unit of the reference: 0 for nothing against nothing, 1 for anything against nothing."""
    return F.when(length > 0, edits / length).when(edits > 0, 1.0).otherwise(0.0)


def safe_ratio(part: Column, whole: Column) -> Column:
    """A ratio that is 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
