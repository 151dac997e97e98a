"""Filter audit, fill-in-the-middle and suffix-array dedup against brute force."""

import hashlib
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korpuslab.llm import filters, fim, suffix
from tests.llm.conftest import frame, prose

SPACE = " \t\n\x0b\x0c\r"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def audit_by_hand(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = words(t)
        fails = {f for f, x in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t],
        ), strict=True) if x}
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[1]]
                gone = [d for d in every if set(order[: step - 1]) & d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in every), sum(d[2] for d in hit), sum(d[3] for d in hit)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filters.filter_audit(docs, labels).collect()}


def test_audit_of_awkward_rows(spark, rows, docs):
    labels = [(i, k % 2, k % 3 == 0) for k, (i, *_) in enumerate(rows) if k % 4] + [(3, 0, 1), (3, 1, 0), (None, 1, 1), (99999, 1, 1), (5, None, None)]
    labels = [(i, q, None if x is None else int(x)) for i, q, x in labels]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = audited(docs, table)
    assert got == audit_by_hand(rows, labels)
    assert all(len({v[0] for (p, o, s), v in got.items() if p == part and s == 5}) == 1 for part in {k[0] for k in got})


def test_audit_of_nothing(spark, rows, docs, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(none, labels) == {}
    assert audited(docs, labels) == audit_by_hand(rows, [])


def test_audit_filters_alone(spark):
    fine = " ".join(f"w{i}" for i in range(200))
    rows = [(0, fine, "x", "s"), (1, fine, "x", "s"), (2, fine, "y", "s"), (3, fine + " #", "x", "s"), (4, fine.replace("w", "W"), "x", "s"), (5, " ".join(f"w{i % 99}" for i in range(200)), "x", "s"), (6, "w\x85w " * 100, "x", "s"), (None, fine, "x", "s")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = audited(frame(spark, rows), labels)
    assert got == audit_by_hand(rows, [(1, 1, 0)])
    assert got["x", "EABCD", 1][1] == 1 and got["y", "EABCD", 1][1] == 1 and got["x", "EABCD", 1][4] == 1


def middle_by_hand(i, text):
    text = text or ""
    h = sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middle_of_awkward_rows(spark, rows):
    more = [(400 + i, t, "en", "s") for i, t in enumerate(["<P>", "a<S>b", "<M", "<", "<<<S", "S><P", "é", "日本語😀" * 50, "\x00a\x00", "a", "P>S>M>" * 9, "<P" * 60] * 4)]
    rows = rows + more
    out = fim.restore(fim.fill_in_middle(frame(spark, rows).repartition(3))).collect()
    made = sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output, r.restored) for r in out), key=repr)
    assert made == sorted(((i, *middle_by_hand(i, t), t or "") for i, t, *_ in rows), key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_middle_digests(spark, rows, docs, none):
    got = {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in fim.middle_digests(docs).collect()}
    assert got == {(i, *(x := middle_by_hand(i, t))[:4], sha(x[4]), sha(t or "")) for i, t, *_ in rows}
    assert fim.middle_digests(none).collect() == []


def test_middle_of_words(spark):
    texts = ["one two  three", " lead", "trail \n", "x", "", "a\tb c" * 40]
    out = fim.restore(fim.fill_in_middle(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), unit="words", plain=0)).collect()
    import re

    for r in out:
        units = re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert r.restored == texts[r.doc_id] and r.n == len(units)
        if r.form != "plain":
            assert r.output.split("<M>")[1].split("<P>")[0].split("<S>")[0] == "".join(units[r.prefix_units : r.prefix_units + r.middle_units])


@given(st.lists(st.text(alphabet="aé日😀 <PSM>", max_size=12), min_size=1, max_size=20), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=150, deadline=None)
def test_cut_points(texts, h1, h2):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    k = len(texts)
    n, a, b, x, y = fim.cut_points(data, offsets, np.full(k, h1), np.full(k, h2))
    for i, t in enumerate(texts):
        lo, hi = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        assert (n[i], a[i], b[i]) == (len(t), lo, hi)
        assert data[offsets[i] : x[i]].tobytes() == t[:lo].encode() and data[x[i] : y[i]].tobytes() == t[lo:hi].encode()


def repeats_by_hand(rows, length=50):
    least = {}
    key = lambda i: float("inf") if i is None else i
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    for i, r in raw:
        for p in range(len(r) - length + 1):
            w = r[p : p + length]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, r in raw:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - length + 1):
            if least[r[p : p + length]] < key(i):
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), len(r) - len(kept), len(edge) // 2, sha(kept)))
    return sorted(out, key=repr)


def removed(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeat_digests(docs).collect()), key=repr)


def test_repeats_of_awkward_rows(spark, rows, docs, none):
    assert removed(docs) == repeats_by_hand(rows)
    assert removed(none) == []


def overlapping(seed):
    """Texts cut from a few sources at any place, periodic ones, and rows that share an id."""
    rng = random.Random(seed)
    sources = [prose(rng, 60, lang) for lang in ("en", "fr", "es")] + ["ab" * 90, "x" * 200, "é" * 70]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(sources)
            a = rng.randrange(len(s))
            parts.append(s[a : a + rng.randint(10, 150)])
            parts.append(prose(rng, rng.randint(0, 4)))
        rows.append((rng.choice([None, i, i, i, i // 2]), "".join(parts), "en", "s"))
    return rows


@pytest.mark.parametrize("limits", [{}, {"_SLICE": 77}, {"GRAM": 50, "_SLICE": 3}, {"GRAM": 8}])
def test_anchors_of_overlapping_texts(monkeypatch, limits):
    """Every window is in one run, and equal windows pick equal anchors, in all sizes of slices."""
    rows = overlapping(len(limits))
    parts = []
    for name, value in limits.items():
        monkeypatch.setattr(suffix, name, value)
    raw = [((t or "").encode(), suffix._LAST if i is None else i) for i, t, *_ in rows]
    for r, _ in raw:
        data = np.frombuffer(r, np.uint8)
        key, _, start, count, _ = suffix.anchors(data, np.array([len(r)]), 50, suffix.GRAM)
        parts += [(r[p : p + 50], int(k), p - int(s)) for k, s, c in zip(key, start, count, strict=True) for p in range(s, s + c)]
        assert count.sum() == max(0, len(r) - 49)
    anchor = {}
    assert all(anchor.setdefault(w, k) == k for w, k, _ in parts)


@pytest.mark.parametrize("limits", [(4 << 20, 1 << 20, 1 << 16), (600, 500, 1 << 16), (2000, 1, 2)])
def test_repeats_in_small_pieces(spark, limits):
    """Blocks, units and the bound of hot anchors made small, in the workers too."""
    rows = overlapping(limits[0])
    docs = frame(spark, rows).repartition(3).cache()
    before = suffix.BLOCK, suffix.UNIT, suffix.HOT
    stages = {"_blocks": suffix._blocks, "_judge": suffix._judge, "_shared": suffix._shared}

    def small(fn):
        def run(given):
            from korpuslab.llm import suffix as s

            s.BLOCK, s.UNIT, s.HOT = limits
            return fn(given)

        return run

    try:
        for name, fn in stages.items():
            setattr(suffix, name, small(fn))
        assert removed(docs) == repeats_by_hand(rows)
    finally:
        for name, fn in stages.items():
            setattr(suffix, name, fn)
        suffix.BLOCK, suffix.UNIT, suffix.HOT = before


@given(st.lists(st.integers(0, 3), max_size=120), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_equal_prefixes(values, length):
    text = np.array(values, np.int16)
    place, classes = suffix.equal_prefixes(text, length)
    whole = [i for i in range(len(values)) if i + length <= len(values)]
    for i in whole:
        for j in whole:
            assert (classes[place[i]] == classes[place[j]]) == (values[i : i + length] == values[j : j + length])
