"""Mixing, sharding, near-duplicates, neighbours, language model, quality and the pipeline against brute force."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from korpuslab.llm import ann, brown, mixing, ngrams, quality, sharding, simhash
from tests.llm.conftest import awkward_rows, frame, prose

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()


def brute_share(children, budget):
    """Whole tokens by weight, nobody above the cap: children is {name: (weight, cap)}."""
    order = sorted(children, key=lambda n: (children[n][1] / children[n][0], n))
    full, rest, weight = {}, budget, sum(w for w, _ in children.values())
    for n in order:
        w, cap = children[n]
        if cap * weight <= rest * w:
            full[n], rest, weight = cap, rest - cap, weight - w
        else:
            break
    opened = sorted(set(children) - set(full))
    part = {n: rest * children[n][0] // weight for n in opened}
    odd = rest - sum(part.values())
    return full | {n: p + (k < odd) for k, (n, p) in enumerate(part.items())}


def brute_mix(rows, epochs, seed, weights, budget=None):
    def domain(s):
        digits = ""
        while s and s[-1].isdigit() and s[-1].isascii():
            digits, s = s[-1] + digits, s[:-1]
        return f"domain{int(digits) % 3}" if digits else "other"

    docs = [(i, (domain(s or ""), lang or "", s or ""), len([w for w in (t or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w])) for i, t, lang, s in rows]
    available = Counter()
    for _, leaf, n in docs:
        available[leaf] += n
    caps = {leaf: n * epochs for leaf, n in available.items()}
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    given = {(): sum(available.values()) if budget is None else budget}
    for depth, level in enumerate(mixing.PATH):
        nodes = defaultdict(Counter)
        for leaf, cap in caps.items():
            nodes[leaf[:depth]][leaf[depth]] += cap
        given = {(*parent, name): x for parent, kids in nodes.items() for name, x in brute_share({k: (w(level, k), c) for k, c in kids.items()}, given[parent]).items()}
    out = []
    for leaf, x in given.items():
        whole, rest = divmod(x, max(1, available[leaf]))
        mine = sorted((md5(f"{seed}|{whole}|{'' if i is None else i}"), -1 if i is None else i, n) for i, at, n in docs if at == leaf)
        for h, i, n in mine:
            upto = sum(m for g, j, m in mine if (g, j, m) <= (h, i, n))
            out.append((i, *leaf, n, x, whole + (upto <= rest)))
    return sorted(out)


@pytest.mark.parametrize("budget", [None, 0, 500, 10**9])
def test_mixing(docs, rows, none, budget):
    weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
    got = mixing.mix_documents(docs, budget=budget).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_mix(rows, mixing.EPOCHS, mixing.SEED, weights, budget)
    assert mixing.mix_documents(none, budget=budget).count() == 0


def test_mixing_spreads_rows_over_many_leaves(docs, monkeypatch):
    want = sorted(map(tuple, mixing.mix_documents(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert sorted(map(tuple, mixing.mix_documents(docs).collect()), key=str) == want


def test_mixing_of_null_and_repeated_ids(spark):
    rng = random.Random(18)
    rows = [(None, prose(rng, rng.randint(1, 9)), "en", "s1") for _ in range(300)] + [(5, "same text here", "de", "s2")] * 200 + [(i, prose(rng, 5), "fr", f"t{i}") for i in range(300)]
    weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANG_WEIGHTS}
    got = mixing.mix_documents(frame(spark, rows), budget=1500).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_mix(rows, mixing.EPOCHS, mixing.SEED, weights, 1500)


def test_mixed_rows_repeat_documents(docs):
    copies = Counter()
    for r in mixing.mix_documents(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({k: v for k, v in copies.items() if v})


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_sharding(docs, rows, none, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in per.values())
    sizes = [len(per[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    text = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == text
    strata = defaultdict(list)
    for i, t, _, s in rows:
        raw = (t or "").encode()
        strata["" if s is None else "=" + s].append((md5(f"0|{'' if i is None else i}"), -1 if i is None else i, len(raw) + 8, zlib.crc32(raw)))
    order = sorted(((2 * k + 1) / (2 * len(x)), s, k, row) for s, x in strata.items() for k, row in enumerate(sorted(x)))
    want = Counter((row[1], row[2], row[3], p * shards // len(rows)) for p, (_, _, _, row) in enumerate(order))
    assert Counter((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    assert sharding.shard_documents(none).count() == 0


@pytest.mark.parametrize("kind", ["one-row strata", "null ids", "equal rows"])
def test_sharding_deals_evenly(spark, monkeypatch, kind):
    from korpuslab.llm import common

    n, sizes, plain = 20_000, [], common.cut
    row = {"one-row strata": ("id", "concat('s', id)", "'text'"), "null ids": ("cast(NULL AS bigint)", "'a'", "cast(id AS string)"), "equal rows": ("7L", "'a'", "'text'")}[kind]
    docs = spark.range(n, numPartitions=4).selectExpr(*(f"{x} AS {name}" for x, name in zip(row, ("doc_id", "source", "text"), strict=True)))

    def spy(df):
        out = plain(df)
        if "_part" in out.columns:
            sizes.append([r["count"] for r in out.groupBy("_part").count().collect()])
        return out

    monkeypatch.setattr(common, "cut", spy)
    monkeypatch.setattr(sharding, "SMALL", 100)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = sharding.shard_documents(docs).cache()
    finally:
        spark.conf.unset(coalesce)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == sorted([n // 24] * (24 - n % 24) + [n // 24 + 1] * (n % 24))
    assert len(sizes) == 2 and all(len(x) == 4 and max(x) <= 2 * n / 4 for x in sizes)


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "en", "big" if i % 3 else ("mid" if i % 2 else "small")) for i in range(1200)]
    got = sharding.shard_documents(frame(spark, rows), 12).collect()
    source = {i: s for i, _, _, s in rows}
    for s in set(source.values()):
        share = Counter(r["shard"] for r in got if source[r["doc_id"]] == s)
        assert max(share.values()) - min(share.values()) <= 2 and len(share) == 12


def brute_print(text, size=3):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)} | {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    low = {x: x for x in nodes}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                low[root(b)] = root(a)
    groups = defaultdict(set)
    for x in nodes:
        groups[root(x)].add(x)
    return {x: frozenset(g) for g in groups.values() for x in g}


def test_simhash_fingerprint_blocks(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 50, 400)] + [None, "", " \t", "İ x\x85y ß"]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [int.from_bytes(simhash.fingerprint(t), "big") for t in texts] == [brute_print(t) for t in texts]
    for t in texts:  # of a wide fingerprint the first word is the majority of the hashes themselves
        assert int.from_bytes(simhash.fingerprint(t, simhash.WIDE)[:8], "big") == brute_print(t, 5) and len(simhash.fingerprint(t, simhash.WIDE)) == 144


def test_simhash_components(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    group = brute_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = lambda g: min((i for i, p in prints if p in g and i is not None), default=None)
    want = Counter((i, f"{p:016x}", least(group[p])) for i, p in prints)
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(docs, rows):
    kept = simhash.one_of_each(docs, simhash.NARROW)
    assert kept.columns == docs.columns
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    group = brute_components({p for _, p in prints}, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((i for i, p in prints if p in g and i is not None), default=None) for g in group.values()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least.values())  # rows without an id, and repeated rows, count once too


def test_copies_without_ids_and_repeated_rows(spark):
    rng = random.Random(21)
    a, b, c = (prose(rng, 50) for _ in range(3))
    df = spark.createDataFrame([(None, a, "x", {"k": 1}), (None, a, "y", {"k": 1}), (None, b, "x", None), (4, c, "x", {}), (4, c, "x", {}), (4, c, "z", {}), (5, None, "x", None), (6, "", "x", None)], "doc_id bigint, text string, `a.b` string, `_row` map<string,int>")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, a), (None, b), (4, c), (5, None)], key=str)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def similar(rng, words, share):
    """The words with so many changed, one after another at random places, that the similarity of 5-word shingles is just ``share`` at least."""
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    now = list(words)
    for at in rng.sample(range(len(words)), len(words)):
        new = [*now[:at], f"w{rng.random()}", *now[at + 1 :]]
        if len(shingles(new) & shingles(words)) / len(shingles(new) | shingles(words)) < share:
            return now
        now = new
    return now


@pytest.mark.parametrize("length", [100, 400])
def test_wide_fingerprints_catch_near_copies_and_leave_others(spark, length):
    rng, rows, caught = random.Random(22), [], {}
    for share in (0.97, 0.9, 0.8, 0.6):
        for k in range(60):
            words = [f"x{rng.randrange(5000)}" for _ in range(length)]
            first = len(rows)
            rows += [(first, " ".join(words), "en", "s"), (first + 1, " ".join(similar(rng, words, share)), "en", "s")]
            caught[first] = share
    kept = {r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()}
    assert all(i in kept for i in caught)
    found = Counter(share for i, share in caught.items() if i + 1 not in kept)
    assert found[0.97] == found[0.9] == 60 and found[0.8] >= 54 and found[0.6] <= 2
    law, prints = simhash.WIDE, [int.from_bytes(simhash.fingerprint(t, simhash.WIDE), "big") for _, t, *_ in rows]
    assert all((i + 1 not in kept) <= ((prints[i] ^ prints[i + 1]).bit_count() <= law.radius) for i in caught)


def law_links(spark, prints, law):
    nodes = spark.createDataFrame([(k, p.to_bytes(8 * law.words, "big")) for k, p in enumerate(prints)], "node bigint, fp binary")
    return [(prints[r["u"]], prints[r["v"]]) for r in simhash.links(nodes, law).collect()]


@pytest.mark.parametrize("many", [3, 10**6])
def test_links_connect_what_is_connected(spark, monkeypatch, many):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(30)} | {0, 2**64 - 1}
    for centre in list(prints)[:12]:  # dense balls, chains and pairs at every distance up to 5
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    monkeypatch.setattr(simhash, "MANY", many)
    edges = law_links(spark, sorted(prints), simhash.NARROW)
    found = set(edges) | {(b, a) for a, b in edges}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert brute_components(prints, lambda a, b: (a, b) in found) == want
    tied = {r["u"]: r["v"] for r in simhash.stars(spark.createDataFrame([(sorted(prints).index(a), sorted(prints).index(b)) for a, b in edges], "u bigint, v bigint")).collect()}
    order = sorted(prints)
    assert tied == {order.index(p): order.index(min(g)) for p, g in want.items() if min(g) != p}


def test_wide_links_are_certain_up_to_71_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 50)
    rng, size = random.Random(5), 64 * simhash.WIDE.words
    prints = [rng.getrandbits(size) for _ in range(8)]
    for centre in prints[:8]:
        for _ in range(20):
            prints.append(centre ^ sum(1 << b for b in rng.sample(range(size), rng.randint(1, 71))))
    edges = law_links(spark, prints, simhash.WIDE)
    found = set(edges) | {(b, a) for a, b in edges}
    got = brute_components(set(prints), lambda a, b: (a, b) in found)
    certain = brute_components(set(prints), lambda a, b: (a ^ b).bit_count() <= 71)
    whole = brute_components(set(prints), lambda a, b: (a ^ b).bit_count() <= simhash.WIDE.radius)
    assert all(certain[p] <= got[p] <= whole[p] for p in prints)


@pytest.mark.parametrize("bits", [6, 13, 31])
def test_packed_keys_are_the_keys(bits):
    rng = random.Random(11)
    prints = [rng.randbytes(144) for _ in range(7)] + [bytes(144), b"\xff" * 144]
    nodes = [i << 33 | i for i in range(len(prints))]
    rows = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(prints, pa.binary())], names=["node", "fp"])
    cells = sorted((b, p) for half in (rows.slice(0, 4), rows.slice(4)) for x in simhash._packed(bits)(iter([half])) for b, p in zip(*(c.to_pylist() for c in x.columns), strict=True))
    packed = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells, strict=True)], names=["bucket", "payload"])
    back = [tuple(r) for x in simhash._unpacked(bits, iter([packed])) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
    want = set()
    for node, fp in zip(nodes, prints, strict=True):
        for place in range(36):
            value = int.from_bytes(fp[4 * place : 4 * place + 4], "big")
            want |= {(place << 32 | value, node, 0)} | {(place << 32 | value | 1 << b, node, b + 1) for b in range(32) if not value >> b & 1}
    assert len(back) == len(want) and set(back) == want
    keys = [k for k, _ in itertools.groupby(r[0] for r in back)]
    assert len(keys) == len(set(keys))  # a key's rows come one after another


@pytest.mark.parametrize("upper", [True, False])
def test_balls_are_looked_up_in_the_half_that_differs(monkeypatch, upper):
    half, rng, shared = 0x9ABCDEF0, random.Random(8), []
    others = sorted(rng.sample(range(2**32), 500))
    fp = [(half << 32 | x if upper else x << 32 | half).to_bytes(8, "big") for x in others]
    key = np.full(500, half if upper else 1 << 32 | half, np.int64)
    plain = simhash._stars_by_ball

    def spy(members, exact, shift):
        shared.append(np.unique(members >> np.uint64(shift) & np.uint64(0xFFFFFFFF), return_counts=True)[1].max())
        return plain(members, exact, shift)

    monkeypatch.setattr(simhash, "MANY", 10)
    monkeypatch.setattr(simhash, "_stars_by_ball", spy)
    list(simhash._links(simhash.NARROW)(iter([pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(500)), pa.array(np.ones(500, bool)), pa.array(fp, pa.binary())], names=["key", "node", "exact", "fp"])])))
    assert shared == [1]


def key_rows(rng):
    """150 rows (key, node, flip) of few keys, sorted by key, and a cutter of them into batches."""
    key, flip = np.sort(rng.integers(0, 60, 150)), rng.integers(0, 3, 150).astype(np.int8)
    columns = [pa.array(key), pa.array(np.arange(150)), pa.array(flip)]
    return key, flip, lambda size: iter([pa.RecordBatch.from_arrays([c.slice(at, size) for c in columns], names=["key", "node", "flip"]) for at in range(0, 150, size)])


@pytest.mark.parametrize("size", [1, 3, 7, 150])
def test_only_keys_that_say_something_are_looked_at(size):
    key, flip, batches = key_rows(np.random.default_rng(6))
    want = [i for i in range(150) if (key == key[i]).sum() > 1 and 0 in flip[key == key[i]]]
    got = [(x, e) for b in simhash._met(batches(size)) for x, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert got == [(i, flip[i] == 0) for i in want]


def test_what_meets_under_a_key_meets_where_most_of_it_stays():
    rng = random.Random(9)
    centre = rng.randbytes(144)
    prints = [bytes(rng.choice(([x] * 6 + [x ^ 1 << rng.randrange(8)])) for x in centre) for _ in range(60)] + [rng.randbytes(144) for _ in range(5)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(65)), pa.array(prints, pa.binary())], names=["node", "fp"])
    key, node, _ = simhash._keys(rows)
    packed = list(simhash._packed(6)(iter([rows])))
    listed = {(k, n) for b in simhash._moved(simhash._unpacked(6, iter(packed))) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    pairs = lambda rows: {(a, b) for _, g in itertools.groupby(sorted(rows), lambda r: r[0]) for a, b in itertools.combinations(sorted({n for _, n in g}), 2)}
    met = Counter(key.tolist())
    everywhere = {(k, n) for k, n in zip(key.tolist(), node.tolist(), strict=True) if met[k] > 1}
    assert pairs(everywhere) <= pairs(listed) and len(listed) < 0.7 * len(everywhere)



def test_stars_on_a_long_chain(spark):
    n = 200
    got = simhash.stars(spark.createDataFrame([(i + 1, i) for i in range(n)], "u bigint, v bigint"))
    assert {(r["u"], r["v"]) for r in got.collect()} == {(i, 0) for i in range(1, n + 1)}


def vectors(seed=0, n=900, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[300:420] = x[7]  # one vector many times over
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    odd = [(5000, None), (5050, [0.0] * dim), (5100, [None] + [1.0] * (dim - 1)), (5150, [float("nan")] * dim), (5200, [float("inf")] + [1.0] * (dim - 1)), (5250, [1.0, 2.0]), (None, [1.0] * dim), (0, rows[0][1])]
    return rows, odd


def brute_nearest(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
            out[int(ids[q])] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[q]][:k]
    return out


def nearest(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<float>, e int").repartition(3)
    got = defaultdict(list)
    for r in sorted(ann.nearest(df, "vec_id", "embedding", "id % 50 = 0", 5, **more).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return got


def recall(got, want):
    assert set(got) == set(want) and all([r for r, _, _ in x] == list(range(1, len(want[q]) + 1)) for q, x in got.items())
    return sum(len({i for _, i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items()) / sum(map(len, want.values()))


def test_neighbours_are_exact_when_all_lists_are_read(spark):
    rows, odd = vectors()
    got, want = nearest(spark, rows + odd, ratio=100.0), brute_nearest(rows, 50, 5)
    assert recall(got, want) == 1
    for q, best in want.items():
        assert [i for _, i, _ in got[q]] == [i for i, _ in best]
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in best], atol=1e-12)


@pytest.mark.parametrize("n, dim", [(500, 64), (3000, 16), (3000, 64)])
def test_neighbours_recall(spark, monkeypatch, n, dim):
    monkeypatch.setattr(ann, "PART", 40)
    monkeypatch.setattr(ann, "BLOCK", 10)
    rows, _ = vectors(1, n, dim)
    assert recall(nearest(spark, rows), brute_nearest(rows, 50, 5)) >= 0.9


def test_clustered_vectors_are_read_in_part():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(60, size=6000)] + 0.5 * rng.normal(size=(6000, 32))
    c, u = ann.Centroids(x, 78), ann.unit(x)
    rows, lists = c.lists_of(u)
    of = [set() for _ in c.at]
    for r, l in zip(rows, lists, strict=True):
        of[l].add(r)
    ask, read = c.probes(u[::50], 5, np.array([len(o) for o in of]))
    hits = seen = 0
    for q in range(120):
        met = set().union(*(of[l] for l in read[ask == q]))
        near = np.argsort(-(u @ u[50 * q]))[1:6]
        hits, seen = hits + len(met & set(near)), seen + len(met)
    assert hits >= 0.95 * 600 and seen < 0.1 * 120 * 6000


def test_the_walk_follows_the_graph():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 8))
    c = ann.Centroids(x, 200)
    far = c.walk(ann.unit(x[:300]), 1.05)
    truth = np.sqrt(np.maximum(2 - 2 * ann.unit(x[:300]) @ c.at.T, 0))
    met = np.isfinite(far)
    assert np.allclose(far[met], truth[met]) and (far.argmin(1) == truth.argmin(1)).mean() > 0.95 and met.mean() < 0.9


@pytest.mark.parametrize("scale", [lambda i: 2.0 ** (i % 40), lambda i: float(i + 1), lambda i: 0.1 * (i + 1)])
def test_ties_of_parallel_vectors_go_to_smaller_ids(spark, scale):
    got = nearest(spark, [(i, [scale(i), scale(i)]) for i in range(200)])
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i, _ in got[50]] == [0, 1, 2, 3, 4] and len({s for x in got.values() for _, _, s in x}) == 1


def test_ties_of_other_vectors_go_to_smaller_ids(spark):
    rng = random.Random(7)
    around = [[1.0, *(rng.choice([-1.0, 1.0]) * 0.5 if k == j else 0.0 for k in range(6))] for j in range(6)]
    rows = [(0, [1.0] + [0.0] * 6)] + [(i, around[rng.randrange(6)]) for i in range(1, 300)]
    got = nearest(spark, rows, ratio=100.0)
    assert [i for _, i, _ in got[0]] == [1, 2, 3, 4, 5]


def test_neighbours_of_tiny_tables(spark):
    assert nearest(spark, [(0, [1.0, 0.0])]) == {}
    assert nearest(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.5])]) == {}
    got = nearest(spark, [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (50, [0.0, 1.0])])
    assert [i for _, i, _ in got[0]] == [1, 50] and [i for _, i, _ in got[50]] == [0, 1]
    assert nearest(spark, [(None, None)]) == {}


def test_centroid_lists_are_balanced_and_replicated():
    x = np.random.default_rng(0).normal(size=(4000, 16))
    c = ann.Centroids(x, 40)
    rows, lists = c.lists_of(ann.unit(x))
    sizes = np.bincount(lists, minlength=40)
    assert set(rows) == set(range(4000)) and sizes.max() < 3 * sizes.mean() and np.bincount(rows).max() <= ann.REPLICAS and len(rows) > 4000


def words(text):
    return [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)} | {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]


def test_language_model(spark, none):
    rng, rows = random.Random(9), awkward_rows()
    rows += [(1000 + i, prose(rng, 40, lang), lang, "s") for i in range(150) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    got = brown.score_documents(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        toks = [*words(t), "\n"]
        want[(i, held(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert all(r["score"] < 0 and r["perplexity"] > 1 for r in got)
    assert brown.score_documents(none).count() == 0


def test_language_model_without_training_text(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = brown.score_documents(frame(spark, [(i, "only held out", "en", "s")])).first()
    assert (r["score"], r["base_score"], r["train_tokens"], r["n_tokens"], r["n_known"]) == (0.0, 0.0, 0, 4, 0)


def test_language_model_adds_up_to_one(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(prose(rng, 30),) for _ in range(80)], "text string")
    model, vocabulary = brown.train(df)
    counts = {bytes(r["word"]): r["n"] for r in vocabulary.collect()}
    facts = [model.word(w, n) for w, n in counts.items()]
    unseen = [model.word(w, 0) for w in {brown.ending(str(i).encode()): str(i).encode() for i in range(100_000)}.values() if w not in counts]
    assert len(unseen) == brown.ENDINGS
    for h in range(brown.CLASSES):
        total = sum(brown.WEIGHT * model.step[h, c] * inside + (1 - brown.WEIGHT) * base for c, inside, base in facts + unseen)
        assert total == pytest.approx(1.0, abs=1e-6)


def brute_scores(texts, held, known):
    """Scores by definition from classes of words alone: counts, transitions, emissions and the mixture, token by token."""
    toks = [[*words(t), "\n"] for t in texts]
    train = [t for t, out in zip(toks, held, strict=True) if not out]
    counts = Counter(w for t in train for w in t)
    cls = {w: c for w, (c, _) in known.items()}
    total, distinct, k = sum(counts.values()), len(counts), brown.CLASSES
    core = {w for w, _ in sorted(((w, n) for w, n in counts.items() if w != "\n"), key=lambda x: (-x[1], x[0].encode()))[: brown.CORE]} | {"\n"}
    rare = [w for w in counts if w not in core]
    once, twice = (sum(counts[w] == n for w in rare) for n in (1, 2))
    discount = min(once / (once + 2 * twice) if once else 0.5, 0.95)
    steps = Counter(x for t in train for x in zip([cls["\n"], *(cls[w] for w in t[:-1])], [cls[w] for w in t], strict=True))
    end = lambda w: zlib.crc32(w.encode()[-brown.TAIL :]) % brown.ENDINGS
    kinds = Counter((end(w), cls[w]) for w in rare)
    home = {}
    for e in range(brown.ENDINGS):
        found = {c: n for (x, c), n in kinds.items() if x == e}
        home[e] = min(found, key=lambda c: (-found[c], c)) if found else None
    return toks, counts, cls, total, distinct, k, core, discount, steps, end, kinds, home


def test_language_model_scores_as_defined(spark):
    rng = random.Random(16)
    vocabulary = prose(rng, 400).split()
    texts = [" ".join(rng.choice(vocabulary[: 40 if rng.random() < 0.7 else 400]) for _ in range(rng.randint(0, 30))) for _ in range(250)]
    held = [i % 5 == 0 for i in range(250)]
    brown_core, brown.CORE = brown.CORE, 60
    try:
        df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(zip(texts, held, strict=True))], "doc_id bigint, text string, held_out boolean").repartition(3)
        model, vocabulary_rows, coded = brown.fit(df)
        known = {bytes(r["word"]).decode(): (r["n"] >> brown.COUNT_BITS, r["n"] & (1 << brown.COUNT_BITS) - 1) for r in vocabulary_rows.collect()}
        toks, counts, cls, total, distinct, k, core, discount, steps, end, kinds, home = brute_scores(texts, held, known)
    finally:
        brown.CORE = brown_core
    assert {w: n for w, (_, n) in known.items()} == counts
    home = {e: int(model.units.n and model.home[e]) if c is None else c for e, c in home.items()}  # an ending no word has: its unit's class
    assert all(model.home[e] == c for e, c in home.items())
    into = Counter(c for (_, c), n in steps.items() for _ in range(n))
    homes = Counter(home.values())
    size = {c: into[c] + homes[c] for c in range(k)}
    whole = sum(size.values())
    out = Counter(c for (c, _), n in steps.items() for _ in range(n))
    kinds_of_end = Counter()
    kinds_of_class = Counter()
    for (e, c), n in kinds.items():
        kinds_of_end[e] += n
        kinds_of_class[c] += n
    weight = Counter()
    for e, c in home.items():
        weight[c] += kinds_of_end[e] + 1
    off = {c: discount if homes[c] else 0.0 for c in range(k)}

    def score(tokens):
        value, last = 0.0, cls["\n"]
        for w in tokens:
            if w in counts:
                c = cls[w]
                inside, base = (counts[w] - off[c] * (w not in core)) / size[c], (counts[w] + 1) / (total + distinct + 1)
            else:
                e = end(w)
                c = home[e]
                inside = (off[c] * kinds_of_class[c] * (kinds_of_end[e] + 1) / weight[c] + 1) / size[c]
                base = 1 / (total + distinct + 1) / brown.ENDINGS
            step = (steps[last, c] + brown.PRIOR * size[c] / whole) / (out[last] + brown.PRIOR)
            value += math.log10(brown.WEIGHT * step * inside + (1 - brown.WEIGHT) * base)
            last = c
        return value

    for r in coded.collect():
        n_known, _, got = model.score(*brown._unpack(bytes(r["codes"]), r["n_tokens"]))
        assert n_known == sum(w in counts for w in toks[r["doc_id"]]) and got == pytest.approx(score(toks[r["doc_id"]]), rel=1e-9)


def test_language_model_with_equal_rows_and_frequent_words(spark, monkeypatch):
    rng = random.Random(19)
    texts = ["the same text in every row"] * 300 + [prose(rng, 60) for _ in range(100)]
    df = spark.createDataFrame([(None if i % 2 else 5, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, block string").repartition(6)
    monkeypatch.setattr(brown, "CORE", 2)
    want = sorted(map(tuple, brown.score_documents(df).drop("score", "perplexity").collect()), key=str)
    one = sorted(((r["score"]) for r in brown.score_documents(df).collect()))
    monkeypatch.setattr(brown, "HELD_ROWS", 1)  # contexts become counts at once
    monkeypatch.setattr(brown, "SLICE", 500)
    monkeypatch.setattr(brown, "MOVING", 50)
    got = brown.score_documents(df).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == want and len({round(r["score"], 9) for r in got if r["n_tokens"] == 7}) == 1 and len(one) == 400


def test_words_outside_the_core_have_classes_of_their_own(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(brown, "CORE", 8)  # the frame, one noun and one verb; all other words end alike
    stem = lambda: "".join(rng.choice("abcdefgh") for _ in range(6)) + "zed"
    nouns, verbs = ([stem() for _ in range(30)] for _ in range(2))
    pick = lambda group, core: core if rng.random() < 0.3 else rng.choice(group)
    texts = [f"the {pick(nouns, 'dog')} is big" if i % 2 else f"they {pick(verbs, 'see')} it now" for i in range(900)]
    model, vocabulary = brown.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    counts = {bytes(r["word"]).decode(): r["n"] for r in vocabulary.collect()}
    of = lambda group: {model.word(w.encode(), counts[w])[0] for w in group if w in counts}
    assert of(nouns).isdisjoint(of(verbs))


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    n, k = 60, 6
    kind = np.concatenate([[0], 1 + rng.integers(0, 5, n - 1)])
    flow = rng.dirichlet(np.full(6, 0.2), 6)
    counts = rng.poisson(40 * flow[kind][:, kind])
    classes = np.concatenate([[0], 1 + np.arange(n - 1) % (k - 1)])
    value = []
    for _ in range(6):
        right = np.stack([np.bincount(classes, counts[u], minlength=k) for u in range(n)])
        left = np.stack([np.bincount(classes, counts[:, u], minlength=k) for u in range(n)])
        joint = np.zeros((k, k))
        np.add.at(joint, classes, right)
        value.append(brown.likelihood(joint))
        classes = brown.exchange(right, left, np.diag(counts).astype(float), classes, k)
    assert max(value) > value[0] + 1 and classes[0] == 0 and (classes[1:] > 0).all()


def test_quality(spark, none):
    rng, rows, bad = random.Random(13), [], set()
    for i in range(300):
        text = prose(rng, 60)
        if i % 10 == 0:
            text, _ = " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in text.split()), bad.add(i)
        elif i % 10 == 1:
            text, _ = " ".join([text.split()[0]] * 60), bad.add(i)
        rows.append((i, text, "en", "s"))
    odd = [(900, None, "en", "s"), (901, " \n", "en", "s"), (None, prose(rng, 60), "en", "s")]
    got = {r["doc_id"]: r for r in quality.judge_documents(frame(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd)
    assert not any(got[i]["keep"] for i in bad) and all(got[i]["keep"] for i in range(300) if i not in bad)
    assert got[900]["score"] == got[901]["score"] == 0 and not got[900]["keep"] and got[None]["keep"]
    assert quality.judge_documents(none).count() == 0
    same = quality.judge_documents(frame(spark, [(i, "A fine text is this.", "en", "s") for i in range(5)])).collect()
    assert all(r["keep"] for r in same)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        kind = rng.integers(2)
        votes = []
        for k in range(len(quality.LABELLERS)):
            told = good or (k in quality.KINDS[kind])
            right = rng.random() < (0.97 if good else 0.9)
            votes.append(quality.NONE if rng.random() < 0.1 else int(good if told and right else not good if told else True))
        counts["".join(map(str, votes))] += 1
    model = quality.LabelModel(dict(counts))
    assert model.prior[0] == pytest.approx(0.8, abs=0.05) and (model.accuracy > 0.75).all()
    assert model.posterior["1111111"] > 0.9 > 0.1 > model.posterior["0000111"]


def brute_em(counts, rounds):
    """Expectation-maximisation one pattern, class and vote at a time."""
    kinds = [None, *quality.KINDS]
    post = {}
    for p in counts:
        start = [1.05, *(2.0 * sum(p[k] == "0" for k in kind) + 0.05 for kind in kinds[1:])]
        post[p] = [x / sum(start) for x in start]
    for _ in range(rounds):
        mass = [sum(n * post[p][c] for p, n in counts.items()) for c in range(3)]
        prior = [(m + 1) / (sum(mass) + 3) for m in mass]
        gives = [[[0.1 + sum(n * post[p][c] for p, n in counts.items() if p[k] == v) for v in "01"] for k in range(len(quality.LABELLERS))] for c in range(3)]
        for p in counts:
            odds = [prior[c] * math.prod(gives[c][k][int(v)] / sum(gives[c][k]) for k, v in enumerate(p) if v != "2") for c in range(3)]
            post[p] = [x / sum(odds) for x in odds]
    return {p: x[0] for p, x in post.items()}


def test_label_model_is_expectation_maximisation():
    rng = random.Random(14)
    counts = {"".join(rng.choice("0112") for _ in quality.LABELLERS): rng.randint(1, 50) for _ in range(60)}
    got, want = quality.LabelModel(counts, 25).posterior, brute_em(counts, 25)
    assert all(got[p] == pytest.approx(x, abs=1e-9) for p, x in want.items())


def test_quality_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(15)
    good, bad = ([prose(rng, 60) for _ in range(40)], [" ".join([w] * 60) for w in prose(rng, 40).split()])
    rows = [(7, t, "en", "s") for t in good + bad] + [(None, t, "en", "s") for t in good + bad] + [(9, prose(rng, 20_000), "en", "s")]
    got = quality.judge_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["keep"] for r in got) == 2 * len(good) + 1  # ids say nothing: each text has its own label


def test_logistic_learner():
    rng = np.random.default_rng(2)
    x = ngrams.features([" ".join(rng.choice(["aa", "bb"] if i % 2 else ["cc", "dd"], 20)) for i in range(200)], lower=True)
    y = (np.arange(200) % 2).astype(np.float32)[:, None]
    w, b = ngrams.fit_logistic(x, y)
    assert (((x @ w + b) > 0) == (y > 0)).all()


def test_pipeline_stages_take_effect(spark):
    rng, rows = random.Random(17), awkward_rows()
    rows += [(1000 + i, prose(rng, 40, lang), lang, f"src{i % 4}") for i in range(200) for lang in [rng.choice(["en", "de", "fr", "es"])]]
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing_weights", "bpe"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "").cache()
        seen[name] = now.collect()
        if name != "bpe":
            assert now.columns == docs.columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("language_id") == set(range(60)) | {i for i, t, *_ in rows if t and any(map(str.isalpha, t))} - {None} | {None}
    assert all(len(r["text"]) == r["n_chars"] for r in seen["line_dedup"])
    assert ids("line_dedup") == ids("language_id") and ids("simhash_near_dedup") < ids("line_dedup")
    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"]}
    assert sum("line that many" in texts[100 + i].lower() for i in range(7)) == 1
    left = [r for r in seen["simhash_near_dedup"] if r["doc_id"] is not None and 200 <= r["doc_id"] < 220]
    assert [r["doc_id"] for r in left if r["text"]] == [219] and len(left) == 2  # the others lost their only line: empty copies, one stays
    assert ids("bpe") == ids("mixing_weights") <= ids("simhash_near_dedup")
    assert len(seen["bpe"]) == len(seen["mixing_weights"])
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_pipeline_with_clashing_names(spark):
    rng, rows = random.Random(23), []
    for i in range(60):
        lang = rng.choice(["en", "de", "fr", "es"])
        rows.append((i, prose(rng, 40, lang) + "\nA shared line that is longer than forty characters, here.", lang, f"src{i % 3}", 1, "d", "dot", "row", "v", 0.5, None))
    columns = "doc_id bigint, text string, lang string, source string, n_lines int, n_dropped string, `a.b` string, `_row` string, `_v` string, score double, copies int"
    now = docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.dtypes == docs.dtypes, name
    left = now.collect()
    assert left and all((r["n_lines"], r["n_dropped"], r["a.b"], r["_row"], r["_v"], r["score"], r["copies"]) == (1, "d", "dot", "row", "v", 0.5, None) for r in left)
    assert sum("shared line" in r["text"] for r in left if r["doc_id"] != 59) == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() == len(left)
