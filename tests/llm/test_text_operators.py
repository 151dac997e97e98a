"""Media columns, BPE, line dedup and language identification against brute force."""

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from korpuslab.llm import bpe, langid, lines, media
from tests.llm.conftest import awkward_rows, frame, prose

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@given(st.binary(max_size=5000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(raw):
    payload = media.pad(raw)
    stored = media.wrap_payload(payload)
    back, track = media.read_payload(stored)
    assert back == payload
    facts = media.probe_bytes(stored)
    assert facts["codec"] == "uncv" and facts["n_samples"] == len(payload) // 64 and facts["duration_s"] == len(payload) / 64 / 30
    for k, at in enumerate(facts["keyframes"]):
        assert stored[at["offset"] : at["offset"] + at["size"]] == payload[k * 1920 : k * 1920 + 64]


@given(st.binary(max_size=300), st.integers(0, 700), st.integers(0, 255))
@settings(max_examples=150, deadline=None)
def test_media_never_breaks_on_damage(raw, at, byte):
    stored = bytearray(media.wrap_payload(media.pad(raw)))
    stored[at % len(stored)] = byte
    for data in (bytes(stored), bytes(stored[: at % len(stored)]), raw):
        try:
            media.probe_bytes(data)
        except media.MediaError:
            pass


def test_media_offsets_beyond_64_bits():
    """A chunk that starts near the largest number, and times whose product has no 64 bits, are told, not wrapped."""
    one = lambda offset, steps: bytes(box(b"moov", trak(1, b"vide", b"xxxx", 30, [
        full(b"stsz", struct.pack(">II", 16, 1)), full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), full(b"co64", struct.pack(">IQ", 1, offset)), full(b"stts", struct.pack(">III", 1, *steps)),
    ])) + box(b"mdat", bytes(64)))
    with pytest.raises(media.MediaError, match="past the end"):
        media.probe_bytes(one(2**63 - 16, (1, 1)))
    assert media.probe_bytes(one(0, (1, 1)))["n_samples"] == 1


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, flags=0):
    return box(kind, struct.pack(">I", flags), *parts)


def trak(number, handler, codec, scale, tables, extra=b""):
    """A track with hand-written sample tables."""
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), *tables)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, scale, 0), bytes(4)), full(b"hdlr", bytes(4), handler, bytes(13)), box(b"minf", stbl))
    return box(b"trak", full(b"tkhd", struct.pack(">IIII", 0, 0, number, 0), bytes(64)), extra, mdia)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def test_media_with_many_kinds_of_tables():
    body = bytes(range(200))
    head = box(b"ftyp", b"isom", u32(0))
    mdat = box(b"mdat", body)
    at = len(head) + 8  # the data comes first
    shadow = box(b"udta", box(b"meta", bytes(4), full(b"hdlr", bytes(4), b"mdir", bytes(13))))
    video = trak(1, b"vide", b"avc1", 100, [full(b"stts", u32(2, 3, 10, 2, 20)), full(b"stss", u32(2, 1, 4)), full(b"stsc", u32(2, 1, 2, 1, 3, 1, 1)), full(b"stsz", u32(0, 5, 10, 20, 30, 40, 50)), full(b"co64", u32(3, 0, at, 0, at + 40, 0, at + 150))], shadow)
    sound = trak(2, b"soun", b"mp4a", 50, [full(b"stts", u32(1, 5, 7)), full(b"stsc", u32(1, 1, 5, 1)), full(b"stz2", u32(4, 5), bytes([0x12, 0x34, 0x50])), full(b"stco", u32(1, at + 100))])
    even = trak(3, b"text", b"tx3g", 10, [full(b"stts", u32(1, 4, 5)), full(b"stsc", u32(1, 1, 2, 1)), full(b"stsz", u32(6, 4)), full(b"stco", u32(2, at + 10, at + 90))])
    facts = media.probe_bytes(head + mdat + box(b"moov", video, sound, even))
    keys = lambda t: [(k["offset"] - at, k["size"]) for k in t["keyframes"]]
    first, second, third = facts["tracks"]
    assert (facts["n_tracks"], facts["codec"], first["codec"], first["handler"], first["duration_s"], first["n_samples"]) == (3, "avc1", "avc1", "vide", 0.7, 5)
    assert keys(first) == [(0, 10), (70, 40)]  # the fourth sample is the second of the second chunk
    assert (second["codec"], second["handler"], second["duration_s"], second["n_samples"], keys(second)) == ("mp4a", "soun", 0.7, 5, [(100, 15)])
    assert (third["n_samples"], third["duration_s"], keys(third)) == (4, 2.0, [(10, 12), (90, 12)])


def test_media_in_fragments():
    empty = [full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0))]
    moov = box(b"moov", trak(1, b"vide", b"hvc1", 10, empty), trak(2, b"soun", b"Opus", 10, empty), box(b"mvex", full(b"trex", u32(1, 1, 5, 0, 0x10000)), full(b"trex", u32(2, 1, 2, 3, 0))))
    head = box(b"ftyp", b"iso5", u32(0)) + moov

    def moof(offset):
        one = box(b"traf", full(b"tfhd", u32(1), flags=0x20000), full(b"trun", u32(3), struct.pack(">i", offset), u32(0), u32(10, 20, 30), flags=0x205))
        two = box(b"traf", full(b"tfhd", u32(2, 4), flags=0x20008), full(b"trun", u32(2), struct.pack(">i", offset + 60), flags=1), full(b"trun", u32(1)))
        return box(b"moof", full(b"mfhd", u32(1)), one, two)

    size = len(moof(0)) + 8
    part = moof(size) + box(b"mdat", bytes(69))
    facts = media.probe_bytes(head + part + part)
    first, second = facts["tracks"]
    start = [len(head) + size, len(head) + len(part) + size]
    assert (first["n_samples"], first["duration_s"], first["codec"]) == (6, 3.0, "hvc1")
    assert [(k["offset"], k["size"]) for k in first["keyframes"]] == [(s, 10) for s in start]  # only the first sample of each run
    assert (second["n_samples"], second["duration_s"]) == (6, 2.4)
    assert [(k["offset"], k["size"]) for k in second["keyframes"]] == [x for s in start for x in ((s + 60, 6), (s + 66, 3))]
    with pytest.raises(media.MediaError):
        media.probe_bytes(head + part[:-1].replace(b"mdat", b"free")[: len(moof(size))])


def test_media_makes_nothing_of_sizes_a_file_does_not_have():
    for table in (full(b"stsz", u32(1 << 30, 1 << 31)), full(b"stsz", u32(0, 1 << 31))):
        tables = [full(b"stts", u32(0)), full(b"stsc", u32(1, 1, 1 << 31, 1)), table, full(b"stco", u32(1, 0))]
        with pytest.raises(media.MediaError):
            media.probe_bytes(box(b"moov", trak(1, b"vide", b"avc1", 1, tables)))
    empty = [full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0))]
    moov = box(b"moov", trak(1, b"vide", b"avc1", 1, empty), box(b"mvex", full(b"trex", u32(1, 1, 0, 0, 0))))
    with pytest.raises(media.MediaError):
        media.probe_bytes(moov + box(b"moof", box(b"traf", full(b"tfhd", u32(1)), full(b"trun", u32(1 << 31, 0x10000), flags=4))))


def test_stored_media_against_another_reader(spark):
    """The file's boxes found by their names and read field by field."""
    got = media.text_media(spark.createDataFrame([(1, "ab" * 3000, "x")], "doc_id bigint, text string, media_sha256 string")).first()
    payload = b"ab" * 3000 + bytes(16)
    stored = media.wrap_payload(payload)
    assert got["media_sha256"] == sha(stored) and got["media_bytes"] == len(stored)
    number = lambda name, skip: struct.unpack_from(">I", stored, stored.index(name) + 4 + skip)[0]
    n = number(b"stsz", 8)
    chunks = [number(b"stco", 8 + 4 * i) for i in range(number(b"stco", 4))]
    sync = [number(b"stss", 8 + 4 * i) for i in range(number(b"stss", 4))]
    assert (number(b"stsz", 4), n, number(b"mdhd", 12), number(b"mdhd", 16)) == (64, 94, 30, 94) and got["duration_s"] == 94 / 30
    whole = b"".join(stored[c : c + 64 * min(30, n - 30 * i)] for i, c in enumerate(chunks))
    assert whole == payload and got["payload_sha256"] == sha(whole)
    assert [(k["offset"], k["size"]) for k in got["keyframes"]] == [(chunks[(s - 1) // 30] + 64 * ((s - 1) % 30), 64) for s in sync]
    mean = sum(payload) / len(payload)
    assert got["feature"].startswith("uncv 94/30 keys=4:") and f"mean={mean:.4f}" in got["feature"]


def test_media_query(spark, docs, rows, none):
    got = media.text_media(docs).toPandas()
    want = sorted((-1 if i is None else i, len(raw := (t or "").encode()), sha(p := media.pad(raw)), zlib.crc32(p[-64:])) for i, t, *_ in rows)
    found = sorted((-1 if i != i else int(i), n, h, c) for i, n, h, c in zip(got.doc_id, got.n_bytes, got.payload_sha256, got.tail_crc32, strict=True))
    assert found == want
    assert (got.payload_bytes % 64 == 0).all() and (got.payload_bytes > 0).all()
    assert media.text_media(none).count() == 0


def test_media_column_reports_errors(spark):
    good = bytearray(media.wrap_payload(media.pad(b"abc")))
    df = spark.createDataFrame([(1, bytes(good)), (2, b"junk"), (3, None)], "id int, media binary")
    out = {r["id"]: r["m"] for r in media.media_columns(df, "media", "m").collect()}
    assert out[1]["codec"] == "uncv" and out[1]["error"] is None and out[2]["error"] and out[3] is None


def test_bpe_equals_the_library(docs, rows, none):
    coder = bpe.ByteBPE(bpe.default_vocabulary())
    got = bpe.encode_documents(docs, leaf=64, with_ids=True).toPandas()  # so that the 30,000 letters go through the tree
    want = sorted((-1 if i is None else i, ",".join(map(str, coder.encode(t or "")))) for i, t, *_ in rows)
    assert sorted((-1 if i != i else int(i), ",".join(map(str, x))) for i, x in zip(got.doc_id, got.ids, strict=True)) == want
    for n, h, d, ids in zip(got.n_tokens, got.ids_sha256, got.decoded_sha256, got.ids, strict=True):
        assert n == len(ids) and h == sha(",".join(map(str, ids))) and d == sha(coder.tokenizer.decode(list(ids), skip_special_tokens=False))
    assert bpe.encode_documents(none).count() == 0


def test_bpe_tree_is_the_path_of_long_runs(spark, monkeypatch):
    coder, rng = bpe.vocabulary(bpe.default_vocabulary()), random.Random(3)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = [run("abcdefg", 2049), run("日本語", 9000), run(" ", 5000) + "x", f"some words {run('xyz', 2 * bpe.LEAF)} and {run('0123', 20_000)}.\n{run('-=', 4000)} end", run("ab", 2048), "short", "", None, run("é", 50_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[1])]
    levels, plain = [], bpe.cut

    def spy(df):
        if "n" in df.columns and "text" not in df.columns:
            levels.append(1)
        return plain(df)

    monkeypatch.setattr(bpe, "cut", spy)
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), with_ids=True).collect()
    assert len(levels) == 7  # the leaves, and six levels: 50,000 letters are 64 leaves
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=key) == sorted(((i, coder.encode(t or "")) for i, t in rows), key=key)


@given(st.text(max_size=60), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_bpe_tree_on_any_text(text, leaf):
    coder = bpe.vocabulary(bpe.default_vocabulary())
    ids = coder.encode(text)
    assert bpe.encode_tree(text, coder, leaf) == ids
    assert coder.decode(ids) == coder.tokenizer.decode(ids, skip_special_tokens=False)
    assert ",".join(coder.decimals(coder.split(text))) == ",".join(map(str, ids))


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz", "日本語漢字", " \t", "!?.-", "0123456789", "éèêaou"])
def test_bpe_tree_on_long_unsplit_text(letters):
    coder, rng = bpe.vocabulary(bpe.default_vocabulary()), random.Random(1)
    for _ in range(10):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(800, 3000)))
        assert bpe.encode_tree(text, coder, 37) == coder.encode(text)


def test_bpe_decode_column(spark):
    coder = bpe.vocabulary(bpe.default_vocabulary())
    df = spark.createDataFrame([(coder.encode("Merhaba dünya"),), ([],), (None,)], "ids array<int>")
    assert [r["text"] for r in bpe.decode_column(df, "ids").collect()] == ["Merhaba dünya", "", None]


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(i)
    out = []
    for i, t, *_ in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((-1 if i is None else i, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup(spark, none, seed):
    rows = awkward_rows(seed=seed)
    got = lines.line_digests(frame(spark, rows).repartition(3)).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == brute_lines(rows)
    assert lines.line_digests(none).count() == 0


def test_line_dedup_keeps_other_columns(docs):
    got = lines.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert got.where("doc_id = 300").first()["text"] is None


def line_batches(rng):
    """Batches of (doc_id, hi, lo), largest ids first, and what they hold by key."""
    want, batches = defaultdict(set), []
    for batch in range(7):
        found = sorted({(900 - batch * 100 + d, rng.randint(0, 30), 0) for d in range(20) for _ in range(5)})
        for d, h, _ in found:
            want[h].add(d)
        batches.append(found)
    return batches, want


def test_line_runs_compact_and_count(spark, tmp_path):
    store, (batches, want) = lines.LineRuns(spark, str(tmp_path)), line_batches(random.Random(2))
    for found in batches:
        store.add(spark.createDataFrame(found, "doc_id bigint, hi bigint, lo bigint"))
    assert [len(level) for level in store.levels] == [1, 1, 1]  # seven batches: merged runs of four and of two, and one
    got = {r["hi"]: (r["n"], r["holder"]) for r in store.verdict().collect()}
    assert got == {h: (len(d), max(d)) for h, d in want.items()}
    entries = [r["hi"] for run in store.runs() for r in run.where("holder IS NOT NULL").collect()]
    assert sorted(entries) == sorted(want)  # one entry for each key in all runs


def test_line_runs_need_their_anti_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines.LineRuns, "_known", lambda self, own, run: own)
    store, (batches, want) = lines.LineRuns(spark, str(tmp_path)), line_batches(random.Random(2))
    for found in batches:
        store.add(spark.createDataFrame(found, "doc_id bigint, hi bigint, lo bigint"))
    got = [(r["hi"], r["n"], r["holder"]) for r in store.verdict().collect()]
    assert len(got) > len(want) and sorted(got) != sorted((h, len(d), max(d)) for h, d in want.items())


def test_runs_meet_without_a_shuffle(spark, tmp_path):
    store, (batches, _) = lines.LineRuns(spark, str(tmp_path)), line_batches(random.Random(3))
    for found in batches[:3]:
        store.add(spark.createDataFrame(found, "doc_id bigint, hi bigint, lo bigint"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    old, new = store.runs()
    assert "Exchange" not in plan(lines.merge(old, new)) and "SortMergeJoin" in plan(lines.merge(old, new))
    own = spark.createDataFrame(batches[3], "doc_id bigint, hi bigint, lo bigint").groupBy("hi", "lo").agg({"doc_id": "max"}).withColumnsRenamed({"max(doc_id)": "holder"}).selectExpr("hi", "lo", "1L AS n", "holder")
    met = plan(store._known(own, old))
    assert "LeftAnti" in met and met.count("Exchange hashpartitioning") == 2 * plan(own).count("Exchange hashpartitioning")  # the batch alone, for each of two joins


def test_line_dedup_carries_clashing_names(spark):
    rows = [(i, f"A line that is longer than forty characters, and shared.\nown {i}", i, "a", "b", "c") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines bigint, n_dropped string, `a.b` string, `_row` string")
    got = lines.with_lines_dropped(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["a.b"], r["_row"], "shared" in r["text"]) for r in got.collect()) == [(i, i, "a", "b", "c", i == 5) for i in range(6)]


def brute_codes(codes, text):
    """Prediction by definition: each codeword's weighted logistic loss over the bits, one at a time."""
    raw, counts = (f" {text.lower()} ").encode(), defaultdict(int)
    for k in range(len(raw) - 2):
        number = raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]
        counts[(number * 2654435761 % 2**32) >> 20] += 1
    total = sum(counts.values())
    margins = [sum((n / total) ** 0.5 * float(codes.w[at, bit]) for at, n in counts.items()) + float(codes.b[bit]) for bit in range(codes.code.shape[1])]
    losses = [sum(float(codes.trust[lang, bit]) * math.log1p(math.exp(-m * codes.code[lang, bit])) for bit, m in enumerate(margins)) for lang in range(len(codes.names))]
    best = min(range(len(losses)), key=losses.__getitem__)
    score = 1 / sum(math.exp(-len(margins) * (x - losses[best])) for x in losses)
    wrong = sum((1 if m > 0 else -1) != codes.code[best, bit] for bit, m in enumerate(margins))
    return codes.names[best], score, wrong > codes.corrects or score < 0.5


def test_language_id_decodes_as_defined(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 40), lang), lang, "s") for i in range(200) for lang in [rng.choice(["en", "de", "fr", "es", "tr"][:4])]]
    docs = frame(spark, rows)
    codes = langid.learn(langid._inputs(docs))
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, text, *_ in rows:
        lang, score, doubt = brute_codes(codes, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=2e-3)
        assert got[i]["ambiguous"] == doubt or abs(score - 0.5) < 1e-2 or min(abs(m) for m in (langid._inputs_of([text]) @ codes.w + codes.b)[0]) < 1e-3


def test_no_language_gets_lost(spark):
    one = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(one, "ein schöner tag und noch einer", "de", "s")] * 3000 + [(20 + i, f"a fine day number {i} it is", "en", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert langid.learn(langid._inputs(df)).names == ["de", "en"]


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 30):
        code = langid.codewords(n)
        gaps = (code[:, None] != code[None]).sum(2)
        assert code.shape[0] == n and gaps[gaps > 0].min() >= 4 and (abs(code.sum(0)) < n).all()


def test_language_id(spark, none):
    rng, rows = random.Random(5), []
    for i in range(400):
        lang = rng.choice(["en", "de", "fr", "es"])
        rows.append((i, prose(rng, 25, lang), lang if i % 5 else None, "s"))
    odd = [(900, None, "en", "s"), (901, "", "de", "s"), (902, "12 !? 3", "fr", "s"), (903, "²³", "fr", "s"), (None, prose(rng, 20), None, None)]
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, rows + odd)).collect()}
    assert len(got) == len(rows) + len(odd)
    truth = {i: next(x for x in ("en", "de", "fr", "es") if x) and lang for i, _, lang, _ in rows if lang}
    held = [i for i in truth if got[i]["held_out"]]
    assert held and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0
    one = langid.identify(frame(spark, [(i, "abc", "tr", "s") for i in range(8)])).collect()
    assert {r["lang_pred"] for r in one} == {"tr"}
    foreign = [(950 + i, " ".join(rng.choice(["pvysk", "zgrlo", "mnath", "krzew", "wjhov", "dźwik"]) for _ in range(40)), "xx" if i == 3 else None, "s") for i in range(4) if zlib.crc32(str(950 + i).encode()) % 4 == 2 or i != 3]
    left = {r["doc_id"] for r in langid.identified_rows(frame(spark, rows + foreign)).collect()}
    assert set(range(400)) <= left and not left & {i for i, *_ in foreign}  # in no learned language: far from every codeword
    kept = langid.identified_rows(frame(spark, rows + odd))
    assert kept.columns == none.columns and {900, 901, 902}.isdisjoint({r["doc_id"] for r in kept.collect()})
