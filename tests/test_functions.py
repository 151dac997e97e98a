"""Text functions, edit scripts and scores."""

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korpuslab.functions import edit, text
from korpuslab.operators import scoring
from korpuslab.plans import registry
from korpuslab.session import register
from tests.conftest import SF


def brute_normalize(t):
    t = unicodedata.normalize("NFKC", t)
    for a, b in zip("’‘–—‐\u00a0Iİ", ["'", "'", "-", "-", "-", " ", "ı", "i"], strict=True):
        t = t.replace(a, b)
    return " ".join(t.lower().split())


def brute_wer(t):
    return " ".join("".join(" " if c in ',;:!?()[]{}"“”…' else c for c in brute_normalize(t)).split())


GOLDEN = [(" IĞDIR   İSTANBUL I ", "ığdır istanbul ı"), ("PyTorch’tA,  Hugging Face!", "pytorch'ta, hugging face!"), ("QWEN3.5-v2  1,25", "qwen3.5-v2 1,25"), ("AI", "aı"), ("I\u0307", "i"), ("", ""), ("a\u00a0b\x1cc\u2003d", "a b c d")]


def test_normalisation(spark):
    odd = ["".join(random.Random(k).choice("aIİıi ’–\u00a0éﬁ①Å\u0301\x85 \tÇß.,!?“”…\u2009") for _ in range(30)) for k in range(200)]
    texts = [a for a, _ in GOLDEN] + odd + ["Merhaba, dünya! Qwen3.5-v2"]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "k int, t string").select("k", text.normalize_tr("t").alias("n"), text.normalize_tr_for_wer("t").alias("w")).collect()
    got = {r["k"]: (r["n"], r["w"]) for r in rows}
    assert [got[k][0] for k in range(len(GOLDEN))] == [b for _, b in GOLDEN]
    assert all(got[k] == (brute_normalize(t), brute_wer(t)) for k, t in enumerate(texts))
    assert got[len(texts) - 1][1] == "merhaba dünya qwen3.5-v2" and got[-1] == (None, None)


def test_small_functions(spark):
    df = spark.createDataFrame([(" Yes ", "clips/a.b.wav"), ("1", ".x"), ("no", "C:\\x"), (None, None)], "b string, p string")
    rows = df.select(text.parse_bool("b").alias("b"), text.stem("p").alias("s"), text.is_absolute_path("p").alias("a"), text.fold_plain(F.lit(" STRASSE  ẞ ")).alias("f")).collect()
    assert [r["b"] for r in rows] == [True, True, False, False]
    assert [r["s"] for r in rows] == ["a.b", ".x", "C:\\x", None]
    assert [r["a"] for r in rows] == [False, False, True, False]
    assert rows[0]["f"] == "strasse ss"


def brute_script(r, h):
    """The least script in the order equal, substitute, delete, insert, by recursion over suffixes."""
    cost = [[0] * (len(h) + 1) for _ in range(len(r) + 1)]
    for i in range(len(r), -1, -1):
        for j in range(len(h), -1, -1):
            if i == len(r) or j == len(h):
                cost[i][j] = len(r) - i + len(h) - j
            else:
                cost[i][j] = min(cost[i + 1][j + 1] + (r[i] != h[j]), cost[i + 1][j] + 1, cost[i][j + 1] + 1)
    i = j = 0
    out = []
    while i < len(r) or j < len(h):
        if i < len(r) and j < len(h) and r[i] == h[j]:
            out, i, j = [*out, 0], i + 1, j + 1
        elif i < len(r) and j < len(h) and cost[i][j] == cost[i + 1][j + 1] + 1:
            out, i, j = [*out, 1], i + 1, j + 1
        elif i < len(r) and cost[i][j] == cost[i + 1][j] + 1:
            out, i = [*out, 2], i + 1
        else:
            out, j = [*out, 3], j + 1
    return out


@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_alignment(pairs):
    steps = edit.align([r for r, _ in pairs], [h for _, h in pairs])
    want = [brute_script(r, h) for r, h in pairs]
    assert [[int(x) for x in s if x >= 0] for s in steps] == want
    assert edit.count([r for r, _ in pairs], [h for _, h in pairs]).tolist() == [[w.count(3), w.count(2), w.count(1)] for w in want]


@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_alignment_by_bits(r, h):
    want = brute_script(r, h)
    assert list(edit.walk(r, h)) == want
    assert edit.distance(r, h) == edit.distance("".join(r), "".join(h)) == sum(x > 0 for x in want)


def test_long_alignment_is_the_table_s():
    rng = random.Random(3)
    r = [rng.choice("abcdefgh") for _ in range(700)]
    h = [y for x in r for y in ([x], [], [x, x], ["z"])[rng.choices(range(4), (9, 1, 1, 1))[0]]]
    steps = edit.walk(r, h)
    assert list(steps) == [int(x) for x in edit.align([r], [h])[0] if x >= 0]
    assert edit.count([r], [h]).tolist() == [[steps.count(3), steps.count(2), steps.count(1)]]


def test_alignment_of_whole_books_is_bounded(monkeypatch):
    """20,000 tokens against 18,000, nearly all distinct: a table would take 1.4 GB; masks kept or made anew, the script is one."""
    rng = random.Random(4)
    r = [f"w{rng.randrange(15_000)}" for _ in range(20_000)]
    h = [x for x in r if rng.random() > 0.1]
    tracemalloc.start()
    steps = edit.walk(r, h)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert edit.distance(r, h) == sum(x > 0 for x in steps) == 20_000 - len(h)
    kept = edit.walk(r[:3000], h[:2500])
    monkeypatch.setattr(edit, "MASKS", 0)
    assert edit.walk(r[:3000], h[:2500]) == kept
    i = j = 0
    for step in steps:
        assert step or r[i] == h[j]
        i, j = i + (step != 3), j + (step != 2)
    assert (i, j) == (len(r), len(h))


CASES = [("a b c", "a x c d", (1, 0, 1)), ("", "bir iki", (2, 0, 0)), ("a b", "b", (0, 1, 0)), ("a a b", "a b", (0, 1, 0)), ("b", "a b", (1, 0, 0)), ("", "", (0, 0, 0))]


def test_long_pairs_in_columns(spark):
    """Pairs on either side of the bound, in one batch."""
    rng = random.Random(5)
    pairs = []
    for k, n in enumerate([3, 150, 230, 400, 0, 600]):
        r = [rng.choice("abcde") for _ in range(n)]
        pairs.append((k, r, [x for x in r if rng.random() > 0.2] + ["x"] * k))
    df = spark.createDataFrame(pairs, "k int, r array<string>, h array<string>").coalesce(1)
    out = df.select("k", edit.edit_counts(F.col("r"), F.col("h")).alias("c"), edit.edit_script(F.col("r"), F.col("h")).alias("s"), edit.char_distance(F.array_join("r", ""), F.array_join("h", "")).alias("d"), F.levenshtein(F.array_join("r", ""), F.array_join("h", "")).alias("want")).collect()
    for row in out:
        _, r, h = pairs[row["k"]]
        want = brute_script(r, h)
        assert [edit.OPERATIONS.index(o["operation"]) for o in row["s"]] == want
        assert tuple(row["c"]) == (want.count(3), want.count(2), want.count(1)) and row["d"] == row["want"] == sum(x > 0 for x in want)


def test_plans_name_inputs_once(spark):
    """Scoring raw and normalised texts of texts made by normalising: plans grow with what is asked, not with its depth."""
    df = spark.createDataFrame([("a", "b")], "r string, h string")
    for _ in range(3):
        df = df.select(text.normalize_tr_for_wer("r").alias("r"), F.array_join(text.tokens(text.normalize_tr_for_wer("h")), " ").alias("h"))
    plan = scoring.micro(scoring.score_text(df, "r", "h"), [])._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 60_000
    queries = registry.QUERIES
    for name in ("wer_cer_by_role", "sliced_rates", "wer_buckets", "macro_by_turn"):
        assert len(queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()) < 60_000


def test_edit_columns(spark, monkeypatch):
    monkeypatch.setattr(edit, "CELLS", 30)
    monkeypatch.setattr(edit, "ROW_CELLS", 9)
    df = spark.createDataFrame([(k, a.split(), b.split()) for k, (a, b, _) in enumerate(CASES)] + [(99, None, ["x"])], "k int, r array<string>, h array<string>")
    rows = df.select("k", edit.edit_counts(F.col("r"), F.col("h")).alias("c"), edit.edit_script(F.col("r"), F.col("h")).alias("s")).withColumn("d", edit.script_counts(F.col("s"))).collect()
    got = {r["k"]: tuple(r["c"]) for r in rows}
    assert [got[k] for k in range(len(CASES))] == [c for *_, c in CASES] and got[99] == (1, 0, 0)
    assert all(tuple(r["c"]) == tuple(r["d"]) for r in rows)
    first = [tuple(o) for o in next(r["s"] for r in rows if r["k"] == 0)]
    assert first == [("equal", "a", "a", 0, 0), ("substitute", "b", "x", 1, 1), ("equal", "c", "c", 2, 2), ("insert", None, "d", 3, 3)]


def test_scores(spark):
    df = spark.createDataFrame([("a b c", "a x c d"), ("", ""), ("", "x"), ("dünya.", "dünya"), ("AI", "ai"), (None, "x y")], "r string, h string")
    rows = scoring.score_text(df, "r", "h").collect()
    assert rows[0]["raw"]["wer"] == rows[0]["normalized"]["wer"] == pytest.approx(2 / 3) and rows[0]["raw"]["cer"] > 0
    assert [r["normalized"]["wer"] for r in rows[1:]] == [0.0, 1.0, 1.0, 1.0, 1.0]
    total = scoring.micro(scoring.score_text(df, "r", "h"), []).first()
    assert total["pairs"] == 6 and total["word_edits"] == 2 + 0 + 1 + 1 + 1 + 2 and total["reference_words"] == 5


def test_before_after(spark):
    rows = [("Merhaba dünya", "Merhaba, dünya", "Merhaba dünya", "orthographic_only"), ("PyTorch ile eğitim", "başka eğitim", "PyTorch ile eğitim", "improved"), ("PyTorch ile eğitim", "PyTorch ile eğitim", "başka eğitim", "damaged"), ("a b", "c d", "c b", "unchanged"), ("a", "a", "a", "unchanged"), ("a b", "a, b", "a, b", "orthographic_only")]
    df = spark.createDataFrame(rows, "r string, b string, a string, want string")
    assert df.where(scoring.classify_before_after(F.col("r"), F.col("b"), F.col("a")) != F.col("want")).count() == 0


def test_buckets_and_substitutions(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.051,), (0.3,), (1.5,)], "w double").select(scoring.wer_bucket(F.col("w")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["identity", "up_to_5", "5_to_15", "15_to_30", "over_30"]
    pairs = spark.createDataFrame([("a b c".split(), "a x c".split()), ("b".split(), "x".split()), ("b".split(), "y".split())], "r array<string>, h array<string>")
    assert [tuple(r) for r in scoring.substitutions(pairs, "r", "h", 5).collect()] == [("b", "x", 2), ("b", "y", 1)]


def test_results_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"a b {i}", f"a {i} c") for i in range(40)], "r string, h string")
    one = scoring.micro(scoring.score_text(df.coalesce(1), "r", "h"), []).first()
    assert scoring.micro(scoring.score_text(df.repartition(7), "r", "h"), []).first() == one


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT nfkc('ﬁ') AS a, edit_counts(array('a'), array('b')).substitutions AS b, collapse_space(' x  y ') AS c, speaker_pseudonym('v1', 'c') AS d").first()
    assert (row["a"], row["b"], row["c"]) == ("fi", 1, "x y") and row["d"].startswith("spk-") and len(row["d"]) == 20


def test_sql_text_functions_are_the_columns(spark):
    """Every function under its SQL name against the column form, over texts of a view."""
    register(spark)
    texts = [" IĞDIR   İSTANBUL I ", "PyTorch’tA,  Hugging Face!", "ﬁne\u00a0x\u2003y", "a'b \\ \"q\" “z”…", "", None, "e\u0301 (x); [y] {z}?"]
    df = spark.createDataFrame([(k, t, texts[k - 1], texts[k - 2]) for k, t in enumerate(texts)], "k int, t string, b string, a string")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT k, normalize_tr(t) AS n, normalize_tr_for_wer(t) AS w, wer_tokens(t) AS s, classify_before_after(t, b, a) AS c, char_distance(t, b) AS d FROM sql_texts")
    want = df.select("k", text.normalize_tr("t").alias("n"), text.normalize_tr_for_wer("t").alias("w"), text.tokens(text.normalize_tr_for_wer("t")).alias("s"), scoring.classify_before_after(F.col("t"), F.col("b"), F.col("a")).alias("c"), edit.char_distance(F.col("t"), F.col("b")).alias("d"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert [brute_normalize(t) for t in texts if t is not None] == [r["n"] for r in sorted(got.collect()) if r["n"] is not None]


def test_edit_steps_in_lateral_joins(spark):
    register(spark)
    spark.createDataFrame([(k, a.split(), b.split()) for k, (a, b, _) in enumerate(CASES)] + [(99, None, ["x"])], "k int, r array<string>, h array<string>").createOrReplaceTempView("step_pairs")
    steps = spark.sql("SELECT k, s.* FROM step_pairs, LATERAL edit_steps(r, h) s")
    script = spark.table("step_pairs").select("k", F.posexplode(edit.edit_script(F.col("r"), F.col("h"))).alias("place", "o")).select("k", "place", "o.*")
    assert sorted(map(tuple, steps.collect()), key=repr) == sorted(map(tuple, script.collect()), key=repr) and steps.where("k = 99").count() == 1


def noisy(rng: random.Random, n: int, values: int, share: float) -> tuple[list[int], list[int]]:
    r = [rng.randrange(values) for _ in range(n)]
    return r, [y for x in r for y in ([x], [], [x, rng.randrange(values)], [values])[rng.choices(range(4), (1 - share, share / 3, share / 3, share / 3))[0]]]


def test_bands_give_the_scripts_of_whole_tables(monkeypatch):
    """Few and many edits, ends cut off, lengths on either side of a word of 64: in bands of several pairs, and one pair at a time."""
    rng = random.Random(6)
    pairs = [noisy(rng, n, values, share) for n in (1, 63, 64, 65, 300, 700) for values in (2, 30, 9000) for share in (0.02, 0.2, 0.7)]
    pairs = [(r, h[len(h) // 7 :] if k % 5 == 0 else h) for k, (r, h) in enumerate(pairs)]
    want = [bytes(edit.walk(r, h)) for r, h in pairs]
    texts = [tuple("".join(chr(300 + x) for x in side) for side in pair) for pair in pairs]
    for worth in (True, False):
        monkeypatch.setattr(edit, "_worth", lambda *a, worth=worth: worth)
        assert [bytes(x.tolist()) for x in edit.walks([np.array(r) for r, _ in pairs], [np.array(h) for _, h in pairs])] == want
        assert edit.distances(texts).tolist() == [len(w) - w.count(0) for w in want]


def test_scripts_leave_a_batch_in_pieces(monkeypatch):
    """One Arrow batch, bounded pieces: what is held does not grow with the rows of a batch."""
    monkeypatch.setattr(edit, "STEPS_OUT", 500)
    rng = random.Random(7)
    rows = [*(noisy(rng, rng.randrange(400), 20, 0.2) for _ in range(40)), ([], []), noisy(rng, 900, 20, 0.2)]
    r, h = ([[f"w{x}" for x in pair[k]] for pair in rows] for k in (0, 1))
    pieces = list(edit.scripts(pa.array([None, *r]), pa.array([["x"], *h])))
    assert len(pieces) > 10 and all(len(p.flatten()) <= 500 or len(p) == 1 for p in pieces)
    got = [x for p in pieces for x in p.to_pylist()]
    assert got == [edit._steps(edit.walk(a, b), a, b) for a, b in zip([[], *r], [["x"], *h], strict=True)]


def test_texts_to_align_are_dealt_by_bytes(spark):
    """A split may hold 32 times what one task aligns."""
    scan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64MB")
    try:
        assert registry.spread(scan, registry.ALIGNED).rdd.getNumPartitions() == 16 * scan.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
