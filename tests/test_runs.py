"""The ledger, transcription rounds, the gate, evidence, the stream and every registered query."""

import hashlib
import json
import math
import sys
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from korpuslab.errors import LedgerError, ProtocolError
from korpuslab.operators import evidence
from korpuslab.operators import transcription as tr
from korpuslab.operators.ledger import Ledger, fold
from korpuslab.plans import registry
from korpuslab.schemas import LEDGER_EVENT, REQUEST
from korpuslab.streaming import ledger_stream
from tests.conftest import SF


def jobs(spark, *names):
    return spark.createDataFrame([(n, "fake") for n in names], "utterance_id string, engine string")


def done(spark, *rows):
    return spark.createDataFrame(rows, "utterance_id string, engine string, event string, reason string, result_json string, output_checksum string")


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, tmp_path / "l", "run-1")
    ledger.create(jobs(spark, "a", "b", "c"), now=10.0)
    for bad in (jobs(spark, "a"), jobs(spark, "d", "d"), jobs(spark, "")):
        with pytest.raises(LedgerError):
            ledger.create(bad)
    with pytest.raises(LedgerError, match="not running"):
        ledger.record(done(spark, ("a", "fake", "failed", "x", None, None)))
    assert [r["utterance_id"] for r in ledger.claim(2, now=20.0).orderBy("job").collect()] == ["a", "b"]
    for bad in (("a", "fake", "succeeded", None, '{"transcript": " "}', "sha256:x"), ("a", "fake", "succeeded", None, '{"transcript": "t"}', ""), ("a", "fake", "lost", None, None, None)):
        with pytest.raises(LedgerError):
            ledger.record(done(spark, bad))
    ledger.record(done(spark, ("a", "fake", "succeeded", None, '{"transcript": "ü"}', "sha256:x"), ("b", "fake", "retry", "transient_failure", None, None)), now=21.5)
    job = ledger.job("a", "fake")
    assert (job["status"], job["latency_ms"], job["retry_count"], job["error_reason"]) == ("succeeded", 1500.0, 0, None)
    assert (ledger.job("b", "fake")["status"], ledger.job("b", "fake")["retry_count"]) == ("pending", 1) and ledger.job("zz", "fake") is None
    ledger.claim(1, now=30.0)
    assert ledger.recover(now=30.0 + 900) == 0 and ledger.recover(now=30.1 + 900) == 1
    assert ledger.job("b", "fake")["error_reason"] == "stale recovery" and ledger.job("b", "fake")["retry_count"] == 1
    ledger.export(tmp_path / "out.jsonl")
    rows = [json.loads(x) for x in (tmp_path / "out.jsonl").read_text().splitlines()]
    assert [r["utterance_id"] for r in rows] == ["a", "b", "c"] and rows[0]["result"] == {"transcript": "ü"} and "result_json" not in rows[0]
    again = Ledger(spark, tmp_path / "l", "run-1")
    assert again.state().count() == 3
    with pytest.raises(LedgerError, match="another run"):
        Ledger(spark, tmp_path / "l", "run-2")
    again.lock()
    with pytest.raises(LedgerError):
        ledger.lock()
    again.unlock()
    again.unlock()


def test_ledger_keeps_the_order_of_many_partitions(spark, tmp_path):
    ledger = Ledger(spark, tmp_path / "l", "run-1")
    wanted = spark.range(400, numPartitions=200).selectExpr("lpad(id, 4, '0') AS utterance_id", "'fake' AS engine")
    ledger.create(wanted, now=1.0)
    ledger._append(ledger.state().select("utterance_id", "engine").repartition(200), "claimed", 2.0)
    ledger.record(ledger.state().select("utterance_id", "engine", F.lit("succeeded").alias("event"), F.lit('{"transcript": "t"}').alias("result_json"), F.lit("sha256:x").alias("output_checksum")).repartition(200), now=3.0)
    assert [(r["status"], r["count"]) for r in ledger.state().groupBy("status").count().collect()] == [("succeeded", 400)]
    ledger.export(tmp_path / "out.jsonl")
    assert [json.loads(x)["utterance_id"] for x in (tmp_path / "out.jsonl").read_text().splitlines()] == [f"{i:04d}" for i in range(400)]


def test_fold_ignores_what_is_not_allowed(spark):
    events = [(1, "succeeded"), (2, "created"), (3, "created"), (4, "skipped"), (5, "claimed"), (6, "failed"), (7, "claimed"), (8, "nonsense")]
    df = spark.createDataFrame([(s, "r", "u", "e", n, float(s), None, None, None, None, 1) for s, n in events], LEDGER_EVENT)
    row = fold(df).first()
    assert (row["status"], row["retry_count"], row["started_at"], row["finished_at"]) == ("failed", 1, 5.0, 6.0)
    assert fold(df.where("seq < 2")).count() == 0


def requests(spark, tmp_path, n, missing=()):
    for i in range(n):
        if i not in missing:
            (tmp_path / f"{i}.wav").write_bytes(b"x")
    return spark.createDataFrame([(tr.PROTOCOL, "tr-1", f"u{i:02d}", "fake", str(tmp_path / f"{i}.wav"), "out", "r", {"language": "tr"}) for i in range(n)], REQUEST)


def flaky(folder):
    """An adapter that fails once for each request in a way that may pass, and raises for one of them.

    Made in a function, so that workers get it by value.
    """

    class Flaky:
        def capabilities(self):
            return tr.FakeAdapter().capabilities()

        def transcribe(self, request):
            if request["utterance_id"] == "u00":
                raise RuntimeError("broken")
            mark = folder / request["utterance_id"]
            if not mark.exists():
                mark.write_text("")
                return tr.outcome(request, "failed", error_reason="transient_failure")
            return tr.FakeAdapter().transcribe(request)

    return Flaky()


def test_transcription_resumes(spark, tmp_path):
    ledger, wanted = Ledger(spark, tmp_path / "l", "tr-1"), requests(spark, tmp_path, 3)
    assert tr.transcribe(tr.FakeAdapter(), wanted, ledger) == tr.TranscriptionSummary(3, 3, 0, 0, 0, 0)
    assert tr.transcribe(tr.FakeAdapter(), wanted, ledger) == tr.TranscriptionSummary(3, 0, 0, 0, 3, 0)
    more = requests(spark, tmp_path, 5, missing=(4,))
    assert tr.transcribe(tr.FakeAdapter(), more, ledger) == tr.TranscriptionSummary(5, 1, 1, 0, 3, 0)
    assert ledger.job("u04", "fake")["error_reason"] == "missing_audio"
    assert tr.transcribe(tr.FakeAdapter(), more, ledger).failed == 0
    (tmp_path / "4.wav").write_bytes(b"x")
    assert tr.transcribe(tr.FakeAdapter(), more, ledger, retry_failed=True).succeeded == 1
    with pytest.raises(ValueError):
        tr.transcribe(tr.FakeAdapter(), more, ledger, max_attempts=0)


def test_transcription_retries(spark, tmp_path):
    ledger = Ledger(spark, tmp_path / "l", "tr-1")
    (tmp_path / "marks").mkdir()
    got = tr.transcribe(flaky(tmp_path / "marks"), requests(spark, tmp_path, 3), ledger, max_attempts=2)
    assert got == tr.TranscriptionSummary(3, 2, 1, 0, 0, 2)
    assert ledger.job("u00", "fake")["error_reason"] == "adapter_exception:RuntimeError"


def test_adapter_forms_agree(spark, tmp_path):
    wanted = requests(spark, tmp_path, 4, missing=(2,)).withColumn("decoding", F.when(F.col("utterance_id") == "u03", F.create_map(F.lit("official_context"), F.lit("yes"))).otherwise(F.col("decoding")))
    for failure in (None, *tr.FAILURES):
        one = tr.run_adapter(tr.FakeAdapter(failure=failure), wanted)
        two = tr.fake_results(wanted, F.col("utterance_id") != "u02", failure)
        assert sorted(map(tuple, one.select(two.columns).collect())) == sorted(map(tuple, two.collect()))
        tr.require(tr.result_violations(one))


def test_protocol(spark, tmp_path):
    good = tr.to_json(requests(spark, tmp_path, 2))
    assert tr.requests_from_json(good, "json").count() == 2
    for bad in ('{"protocol_version": "old"}', "no json"):
        with pytest.raises(ProtocolError):
            tr.requests_from_json(spark.createDataFrame([(bad,)], "json string"), "json")
    with pytest.raises(ProtocolError, match="transcript"):
        tr.results_from_json(spark.createDataFrame([(json.dumps({"protocol_version": tr.PROTOCOL, "status": "succeeded", "utterance_id": "u", "transcript": " "}),)], "json string"), "json")


def test_gate(spark, tmp_path):
    gate = tr.resource_gate(tr.FakeAdapter(), requests(spark, tmp_path, 30), "utterance_id")
    assert (gate.status, gate.clip_count, gate.succeeded, gate.coverage, gate.reason) == ("allowed", 25, 25, 1.0, None) and gate.throughput_clips_per_second > 0 and gate.to_dict()["schema_version"] == tr.GATE_SCHEMA
    bad = tr.resource_gate(tr.FakeAdapter(failure="oom"), requests(spark, tmp_path, 3), "utterance_id")
    assert (bad.status, bad.failed, bad.projected_duration_seconds, bad.reason) == ("incomplete_resource", 3, None, "coverage_below_threshold")


def test_evidence(spark):
    weights = spark.range(20000).select(evidence.poisson_weight(F.concat(F.lit("s"), F.col("id").cast("string"))).alias("w")).groupBy("w").count().collect()
    share = {r["w"]: r["count"] / 20000 for r in weights}
    assert all(abs(share.get(k, 0) - math.exp(-1) / math.factorial(k)) < 0.015 for k in range(5))
    df = spark.range(4000).select("id", (F.col("id") % 10 < 8).alias("same"))
    kept = evidence.rebalance_identity(df, F.col("same"), "id", 0.25).groupBy("same").count().collect()
    n = {r["same"]: r["count"] for r in kept}
    assert n[False] == 800 and abs(n[True] / (n[True] + n[False]) - 0.25) < 0.03
    low_high = evidence.interval(spark.createDataFrame([(float(i),) for i in range(101)], "difference double")).first()
    assert (low_high["low"], low_high["high"]) == pytest.approx((2.5, 97.5))


def test_stream(spark, narrow, tmp_path):
    events = [("a", "e", 1, "created"), ("a", "e", 2, "claimed"), ("b", "e", 3, "claimed"), ("a", "e", 4, "retry"), ("a", "e", 5, "claimed"), ("a", "e", 6, "succeeded"), ("b", "e", 7, "created")]
    schema = "utterance_id string, engine string, seq bigint, event string"
    last, seen = {}, []
    for k, part in enumerate((events[:3], events[3:])):  # two runs over one checkpoint: the state goes on
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        query = ledger_stream.stream_states(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start()
        try:
            assert query.awaitTermination(240)
        finally:
            query.stop()
    for r in seen:
        last[r["utterance_id"]] = (r["events"], r["status"], r["retry_count"])
    assert last["a"][1:] == ("succeeded", 1) and last["b"][1] == "pending"
    assert ledger_stream.advance("running", 0, "recovered") == ("pending", 0)


@pytest.fixture
def narrow(spark):
    """One partition of state: each partition of a micro-batch starts a worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run_stream(stream, tmp_path, seen, until):
    """Until ``until`` says so of the query; timers keep a stream with nothing to read going, so it is stopped."""
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 120
        while not until(query):
            assert query.isActive and time.time() < end, query.exception()
            time.sleep(0.2)
    finally:
        query.stop()


def has_read(rows):
    return lambda query: sum(p["numInputRows"] for p in query.recentProgress) >= rows


def test_stream_is_the_fold_of_a_ledger_s_own_files(spark, narrow, tmp_path):
    """Batches written by a ledger come in another order and one file at a time; the stream starts from states in the middle."""
    ledger = Ledger(spark, tmp_path / "l", "run-1")
    ledger.create(jobs(spark, *"abcdef").repartition(3), now=1.0)
    ledger.claim(5, now=2.0)
    middle = [r.asDict() for r in ledger.state().select("utterance_id", "engine", "status", "retry_count").collect()]
    ledger.record(done(spark, ("a", "fake", "retry", "transient_failure", None, None), ("b", "fake", "failed", "x", None, None), ("c", "fake", "succeeded", None, '{"transcript": "t"}', "sha256:x")), now=3.0)
    ledger.claim(now=4.0)
    ledger.record(done(spark, ("a", "fake", "failed", "y", None, None), ("f", "fake", "skipped", "z", None, None)), now=5.0)
    ledger.reopen_failed(now=6.0)
    events = ledger.events().select("utterance_id", "engine", "batch", "seq", "event")
    rows = sorted(map(tuple, events.collect()), key=lambda r: hash((r[0], r[3], r[4], 7)) % 1009)
    schema = events.schema
    want = {r["utterance_id"]: (r["status"], r["retry_count"]) for r in ledger.state().collect()}
    for case, initial, upto in (("all", None, 0), ("middle", spark.createDataFrame(middle, "utterance_id string, engine string, status string, retry_count int"), 2)):
        at, seen = tmp_path / case, []
        for k in range(0, len(rows), 8):
            spark.createDataFrame(rows[k : k + 8], schema).coalesce(1).write.json(str(at / f"in/{k:03d}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(at / "in"))
        run_stream(ledger_stream.stream_states(stream, initial=initial, upto=upto), at, seen, has_read(len(rows)))
        got = {r["utterance_id"]: (r["status"], r["retry_count"]) for r in middle} if initial is not None else {}
        for r in seen:
            got[r["utterance_id"]] = (r["status"], r["retry_count"])
        assert got == want


def test_stream_order_is_by_batch_first(spark, narrow, tmp_path):
    rows = [("u", "e", 2, 0, "claimed"), ("u", "e", 1, 5 << 33, "created")]
    spark.createDataFrame(rows, "utterance_id string, engine string, batch bigint, seq bigint, event string").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    run_stream(ledger_stream.stream_states(spark.readStream.schema("utterance_id string, engine string, batch bigint, seq bigint, event string").json(str(tmp_path / "in"))), tmp_path, seen, has_read(2))
    assert [(r["status"], r["events"]) for r in seen] == [("running", 2)]


def test_stream_takes_back_what_runs_too_long(spark, narrow, tmp_path):
    rows = [("u", "e", 1, 1, "created"), ("u", "e", 1, 2, "claimed")]
    spark.createDataFrame(rows, "utterance_id string, engine string, batch bigint, seq bigint, event string").coalesce(1).write.json(str(tmp_path / "in"))
    seen = []
    run_stream(ledger_stream.stream_states(spark.readStream.schema("utterance_id string, engine string, batch bigint, seq bigint, event string").json(str(tmp_path / "in")), stale_after=0.5), tmp_path, seen, lambda _: len(seen) > 1)
    assert [r["status"] for r in seen][:2] == ["running", "pending"] and {r["retry_count"] for r in seen} == {0}


def test_ledger_reads_runs_and_the_tail(spark, tmp_path, monkeypatch):
    """After many batches: few batches and few runs of each level are read, and states are those of the whole history."""
    monkeypatch.setattr("korpuslab.operators.ledger.FAN", 3)
    ledger = Ledger(spark, tmp_path / "l", "run-1")
    ledger.create(jobs(spark, *"abcdefgh"), now=1.0)
    for k in range(6):
        claimed = [r["utterance_id"] for r in ledger.claim(2, now=10.0 * k).collect()]
        outcomes = [(u, "fake", ("retry", "failed", "succeeded")[(i + k) % 3], "transient_failure", '{"transcript": "t", "n": %d}' % k, "sha256:x") for i, u in enumerate(claimed)]
        ledger.record(done(spark, *outcomes), now=10.0 * k + 5)
        names = ledger.state().inputFiles()
        batches = {n.split("/events/")[1].split("/")[0] for n in names if "/events/" in n}
        runs = {n.split("/runs/")[1].split("/")[0] for n in names if "/runs/" in n}
        assert len(batches) < 3 and all(sum(f"-{level}-" in r for r in runs) < 3 for level in range(4))
    assert len(ledger.store.names("events")) == 13
    columns = ["utterance_id", "engine", "status", "retry_count", "started_at", "finished_at", "error_reason", "result_json", "output_checksum", "latency_ms", "job"]
    assert sorted(ledger.state().select(columns).collect()) == sorted(fold(ledger.events()).select(columns).collect())
    again = Ledger(spark, tmp_path / "l", "run-1")
    assert again.state().count() == 8 and len(again.store.names("runs")) <= 9
    with pytest.raises(LedgerError):
        again.create(jobs(spark, "a"))
    results = {r["utterance_id"]: (r["transcript"], r["n"], r["lost"]) for r in again.results(transcript="string", n="int", lost="double").collect()}
    assert results and all(v[0] == "t" and isinstance(v[1], int) and v[2] is None for v in results.values())
    again.export(tmp_path / "out.jsonl")
    lines = (tmp_path / "out.jsonl").read_text()
    assert lines == "".join(r["value"] + "\n" for r in again.lines().collect()) and [json.loads(x)["utterance_id"] for x in lines.splitlines()] == list("abcdefgh")
    assert all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines.splitlines()) and sorted(p.name for p in tmp_path.iterdir() if "out" in p.name and not p.name.endswith(".crc")) == ["out.jsonl"]


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:10", "created"), ("2026-01-01 00:04:00", "created"), ("2026-01-01 00:06:00", "created")], "t string, event string").withColumn("at", F.to_timestamp("t"))
    assert sorted(r["n"] for r in ledger_stream.windowed_counts(df, "at").collect()) == [1, 2]


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9, 1.0])
def test_rebalancing_is_exact(spark, share):
    df = spark.range(900).select("id", (F.col("id") % 10 < 8).alias("same"))
    kept = evidence.rebalance_identity(df, F.col("same"), "id", share, 3).collect()
    order = sorted((hashlib.sha256(f"3|{i}".encode()).hexdigest(), i) for i in range(900) if i % 10 < 8)
    want = len(order) if share == 1 else min(len(order), int(share / (1 - share) * 180))
    assert sorted(r["id"] for r in kept if r["same"]) == sorted(i for _, i in order[:want]) and sum(not r["same"] for r in kept) == 180


def test_kth_digest(spark):
    digests = sorted(hashlib.sha256(str(i // 2).encode()).hexdigest() for i in range(300)) + ["f" * 64] * 50
    df = spark.createDataFrame([(d,) for d in digests], "d string")
    for digits in (1, 4):
        assert [evidence.kth_digest(df, "d", k, digits) for k in (1, 2, 3, 150, 300, 301, 350, 351)] == [digests[k - 1] if k <= 350 else None for k in (1, 2, 3, 150, 300, 301, 350, 351)]


def test_crossed_slices(spark):
    df = spark.createDataFrame([("a", "x", 1, 10), ("a", "y", 0, 0), ("b", "x", 3, 0), (None, "x", 2, 4)], "p string, q string, e long, n long")
    rows = {(r["p"], r["q"], r["grouping"]): (r["pairs"], r["edits"], r["words"], r["macro_wer"], r["micro_wer"]) for r in evidence.crossed(df, [["p"], ["p", "q"], []], "e", "n").collect()}
    assert rows[None, None, 3] == (4, 6, 14, pytest.approx((0.1 + 0 + 1 + 0.5) / 4), pytest.approx(6 / 14))
    assert rows["a", None, 1] == (2, 1, 10, 0.05, 0.1) and rows[None, None, 1] == (1, 2, 4, 0.5, 0.5) and rows["b", "x", 0][4] == 1.0 and len(rows) == 8


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    value = lambda v: round(float(v), 9) if isinstance(v, float) else int(v) if isinstance(v, bool) or hasattr(v, "__index__") else v
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_duckdb(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in "nation customer part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(got.fetchall(), names)


def test_wer_by_lang_against_brute_force(spark):
    from tests.test_functions import brute_script, brute_wer

    sums = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").collect():
        toks = brute_wer(r["text"]).split()
        hyp = [y for i, x in enumerate(toks) for y in ([] if (i + r["doc_id"]) % 11 == 0 else ["zzz"] if (i + r["doc_id"]) % 13 == 0 else [x, x] if (i + r["doc_id"]) % 17 == 0 else [x])]
        script = brute_script(toks, hyp)
        old = sums.get(r["lang"], (0, 0, 0, 0, 0))
        sums[r["lang"]] = tuple(a + b for a, b in zip(old, (1, script.count(3), script.count(2), script.count(1), len(toks)), strict=True))
    few = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    original, registry.table = registry.table, lambda s, d, n: few
    try:
        got = registry.wer_by_lang(spark, SF).collect()
    finally:
        registry.table = original
    assert {r["lang"]: tuple(r)[1:6] for r in got} == sums


def test_entry_without_the_corpus_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "korpuslab.llm", None)
    for name in ("korpuslab.llm.registry", "corpus_pipeline"):
        monkeypatch.delitem(sys.modules, name, raising=False)
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert __spark_entry__.oracle_sql() == registry.ORACLE_SQL


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
