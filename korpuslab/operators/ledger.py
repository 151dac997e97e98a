"""A job ledger as an append-only table of events; the state of a job is a fold over its events.

A job is a pair of utterance and engine within one run. Events that the state of a
job does not allow are ignored by the fold, and the ledger refuses to write them.
Batches are appended whole. One driver owns a run while it holds the lock.

Reading does not go through the history. After every ``FAN`` batches the jobs they touched are folded on from their last
known states into a run of states, and ``FAN`` runs of a level are merged into one of the next, newest state of each
job. The state is then the newest row over the runs, of which there are fewer than ``FAN`` a level, and a fold of the
batches since. Events stay as they are: folding them all gives the same.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuslab.errors import LedgerError
from korpuslab.schemas import LEDGER_EVENT
from korpuslab.sources.files import Store, publish_lines

STALE_AFTER = 900.0
#: Batches that are folded into a run of states, and runs of a level that are merged into one of the next.
FAN = 8
KEY = ["utterance_id", "engine"]
#: What an event needs the job to be, and what it makes of it.
TRANSITIONS = {"created": (None, "pending"), "claimed": ("pending", "running"), "succeeded": ("running", "succeeded"), "retry": ("running", "pending"), "failed": ("running", "failed"), "skipped": ("running", "skipped"), "recovered": ("running", "pending"), "reopened": ("failed", "pending")}

_STATE = "struct<status:string,retry_count:int,started_at:double,finished_at:double,error_reason:string,result_json:string,output_checksum:string,peak_vram_mb:double,job:struct<batch:bigint,seq:bigint>>"


def _step(s: Column, e: Column) -> Column:
    """The state after an event, or the same state if the event is not allowed."""
    event = e["event"]
    needs, makes = F.create_map(*(F.lit(x) for k, (a, _) in TRANSITIONS.items() for x in (k, a or "none"))), F.create_map(*(F.lit(x) for k, (_, b) in TRANSITIONS.items() for x in (k, b)))
    allowed = F.coalesce(F.try_element_at(needs, event) == F.coalesce(s["status"], F.lit("none")), F.lit(False))
    is_ = lambda *names: event.isin(*names)
    new = F.struct(
        F.try_element_at(makes, event).alias("status"),
        (s["retry_count"] + is_("retry", "failed").cast("int")).alias("retry_count"),
        F.when(is_("claimed"), e["at"]).when(is_("recovered"), F.lit(None)).otherwise(s["started_at"]).alias("started_at"),
        F.when(is_("claimed"), F.lit(None)).when(is_("succeeded", "retry", "failed", "skipped"), e["at"]).otherwise(s["finished_at"]).alias("finished_at"),
        F.when(is_("succeeded"), F.lit(None)).when(is_("retry", "failed", "skipped"), e["reason"]).when(is_("recovered"), F.lit("stale recovery")).otherwise(s["error_reason"]).alias("error_reason"),
        F.when(is_("succeeded"), e["result_json"]).when(is_("retry", "failed"), F.lit(None)).otherwise(s["result_json"]).alias("result_json"),
        F.when(is_("succeeded"), e["output_checksum"]).when(is_("retry", "failed"), F.lit(None)).otherwise(s["output_checksum"]).alias("output_checksum"),
        F.when(is_("succeeded"), e["peak_vram_mb"]).otherwise(s["peak_vram_mb"]).alias("peak_vram_mb"),
        F.coalesce(s["job"], F.struct(e["batch"], e["seq"])).alias("job"),
    ).cast(_STATE)
    return F.when(allowed, new).otherwise(s)


def _states(df: DataFrame, *more: str) -> DataFrame:
    """Columns of states alone."""
    names = [x.split(":")[0] for x in _STATE[len("struct<") : _STATE.index(",job")].split(",")]
    return df.select(*more, *names, "job")


def fold(events: DataFrame, key: list[str] = KEY, base: DataFrame | None = None) -> DataFrame:
    """One row for each job: its state after all its events in the order of ``batch``, then ``seq``.

    ``base`` holds states that the events come after, a row for each job; jobs without events keep theirs. A job's
    events are few: each is an attempt or an operator's act.
    """
    order = {"batch": 0, "seq": 1}
    layout = sorted((f for f in LEDGER_EVENT.fields if f.name not in key), key=lambda f: order.get(f.name, 2))
    fields = [F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in layout]
    gathered = events.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_events"))
    start = F.struct(F.lit(None), F.lit(0), *[F.lit(None)] * 7).cast(_STATE)
    if base is not None:
        known = _states(base, *key).select(*key, F.struct(*(c for c in _states(base).columns)).cast(_STATE).alias("_base"))
        gathered = gathered.join(known, key, "full_outer").withColumn("_events", F.coalesce("_events", F.array().cast(gathered.schema["_events"].dataType)))
        start = F.coalesce("_base", start)
    folded = gathered.withColumn("_s", F.aggregate("_events", start, _step)).where("_s.status IS NOT NULL").select(*key, "_s.*")
    return folded.withColumn("latency_ms", F.when(F.col("status") == "succeeded", (F.col("finished_at") - F.col("started_at")) * 1000))


def newest(runs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The state of each job as the newest of its rows, by ``version``, has it."""
    names = [c for c in runs.columns if c not in key]
    return runs.groupBy(*key).agg(F.max_by(F.struct(*names), "version").alias("_s")).select(*key, "_s.*")


def stale_jobs(state: DataFrame, now: float | Column, stale_after: float = STALE_AFTER) -> DataFrame:
    """Jobs that have run for longer than allowed: started strictly before the cutoff."""
    now = F.lit(now) if isinstance(now, float) else now
    return state.where((F.col("status") == "running") & (F.col("started_at") < now - stale_after))


def claimable(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending jobs in the order in which they were created: all of them, or the first ``limit``."""
    pending = state.where("status = 'pending'").orderBy("job")
    return pending if limit is None else pending.limit(limit)


class Ledger:
    """The ledger of one run in a folder on any file system that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | Path, run: str, stale_after: float = STALE_AFTER):
        self.spark, self.run, self.stale_after = spark, run, stale_after
        self.store = Store(spark, folder)
        if not self.store.create("run.json", json.dumps({"run": run})) and json.loads(self.store.read("run.json"))["run"] != run:
            raise LedgerError("the ledger belongs to another run")

    def _batches(self) -> list[str]:
        return self.store.names("events")

    def _read_events(self, after: int) -> DataFrame:
        done = [self.store.path(f"events/{name}") for name in self._batches() if int(name[6:]) > after and self.store.exists(f"events/{name}/_SUCCESS")]
        return self.spark.read.schema(LEDGER_EVENT).parquet(*done) if done else self.spark.createDataFrame([], LEDGER_EVENT)

    def events(self) -> DataFrame:
        """The whole history."""
        return self._read_events(0)

    def _manifest(self) -> dict:
        """What the newest manifest lists: the last batch that runs cover, and the runs with their levels."""
        names = self.store.names("manifests")
        return json.loads(self.store.read(f"manifests/{names[-1]}")) if names else {"number": 0, "upto": 0, "runs": [], "dropped": []}

    def _base(self, runs: list[dict]) -> DataFrame | None:
        return newest(self.spark.read.parquet(*(self.store.path(f"runs/{r['name']}") for r in runs))) if runs else None

    def state(self) -> DataFrame:
        """The state of every job, from the runs and the batches since; the plan reads no other files."""
        manifest = self._manifest()
        return fold(self._read_events(manifest["upto"]), base=self._base(manifest["runs"])).withColumn("transcription_run_id", F.lit(self.run))

    def compact(self) -> None:
        """Fold the batches since the last compaction into a run, and merge runs where a level is full.

        Runs are published by the next manifest. What it drops is deleted by the one after, so that a reader who still
        holds the last manifest finds its files.
        """
        manifest = self._manifest()
        tail, runs, last = self._read_events(manifest["upto"]), manifest["runs"], max((int(name[6:]) for name in self._batches()), default=0)
        if last == manifest["upto"]:
            return

        def write(rows: DataFrame, level: int) -> dict:
            name = f"run-{last:08d}-{level}-{uuid.uuid4().hex[:8]}"
            rows.write.parquet(self.store.path(f"runs/{name}"))
            return {"name": name, "level": level}

        base = self._base(runs)
        touched = None if base is None else base.join(tail.select(*KEY).distinct(), KEY, "left_semi")
        runs, dropped = [*runs, write(_states(fold(tail, base=touched), *KEY).withColumn("version", F.lit(last)), 0)], []
        for level in range(64):
            full = [r for r in runs if r["level"] == level]
            if len(full) < FAN:
                break
            runs, dropped = [r for r in runs if r["level"] != level] + [write(self._base(full), level + 1)], dropped + [r["name"] for r in full]
        number = manifest["number"] + 1
        self.store.create(f"manifests/manifest-{number:08d}.json", json.dumps({"number": number, "upto": last, "runs": runs, "dropped": dropped}))
        for name in manifest["dropped"]:
            self.store.delete(f"runs/{name}")

    def _append(self, rows: DataFrame, event: str | Column, now: float) -> DataFrame:
        """Write a batch of events, in order of batch and place in it; what is returned reads the written rows."""
        number = 1 + max((int(name[6:]) for name in self._batches()), default=0)
        given = {"batch": F.lit(number), "seq": F.monotonically_increasing_id(), "transcription_run_id": F.lit(self.run), "event": F.lit(event) if isinstance(event, str) else event, "at": F.lit(now)}
        columns = [(given[f.name] if f.name in given else F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER_EVENT.fields]
        path = self.store.path(f"events/batch-{number:08d}")
        rows.select(*columns).write.parquet(path)
        if number - self._manifest()["upto"] >= FAN:
            self.compact()
        return self.spark.read.schema(LEDGER_EVENT).parquet(path)

    def create(self, jobs: DataFrame, now: float | None = None) -> None:
        """Add jobs; blank or repeated keys, and keys that are there, are refused."""
        blank = " OR ".join(f"coalesce({k}, '') = ''" for k in KEY)
        if not jobs.where(blank).isEmpty():
            raise LedgerError("a job needs an utterance and an engine")
        if not jobs.groupBy(*KEY).count().where("count > 1").isEmpty() or not jobs.join(self.state().select(*KEY), KEY, "left_semi").isEmpty():
            raise LedgerError("a job is there already")
        order = ["order"] if "order" in jobs.columns else KEY
        self._append(jobs.orderBy(*order), "created", time.time() if now is None else now)  # ranges in order, so numbers are too

    def recover(self, now: float | None = None) -> int:
        """Jobs that have run for longer than allowed are pending again; their retries do not count up."""
        now = time.time() if now is None else now
        stale = stale_jobs(self.state(), float(now), self.stale_after)
        return 0 if stale.isEmpty() else self._append(stale.select(*KEY), "recovered", now).count()

    def claim(self, limit: int | None = None, now: float | None = None) -> DataFrame:
        """The oldest pending jobs, now running: all of them, or ``limit``."""
        now = time.time() if now is None else now
        self.recover(now)
        state = self.state()
        claimed = self._append(claimable(state, limit).select(*KEY), "claimed", now).select(*KEY)
        return claimed.join(state.select(*KEY, "retry_count", "job"), KEY)  # which a claim leaves as they are

    def record(self, results: DataFrame, now: float | None = None) -> DataFrame:
        """Outcomes of running jobs: KEY, event, and reason or result_json and output_checksum. Returns what was written."""
        bad = results.where("event NOT IN ('succeeded', 'retry', 'failed', 'skipped')")
        empty = results.where("event = 'succeeded' AND (trim(coalesce(get_json_object(result_json, '$.transcript'), '')) = '' OR trim(coalesce(output_checksum, '')) = '')")
        if not bad.isEmpty():
            raise LedgerError("an outcome is unknown")
        if not empty.isEmpty():
            raise LedgerError("success needs a transcript and a checksum")
        if not results.join(self.state().where("status = 'running'").select(*KEY), KEY, "left_anti").isEmpty():
            raise LedgerError("a job is not running")
        return self._append(results, F.col("event"), time.time() if now is None else now)

    def reopen_failed(self, now: float | None = None) -> None:
        failed = self.state().where("status = 'failed'").select(*KEY)
        if not failed.isEmpty():
            self._append(failed, "reopened", time.time() if now is None else now)

    def job(self, utterance: str, engine: str) -> dict | None:
        row = self.state().where((F.col("utterance_id") == utterance) & (F.col("engine") == engine)).first()
        return row and row.asDict()

    def lines(self) -> DataFrame:
        """``value``: each job as a line of JSON with its result as an object, keys sorted; dealt by ranges in the order in which jobs were created."""
        rows = self.state().withColumn("result", F.parse_json("result_json"))
        names = sorted(c for c in rows.columns if c not in ("result", "result_json"))
        line = lambda columns: F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
        text = F.when(F.col("result_json").isNull(), line(names)).otherwise(line([*names, "result"]))
        return rows.select("job", text.alias("value")).repartitionByRange("job").sortWithinPartitions("job").select("value")

    def export(self, path: str | Path) -> None:
        """All jobs as JSON lines, written in parts by executors; the parts are joined in order, block by block, and published by renaming."""
        publish_lines(self.lines(), str(path))

    def results(self, **fields: str) -> DataFrame:
        """Succeeded jobs with fields of their results: name=SQL type, read as variants. What is missing or of another kind is null."""
        rows = self.state().where("status = 'succeeded'").withColumn("_v", F.parse_json("result_json"))
        return rows.select(*KEY, *(F.try_variant_get("_v", f"$.{name}", kind).alias(name) for name, kind in fields.items()))

    def lock(self) -> None:
        if not self.store.create("run.lock", str(time.time())):
            raise LedgerError("another owner has the run")

    def unlock(self) -> None:
        self.store.delete("run.lock")
