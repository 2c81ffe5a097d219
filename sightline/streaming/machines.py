"""State machines in event time: what a key's rows do depends on their own times and not on how files, batches and tasks deliver them.

A key's rows wait in the state, in buckets of time, until the watermark has passed their bucket; then they are taken in order of time and id.
Deadlines that a machine sets fall due between rows, in the same order, whether or not another row comes. Keys are dealt over SHARDS entries of
the state, as a call for each key costs far more than its few rows do: a bucket of a shard is one entry of the
state and is written and read by itself, so a batch is taken as the pieces it comes in, and no more than the rows between a shard's oldest
open bucket and the watermark wait. The states of a shard's keys are one entry too. Rows that come later than the watermark allows are dropped by Spark, which counts them. What is newer
than the watermark stays in the state; run_to_end closes a stream of a given table, so that nothing stays.

Rows of a null time never pass a watermark and are dropped. Keys may be null, a null id is 0. Repeated rows are taken as often as they come; rows of one
time and id are taken in the order of their other values.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.sources.shared import shared_dir

#: Milliseconds of a bucket: rows wait for the watermark and for this long.
BUCKET = 60_000
#: Shards of keys; a key with very many rows is a shard's main load.
SHARDS = 1024
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CLOSING = "2250-01-01"
_CLOSING_US = 8_835_955_200_000_000


class Machine:
    """What a key does with its rows, in order. Times are microseconds; a state is a dict that JSON can hold, None before the first row.

    A state's entry "due", if any, is the time of its next deadline. A state of None is forgotten.
    """

    #: Columns that rows bring besides ts and id, and columns of what comes out besides the key; times among them are microseconds.
    reads: tuple[str, ...] = ()
    gives: str = ""

    def row(self, state: dict | None, ts: int, row: tuple) -> tuple[dict | None, list[tuple]]:
        raise NotImplementedError

    def due(self, state: dict) -> tuple[dict | None, list[tuple]]:
        return None, []


class Streaks(Machine):
    """Calls of a vendor. A streak of failures gives an alert when it has so many and opens the circuit; a success resets the count and
    closes it. An open circuit is half open after the recovery time, and a failure then opens it again.

    Rows: kind (alert, open, half_open, closed), ts, failures in a row.
    """

    reads, gives = ("ok",), "kind string, ts long, failures int"

    def __init__(self, streak: int, recovery: int = 60_000_000):
        self.streak, self.recovery = streak, recovery

    def row(self, state, ts, row):
        s, out = state or {"n": 0, "circuit": "closed"}, []
        if row[0] is None:
            return state, []
        if row[0]:
            s["n"] = 0
            if s["circuit"] != "closed":
                out.append(("closed", ts, 0))
            s.update(circuit="closed", due=None)
            return s, out
        s["n"] += 1
        if s["n"] == self.streak:
            out.append(("alert", ts, s["n"]))
        if s["n"] >= self.streak and s["circuit"] != "open":
            out.append(("open", ts, s["n"]))
            s.update(circuit="open", due=ts + self.recovery)
        return s, out

    def due(self, state):
        state["circuit"] = "half_open"
        return {**state, "due": None}, [("half_open", state["due"], state["n"])]


class Sessions(Machine):
    """Runs of a session. It is complete with the run that brings the last of its indexes, and expires if that takes longer than patience;
    a repeated index counts once, as it first came. Runs that come after are late. A closed session is forgotten after the memory time, and a
    run that comes then begins a new one.

    Rows: status (complete, expired, late), ts when that was, runs, successes and failures among them, cost. A late run is a row by itself.
    """

    reads, gives = ("run", "total", "ok", "cost"), "status string, ts long, runs int, succeeded int, failed int, cost long"

    def __init__(self, patience: int, memory: int):
        self.patience, self.memory = patience, memory

    def _close(self, s, status, ts):
        runs = s["runs"].values()
        return {"closed": True, "due": ts + self.memory}, [(status, ts, len(runs), sum(ok for ok, _ in runs), sum(not ok for ok, _ in runs), sum(c for _, c in runs))]

    def row(self, state, ts, row):
        run, total, ok, cost = row
        if run is None:
            return state, []
        if state and state.get("closed"):
            return state, [("late", ts, 1, int(bool(ok)), int(not ok), cost or 0)]
        s = state or {"runs": {}, "due": ts + self.patience}
        s["runs"].setdefault(str(run), (bool(ok), cost or 0))
        return self._close(s, "complete", ts) if len(s["runs"]) >= (total or 1) else (s, [])

    def due(self, state):
        return (None, []) if state.get("closed") else self._close(state, "expired", state["due"])


class Profiles(Machine):
    """Arrivals of an entity. One is new where no profile of it was made in the time to live before, and makes one; a profile as old as
    that is still good. Rows: ts, how many profiles the entity has had in one unbroken state."""

    reads, gives = (), "ts long, arrivals int"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def row(self, state, ts, row):
        if state:
            state["n"] += 1
            return state, []
        return {"n": 1, "at": ts, "due": ts + self.ttl + 1}, [(ts, 1)]


class _Keyed(StatefulProcessor):
    """Runs a machine for each key of a shard; the key's columns are strings."""

    def __init__(self, machine: Machine, keys: list[str], bucket: int):
        self.machine, self.keys, self.bucket = machine, keys, bucket

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = T.StructType().add("json", "string")
        self.handle = handle
        self.held = handle.getMapState("held", T.StructType().add("bucket", "long"), text)
        self.states = handle.getValueState("states", text)
        self.passed: dict[Any, int] = {}

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        for piece in rows:
            piece = piece[piece["us"] < _CLOSING_US]
            by: dict[int, list] = {}
            for row in zip(piece["us"].tolist(), piece["row_id"].tolist(), piece["vals"].tolist(), piece["of"].tolist(), strict=True):
                by.setdefault(row[0] // 1000 // self.bucket * self.bucket, []).append(row)
            for start, new in by.items():
                if self.held.containsKey((start,)):
                    new = json.loads(self.held.getValue((start,))[0]) + new
                else:
                    self.handle.registerTimer(start + self.bucket)
                self.held.updateValue((start,), (json.dumps(new),))
        yield self._frame([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator:
        until = timerValues.getCurrentWatermarkInMs() // self.bucket * self.bucket
        if self.passed.get(key) == until:  # an earlier timer of this batch took all that is due
            return
        self.passed[key] = until
        states: dict[str, dict] = json.loads(self.states.get()[0]) if self.states.exists() else {}
        out: list[tuple] = []

        def pass_deadlines(of, state, end):
            while state and state.get("due") is not None and state["due"] <= end:
                state, rows = self.machine.due(state)
                out.extend((of, *r) for r in rows)
            return state

        for start in sorted(k[0] for k in self.held.keys() if k[0] < until):
            for ts, _, values, of in sorted(json.loads(self.held.getValue((start,))[0]), key=lambda r: r[:3]):
                states[of], rows = self.machine.row(pass_deadlines(of, states.get(of), ts), ts, tuple(json.loads(values).values()))
                out.extend((of, *r) for r in rows)
            self.held.removeKey((start,))
        states = {of: pass_deadlines(of, state, until * 1000 - 1) for of, state in states.items()}
        states = {of: state for of, state in states.items() if state is not None}
        if states:
            self.states.update((json.dumps(states),))
        else:
            self.states.clear()
        due = min((s["due"] for s in states.values() if s.get("due") is not None), default=None)
        if due is not None:
            self.handle.registerTimer((due // 1000 // self.bucket + 1) * self.bucket)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]):
        import pandas as pd

        names = [c.split(" ")[0] for c in self.machine.gives.split(", ")]
        d = pd.DataFrame([r[1:] for r in rows], columns=names)
        of = [json.loads(r[0]) for r in rows]
        for i, k in enumerate(self.keys):
            d.insert(i, k, pd.Series([x[k] for x in of], dtype=object))
        return d

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, keys: list[str], machine: Machine, late: str = "1 hour", ts: str = "ts", id: str = "id", bucket: int = BUCKET) -> DataFrame:
    """What a machine gives for each key of a stream, appended as the watermark moves: the keys as strings, then the machine's columns, ts as a time.

    The session's state store must be RocksDB's, as in run_to_end.
    """
    d = stream.withColumn("at_time", F.col(ts).cast("timestamp")).withWatermark("at_time", late)
    values = F.to_json(F.struct(*(F.col(c) for c in machine.reads)), {"ignoreNullFields": "false"}) if machine.reads else F.lit("{}")
    of = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)), {"ignoreNullFields": "false"})
    d = d.where("at_time is not null").select(of.alias("of"), F.unix_micros("at_time").alias("us"), F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("row_id"), values.alias("vals"), "at_time")
    d = d.withColumn("shard", F.pmod(F.xxhash64("of"), F.lit(SHARDS)).cast("int"))
    schema = ", ".join([*(f"{k} string" for k in keys), machine.gives])
    out = d.groupBy("shard").transformWithStateInPandas(_Keyed(machine, keys, bucket), schema, "append", "eventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


def run_to_end(stream: DataFrame, run: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """The whole result of an append-mode stream over what there is, as a table: run builds it from the stream.

    Rows that wait for the watermark come out too: once the stream is drained, a second source brings one closing row of a far time, and the
    query goes on from its checkpoint. Results are files of a streaming sink, each batch of them written once.
    """
    spark: SparkSession = stream.sparkSession
    base = shared_dir(spark)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    none = spark.createDataFrame([], stream.schema)
    none.write.parquet(f"{base}/closing")
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(f"{base}/closing"))
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, _PROVIDER)
    try:
        out = run(both)

        def drain() -> None:
            out.writeStream.format("parquet").option("path", f"{base}/result").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

        drain()
        spark.range(1).select(*(F.lit(f"{_CLOSING} 00:00:00" if c == ts else None).cast(t).alias(c) for c, t in kinds.items())).write.mode("append").parquet(f"{base}/closing")
        drain()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(out.schema).parquet(f"{base}/result")
