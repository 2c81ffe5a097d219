"""State machines in event time: the machines by themselves, and streams of one file and of many against each other."""

import random
import time
from datetime import timezone

from sightline.streaming import machines as M

S = 1_000_000


def play(machine, rows, end=None):
    """What a machine gives for rows (ts, values) in order, deadlines in between."""
    state, out = None, []

    def pass_deadlines(state, until):
        while state and state.get("due") is not None and state["due"] <= until:
            state, got = machine.due(state)
            out.extend(got)
        return state

    for ts, values in rows:
        state, got = machine.row(pass_deadlines(state, ts), ts, values)
        out.extend(got)
    return out, pass_deadlines(state, end if end is not None else 1 << 60)


def test_streaks():
    fails = [(i * S, (False,)) for i in range(5)]
    assert play(M.Streaks(5), fails)[0] == [("alert", 4 * S, 5), ("open", 4 * S, 5), ("half_open", 64 * S, 5)]
    out, state = play(M.Streaks(5), [*fails[:4], (5 * S, (True,)), *[(i * S, (False,)) for i in range(6, 10)]])
    assert out == [] and state["n"] == 4
    # a failure while the circuit is open changes nothing, one in half-open opens it again, a success closes it
    rows = [*fails, (10 * S, (False,)), (10 * S, (None,)), (64 * S, (False,)), (70 * S, (True,)), (71 * S, (True,))]
    assert play(M.Streaks(5), rows)[0] == [("alert", 4 * S, 5), ("open", 4 * S, 5), ("half_open", 64 * S, 6), ("open", 64 * S, 7), ("closed", 70 * S, 0)]


def test_sessions():
    m = M.Sessions(100, 1000)
    run = lambda i, ok=True, total=3: (i, total, ok, 10)
    out, state = play(m, [(0, run(0)), (1, run(1, False)), (2, run(1)), (3, run(2)), (4, run(0))], 500)
    assert out == [("complete", 3, 3, 2, 1, 30), ("late", 4, 1, 1, 0, 10)] and state["closed"]
    assert play(m, [(0, run(0)), (99, run(1)), (100, run(2))])[0] == [("expired", 100, 2, 2, 0, 20), ("late", 100, 1, 1, 0, 10)]
    # closed sessions are forgotten, and then begin anew
    assert [r[0] for r in play(m, [(0, run(0, total=1)), (999, run(0, total=1)), (1000, run(0, total=1))])[0]] == ["complete", "late", "complete"]
    assert play(m, [(0, (0, None, None, None))])[0] == [("complete", 0, 1, 0, 1, 0)]
    assert play(m, [(0, (None, 3, True, 1))]) == ([], None)


def test_profiles():
    week = 7 * 86_400 * S
    out, state = play(M.Profiles(week), [(0, ()), (5, ()), (week, ()), (week + 1, ()), (2 * week + 2, ())], 2 * week + 2)
    assert [r[0] for r in out] == [0, week + 1, 2 * week + 2] and state["n"] == 1
    assert play(M.Profiles(week), [(0, ())])[1] is None


def streamed(spark, path, files, machine, keys, reads):
    schema = spark.read.parquet(path).schema
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return sorted((tuple(r) for r in M.run_to_end(d, lambda d: M.run_machine(d, keys, machine, "30 hours", bucket=3_600_000)).collect()), key=str)


def test_files_do_not_matter(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"v{rng.randrange(3)}" if rng.random() < 0.9 else None, 1_700_000_000 * S + rng.randrange(24 * 3600) * S, i, rng.random() < 0.4) for i in range(400)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "vendor string, us long, id long, ok boolean").selectExpr("vendor", "timestamp_micros(us) AS ts", "id", "ok")
    df = df.unionByName(df.limit(1).selectExpr("vendor", "CAST(null AS timestamp) AS ts", "id", "ok"))
    df.coalesce(1).write.parquet(f"{tmp_path}/one")
    df.repartition(4).write.parquet(f"{tmp_path}/many")
    machine = M.Streaks(3, 1800 * S)
    one = streamed(spark, f"{tmp_path}/one", 1, machine, ["vendor"], ["ok"])
    assert one == streamed(spark, f"{tmp_path}/many", 1, machine, ["vendor"], ["ok"])
    want = []
    for v in {r[0] for r in rows}:
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == v)
        want += [(str(v), kind, ts, n) for kind, ts, n in play(machine, [(ts, (ok,)) for ts, _, ok in mine])[0]]
    stamp = lambda t: int(t.timestamp() * S) if t.tzinfo else int(t.replace(tzinfo=timezone.utc).timestamp() * S)
    assert sorted((str(v), kind, stamp(ts), n) for v, kind, ts, n in one) == sorted(want)
    assert {k for _, k, _, _ in one} == {"alert", "open", "half_open", "closed"}


def test_keys_share_shards(spark, tmp_path, monkeypatch):
    """Many keys of few rows, some of them null, in two shards: each is by itself, and calls are as many as shards and buckets."""
    monkeypatch.setattr(M, "SHARDS", 2)
    rng = random.Random(5)
    rows = [(f"e{rng.randrange(60)}" if rng.random() < 0.95 else None, f"d{rng.randrange(3)}", 1_700_000_000 * S + rng.randrange(24 * 3600) * S, i) for i in range(600)]
    spark.createDataFrame(rows, "entity string, part string, us long, id long").selectExpr("entity", "part", "timestamp_micros(us) AS ts", "id").repartition(3).write.parquet(f"{tmp_path}/e")
    want = []
    for k in {r[:2] for r in rows}:
        mine = sorted(r[2:] for r in rows if r[:2] == k)
        want += [(str(k[0]), k[1], ts) for ts, _ in play(M.Profiles(3600 * S), [(ts, ()) for ts, _ in mine])[0]]
    got = streamed(spark, f"{tmp_path}/e", 1, M.Profiles(3600 * S), ["entity", "part"], [])
    stamp = lambda t: int(t.timestamp() * S) if t.tzinfo else int(t.replace(tzinfo=timezone.utc).timestamp() * S)
    assert sorted((str(e), p, stamp(ts)) for e, p, ts, _ in got) == sorted(want) and len({r[0] for r in got}) > 40


def test_empty_and_late(spark, tmp_path):
    df = spark.sql("SELECT 'v' AS vendor, timestamp '2024-01-01 00:00:00' AS ts, 1L AS id, false AS ok")
    df.where("false").write.parquet(f"{tmp_path}/none")
    assert streamed(spark, f"{tmp_path}/none", 1, M.Streaks(1), ["vendor"], ["ok"]) == []
    for day in ("2024-01-05", "2024-01-06", "2024-01-01"):  # the third file comes five days late
        df.selectExpr("vendor", f"timestamp '{day} 00:00:00' AS ts", "id", "ok").coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
        time.sleep(1.1)
    got = streamed(spark, f"{tmp_path}/late", 1, M.Streaks(1), ["vendor"], ["ok"])
    assert [(r[1], r[2].day) for r in got] == [("alert", 5), ("half_open", 5), ("half_open", 6), ("open", 5), ("open", 6)]
