"""Streaks and sliding load of calls in buckets against plain loops: hot and null vendors, ties, null times, edges of buckets."""

import random
from datetime import datetime, timedelta

from sightline.operators.ranks import failure_streaks, sliding_load

START = datetime(2024, 1, 1)


def calls(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a"] * 6 + ["b", None]), START + timedelta(seconds=rng.randrange(0, 4000, 7)), rng.random() < 0.3, rng.randrange(9)) for i in range(900)]
    rows += [(900 + i, "c", START + timedelta(seconds=100 * i), False, 1) for i in range(40)]  # one streak through many buckets
    return rows, spark.createDataFrame(rows, "call_id long, vendor string, ts timestamp, ok boolean, tokens long").repartition(5)


def test_streaks(spark):
    rows, df = calls(spark)
    want = set()
    for v in {r[1] for r in rows}:
        run = []
        for i, _, ts, ok, _ in [*sorted((r for r in rows if r[1] == v), key=lambda r: (r[2], r[0])), (0, v, None, True, 0)]:
            if not ok:
                run.append(ts)
                continue
            if len(run) >= 3:
                want.add((v, len(run), run[0], run[-1]))
            run = []
    for bucket in (60, 3600):
        got = [tuple(r) for r in failure_streaks(df, 3, bucket).collect()]
        assert set(got) == want and len(got) == len(want) and ("c", 40, START, START + timedelta(seconds=3900)) in want


def test_load(spark):
    rows, df = calls(spark)
    want = {}
    for i, v, ts, _, _ in rows:
        near = [r[4] for r in rows if r[1] == v and timedelta(0) <= ts - r[2] <= timedelta(seconds=70)]
        want[i] = (v, len(near), sum(near))
    for widths in (1, 8):
        got = sliding_load(df, 70, widths).collect()
        assert {r["call_id"]: (r["vendor"], r["requests"], r["load"]) for r in got} == want and len(got) == len(rows)
    late = spark.createDataFrame([(1, "a", None, False, 2), (2, "a", None, True, 3)], "call_id long, vendor string, ts timestamp, ok boolean, tokens long")
    assert {(r["call_id"], r["requests"], r["load"]) for r in sliding_load(late, 60).collect()} == {(1, 2, 5), (2, 2, 5)}
    assert failure_streaks(late, 1).count() == 1


def test_load_is_a_running_sum(spark):
    """No frame slides over the calls near a call, and calls without tokens have no load."""
    df = spark.createDataFrame([(1, "a", START, True, None), (2, "a", START + timedelta(seconds=200), True, 5), (3, "a", START + timedelta(seconds=210), True, None)], "call_id long, vendor string, ts timestamp, ok boolean, tokens long")
    d = sliding_load(df, 60)
    assert "RangeFrame, -" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in d.select("call_id", "requests", "load").collect()} == {(1, 1, None), (2, 1, 5), (3, 2, 5)}
