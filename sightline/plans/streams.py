"""Streaming queries, drained, and their batch twins in SQL."""

from pyspark.sql import functions as F

from sightline.sources.shared import shared_dir
from sightline.streaming import machines as M
from sightline.streaming import streams as S

HOUR, DAY = 3_600_000_000, 86_400_000_000
LATE = "1 hour"


def _calls(spark, sf_dir):
    return S.event_stream(spark, sf_dir).selectExpr("concat('v', user_id % 6) AS vendor", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", "event_type <> 'error' AS ok")


def failure_alerts(spark, sf_dir):
    d = M.run_to_end(_calls(spark, sf_dir), lambda d: M.run_machine(d, ["vendor"], M.Streaks(2), LATE, bucket=DAY // 1000))
    return d.where("kind = 'alert'").groupBy("vendor").agg(F.count("*").alias("alerts"))


def circuits(spark, sf_dir):
    """Changes of the circuits of vendors: two failures in a row open one, and an hour makes it half open."""
    d = M.run_to_end(_calls(spark, sf_dir), lambda d: M.run_machine(d, ["vendor"], M.Streaks(2, HOUR), LATE, bucket=DAY // 1000))
    return d.where("kind <> 'alert'").select("vendor", "kind", "ts", "failures")


def sessions(spark, sf_dir):
    """Sessions of three runs: a user's events of a day, numbered by three; a session waits six hours."""
    d = S.event_stream(spark, sf_dir).selectExpr(
        "CAST(user_id AS STRING) AS prompt_id", "CAST(CAST(ts AS DATE) AS STRING) AS session_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", "CAST(event_id % 3 AS INT) AS run", "3 AS total", "event_type <> 'error' AS ok",
        "CAST(floor(value) AS BIGINT) AS cost",
    )
    out = M.run_to_end(d, lambda d: M.run_machine(d, ["prompt_id", "session_id"], M.Sessions(6 * HOUR, 2 * DAY), LATE, bucket=DAY // 1000))
    return out.select("prompt_id", "session_id", "status", "ts", "runs", "succeeded", "failed", "cost")


def profile_ttl(spark, sf_dir):
    """When users' profiles are made: at an arrival that has none of the last seven days."""
    d = S.event_stream(spark, sf_dir).selectExpr("CAST(user_id AS STRING) AS entity", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id")
    return M.run_to_end(d, lambda d: M.run_machine(d, ["entity"], M.Profiles(7 * DAY), LATE, bucket=DAY // 1000)).select("entity", "ts")


def upserted(spark, sf_dir):
    """The latest event of each user and type, kept by a continuous upsert."""
    path, d = shared_dir(spark), S.event_stream(spark, sf_dir)
    S.upsert_stream(d, path, ["user_id", "event_type"], ["ts", "event_id"])
    return S.read_upserted(spark, path, d.schema).select("user_id", "event_type", "event_id", "ts")


QUERIES = {
    "stream_upsert": upserted,
    "stream_failure_alerts": failure_alerts,
    "stream_circuits": circuits,
    "stream_sessions": sessions,
    "stream_profile_ttl": profile_ttl,
    "stream_daily_rate": lambda spark, sf_dir: S.run_available(S.daily_rates(S.event_stream(spark, sf_dir))),
    "stream_counters": lambda spark, sf_dir: S.run_available(S.counters(S.event_stream(spark, sf_dir))),
    "stream_sliding_load": lambda spark, sf_dir: S.run_available(S.sliding_load(S.event_stream(spark, sf_dir))).groupBy("vendor").agg(F.max("requests").alias("peak"), F.count("*").alias("windows")),
}
ORACLES = {
    "stream_upsert": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stream_failure_alerts": """WITH c AS (SELECT 'v' || (user_id % 6)::VARCHAR AS vendor, event_type <> 'error' AS ok, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id % 6 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
g AS (SELECT vendor, run FROM c WHERE NOT ok GROUP BY ALL HAVING count(*) >= 2) SELECT vendor, count(*) AS alerts FROM g GROUP BY 1""",
    # a streak opens once with its second failure; it is half open an hour later unless a success came; each later failure in half-open opens again
    "stream_circuits": """WITH RECURSIVE e AS (SELECT 'v' || (user_id % 6)::VARCHAR AS vendor, ts, event_id, event_type <> 'error' AS ok FROM events),
c AS (SELECT *, sum(ok::INT) OVER (PARTITION BY vendor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT vendor, run, ts, row_number() OVER (PARTITION BY vendor, run ORDER BY ts, event_id) AS n FROM c WHERE NOT ok),
s AS (SELECT vendor, run, min(ts) AS closed FROM c WHERE ok GROUP BY ALL),
o AS (SELECT vendor, run, ts, n FROM f WHERE n = 2 UNION ALL SELECT vendor, run, ts, n FROM (SELECT f.*, row_number() OVER (PARTITION BY f.vendor, f.run ORDER BY f.n) AS k FROM o JOIN f ON f.vendor = o.vendor AND f.run = o.run AND f.n > o.n AND f.ts >= o.ts + INTERVAL 1 HOUR) WHERE k = 1),
h AS (SELECT o.vendor, 'half_open' AS kind, o.ts + INTERVAL 1 HOUR AS ts, (SELECT max(f.n) FROM f WHERE f.vendor = o.vendor AND f.run = o.run AND f.ts < o.ts + INTERVAL 1 HOUR) AS failures
  FROM o LEFT JOIN s ON s.vendor = o.vendor AND s.run = o.run + 1 WHERE s.closed IS NULL OR s.closed >= o.ts + INTERVAL 1 HOUR)
SELECT vendor, 'open' AS kind, ts AS ts, n::INT AS failures FROM o UNION ALL SELECT vendor, kind, ts, failures::INT FROM h
UNION ALL SELECT DISTINCT o.vendor, 'closed', closed, 0 FROM o JOIN s ON s.vendor = o.vendor AND s.run = o.run + 1""",
    "stream_sessions": """WITH e AS (SELECT user_id, ts::DATE AS day, ts, event_id % 3 AS run, event_type <> 'error' AS ok, floor(value)::BIGINT AS cost, min(ts) OVER (PARTITION BY user_id, ts::DATE) + INTERVAL 6 HOURS AS until FROM events),
f AS (SELECT user_id, day, run, min(ts) AS ts, arg_min(ok, ts) AS ok, arg_min(cost, ts) AS cost, any_value(until) AS until FROM e WHERE ts < until GROUP BY ALL),
d AS (SELECT user_id, day, count(*) AS runs, CASE count(*) WHEN 3 THEN max(ts) ELSE any_value(until) END AS at_, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, sum(cost) AS cost FROM f GROUP BY ALL),
r AS (SELECT user_id, day, CASE runs WHEN 3 THEN 'complete' ELSE 'expired' END AS status, at_, runs, succeeded, failed, cost FROM d
 UNION ALL SELECT user_id, day, 'late', ts, 1, ok::INT, (NOT ok)::INT, e.cost FROM e JOIN d USING (user_id, day) WHERE ts > at_ OR (ts = at_ AND d.runs < 3))
SELECT user_id::VARCHAR AS prompt_id, day::VARCHAR AS session_id, status, at_ AS ts, runs::INT AS runs, succeeded::INT AS succeeded, failed::INT AS failed, cost::BIGINT AS cost FROM r""",
    "stream_profile_ttl": """WITH RECURSIVE e AS (SELECT user_id, ts FROM events), p AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
 UNION ALL SELECT p.user_id, min(e.ts) FROM p JOIN e ON e.user_id = p.user_id AND e.ts > p.ts + INTERVAL 7 DAYS GROUP BY p.user_id)
SELECT user_id::VARCHAR AS entity, ts AS ts FROM p""",
    "stream_daily_rate": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(floor(value)::BIGINT)::BIGINT AS total FROM events GROUP BY ALL",
    "stream_counters": "SELECT user_id, count(*) AS mentions, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1",
    "stream_sliding_load": """WITH w AS (SELECT user_id % 6 AS vendor, time_bucket(INTERVAL 10 SECONDS, ts) - i * INTERVAL 10 SECONDS AS start FROM events, range(0, 6) AS r(i)),
c AS (SELECT vendor, start, count(*) AS requests FROM w GROUP BY ALL) SELECT vendor, max(requests) AS peak, count(*) AS windows FROM c GROUP BY 1""",
}
