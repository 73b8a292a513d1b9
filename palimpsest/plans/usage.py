"""Usage analytics over the event log: event types are paths, value is the latency, errors are failures, props.k counts tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..streaming import events as S
from .core import query


def _failed():
    return F.col("event_type") == "error"


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_latency, max(value) AS max_latency, round(quantile_cont(value, 0.95), 6) AS p95_latency, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY event_type""")
def api_stats(t):
    out = A.latency_stats(t.events, ["event_type"], "value", _failed())
    return out.withColumns({"avg_latency": F.round("avg_latency", 6), "p95_latency": F.round("p95_latency", 6)})


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS hour_start, CAST(day(date_trunc('hour', ts)) AS INT) AS day, CAST(hour(date_trunc('hour', ts)) AS INT) AS hour, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL""")
def hourly_volume(t):
    return A.hourly(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", _failed()).withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def daily_counts(t):
    return A.daily(t.events, "ts")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE user_id IS NOT NULL GROUP BY event_type")
def distinct_users(t):
    return t.events.where("user_id IS NOT NULL").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("""SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value <= le) AS n FROM events, (SELECT unnest([10.0, 50.0, 100.0, 150.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL""")
def latency_histogram(t):
    return A.histogram(t.events, "value", (10.0, 50.0, 100.0, 150.0), ("event_type",))


_MODEL = """CASE user_id % 5 WHEN 0 THEN 'gemini-2.5-flash-lite' WHEN 1 THEN 'gemini-2.0-flash-lite-001' WHEN 2 THEN ' Gemini-2.5-Flash ' WHEN 3 THEN 'gemini-embedding-001' ELSE 'other' END"""
_TOKENS = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_PRICED = """(VALUES (0, 0.10, 0.40), (1, {lite_in}, {lite_out}), (2, 0.15, 0.60), (3, 0.15, 0.0), (4, 0.0, 0.0)) p(m, i, o)"""


def _cost_sql(lite_in: float, lite_out: float) -> str:
    p = _PRICED.format(lite_in=lite_in, lite_out=lite_out)
    return f"""SELECT lower(trim({_MODEL})) AS model, CAST(sum({_TOKENS}) AS BIGINT) AS input_tokens, round(sum(({_TOKENS} * p.i + 2 * {_TOKENS} * p.o) / 1000000)::DOUBLE, 9) AS cost
FROM events JOIN {p} ON p.m = user_id % 5 GROUP BY 1"""


def _cost(t, strict: bool):
    u = F.col("user_id") % 5
    model = F.when(u == 0, "gemini-2.5-flash-lite").when(u == 1, "gemini-2.0-flash-lite-001").when(u == 2, " Gemini-2.5-Flash ").when(u == 3, "gemini-embedding-001").otherwise("other")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select(model.alias("model"), k.alias("k"))
    each = A.cost(F.col("model"), F.col("k"), 2 * F.col("k"), strict)
    return rows.groupBy(F.lower(F.trim("model")).alias("model")).agg(F.sum("k").alias("input_tokens"), F.round(F.sum(each), 9).alias("cost"))


@query(_cost_sql(0.075, 0.30))
def cost_by_model_prefix(t):
    return _cost(t, False)


@query(_cost_sql(0.10, 0.40))
def cost_by_model_table_order(t):
    """Prefixes in table order, as the prices were first used: a suffixed lite model gets the dearer price."""
    return _cost(t, True)


@query("SELECT event_id, ts, event_type FROM events WHERE user_id IN (7, 11) AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def user_trail(t):
    return A.trail(t.events, [7, 11], F.lit("2024-01-10").cast("timestamp_ntz"), 50).select("event_id", "ts", "event_type")


@query("""SELECT count(*) AS sent, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS opened, count(*) FILTER (WHERE event_type = 'purchase') AS bought,
round(count(*) FILTER (WHERE event_type IN ('click', 'purchase')) * 100.0 / count(*), 1)::DOUBLE AS opened_rate, round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*), 1)::DOUBLE AS bought_rate FROM events""")
def funnel_rates(t):
    e = F.col("event_type")
    return A.funnel(t.events, {"sent": F.lit(True), "opened": e.isin("click", "purchase"), "bought": e == "purchase"})


@query("SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS opened_at, min(ts) FILTER (WHERE event_type = 'click') AS clicked_at FROM events GROUP BY user_id")
def first_touch(t):
    at = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts")))
    return t.events.groupBy("user_id").agg(at("view").alias("opened_at"), at("click").alias("clicked_at"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_events(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "ts", "event_type")


@query("SELECT event_id FROM events WHERE event_id > 400 ORDER BY event_id DESC LIMIT 500")
def log_since_id(t):
    from ..sources.files import newer_than

    return newer_than(t.events, 400, 500, "event_id").select("event_id")


@query("SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 10 DAY")
def retention_cut(t):
    from ..sources.files import retained

    return retained(t.events, F.lit("2024-01-25").cast("timestamp_ntz"), 10).agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 14400000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(t):
    return A.sessions(t.events, "user_id", "ts", 4 * 3600)


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY ALL""")
def tumbling_windows(t):
    """The batch run of the streaming window."""
    out = S.windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "errors")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT user_id, event_id, r, true AS allowed, [us] AS hits FROM e WHERE r = 1
UNION ALL SELECT user_id, event_id, r, len(live) < 3, CASE WHEN len(live) < 3 THEN list_append(live, us) ELSE live END
FROM (SELECT e.user_id, e.event_id, e.r, e.us, list_filter(s.hits, lambda h: e.us - h < 21600000000) AS live FROM s JOIN e ON e.user_id IS NOT DISTINCT FROM s.user_id AND e.r = s.r + 1))
SELECT user_id, event_id, allowed FROM s""")
def rate_limit(t):
    """Three hits in six hours for each user; refused ones don't count, so SQL needs a loop."""
    return A.rate_limit(t.events, "user_id", "ts", "event_id", 3, 6 * 3600)


@query("""SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS sent FROM events WHERE event_type = 'signup' GROUP BY ALL""")
def sent_per_day(t):
    return t.events.where("event_type = 'signup'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("sent"))


@query("""SELECT p_partkey, round(45.0 + p_size * 8.0, 6) AS seconds, CAST(ceil(p_size * 15.0) AS BIGINT) AS embedding_calls, CAST(ceil(p_size * 15.0) * 256 AS BIGINT) AS embedding_tokens, CAST(p_size * 12000 AS BIGINT) AS enrich_tokens FROM part""")
def scan_cost_estimate(t):
    return t.part.select("p_partkey", A.scan_estimate(F.col("p_size")).alias("e")).select("p_partkey", "e.*")


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-30' GROUP BY ROLLUP (event_type)""")
def token_totals_week(t):
    week = A.since(t.events, "ts", F.lit("2024-01-30").cast("timestamp_ntz"), "7 days")
    return week.rollup("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"))


@query(f"""WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, {_MODEL} AS model, event_type AS agent, {_TOKENS} AS i, {_TOKENS} * 2 AS o, value, event_id % 7 = 0 AS bad FROM events),
g AS (SELECT provider, model, agent, count(*) AS n, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(avg(value), 6) AS avg_latency, count(*) FILTER (WHERE bad) AS failures FROM c GROUP BY ALL)
SELECT g.*, CAST(round((input_tokens * CASE trim(lower(model)) WHEN 'gemini-2.5-flash-lite' THEN 0.10 WHEN 'gemini-2.0-flash-lite-001' THEN 0.075 WHEN 'gemini-2.5-flash' THEN 0.15 WHEN 'gemini-embedding-001' THEN 0.15 ELSE 0.00 END
+ output_tokens * CASE trim(lower(model)) WHEN 'gemini-2.5-flash-lite' THEN 0.40 WHEN 'gemini-2.0-flash-lite-001' THEN 0.30 WHEN 'gemini-2.5-flash' THEN 0.60 ELSE 0.00 END) * 0.000001, 6) AS DOUBLE) AS cost FROM g""")
def llm_usage(t):
    """Calls, tokens, latency, failures and cost by provider, model and agent."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.col("user_id") % 5
    model = F.when(m == 0, "gemini-2.5-flash-lite").when(m == 1, "gemini-2.0-flash-lite-001").when(m == 2, " Gemini-2.5-Flash ").when(m == 3, "gemini-embedding-001").otherwise("other")
    calls = t.events.select(F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("provider"), model.alias("model"), F.col("event_type").alias("agent"), k.alias("input_tokens"), (k * 2).alias("output_tokens"), F.col("value").alias("latency"), (F.col("event_id") % 7 != 0).alias("success"))
    return A.llm_usage(calls).withColumn("avg_latency", F.round("avg_latency", 6))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE value > 50) AS errors, round(avg(value), 6) AS mean, true AS users_near, true AS median_near, true AS p95_near FROM events GROUP BY 1, 2""")
def rollups_of_days(t):
    """Days merged from hourly rows with sketches: counts and means exactly, users and quantiles within the stated errors of the exact values."""
    events = t.events.withColumn("day", F.to_date("ts"))
    hours = A.rollup(events, ("event_type",), failed=F.col("value") > 50)
    merged = A.merged(hours.withColumn("day", F.to_date("bucket")), ("event_type", "day"), (0.5, 0.95))
    exact = events.groupBy("event_type", "day").agg(F.count_distinct("user_id").alias("people"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)").alias(f"x{i}") for i, q in ((0, 0.45), (1, 0.55), (2, 0.91), (3, 0.99))])
    both = merged.join(exact, ["event_type", "day"])
    near = F.abs(F.col("users") - F.col("people")) <= F.greatest(F.lit(1.0), 5 * 0.023 * F.col("people"))
    return both.select("event_type", "day", "n", "errors", F.round("mean", 6).alias("mean"), near.alias("users_near"), F.col("q50").between(F.col("x0"), F.col("x1")).alias("median_near"), F.col("q95").between(F.col("x2"), F.col("x3")).alias("p95_near"))
