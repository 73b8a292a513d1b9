"""Usage analytics: grouped counts and latencies, costs, funnels, trails, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Model, USD for a million input and output tokens, in the order in which prefixes are tried.
PRICES = (
    ("gemini-embedding-001", 0.15, 0.0),
    ("gemini-2.5-flash-lite", 0.10, 0.40),
    ("gemini-2.5-flash", 0.15, 0.60),
    ("gemini-2.0-flash", 0.10, 0.40),
    ("gemini-2.0-flash-lite", 0.075, 0.30),
)


def since(df: DataFrame, ts: str, now: Column, interval: str) -> DataFrame:
    """Rows of the last ``interval`` before ``now``; on stored tables the comparison is pushed to the scan."""
    return df.where((F.col(ts) >= now - F.expr(f"INTERVAL {interval}")) & (F.col(ts) <= now))


def latency_stats(df: DataFrame, keys: list[str], value: str, failed: Column, share: float = 0.95) -> DataFrame:
    """Count, average, maximum, true 95th percentile (interpolated) and failures for each key.

    A first pass gives a narrow band of values that holds the percentile, a second one counts each value in it and all below, so
    that no task holds a key's values. A key of fewer than 10,000 values has all of them in its band.
    """
    v, n = F.col(value), F.count(F.lit(1)).alias("n")
    rough = F.percentile_approx(v, [share - 0.001, min(1.0, share + 0.001)], 10_000)
    sums = df.groupBy(*keys).agg(n, F.avg(v).alias("avg_latency"), F.max(v).alias("max_latency"), F.sum(failed.cast("long")).alias("errors"), F.count(v).alias("__m"), F.min(v).alias("__min"), rough.alias("__rough"))
    few = F.col("__m") < 10_000
    sums = sums.withColumns({"__low": F.when(few, F.col("__min")).otherwise(F.col("__rough")[0]), "__high": F.when(few, F.col("max_latency")).otherwise(F.col("__rough")[1])})
    on = [df[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
    bands = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], "__low", "__high", "__m")
    near = df.join(bands, on).where(v <= F.col("__high"))
    counted = near.groupBy(*[f"__{k}" for k in keys], "__m", F.when(v >= F.col("__low"), v).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(*[f"__{k}" for k in keys]).orderBy(F.asc_nulls_first("v")))
    place = (F.col("__m") - 1) * F.lit(share)
    at = counted.withColumn("upto", upto).groupBy(*[f"__{k}" for k in keys]).agg(F.first("__m").alias("__m"), F.min(F.when(F.col("upto") > F.floor(place), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(place), F.col("v"))).alias("b"))
    at = at.select(*[f"__{k}" for k in keys], (F.col("a") + (F.col("b") - F.col("a")) * (place - F.floor(place))).alias("p95_latency"))
    both = sums.join(at, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    return both.select(*keys, "n", "avg_latency", "max_latency", "p95_latency", "errors")


def llm_usage(df: DataFrame, keys: tuple[str, ...] = ("provider", "model", "agent"), failed: Column | None = None) -> DataFrame:
    """(keys, n, input_tokens, output_tokens, avg_latency, failures, cost) of calls (keys, input_tokens, output_tokens, latency): the cost by ``price``, rounded to six places."""
    failed = ~F.coalesce("success", F.lit(True)) if failed is None else failed
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.avg("latency").alias("avg_latency"), F.sum(failed.cast("long")).alias("failures"))
    return out.withColumn("cost", F.round(cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")), 6))


def unenriched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, total, unenriched): rows whose summary isn't by a model, those without a source among them."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("summary_source").eqNullSafe("llm")).alias("unenriched"))


def repo_stats(files: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directories, files, symbols) of files (keys, file_path, dir_path) and symbols (keys, qualified_name); counted apart, then joined."""
    f = files.groupBy(*keys).agg(F.countDistinct("dir_path").alias("directories"), F.countDistinct("file_path").alias("files"))
    s = symbols.groupBy(*keys).agg(F.countDistinct("qualified_name").alias("symbols"))
    return f.join(s, keys, "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def hourly(df: DataFrame, ts: str, failed: Column) -> DataFrame:
    """By hour, in order of time, with day of month and hour."""
    hour = F.date_trunc("hour", F.col(ts))
    return df.groupBy(hour.alias("hour_start")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("errors")).select("hour_start", F.dayofmonth("hour_start").alias("day"), F.hour("hour_start").alias("hour"), "n", "errors")


def daily(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def price(model: Column, strict_order: bool = False) -> Column:
    """(input, output) USD for a million tokens: the model's own entry, else that of the longest prefix, or with ``strict_order`` the first; else 0."""
    key = F.lower(F.trim(model))
    pair = lambda p: F.struct(F.lit(p[1]).alias("input"), F.lit(p[2]).alias("output"))
    out = F
    for p in PRICES:
        out = out.when(key == p[0], pair(p))
    for p in PRICES if strict_order else sorted(PRICES, key=lambda p: -len(p[0])):
        out = out.when(F.startswith(key, F.lit(p[0])), pair(p))
    return out.otherwise(pair(("", 0.0, 0.0)))


def cost(model: Column, input_tokens: Column, output_tokens: Column, strict_order: bool = False) -> Column:
    p = price(model, strict_order)
    return (input_tokens * p["input"] + output_tokens * p["output"]) / 1_000_000


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: totals of each step, and each later step's share of the first in percent with one decimal (0 without any)."""
    names = list(steps)
    n = df.agg(*[F.sum(c.cast("long")).alias(k) for k, c in steps.items()])
    rate = lambda k: F.when(F.col(names[0]) > 0, F.round(F.col(k) * 100.0 / F.col(names[0]), 1)).otherwise(0.0)
    return n.select(*names, *[rate(k).alias(f"{k}_rate") for k in names[1:]])


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, le, n): counts up to each bound, as counters with fixed buckets report them; the last bound is infinity."""
    limits = (*bounds, float("inf"))
    row = df.groupBy(*keys).agg(*[F.sum((F.col(value) <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(limits)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.coalesce(F.col(f"b{i}"), F.lit(0)).alias("n")) for i, b in enumerate(limits)]))
    return row.select(*keys, pairs.alias("p")).select(*keys, "p.*")


def trail(df: DataFrame, ids: list, start: Column, n: int, id_col: str = "user_id", ts: str = "ts", key: str = "event_id") -> DataFrame:
    """A user's newest rows, by any of the user's ids."""
    return df.where(F.col(id_col).isin(*ids) & (F.col(ts) >= start)).orderBy(F.desc(ts), F.desc(key)).limit(n)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): a session ends where the next row comes later than the gap."""
    w = W.partitionBy(key).orderBy(ts)
    new = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int")
    marked = df.select(key, ts, F.coalesce(new, F.lit(0)).alias("new")).withColumn("session", F.sum("new").over(w))
    return marked.groupBy(key, "session").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))


def rate_limit(df: DataFrame, key: str, ts: str, order: str, most: int, window_seconds: int) -> DataFrame:
    """(key, order, allowed): at most ``most`` allowed hits in any window; hits that are refused don't count. Null keys are one key;
    hits without a time are refused.

    What is allowed depends on what was allowed before, but nothing before a pause of a window or more matters: a key's hits are cut
    there, so that a hot key is many segments, dealt to as many tasks. Pauses are found without its hits in one place: within a
    window's length of time there is none, so the first and last hit of each such slot tell them all. Hits of a
    segment stream by in order; its state is at most ``most`` times.
    """
    kind = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, allowed boolean"
    span = window_seconds * 1_000_000
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    hits = df.select(F.col(key).alias("k"), F.col(order).alias("o"), us.alias("us"), F.floor(us / F.lit(span)).cast("long").alias("slot"))
    slots = hits.groupBy("k", "slot").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    before = W.partitionBy("k").orderBy(F.asc_nulls_first("slot"))
    pause = (F.col("first") - F.lag("last").over(before) >= span).cast("int")
    slots = slots.withColumn("pause", F.coalesce(pause, F.lit(0))).withColumn("segment", F.sum("pause").over(before))
    slots = slots.select(F.col("k").alias("k2"), F.col("slot").alias("slot2"), "segment")
    both = hits.join(slots, F.col("k").eqNullSafe(F.col("k2")) & F.col("slot").eqNullSafe(F.col("slot2")))
    rows = both.select("k", "o", "us", "segment", F.col("k").isNull().alias("none"), F.coalesce(F.col("k").cast("string"), F.lit("")).alias("name"))
    rows = rows.repartition("name", "none", "segment").sortWithinPartitions("name", "none", "segment", "us", "o")

    def run(frames):
        from collections import deque

        import pandas as pd

        now, past = None, deque()
        for pdf in frames:
            out = []
            for at in zip(pdf["name"], pdf["none"], pdf["segment"], pdf["us"], strict=True):
                if at[:3] != now:
                    now, past = at[:3], deque()
                while past and at[3] - past[0] >= span:
                    past.popleft()
                out.append(at[3] == at[3] and len(past) < most)
                if out[-1]:
                    past.append(at[3])
            yield pd.DataFrame({key: pdf["k"], order: pdf["o"], "allowed": out})

    return rows.mapInPandas(run, kind)


def scan_estimate(size_mb: Column, base_s: float = 45.0, s_per_mb: float = 8.0, calls_per_mb: float = 15.0, tokens_per_call: int = 256, enrich_tokens_per_mb: int = 12_000) -> Column:
    """Expected seconds, embedding calls and tokens of a repository scan."""
    calls = F.ceil(size_mb * calls_per_mb)
    return F.struct((F.lit(base_s) + size_mb * s_per_mb).alias("seconds"), calls.alias("embedding_calls"), (calls * tokens_per_call).alias("embedding_tokens"), F.ceil(size_mb * enrich_tokens_per_mb).alias("enrich_tokens"))


def rollup(events: DataFrame, keys: tuple[str, ...], ts: str = "ts", user: str = "user_id", value: str = "value", failed: Column | None = None, unit: str = "hour") -> DataFrame:
    """(bucket, *keys, n, errors, total, users, values): a row a unit of time, which any window may be merged from.

    ``users`` is a sketch of the distinct users (HyperLogLog, 4096 registers: 2.3 % standard error), ``values`` one of the values
    (KLL of size 200: ranks within 1.65 % with 99 % certainty); both have a bounded size whatever the number of events.
    """
    failed = F.lit(False) if failed is None else failed
    person = F.col(user).cast("string")
    aggregates = [F.count(F.lit(1)).alias("n"), F.count(F.when(failed, 1)).alias("errors"), F.sum(value).alias("total"), F.hll_sketch_agg(F.nullif(person, F.lit("")), 12).alias("users"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("values")]
    return events.groupBy(F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bucket"), *keys).agg(*aggregates)


def merged(rollups: DataFrame, keys: tuple[str, ...] = (), quantiles: tuple[float, ...] = (0.5, 0.95), where: Column | None = None) -> DataFrame:
    """(*keys, n, errors, mean, users, q50, q95, ...) of rollups, of those that ``where`` chooses: counts and means exactly, users and quantiles by their sketches."""
    rows = rollups if where is None else rollups.where(where)
    out = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("total").alias("__total"), F.hll_union_agg("users").alias("__users"), F.kll_merge_agg_double("values").alias("__values"))
    marks = [F.kll_sketch_get_quantile_double("__values", F.lit(q)).alias(f"q{q * 100:g}") for q in quantiles]
    return out.select(*keys, "n", "errors", (F.col("__total") / F.col("n")).alias("mean"), F.hll_sketch_estimate("__users").alias("users"), *marks)
