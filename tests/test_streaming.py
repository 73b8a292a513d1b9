from pyspark.sql import functions as F

from palimpsest.operators import analytics as A
from palimpsest.streaming import events as S

from .conftest import SMALL


def _input(spark, tmp_path, name):
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    e.repartition(1).write.parquet(str(tmp_path / name))
    return e, S.read(spark, str(tmp_path / name), e.schema)


def _run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_the_batch_run_where_closed(spark, tmp_path):
    e, stream = _input(spark, tmp_path, "a")
    got = {tuple(r) for r in _run(S.windowed(stream, "6 hours"), "w1").collect()}
    want = {tuple(r) for r in S.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours").collect()}
    assert got <= want and len(want) - len(got) <= 10 and got


def test_sessions(spark, tmp_path):
    e, stream = _input(spark, tmp_path, "b")
    got = {tuple(r) for r in _run(S.sessions(stream, "4 hours"), "w2").collect()}
    want = {tuple(r) for r in S.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "4 hours").collect()}
    assert got <= want and got


def test_limiter_equals_the_batch_operator(spark, tmp_path):
    e, stream = _input(spark, tmp_path, "c")
    got = {tuple(r) for r in _run(S.rate_limited(stream, 3, 6 * 3600), "w3").collect()}
    assert got == {tuple(r) for r in A.rate_limit(e, "user_id", "ts", "event_id", 3, 6 * 3600).collect()}


def test_limiter_state_goes_after_the_window(spark, tmp_path):
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    batches = [[(k, i, at(i)) for i, k in enumerate(range(50))], [(1, 100, at(55)), (1, 101, at(56))], [(99, 200, at(600))], [(99, 201, at(601))]]
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    seen, rows = [], []
    for batch in batches:
        spark.createDataFrame(batch, "user_id long, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        stream = S.rate_limited(S.read(spark, path, "user_id long, event_id long, ts timestamp"), 2, 3600)
        q = stream.writeStream.outputMode("append").foreachBatch(lambda df, _: rows.extend(tuple(r) for r in df.collect())).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        seen.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    assert seen[0] >= 50 and seen[-1] <= 4 < seen[0]  # one key's times, and its timer
    assert {r[1] for r in rows} == {i for b in batches for _, i, _ in b} and [r for r in rows if not r[2]] == [(1, 101, False)]


def test_file_sink(spark, tmp_path):
    e, stream = _input(spark, tmp_path, "d")
    for _ in range(2):  # a restart writes nothing twice
        S.append(stream, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()
