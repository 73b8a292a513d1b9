"""Vector index, snapshots in buckets, rollups and agents."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import agents as G
from palimpsest.operators import analytics as A
from palimpsest.operators import search as S
from palimpsest.operators import vector_index as V
from palimpsest.operators.reconcile import delete
from palimpsest.operators.snapshots import Snapshot


def files_read(df):
    """As the scan of a collected frame counted them."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("Adaptive") else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_index_equals_the_scan_and_reads_less(spark, tmp_path, metric):
    r = np.random.default_rng(1)
    centers = r.normal(size=(20, 8)) * 5
    rows = [(i, [float(x) for x in centers[i % 20] + r.normal(size=8) * 0.2], i % 3) for i in range(600)]
    rows += [(600, [0.0] * 8, 1), (601, None, 1), (602, [1.0], 1), (603, [None] * 8, 1), (604, rows[5][1], 1), (605, rows[5][1], 1)]
    table = spark.createDataFrame(rows, "id int, embedding array<double>, label int")
    index = V.build(table, f"file://{tmp_path}/index", 8, metric=metric)
    good = table.where(F.size("embedding") == 8).where("id != 603")
    every = len(index.vectors().inputFiles())
    for query, k in ((rows[5][1], 7), ([float(x) for x in centers[3]], 30), ([0.0] * 8, 5), ([100.0] * 8, 3), (rows[0][1], 1000), (rows[7][1], 1)):
        got = [(x["id"], x["score"]) for x in index.nearest(query, k).collect()]
        assert got == [(x["id"], x["score"]) for x in S.knn(good, query, k, metric=metric).collect()], (query, k)
    few = index.nearest(rows[5][1], 7)
    few.collect()
    assert files_read(few) < every / 2
    some = {"where": F.col("label") == 1}
    assert [x["id"] for x in index.nearest(rows[5][1], 9, **some).collect()] == [x["id"] for x in S.knn(good, rows[5][1], 9, metric=metric, **some).collect()]
    least = 0.9 if metric == "cosine" else -3.0
    assert [x["id"] for x in index.nearest(rows[5][1], 99, least=least).collect()] == [x["id"] for x in S.knn(good, rows[5][1], 99, metric=metric, least=least).collect()]


def test_index_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "id int, embedding array<float>")
    assert V.build(none, f"file://{tmp_path}/none", 3).nearest([1.0, 0.0, 0.0], 5).count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    assert [(r["id"], r["score"]) for r in V.build(zero, f"file://{tmp_path}/zero", 2).nearest([1.0, 0.0], 5).collect()] == [(1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        V.build(zero, f"file://{tmp_path}/dot", 2, metric="dot")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_batch_rewrites_its_buckets_once(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/t", ["id"], buckets=16)
    frame = lambda rows: spark.createDataFrame(rows, "id int, name string, n int")
    s.create(frame([(i, f"a{i}", 1) for i in range(300)]))
    before = files(tmp_path / "t" / "rows")
    batch = frame([(3, "new", 2), (1000, "added", 2)])
    touched = s.apply(batch, "b1")
    after = files(tmp_path / "t" / "rows")
    outside = lambda f: {k: v for k, v in f.items() if int(k.split("__bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and outside(before) == outside(after) and before != after
    state = sorted(tuple(r) for r in s.rows().collect())
    assert state == sorted([(i, "new" if i == 3 else f"a{i}", 2 if i == 3 else 1) for i in range(300)] + [(1000, "added", 2)])
    assert s.apply(batch, "b1") == [] and files(tmp_path / "t" / "rows") == after
    # cut off before its record: the same rows again
    spark.createDataFrame([], "batch string, buckets array<int>").write.mode("overwrite").parquet(f"{s.path}/batches")
    assert s.apply(batch, "b1") == touched and sorted(tuple(r) for r in s.rows().collect()) == state
    gone = frame([(i, None, None) for i in range(300)])
    s.apply(gone, "b2", lambda old, b: delete(old, b, ["id"]))
    assert [r["id"] for r in s.rows().collect()] == [1000] and {r["batch"] for r in s.batches().collect()} == {"b1", "b2"}
    with pytest.raises(ValueError):
        s.apply(frame([(1000, "x", 1)]), "b3", lambda old, b: old.withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(500)))))
    assert s.rows().count() == 1
    s.apply(frame([(1000, None, None)]), "b4", lambda old, b: delete(old, b, ["id"]))
    assert s.rows().count() == 0 and len(s.apply(frame([(7, "again", 1)]), "b5")) == 1 and s.rows().count() == 1


def test_rollups_merge_within_their_error(spark):
    r = random.Random(3)
    rows = [(f"2024-01-0{1 + i % 2} {r.randrange(24):02d}:10:00", f"u{r.randrange(3000)}", r.lognormvariate(3, 1), r.choice(["a", "b"])) for i in range(40_000)] + [("2024-01-01 00:00:00", "", None, "a"), ("2024-01-01 00:00:00", None, 1.0, "b")]
    e = spark.createDataFrame(rows, "ts string, user_id string, value double, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    up = A.rollup(e, ("kind",), failed=F.col("value") > 100)
    assert up.count() == 96
    for day in ("2024-01-01", "2024-01-02"):
        own = [x for x in rows if x[0].startswith(day)]
        for x in A.merged(up, ("kind",), where=F.to_date("bucket") == day).collect():
            mine = [y for y in own if y[3] == x["kind"]]
            values = sorted(y[2] for y in mine if y[2] is not None)
            users = len({y[1] for y in mine if y[1]})
            assert (x["n"], x["errors"]) == (len(mine), sum(v > 100 for v in values))
            assert abs(x["users"] - users) <= 5 * 0.023 * users
            for q in (0.5, 0.95):
                rank = sum(v <= x[f"q{q * 100:g}"] for v in values) / len(values)
                assert abs(rank - q) < 0.03


def test_agents_are_called_once_a_text(spark):
    def agent(text):
        import uuid

        return [(w, uuid.uuid4().hex) for w in text.split() if w.startswith("x")]

    rows = spark.createDataFrame([(i, f"x{i % 5} and xy {i % 5}") for i in range(200)] + [(300, None), (301, " "), (302, "none")], "id int, said string")
    got = G.records(rows, "said", agent, "word string, call string").collect()
    assert len(got) == 400 and len({r["call"] for r in got}) == 10 and {r["id"] for r in got} == set(range(200))


def test_annotations_of_members(spark):
    turns = [(1, "p", "o", "r", "u1", "Ada", "manager", " fix: the cache leaks ", "a.py", "f"), (2, "p", "o", "r", "u2", None, "intern", "fix: no", None, None), (3, "p", "o", "r", "u3", None, "sde2", "fix:   ", None, None), (4, "q", "o", "r", "u3", None, "sde2", "fix: the cache leaks", None, None), (5, "p", "o", "r", "u9", None, None, "fix: no", None, None), (6, "p", "o", "r", "u1", "Ada", "manager", None, None, None)]
    df = spark.createDataFrame(turns, "turn_id int, project_id string, org_id string, repo string, user_id string, user_name string, role string, query string, file_path string, symbol_name string")
    agent = lambda text: [(text.split(":", 1)[1], "", None, None, "b.py" if "cache" in text else None, "", None)] if ":" in text else []
    made = G.annotations(df, agent)
    got = {(r["project_id"], r["author_name"], r["content"], r["annotation_type"], r["file_path"], r["symbol_name"], r["repo"], r["status"]) for r in made.collect()}
    assert got == {("p", "Ada", "the cache leaks", "explanation", "b.py", "f", "r", "active"), ("q", "u3", "the cache leaks", "explanation", "b.py", None, "r", "active")}
    projects = spark.createDataFrame([("p", 3, "x"), ("z", None, "y")], "project_id string, annotation_count long, name string")
    assert {(r["project_id"], r["annotation_count"], r["name"]) for r in G.counted(projects, made).collect()} == {("p", 4, "x"), ("z", 0, "y")}
