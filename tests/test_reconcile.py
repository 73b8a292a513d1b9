"""Scenarios of the deterministic memory layer."""

from palimpsest.operators import reconcile as R

ITEMS = "user_id string, pos int, topic string, sub_topic string, memo string"
STORED = "user_id string, id string, main_content string, subcontent string"
EVENTS = "user_id string, date string, event_name string, desc string, year string, time string, date_expression string"


def profile(spark, items, stored):
    out = R.judge_profile(spark.createDataFrame(items, ITEMS), spark.createDataFrame(stored, STORED))
    return [(r["type"], r["content"], r["embedding_id"]) for r in out.orderBy("pos").collect()]


def test_unchanged_profile_fact(spark):
    got = profile(spark, [("ines", 1, "Interest", "Winter Sport", "  cross-country   SKIING")], [("ines", "f7", "interest_winter_sport", "Cross-country skiing")])
    assert got == [("NOOP", "Interest / Winter Sport =   cross-country   SKIING", "f7")]


def test_changed_profile_fact(spark):
    got = profile(spark, [("ines", 1, "contact_info", "city", "Porto")], [("ines", "f8", "contact_info_city", "Lyon"), ("ines", "f9", "contact_info_city", "Porto")])
    assert got == [("UPDATE", "contact_info / city = Porto", "f8")]


def test_new_duplicate_and_keyless_facts(spark):
    items = [("ines", 1, "education", "degree", "BSc"), ("ines", 2, "", "hobby", "knits"), ("ines", 3, "Education", "Degree", "MSc"), ("otto", 4, "pets", "dog", "Rex")]
    got = profile(spark, items, [("otto", "g1", "education_degree", "MSc")])
    assert sorted(got) == [("ADD", " / hobby = knits", None), ("ADD", "Education / Degree = MSc", None), ("ADD", "pets / dog = Rex", None)]


def temporal(spark, item, stored):
    items = spark.createDataFrame([("u", 1, *item)], EVENTS.replace("user_id string,", "user_id string, pos int,"))
    return [(r["type"], r["embedding_id"]) for r in R.judge_temporal(items, spark.createDataFrame(stored, EVENTS)).orderBy("pos", "step").collect()]


def test_events(spark):
    stored = [("u", "09-30", "Harvest fair", "stalls and music", None, "11:00", "")]
    assert temporal(spark, ("10-01", "Book club", None, "2030", None, None), stored) == [("ADD", None)]
    assert temporal(spark, ("10-07", "harvest FAIR", "stalls and music", "", "11:00", None), stored) == [("DELETE", "09-30_Harvest fair"), ("ADD", None)]
    assert temporal(spark, ("09-30", "Harvest fair", "rain: indoors", None, "12:30", None), stored) == [("UPDATE", "09-30_Harvest fair")]
    assert temporal(spark, ("09-30", "Harvest  Fair", "Stalls and Music", "", "11:00", None), stored) == [("NOOP", "09-30_Harvest fair")]


def test_apply_ops(spark):
    stored = spark.createDataFrame([("k1", "plays cello"), ("k2", "lives in Lyon")], "id string, content string")
    ops = spark.createDataFrame(
        [(1, "ADD", "pets / dog = Rex", None), (2, "UPDATE", "plays viola", "k1"), (3, "DELETE", None, "nowhere"), (4, "UPDATE", "sings", "k9"), (5, "NOOP", "x", "k2"), (6, "ADD", "   ", None), (7, "DELETE", None, "k2"), (8, "UPDATE", "unplaced", None)],
        "op_id long, type string, content string, embedding_id string",
    )
    state, audit = R.apply_ops(stored, ops)
    assert {(r["id"], r["content"]) for r in state.collect()} == {("k1", "plays viola"), ("new-1", "pets / dog = Rex"), ("k9", "sings"), ("new-8", "unplaced")}
    assert R.weaver_result(audit).head().asDict() == {"total": 8, "succeeded": 6, "skipped": 2, "failed": 0}


def test_last_op_of_an_id_counts(spark):
    stored = spark.createDataFrame([("a", "1")], "id string, content string")
    ops = spark.createDataFrame([(1, "DELETE", None, "a"), (2, "UPDATE", "2", "a")], "op_id long, type string, content string, embedding_id string")
    assert [tuple(r) for r in R.apply_ops(stored, ops)[0].select("id", "content").collect()] == [("a", "2")]


def test_maps_are_merged(spark):
    stored = spark.createDataFrame([("a", {"x": "1", "y": "2"}, "t"), ("b", {"z": "0"}, "t")], "id string, metadata map<string,string>, content string")
    changes = spark.createDataFrame([("a", {"y": "3"}, None), ("missing", {"q": "1"}, "u")], "id string, metadata map<string,string>, content string")
    got = {r["id"]: (r["metadata"], r["content"]) for r in R.partial_update(stored, changes, maps=("metadata",)).collect()}
    assert got == {"a": ({"x": "1", "y": "3"}, "t"), "b": ({"z": "0"}, "t")}


EVENT_OPS = "op_id long, user_id string, type string, date string, event_name string, desc string, year string"


def test_event_operations(spark):
    events = spark.createDataFrame([("u", "03-08", "Swim", "lanes", "2030", [1.0]), ("u", "03-08", "Dinner", "at home", None, None)], "user_id string, date string, event_name string, desc string, year string, embedding array<double>")
    rows = [(1, "u", "UPDATE", "03-08", "Swim", "pool closed", None), (2, "u", "ADD", "02-30", "Never", "x", None), (3, "u", "ADD", "03-09", "Walk", "hills", "2031"), (4, "u", "ADD", "03-08", "Cinema", None, None), (5, "u", "UPDATE", "03-08", "Unknown", "y", None), (6, "u", "DELETE", "03-08", "Cinema", None, None), (7, "u", "ADD", None, "No day", None, None)]
    state, audit = R.apply_event_ops(events, spark.createDataFrame(rows, EVENT_OPS))
    assert {(r["event_name"], r["desc"], r["year"], tuple(r["embedding"] or ())) for r in state.collect()} == {("Swim", "pool closed", "2030", (1.0,)), ("Dinner", "at home", None, ()), ("Walk", "hills", "2031", ())}
    assert {r["op_id"]: r["status"] for r in audit.collect()} == {1: "succeeded", 2: "failed", 3: "succeeded", 4: "succeeded", 5: "succeeded", 6: "succeeded", 7: "failed"}


def test_operations_on_a_date(spark):
    events = spark.createDataFrame([("u", "03-08", "Swim", "lanes"), ("u", "03-09", "Walk", "hills")], "user_id string, date string, event_name string, desc string")
    run = lambda *rows: {(r["date"], r["event_name"], r["desc"]) for r in R.apply_event_ops(events, spark.createDataFrame(rows, EVENT_OPS), match_name=False)[0].collect()}
    walk = ("03-09", "Walk", "hills")
    assert run((1, "u", "ADD", "03-08", "Tea", "cake", None)) == {("03-08", "Swim", "lanes"), ("03-08", "Tea", "cake"), walk}
    assert run((1, "u", "ADD", "03-08", "Tea", "cake", None), (2, "u", "UPDATE", "03-08", None, "moved", None)) == {("03-08", "Swim", "moved"), ("03-08", "Tea", "moved"), walk}
    assert run((1, "u", "UPDATE", "05-05", None, "nobody", None)) == {("03-08", "Swim", "lanes"), walk}
    assert run((1, "u", "DELETE", "03-08", None, None, None), (2, "u", "ADD", "03-08", "Tea", None, None)) == {("03-08", "Tea", None), walk}


def test_judges(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id int, content string")
    near = spark.createDataFrame([(1, "x", 0.99), (2, "y", 0.85), (2, "z", 0.2)], "item_id int, id string, score double")
    assert {r["item_id"]: (r["type"], r["embedding_id"]) for r in R.judge_semantic(items, near).collect()} == {1: ("NOOP", "x"), 2: ("UPDATE", "y"), 3: ("ADD", None)}
    from pyspark.sql import functions as F

    good = 'Well:\n```json\n{"confidence": 0.7, "operations": [{"type": "delete", "embedding_id": "k4"}, {"type": "perhaps", "content": "tea"}]}\n```'
    df = spark.createDataFrame([(good,), ("no idea",), ("{}",)], "a string")
    got = [r["x"] for r in df.select(R.parse_judgement(F.col("a"), F.array(F.lit("one"), F.lit("two"))).alias("x")).collect()]
    assert [(o["type"], o["content"], o["embedding_id"]) for o in got[0]["operations"]] == [("DELETE", "", "k4"), ("ADD", "tea", None)] and got[0]["confidence"] == 0.7
    assert [(o["type"], o["content"]) for o in got[1]["operations"]] == [("ADD", "one"), ("ADD", "two")] and got[1]["confidence"] == 0.5
    assert got[2]["operations"] == [] and got[2]["confidence"] == 0.0


def test_event_operations_in_any_order(spark):
    """Against a loop over the operations, with a hot event."""
    import random

    r = random.Random(4)
    dates, names = ["01-01", "01-02", "02-29"], ["a", "b", "c"]
    stored = [(f"u{u}", d, n, f"old {n}", None if n == "a" else "9:00", u) for u in range(3) for d in dates for n in names if r.random() < 0.6]
    ops = []
    for i in range(900):
        hot = r.random() < 0.5
        u, d, n = ("u0", "01-01", "a") if hot else (f"u{r.randrange(4)}", r.choice(dates), r.choice(names))
        kind = r.choice(["ADD", "UPDATE", "UPDATE", "UPDATE", "DELETE", "NOOP"] if hot else ["ADD", "UPDATE", "DELETE"])
        name = None if kind == "DELETE" and r.random() < 0.2 and not hot else n
        ops.append((i, u, kind, d, name, r.choice([None, f"text {i}"]), r.choice([None, f"{i}:00"])))
    e = spark.createDataFrame(stored, "user_id string, date string, event_name string, `desc` string, time string, extra int")
    o = spark.createDataFrame(r.sample(ops, len(ops)), "op_id long, user_id string, type string, date string, event_name string, `desc` string, time string")
    state = {(u, d, n): [a, b, x] for u, d, n, a, b, x in stored}
    for _, u, kind, d, n, a, b in ops:
        if kind == "DELETE":
            for k in [k for k in state if k[:2] == (u, d) and n in (None, k[2])]:
                del state[k]
        elif kind == "ADD" or kind == "UPDATE" and (u, d, n) in state:
            now = state.setdefault((u, d, n), [None, None, None])
            now[0], now[1] = a or now[0], b or now[1]
    got = R.apply_event_ops(e, o)[0]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*k, *v) for k, v in state.items()), key=str)
