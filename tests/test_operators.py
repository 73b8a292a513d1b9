from collections import deque

from pyspark.sql import functions as F

from palimpsest.operators import analytics as A
from palimpsest.operators import graph as G
from palimpsest.operators import search as S
from palimpsest.operators import turns as T
from palimpsest.plans import core
from palimpsest.sources import code, files

from .conftest import SMALL


def test_rrf_scores_and_ties(spark):
    lane = lambda *names: spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "qualified_name string, rank int")
    got = S.rrf([lane("A", "B"), lane("B", "C", "")], "qualified_name", limit=5).collect()
    assert [r["qualified_name"] for r in got] == ["B", "A", "C"]
    assert abs(got[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_knn_edge_cases(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0]), (6, [-1.0, 0.0])], "id int, embedding array<float>")
    got = [(r["id"], r["score"]) for r in S.knn(v, [1.0, 0.0], 10, mode="unit").collect()]
    assert got == [(1, 1.0), (5, 1.0), (2, 0.5), (6, 0.0)]
    assert S.knn(v, [1.0, 0.0], 10, least=0.3).count() == 2


def test_metadata_and_terms(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"b": "2"},)], "m map<string,string>")
    assert df.where(S.matches(F.col("m"), {"a": "1"})).count() == 1
    assert df.where(S.matches(F.col("m"), {"a": None})).count() == 1
    assert df.where(S.matches(F.col("m"), {})).count() == 2
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string")
    assert S.bm25(d.where("false"), "a", 5).count() == 0 == S.bm25(spark.createDataFrame([], d.schema), "a", 5).count()
    assert S.bm25(d, "()*", 5).count() == 0 and [r["id"] for r in S.bm25(d, "a +", 5).collect()] == [1]


def test_k_hop(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "a")], "src string, dst string")
    hop = lambda n, **kw: sorted((r["node"], r["distance"]) for r in G.k_hop(e, spark.createDataFrame([("a",)], "node string"), n, **kw).collect())
    assert hop(2) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 2)]  # the loop is not taken twice
    assert hop(5, least=True) == [("a", 1), ("b", 1), ("c", 2)]
    assert {r["node"] for r in G.inheritance(e, spark.createDataFrame([("c",)], "node string")).where("direction = 'descendant'").collect()} == {"b", "a"}


def test_directories(spark):
    f = spark.createDataFrame([("a/b/c.py",), ("a/d.py",), ("e.py",)], "file_path string")
    tree = {(r["path"], r["parent"], r["depth"], r["type"]) for r in G.dir_tree(f).collect()}
    assert tree == {("a", "", 1, "directory"), ("a/b", "a", 2, "directory"), ("a/b/c.py", "a/b", 3, "file"), ("a/d.py", "a", 2, "file"), ("e.py", "", 1, "file")}
    assert [r["p"] for r in f.select(G.parent(F.col("file_path")).alias("p")).collect()] == ["a/b/", "a/", "/"]


def test_pairing(spark):
    rows = [(1, 0, "assistant", "hi"), (1, 1, "user", "q1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2"), (1, 5, "user", "q3")]
    t = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    pairs = lambda df: [(r["user_query"], r["agent_response"]) for r in df.orderBy(*[c for c in ("turn", "i", "g") if c in df.columns]).collect()]
    assert pairs(T.pair_last_user(t)) == [("", "hi"), ("q2", "a1"), ("", "a2")]
    assert pairs(T.pair_last_user(t, leftover=False)) == [("q2", "a1")]
    assert pairs(T.pair_zip(t)) == [("q1", "hi"), ("q2", "a1"), ("q3", "a2")]
    assert pairs(T.pair_runs(t)) == [("q2", "a1\n\na2")]


def test_planner_transcript(spark):
    text = "# Chat Conversation\n\n### User Input\n\nhello\n\n### Planner Response\n\none\n\n### Planner Response\n\ntwo\n"
    turns = T.transcript_turns(spark.createDataFrame([(1, text)], "id int, text string"))
    got = T.pair_runs(turns, "id").collect()
    assert [(r["user_query"], r["agent_response"]) for r in got] == [("hello", "one\n\ntwo")]


def limited(hits, most, seconds):
    out, kept = [], deque()
    for h in hits:
        while kept and h - kept[0] >= seconds:
            kept.popleft()
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(h)
    return out


def test_rate_limit_against_a_loop(spark):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    got = {r["event_id"]: r["allowed"] for r in core.QUERIES["rate_limit"](spark, SMALL).collect()}
    by = {}
    for r in sorted(events.select("user_id", "ts", "event_id").collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        by.setdefault(r["user_id"], []).append(r)
    want = {}
    for rows in by.values():
        want |= {r["event_id"]: ok for r, ok in zip(rows, limited([r["ts"].timestamp() for r in rows], 3, 6 * 3600), strict=True)}
    assert got == want and not all(want.values())


def test_limit_one(spark):
    df = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-01 00:00:01", 2), ("k", "2024-01-01 00:01:00", 3)], "key string, ts string, id int")
    got = A.rate_limit(df.withColumn("ts", F.col("ts").cast("timestamp")), "key", "ts", "id", 1, 60).orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, False, True]


def test_chunks_against_plain_python(spark):
    from palimpsest.functions.chunks import chunks_of

    want = {(r["doc_id"], i): c for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() for i, c in enumerate(chunks_of(r["text"], 200, 15))}
    assert {(r["doc_id"], r["pos"]): r["chunk"] for r in core.QUERIES["chunk_text"](spark, SMALL).collect()} == want


PY = '''"""m"""
import os.path
from a.b import c

def main(x, y=1):
    """Doc."""
    helper(x)
    if x and y:
        return os.path.join(x)

def helper(v):
    helper(v)

class K(Base):
    def run(self):
        self.go(); main(1)
    def go(self): pass
'''


def test_python_parser(spark):
    f = spark.createDataFrame([("a.py", PY), ("bad.py", "def ("), ("none.py", None)], "file_path string, content string")
    symbols = {r["qualified_name"]: r for r in code.parse(f).collect()}
    assert set(symbols) == {"main", "helper", "K", "K.run", "K.go", None}
    assert symbols["main"]["signature"] == "def main(x, y = ...)" and symbols["K"]["signature"] == "class K(Base)" and symbols["main"]["complexity"] == 3 and symbols["main"]["is_entrypoint"] and symbols["main"]["docstring"] == "Doc."
    assert symbols[None]["error"]
    calls = {(r["caller_name"], r["callee_name"]) for r in code.parse(f, "calls").collect()}
    assert calls == {("main", "helper"), ("main", "os.path.join"), ("run", "go"), ("run", "main")}
    assert {r["module"] for r in code.parse(f, "imports").collect()} == {"os.path", "a.b"}


def test_python_names_and_entry_points(spark):
    text = """
class Nest:
    @classmethod
    def lay(cls, n: int = 2) -> "Egg":
        cls.check(n); self.box.open(); make()(n); a.b.c()

@router.post
async def hatch(egg, *rest, warm=True, **more):
    pass

def run():
    pass
"""
    f = spark.createDataFrame([("n.py", text)], "file_path string, content string")
    got = {r["qualified_name"]: (r["signature"], r["is_entrypoint"], r["parameters"]) for r in code.parse(f).collect()}
    assert got["Nest.lay"] == ("def lay(n: int = ...) -> 'Egg'", False, ["n"]) and got["Nest"][2] == ["lay"]
    assert got["hatch"] == ("async def hatch(egg, *rest, **more)", False, ["egg", "*rest", "**more"]) or got["hatch"][1]
    assert got["hatch"][1] and not got["run"][1]
    assert {r["callee_name"] for r in code.parse(f, "calls").collect()} == {"cls.check", "box", "make", "a.b.c"}


def test_script_and_go_parsers(spark):
    ts = "import x from 'left-pad'\nconst y = require(\"./y\")\n\nexport default class Nest extends Base {\n  private eggs = 0 // {\n  hatch(n: number): void {\n    this.warm(n)\n    log.info('}')\n  }\n  cool = async (t) => {\n    fan(t)\n  }\n}\nfunction* walk(a, b) { step(a) }\n"
    go = 'package p\n\nimport (\n\t"fmt"\n\tq "a/b"\n)\n\ntype Nest struct {\n\tEggs int\n}\n\nfunc (n *Nest) Hatch(k int) {\n\tif k > 0 {\n\t\tfmt.Println(k)\n\t}\n}\n\nfunc main() {\n\tnew(Nest).Hatch(1)\n}\n'
    f = spark.createDataFrame([("a.ts", "typescript", ts), ("b.go", "go", go), ("c.py", "python", "def f(): pass"), ("d.js", "javascript", None)], "file_path string, language string, content string")
    got = {(r["file_path"], r["qualified_name"], r["symbol_type"], r["start_line"], r["end_line"]) for r in code.parse(f.where("language != 'python'")).collect()}
    assert got == {("a.ts", "Nest", "class", 4, 13), ("a.ts", "Nest.hatch", "method", 6, 9), ("a.ts", "Nest.cool", "method", 10, 12), ("a.ts", "walk", "function", 14, 14), ("b.go", "Nest", "class", 8, 10), ("b.go", "Nest.Hatch", "method", 12, 16), ("b.go", "main", "function", 18, 20)}
    calls = {(r["caller_name"], r["callee_name"]) for r in code.parse(f, "calls").collect()}
    assert {("hatch", "warm"), ("hatch", "log.info"), ("cool", "fan"), ("walk", "step"), ("Hatch", "Println"), ("main", "Hatch")} <= calls
    assert {(r["importer_file"], r["module"]) for r in code.parse(f, "imports").collect()} == {("a.ts", "left-pad"), ("a.ts", "./y"), ("b.go", "fmt"), ("b.go", "a/b")}


def test_user_text_is_no_pattern(spark):
    from palimpsest.operators import catalog as C

    rows = spark.createDataFrame([("a.*b",), ("axxb",), ("q\\E(",), (None,)], "name string")
    find = lambda text: [r["name"] for r in C.matching(rows, ["name"], text).collect()]
    assert find(".*") == ["a.*b"] and find("\\e(") == ["q\\E("] and find("AXX") == ["axxb"]


def test_roles_phases_and_limits(spark):
    from palimpsest.operators import catalog as C

    rows = spark.createDataFrame([("manager",), ("staff_engineer",), ("sde2",), ("intern",), ("guest",), (None,)], "role string")
    got = {r["role"]: (r["a"], r["m"], r["e"]) for r in rows.select("role", C.may_annotate(F.col("role")).alias("a"), C.may_manage(F.col("role")).alias("m"), C.may_edit(F.col("role"), F.lit("sde2"), F.lit(False)).alias("e")).collect()}
    assert got == {"manager": (True, True, True), "staff_engineer": (True, False, True), "sde2": (True, False, False), "intern": (False, False, False), "guest": (False, False, False), None: (False, False, False)}
    ranks = spark.createDataFrame([("Complete",), ("never heard",), (None,), ("not_started",), ("pending",)], "p string").select(C.rank_of(F.col("p"), C.PHASES).alias("r"))
    assert [r["r"] for r in ranks.collect()] == [4, 0, 0, 0, 1]
    S.check_request("q", "t", 5, name="a-b@c.d")
    for bad in ({"query": "x" * 5001}, {"top_k": 0}, {"top_k": 51}, {"batch": 101}, {"name": "no blanks"}):
        try:
            S.check_request(**bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_sized_vectors_and_text_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "id int, embedding array<float>")
    assert {r["id"]: r["fault"] for r in S.sized(v, 2, strict=False).collect()} == {1: None, 2: "size 1 instead of 2", 3: "no vector"}
    try:
        S.sized(v, 2).collect()
        raise AssertionError
    except Exception as e:
        assert "instead of 2" in str(e) or "no vector" in str(e)
    rows = spark.createDataFrame([(1, "red boats at sea"), (2, "green hills"), (3, None)], "id int, content string")
    assert S.search_by_text(rows, "boats at sea", 1).head()["id"] == 1


def test_large_query_tables_join_by_parts(spark, monkeypatch):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    run = lambda: {tuple(r) for r in S.knn_join(q, e.select(F.col("vec_id").alias("id"), "embedding", "label"), ["label"], 3).collect()}
    want = run()
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 3)
    assert run() == want


def test_percentile_of_many_values(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(5_000)).cast("double").alias("v"))
    got = {r["k"]: r["p95_latency"] for r in A.latency_stats(rows, ["k"], "v", F.lit(False)).collect()}
    want = {r["k"]: r["p"] for r in rows.groupBy("k").agg(F.percentile("v", F.lit(0.95)).alias("p")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_roots_with_pattern_characters(spark, tmp_path):
    root = tmp_path / "c++ (old).x"
    (root / "lib").mkdir(parents=True)
    (root / "lib/a.py").write_bytes(b"y = 2")
    assert [r["file_path"] for r in files.source_files(spark, str(root)).collect()] == ["lib/a.py"]


def test_transcripts_lose_undecodable_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xff\xc3\xa9")
    (tmp_path / "b.txt").write_bytes(b" \n")
    assert [r["text"] for r in files.transcripts(spark, str(tmp_path)).collect()] == ["caf\u00e9"]


def test_source_files_and_diffs(spark, tmp_path):
    for name, data in (("src/a.py", b"x = 1\n"), ("src/b.txt", b"no"), ("node_modules/c.js", b"no"), ("d.go", b"package \xff")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["file_path"]: (r["language"], r["content"]) for r in files.source_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.py", "d.go"} and got["src/a.py"] == ("python", "x = 1\n") and got["d.go"][0] == "go"
    lines = spark.createDataFrame([("A\tnew.py",), ("R100\told.py\tmoved.py",), ("D\tgone.py",), ("",)], "value string")
    assert {tuple(r) for r in files.diff_rows(lines).collect()} == {("ADDED", "new.py"), ("RENAMED", "moved.py"), ("DELETED", "old.py"), ("DELETED", "gone.py")}


def test_tools_and_small_parsers(spark):
    from palimpsest.functions import text as X
    from palimpsest.operators import team

    tools = team.Tools(search_symbols=lambda n: spark.range(n))
    assert tools("SearchSymbols", n=3).count() == 3
    try:
        tools("other")
        raise AssertionError
    except ValueError:
        pass
    one = lambda c, v: spark.createDataFrame([(v,)], "a string").select(c(F.col("a")).alias("x")).head()["x"]
    assert one(X.content_text, '["a", {"text": "b"}, {"image": 1}]') == "ab" and one(X.content_text, "plain") == "plain"
    assert tuple(one(X.topic_of, "basic_info_name")) == ("basic_info", "name") and tuple(one(X.topic_of, "odd")) == ("odd", "")
    assert one(X.ndjson_text, '{"type":"chunk","text":"a"}\nbroken\n{"type":"done"}\n{"type":"chunk","text":"b"}') == "ab"
    rows = spark.sql("SELECT 'new' AS i, array(named_struct('id', 1, 'score', 0.5, 'content', 'old')) AS r UNION ALL SELECT 'x', array()")
    assert {r["x"] for r in rows.select(team.neighbour_block(F.col("i"), F.col("r")).alias("x")).collect()} == {"NEW: new\n1 | 0.500 | old", "NEW: x\n(none)"}


def test_editable_counts_take_all_members(spark, duck):
    from .conftest import same

    small = "/root/testdata/sf0.01"
    sql = core.ORACLE_SQL["role_rank_counts"].replace("FROM customer", f"FROM read_parquet('{small}/customer.parquet')")
    got = core.QUERIES["role_rank_counts"](spark, small)
    assert got.count() == spark.read.parquet(f"{small}/customer.parquet").count() > 400
    same(got, duck.sql(sql))


def test_limiter_on_a_hot_key(spark):
    """A key with nine tenths of the hits, pauses, ties, null keys and times; against a plain loop."""
    import random

    r = random.Random(2)
    rows, us = [], 0
    for i in range(4000):
        us += r.choice([0, 1, 5, 20, 59, 60, 61, 400]) * 1_000_000 if r.random() < 0.5 else 0
        rows.append((None if r.random() < 0.02 else "hot" if r.random() < 0.9 else f"k{r.randrange(50)}", i, us))
    df = spark.createDataFrame(rows, "user string, n long, us long").withColumn("ts", F.timestamp_micros("us"))
    want, past = set(), {}
    for k, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        live = [x for x in past.get(k, []) if t - x < 60_000_000]
        want.add((k, i, len(live) < 3))
        past[k] = [*live, t] if len(live) < 3 else live
    got = A.rate_limit(df, "user", "ts", "n", 3, 60)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = A.rate_limit(df, "user", "ts", "n", 3, 60).where("user = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts == 4  # all of them


def test_pages_of_equal_rows_hold_each_row_once(spark):
    from palimpsest.operators import catalog as C

    rows = spark.createDataFrame([(i * 7 % 30, "same name", 5) for i in range(30)], "id int, name string, stars int")
    for parts in (1, 4):
        pages = [[r["id"] for r in C.catalog_page(rows.repartition(parts), "stars", at, 10, "id").collect()] for at in (0, 10, 20)]
        assert pages == [list(range(at, at + 10)) for at in (0, 10, 20)]


def test_nearest_neighbours_of_many_queries_equal_scores_of_all_pairs(spark, monkeypatch):
    import math
    import random

    from palimpsest.functions.vectors import METRICS, scaled
    from palimpsest.operators import neighbours

    random.seed(3)
    some = [[random.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(4)] for _ in range(25)]
    odd = [None, [], [1.0], [0.0] * 4, [1.0, None, 0.0, 0.0], [math.nan, 0.0, 0.0, 1.0], [math.inf, 1.0, 0.0, 0.0], [1e-180, 0.0, 0.0, 0.0], [1e200, 1e200, 0.0, 0.0]]
    rows = [(f"id{random.randrange(10**6)}", v, random.choice(("x", "y", None))) for v in [*some, *some, *some, *some, *odd, *odd]]
    vectors = spark.createDataFrame(rows, "id string, embedding array<double>, tag string")
    queries = spark.createDataFrame([(i % 30, *r[1:]) for i, r in enumerate(rows[::3] + rows[-18:])], "query_id long, query_vector array<double>, tag string")
    both = vectors.join(queries, "tag")
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    order = lambda r: (r["query_id"], r["rank"])
    for metric, mode, least, block in (("cosine", "raw", None, 10_000), ("cosine", "clamp", None, 7), ("dot", "unit", 0.5, 10_000), ("dot", "raw", None, 10_000), ("euclidean", "raw", -1.0, 9)):
        monkeypatch.setattr(S, "BROADCAST_QUERIES", block)
        raw = METRICS[metric](F.col("embedding"), F.col("query_vector"))  # null for pairs that can't be compared, whatever the mode
        score = both.where(raw.isNotNull()).withColumn("score", scaled(raw, mode))
        score = score.where(F.lit(True) if least is None else F.col("score") >= least).select("query_id", "id", "score")
        want = S.top_per(score, ["query_id"], 5, F.desc("score"), F.asc("id")).collect()
        got = S.knn_join(queries, vectors, ["tag"], 5, mode, metric, least).collect()
        plain = lambda out: [(r["query_id"], r["rank"], r["id"], repr(r["score"] + 0.0)) for r in sorted(out, key=order)]
        assert plain(got) == plain(want)


def test_pairs_ruled_out_by_bounds_are_not_scored(spark, monkeypatch):
    import numpy as np

    from palimpsest.operators import neighbours

    random, scored, exact = np.random.default_rng(1), [], neighbours._exact
    monkeypatch.setattr(neighbours, "_exact", lambda a, i, *x: scored.append(len(i)) or exact(a, i, *x))
    best = neighbours.Best(np.arange(100), neighbours.Side(random.normal(size=(100, 16))), 3)
    for _ in range(5):
        best.add(neighbours.Side(random.normal(size=(1000, 16))), np.arange(1000).astype(object), "cosine", "raw", None)
    assert sum(scored) < 500_000 // 100


def test_large_topics_are_paired_by_blocks(spark, monkeypatch):
    from palimpsest.operators import team as T

    monkeypatch.setattr(T, "TOPIC_BLOCK", 8)
    rows = [(1, "big", i * 3 % 100) for i in range(100)] + [(1, "big", 7), (1, "big", None), (2, "big", 5), (2, "big", 4), (None, "big", 1), (None, "big", 2), (1, None, 3), (1, None, 4), (1, "one", 9)]
    memory = spark.createDataFrame(rows, "user_id int, topic string, id long").coalesce(1)
    edges = T.topic_edges(memory)
    want = sorted((u, a, b, 0.8) for u, x, a in rows for v, y, b in rows if u == v and x == y and None not in (u, x, a, b) and a < b)
    assert sorted(tuple(r) for r in edges.collect()) == want
    most = edges.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).head()[0]
    assert most < len(want) / 2  # no task has a topic's pairs alone
