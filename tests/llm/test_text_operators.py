"""Line dedup, decontamination, near-dedup and top-k against SQL and brute force, and their edge cases."""

import random

import numpy as np
import pytest
from palimpsest.llm import decontaminate as D
from palimpsest.llm import line_dedup as L
from palimpsest.llm import near_dedup as N
from palimpsest.llm import queries as Q
from palimpsest.llm import top_k as K

from ..conftest import SMALL, same
from . import helpers as H


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SMALL), duck.sql(Q.ORACLE_SQL[name]))


LINES = [(i, f" Shared Line\t\nown {i}\n\nshared line") for i in range(12)] + [(20, None), (21, ""), (22, "\n"), (None, "shared line\nkeep"), (23, "SHARED LINE"), (0, " Shared Line\t\nown 0\n\nshared line"), (24, "É\né"), (25, "x\n" * 3000 + "shared line")]


def test_line_dedup(spark):
    got = L.line_dedup(spark.createDataFrame(LINES, H.DOCS)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(H.line_deduped(LINES), key=key)


def test_line_dedup_keeps_case_of_other_letters_apart(spark):
    docs = [(i, "É") for i in range(6)] + [(10 + i, "é") for i in range(6)]
    assert all(r["n_dropped"] == 0 for r in L.line_dedup(spark.createDataFrame(docs, H.DOCS)).collect())


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, None), (4, "..."), (None, "nobody's item here"), (5, "a b a b a b a b a b a b"), (1, "one two three four five six seven eight nine ten eleven")]
TEXTS = [(1, "x one two three four five six seven eight nine, TEN eleven y"), (2, "one two three four five six seven eight nine zehn"), (3, "a short-item, short item!"), (4, None), (5, ""), (6, "a b " * 40), (None, "Short item"), (1, "x one two three four five six seven eight nine, TEN eleven y"), (7, "nobody s item here"), (8, "déjà " * 10)]


def test_decontaminate(spark):
    got = D.decontaminate(spark.createDataFrame(TEXTS, H.DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    want = H.decontaminated([(n, t) for n, (_, t) in enumerate(TEXTS)], [("" if i is None else i, t) for i, t in ITEMS])
    key = lambda r: str(r)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in got], key=key) == sorted([(TEXTS[n][0], *want[n]) for n in want], key=key)


def test_proximity(spark):
    item = "alpha beta gamma delta"
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha x beta gamma delta"), (3, "alpha gamma beta delta zeta"), (4, "alpha beta gamma")], H.DOCS)
    found = lambda slop: {(r["doc_id"], r["exact"]) for r in D.find_matches(docs, spark.createDataFrame([(1, item)], "item_id int, text string"), slop=slop).collect()}
    assert found(0) == {(1, True)}
    assert {(1, True), (2, False), (3, False)} == found(1)


def test_no_documents_or_items(spark):
    none, items = spark.createDataFrame([], H.DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.decontaminate(none, items).count() == 0 and L.line_dedup(none).count() == 0 and N.near_duplicates(none).count() == 0
    assert K.top_k(none, items, query_id_col="item_id").count() == 0
    clean = D.decontaminate(spark.createDataFrame(TEXTS, H.DOCS), items.where("false"))
    assert not clean.where("contaminated").count() and clean.count() == len(TEXTS)


def near_copies(seed=5):
    r = random.Random(seed)
    base = [[f"w{r.randrange(4000)}" for _ in range(r.randrange(5, 120))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(r.randrange(1, 9)):
            own = list(b)
            for _ in range(r.randrange(0, 5)):
                own[r.randrange(len(own))] = f"n{r.randrange(9999)}"
            rows.append(" ".join(own) + (" " + " ".join(base[0][:4]) if r.random() < 0.3 else ""))
    rows += ["", None, "one two", "One  TWO", "é à", rows[0], rows[0].upper()]
    r.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


def test_near_duplicates(spark):
    rows = near_copies()
    got = {r["doc_id"]: r for r in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()}
    want = H.components(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(H.shingles(t)) and r["kept"] == (want[i] == i) for i, t in rows for r in [got[i]])


def test_large_nodes_branch(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 3)
    monkeypatch.setattr(N, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(N, "GROUP_BYTES", 1500)
    rows = near_copies(6)
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()} == H.components(rows)


@pytest.mark.parametrize(("few", "last"), [(1, 12), (2, 2)])
def test_nodes_of_few_besides_the_main_component_branch(spark, monkeypatch, few, last):
    for name, value in (("SMALL", 3), ("BLOCK_BYTES", 2000), ("GROUP_BYTES", 1500), ("FEW", few), ("LAST", last)):
        monkeypatch.setattr(N, name, value)
    saved = []
    monkeypatch.setattr(N.Workspace, "save", lambda self, df, name, *a, f=N.Workspace.save: (saved.append(name), f(self, df, name, *a))[1])
    rows = near_copies(6) + [(1000 + i, f"{t} end{i % 7}") for i, t in near_copies(7) if t]
    assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()} == H.components(rows)
    assert "down-0" in saved


def test_small_tables_take_few_tasks_whatever_the_shuffle(spark, monkeypatch):
    """Many shuffle partitions that aren't coalesced: tables of short rows have a file for what their rows need, not for each partition."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    files = {}
    monkeypatch.setattr(N.Workspace, "save", lambda self, df, name, *a, f=N.Workspace.save: (out := f(self, df, name, *a), files.setdefault(name, len(out.inputFiles())))[0])
    few, rows = 2 * spark.sparkContext.defaultParallelism, near_copies(8)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * few))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()} == H.components(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert all(0 < files[name] <= few for name in ("vertices", "nodes", "members", "often", "mixed-0", "at-0", "all-edges", "all-0", "all-1", "components"))


def test_a_component_of_many_blocks_is_one_vertex(spark, monkeypatch):
    """What several blocks of a component found alike is one edge of the components: their rows grow with the vertices, not with vertices times blocks."""
    found = {}
    monkeypatch.setattr(N.Workspace, "save", lambda self, df, name, *a, f=N.Workspace.save: (out := f(self, df, name, *a), found.setdefault(name, out.count()))[0])
    join = object.__new__(N._Join)
    join.work, join.rows = N.Workspace(spark, "merged"), 100
    name = lambda i: bytes([i])
    labels = spark.createDataFrame([(name(i), name(i // 30 * 30)) for i in range(60)], "digest binary, label binary")
    links = spark.createDataFrame([(name(i), name(80 + j)) for i in range(30, 60) for j in range(4)] + [(name(90), name(91))], "a binary, b binary")
    got = {bytes(x["digest"])[0]: bytes(x["label"])[0] for x in join.merged(labels, links).collect()}
    assert got == {i: i // 30 * 30 for i in range(60)} | {80 + j: 30 for j in range(4)} | {90: 90, 91: 90}
    assert found["joined"] == 5 and found["all-edges"] == 10


def test_chains_are_one_component(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w[i : i + 40])) for i in range(16)]  # neighbours are alike, ends are not
    assert {r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()} == {0}


def test_without_broadcasts(spark, monkeypatch):
    """Terms beyond the bound of a broadcast: words are shuffled, and no row holds more of its text than a window can reach."""
    monkeypatch.setattr(D, "checked_broadcast", lambda df: df)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = random.Random(5)
        words = [f"w{r.randrange(400)}" if i % 3 else "the" for i in range(60_000)]
        rows = [(1, " ".join(words)), (2, "the the the"), (None, " ".join(words[100:140])), (4, None)]
        items = [(1, " ".join(words[30_000:30_014])), (2, " ".join(words[:9])), (3, "the the the the"), (4, "not there at all"), (5, "the")]
        docs, items_ = spark.createDataFrame(rows, H.DOCS), spark.createDataFrame(items, "item_id int, text string")
        got = {x["doc_id"]: (x["n_words"], x["n_hit"], list(x["item_ids"])) for x in D.decontaminate(docs, items_).collect()}
        assert got == H.decontaminated(rows, items)
        assert D.decontaminate(docs, items_.where("false")).where("contaminated").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g"
    got = N.near_duplicates(spark.createDataFrame([(None, text), (5, text), (5, text), (3, text), (3, "other words here now ok"), (4, None)], H.DOCS)).collect()
    want = [(None, 3, None, True), (5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (3, 1, 3, True), (4, 0, 4, True)]
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert sorted(str((r["doc_id"], r["n_shingles"])) for r in got if r["representative"]) == ["(3, 1)", "(3, 3)", "(4, 0)", "(None, 3)"]


def test_top_k_against_brute_force(spark):
    import math

    r = random.Random(3)
    vocab = [f"t{int(r.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 80)))) for i in range(700)] + [(1000, None), (1001, "")]
    docs += [(2000 + i, docs[5][1]) for i in range(30)]  # ties
    queries = [(q, " ".join(r.choice(vocab) for _ in range(r.randrange(1, 12)))) for q in range(15)] + [(90, None), (91, "unknownword"), (92, "...")]
    tokens = {i: H.words(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = set()
    for q, text in queries:
        scores = []
        for i, t in tokens.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in H.words(text) if w in t)
            if any(w in t for w in H.words(text)):
                scores.append((-round(s, 9), i))
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:10])}
    got = K.top_k(spark.createDataFrame(docs, H.DOCS).repartition(3), spark.createDataFrame(queries, "query_id long, text string"))
    assert {(r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in got.collect()} == {(q, k, i, round(s, 6)) for q, k, i, s in want}


def test_blocks_are_skipped_for_queries_of_any_length():
    """Documents of topics, one topic after the other: long and short queries score the blocks of their topic only, and find what a full scan does."""
    r = np.random.default_rng(4)
    n, n_terms = 6400, 2000
    text, term = [], []
    for d in range(n):
        own = r.choice(100, 40, replace=False) + 100 * (d // 640) if d % 7 else r.choice(n_terms, 40, replace=False)
        text += [d] * 40
        term += np.sort(own).tolist()
    text, term = np.array(text), np.array(term)
    score = r.random(len(text)) + 0.5
    shard = K._Shard(text, term, score, n, n_terms)
    for length in (2, 3, 12, 40, 80):
        for _ in range(5):
            own = np.sort(r.choice(100, length, replace=False) + 300)
            times = r.integers(1, 3, length)
            weight = np.zeros(n_terms)
            weight[own] = times
            full = np.bincount(text, weights=score * weight[term], minlength=n)
            heap = []
            done, total = shard.search(own, times, 10, heap, list(range(n)), K._Last)
            want = sorted(((-round(full[d], 9), d) for d in range(n) if full[d] > 0))[:10]
            assert sorted((-s, d) for s, _, d in heap) == want
            assert done <= 20 and 2 * done < total, (length, done, total)
            again = shard.search(own, times, 10, heap, list(range(n, 2 * n)), K._Last)[0]
            assert again <= done


def test_batches_of_long_queries_find_what_a_full_scan_does():
    """Ties and scores a hair apart too; blocks that no query of the batch reaches stay unscored."""
    r = np.random.default_rng(6)
    n, n_terms = 6400, 2000
    text, term = [], []
    for d in range(n):
        own = r.choice(100, 40, replace=False) + 100 * (d // 640) if d % 7 else r.choice(n_terms, 40, replace=False)
        text += [d] * 40
        term += np.sort(own).tolist()
    text, term = np.array(text), np.array(term)
    score = np.round(r.random(len(text)), 1) + 0.5 + 1e-7 * r.integers(0, 2, len(text))
    shard = K._Shard(text, term, score, n, n_terms)
    wanted = [(own, r.integers(1, 4, len(own))) for _ in range(20) for own in [np.sort(r.choice(100, 60, replace=False) + 300)]]
    heaps = [[] for _ in wanted]
    shard.search_batch(wanted, 10, heaps, list(range(n)), K._Last)
    for (own, times), heap in zip(wanted, heaps, strict=True):
        weight = np.zeros(n_terms)
        weight[own] = times
        full = np.bincount(text, weights=score * weight[term], minlength=n)
        assert sorted((-s, d) for s, _, d in heap) == sorted((-round(full[d], 9), d) for d in range(n) if full[d] > 0)[:10]
    done, total = shard.search_batch(wanted, 10, heaps, list(range(n, 2 * n)), K._Last)
    assert done <= 20 and 2 * done < total


def test_documents_as_queries_in_blocks(spark, duck, monkeypatch):
    monkeypatch.setattr(K, "QUERY_TERMS", 900)
    got = Q.QUERIES["op9_top_k_documents"](spark, SMALL)
    assert {r["query_id"] for r in got.select("query_id").distinct().collect()} == {i for (i,) in duck.sql("SELECT doc_id FROM documents WHERE doc_id % 20 = 0 AND regexp_matches(text, '[a-z]')").fetchall()}
    same(got, duck.sql(Q.ORACLE_SQL["op9_top_k_documents"]))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"some words of document {i} here\nx", "en", "s", 9, "w", "l", "d", 0.5, "i", 1, "a", "n", 2) for i in range(4)], H.CLASHING)
    items = spark.createDataFrame([(1, "words of document", "x")], "item_id int, text string, term string")
    assert D.decontaminate(docs, items).where("contaminated").count() == 4
    assert L.line_dedup(docs, min_docs=4).where("n_dropped = 1").count() == 4
    assert L.line_dedup(docs, keep=("lang", "words")).columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "words"]
    assert N.near_duplicates(docs).count() == 4
    assert K.top_k(docs, items.withColumnRenamed("item_id", "query_id")).count() == 4


def test_very_long_texts(spark):
    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    item = " ".join(words[30_000:30_012])
    other = [w if i % 40 else f"n{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "short text of a few words"), (4, " ".join(words).upper())]
    docs = spark.createDataFrame(rows, H.DOCS)
    got = {x["doc_id"]: (x["n_words"], x["n_hit"]) for x in D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    want = H.decontaminated(rows[:1], [(1, item)])
    assert got[1] == got[4] == want[1][:2] and got[2][0] == 60_000 and got[3][1] == 0
    assert {x["doc_id"]: x["component_id"] for x in N.near_duplicates(docs).collect()} == H.components(rows)
    best = K.top_k(docs, spark.createDataFrame([(7, item)], "query_id int, text string"), k=2).collect()
    assert {x["doc_id"] for x in best} == {1, 4}


def test_ties_in_the_last_bits_go_by_the_id(spark):
    # the same words in another order: sums may differ in the last bit, the rounded scores don't
    r = random.Random(2)
    vocab = [f"t{i}" for i in range(30)]
    rows = [(i, " ".join(r.sample(vocab, 30))) for i in range(40)]
    for k in (3, 7):
        got = K.top_k(spark.createDataFrame(rows, H.DOCS).repartition(5), spark.createDataFrame([(1, " ".join(vocab[:9])), (2, " ".join(vocab))], "query_id int, text string"), k=k).collect()
        assert {(x["query_id"], x["rank"], x["doc_id"]) for x in got} == {(q, n + 1, n) for q in (1, 2) for n in range(k)}


def test_recall_at_the_threshold(spark):
    """Groups whose members are just above and below the threshold, against all pairs."""
    r = random.Random(12)
    rows = []
    for g in range(30):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(25):
            own = list(base)
            for at in r.sample(range(120), r.choice((1, 2, 3, 4, 5))):
                own[at] = f"x{r.random()}"
            rows.append((len(rows), " ".join(own)))
    got = {x["doc_id"]: x["component_id"] for x in N.near_duplicates(spark.createDataFrame(rows, H.DOCS)).collect()}
    assert got == H.components(rows)
