"""Vector near-dedup and vector codes against plain NumPy and Python."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import queries as Q
from palimpsest.llm import vector_codes as C
from palimpsest.llm import vector_dedup as D
from palimpsest.llm import vector_rows as R

from ..conftest import SMALL, same

VECTORS = "vec_id long, embedding array<float>, label int"
#: Other columns have names that the operators use themselves.
CLASHING = "vec_id long, embedding array<double>, label string, digest string, n_links long, component_id long, code string, list string, error long, side int, id int, vec string, size int"


@pytest.mark.parametrize("name", ["op11_vector_dedup", "op12_vector_codes", "op13_fill_in_middle"])
def test_query_equals_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SMALL), duck.sql(Q.ORACLE_SQL[name]))


def linked(rows, least=0.9):
    """[(vec_id, n_links, component_id)] of all pairs of rows (vec_id, vector)."""
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)
    good = [v is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = [R.unit(np.array([v], float))[0] if g else None for (_, v), g in zip(rows, good, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    ids = {}
    for i in range(n):
        if good[i]:
            ids[find(i)] = min(rows[i][0], ids.get(find(i), rows[i][0]))
    return sorted(((v, links[i], ids[find(i)] if good[i] else v) for i, (v, _) in enumerate(rows)), key=str)


def found(spark, rows, schema="vec_id long, embedding array<double>", **k):
    out = D.near_vectors(spark.createDataFrame(rows, schema), **k).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def turned(r, x, cosine):
    """A unit vector of that cosine to the unit vector x."""
    e = r.normal(size=len(x))
    e -= (e @ x) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * e / np.linalg.norm(e)


def test_groups_of_every_kind(spark):
    r = np.random.default_rng(3)
    base, rows = R.unit(r.normal(size=(60, 24))), []
    for i, x in enumerate(base):
        rows.append(x)
        if i % 3 == 0:
            rows += [turned(r, x, c) for c in (0.85, 0.899, 0.901, 0.95, 0.99)]
    rows += [turned(r, base[0], 0.98) for _ in range(40)]  # a ball, and what lies around it
    rows += [turned(r, base[0], c) for c in np.linspace(0.75, 0.97, 40)]
    for _ in range(30):  # a chain
        rows.append(turned(r, rows[-1], 0.93))
    rows += [base[1] * 3, base[2] * 1e-200, base[3] * 1e200, base[4], base[4]]
    rows = [(7 * i % 1009, [float(v) for v in x]) for i, x in enumerate(rows)]
    assert found(spark, rows) == linked(rows)


def test_blocks_and_few_pivots(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 16)
    r = np.random.default_rng(4)
    x = R.unit(r.normal(size=(1, 16)))[0]
    rows = [(i, [float(v) for v in turned(r, x, c)]) for i, c in enumerate(np.linspace(0.6, 1, 150))]
    monkeypatch.setattr(D, "SAMPLE", 3)
    assert found(spark, rows) == linked(rows)
    monkeypatch.setattr(D, "SAMPLE", 1)
    monkeypatch.setattr(D, "pivots_of", lambda sample, least: np.zeros((0, sample.shape[1])))
    assert found(spark, rows) == linked(rows)


def test_recall_at_the_threshold(spark):
    """Pairs of just 0.9 among many others, none in a ball: the sample is far smaller than the table."""
    r = np.random.default_rng(5)
    base = R.unit(r.normal(size=(4000, 64)))
    partner = np.stack([turned(r, x, 0.9005) for x in base])
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.vstack([base, partner]))]
    got = found(spark, rows)
    hit = sum(n > 0 for _, n, _ in got) / len(got)
    assert hit > 0.96 and all(n <= 1 for _, n, _ in got) and all(c in (i, i - 4000) for i, _, c in got)


def test_a_third_of_all_rows_is_one_group(spark):
    r = np.random.default_rng(6)
    x = R.unit(r.normal(size=(1, 64)))[0]
    rows = [(i, [float(v) for v in turned(r, x, 0.985)]) for i in range(800)] + [(800 + i, [float(v) for v in x]) for i in range(800)]
    rows += [(1600 + i, [float(v) for v in y]) for i, y in enumerate(r.normal(size=(1600, 64)))]
    got = {i: (n, c) for i, n, c in found(spark, rows)}
    assert all(got[i] == (1599, 0) for i in range(1600)) and all(got[i] == (0, i) for i in range(1600, 3200))


def test_odd_vectors(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0]), (11, [-0.0, 5.0]), (12, [0.0, 5.0]), (None, None)]
    assert found(spark, odd) == linked(odd)
    assert found(spark, []) == [] and found(spark, odd[:1]) == [(1, 0, 1)]
    df = spark.createDataFrame([(1, [1.0, 2.0], *[None] * 11), (2, [1.0, 2.0], "x", "d", 5, 5, "c", "l", 1, 1, 1, "v", 1)], CLASHING)
    assert [tuple(r) for r in D.near_vectors(df).orderBy("vec_id").collect()] == [(1, 1, 1, True), (2, 1, 1, False)]
    assert {(r["label"], r["label_error"]) for r in C.compressed(df)[0].collect()} == {(None, 0), ("x", 0)}


def coded(rows, parts=16, entries=64, rounds=2, scale=256):
    """The codes of rows (vec_id, label, vector) without null ids, by comparing each part with each entry."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, _, v in kept), default=0) // parts))
    cut = lambda v: [(v + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)]
    kept = [(i, label, cut(v)) for i, label, v in kept]
    books = [[v[p] for _, _, v in sorted(kept, key=lambda r: (r[0], r[2]))[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(v[p], books[p])[1] for _, _, v in kept]
            new = []
            for j, e in enumerate(books[p]):
                mine = [v[p] for (_, _, v), o in zip(kept, own, strict=True) if o == j]
                new.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else e)
            books[p] = new
    out = [(i, label, [near(v[p], books[p]) for p in range(parts)]) for i, label, v in kept]
    total = {}
    for _, label, found in out:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, bytes(j for _, j in f).hex(), sum(d for d, _ in f), total[label]) for i, label, f in out), key=str), sha


def codes(spark, rows, schema="vec_id long, label int, embedding array<double>"):
    df, books = C.compressed(spark.createDataFrame(rows, schema))
    return sorted(((r["vec_id"], bytes(r["code"]).hex(), r["error"], r["label_error"]) for r in df.collect()), key=str), books.sha256()


def test_codes_against_plain_python(spark):
    r = np.random.default_rng(7)
    rows = [(int(i), None if i % 5 == 0 else int(i % 3), [float(x) for x in r.normal(size=32).round(1) * (1 + i % 4)]) for i in r.permutation(150)]
    rows += rows[:5] + [(3, 1, rows[9][2]), (1000, 1, None), (1001, 1, [None] * 32), (1002, None, [math.inf] * 32), (1003, 2, [math.nan] * 32), (1004, 2, [0.0] * 32)]
    assert codes(spark, rows) == coded(rows)


def test_codes_of_odd_tables(spark):
    few = [(5, 1, [1.0, -2.5]), (4, 1, [0.1] * 17), (6, None, [])]
    assert codes(spark, few) == coded(few)
    df, books = C.compressed(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))
    assert df.count() == 0
    df, books = C.compressed(spark.createDataFrame([(None, 1, [0.5] * 16)], "vec_id long, label int, embedding array<float>"))
    assert [tuple(r)[2:] for r in df.collect()] == [(bytearray(16), 16 * 128**2, 16 * 128**2)]
    large = [(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16)]
    assert len(codes(spark, large)[0]) == 2


def test_decoding(spark):
    rows = [(i, 1, [float(i * 16 + j) / 256 for j in range(32)]) for i in range(40)]
    df, books = C.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    got = df.select("vec_id", "error", books.decode(df["code"]).alias("x")).collect()
    assert all(r["error"] == 0 and list(r["x"]) == rows[r["vec_id"]][2] for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.tuples(st.lists(st.lists(st.integers(-40, 40), min_size=w, max_size=w), min_size=1, max_size=70), st.lists(st.lists(st.integers(-60, 60), min_size=w, max_size=w), min_size=1, max_size=20))))
def test_annuli_find_the_nearest(case):
    entries, x = (np.array(a, np.int64) for a in case)
    index, distance, evaluated = C.Annuli(entries).nearest(x)
    every = ((x[:, None] - entries) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (index == every.argmin(1)).all() and evaluated <= every.size


def test_annuli_leave_most_entries_out():
    r = np.random.default_rng(8)
    norm = np.arange(1, 65)[:, None] * 100
    entries = np.floor(R.unit(r.normal(size=(64, 4))) * norm).astype(np.int64)
    x = entries[r.integers(0, 64, 500)] + r.integers(-5, 5, (500, 4))
    assert C.Annuli(entries).nearest(x)[2] < 500 * 12
