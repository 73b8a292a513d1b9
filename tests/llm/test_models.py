"""Language ID, quality and toxicity: held-out accuracy, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language_id as I
from palimpsest.llm import quality as Qu
from palimpsest.llm import queries as Q
from palimpsest.llm import text_bytes as B
from palimpsest.llm import toxicity as X

from . import helpers as H

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "12 !"), (4, "a"), (None, "The end of it."), (5, "word " * 200_000), (4, "a"), (6, "é")]


def joined(spark, name, table):
    rows = Q.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/{table}.parquet"), "doc_id").where("held_out").toPandas()
    return rows


def auc(score, label):
    neg = np.sort(score[label == 0])
    return np.searchsorted(neg, score[label == 1]).mean() / len(neg)


def test_language_of_held_out_documents(spark):
    rows = joined(spark, "op2_language_id", "documents")
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.98 and rows["score"].between(0, 1).all()


def test_quality_of_held_out_documents(spark):
    rows = joined(spark, "op3_quality", "labels")
    assert auc(rows["score"].values, rows["quality"].values) > 0.9
    assert rows.loc[rows["quality"] == 1, "predicted"].mean() > 0.85


def test_toxicity_of_held_out_documents(spark):
    rows = joined(spark, "op4_toxicity", "labels")
    assert rows.loc[rows["toxic"] == 0, "predicted"].mean() < 0.1 and auc(rows["score"].values, rows["toxic"].values) > 0.7


def test_offending_sentences_are_found():
    r = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(600):
        s = [" ".join(r.choice(vocab, 8)) for _ in range(5)]
        if i % 4 == 0:
            s[int(r.integers(5))] += " scoundrel"
        texts.append((". ".join(s) + ".").encode())
        y.append(int(i % 4 == 0))
    model = X.Model()
    model.fit(texts, np.array(y, float))
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    p, found = model.score(raw, at, 0.5)
    assert ((p >= 0.5) == (np.array(y) == 1)).mean() > 0.99
    assert all("scoundrel" in s["sentence"] for f in found for s in f)
    assert all(texts[i][s["begin"] :].decode().lstrip(". ").startswith(s["sentence"].lstrip(". ")) for i, f in enumerate(found) for s in f)


def test_odd_rows(spark):
    odd = spark.createDataFrame(ODD, H.DOCS)
    filters = I.learn(spark.createDataFrame([(i, f"the end of it and the word {i}", "en") for i in range(20)] + [(50 + i, f"das ende von dem und das wort {i}", "de") for i in range(20)] + [(99, None, "fr"), (98, "x", None)], "doc_id long, text string, lang string"))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in I.identify(odd, filters).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= got and (None, "en") in {g[:2] for g in got} and I.identify(odd, filters).count() == len(ODD)
    for rows in (Qu.score(odd, Qu.Network()).collect(), X.score(odd, X.Model()).collect()):
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    none = odd.where("false")
    assert I.identify(none, filters).count() == Qu.score(none, Qu.Network()).count() == X.score(none, X.Model()).count() == 0
    assert I.identify(odd, I.learn(none.withColumn("lang", F.lit("x")))).where("lang_pred != 'und'").count() == 0


def test_more_than_64_languages(spark):
    rows = [(i, " ".join(f"l{i:02d}x{j:02d}" for j in range(40)).replace("0", "q").replace("1", "v"), f"l{i:02d}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = I.identify(docs, I.learn(docs))
    assert len(got.head()["matches"]) == 70


def test_network_reads_whole_texts():
    r = np.random.default_rng(1)
    texts = [b"", b"ab", b"abcde", b"x" * 300] + [bytes(r.integers(32, 127, int(n), dtype=np.uint8)) for n in [*r.integers(0, 2000, 30), 200_000, 65_536, 65_540]]
    raw, at, net = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), Qu.Network()
    tables = net.tables()

    def plain(text):
        x = np.frombuffer(text, np.uint8)
        if not len(x):
            return net.head(np.zeros((1, Qu.FILTERS)))[1][0]
        x = np.pad(x, (0, max(0, Qu.WIDTH - len(x))))
        v = sum(tables[k][x[k : len(x) - Qu.WIDTH + 1 + k]] for k in range(Qu.WIDTH))
        tops = [np.maximum(0, v[i : i + Qu.CHUNK].max(0)) for i in range(0, len(v), Qu.CHUNK)]
        return net.head(np.mean(tops, 0)[None])[1][0]

    assert np.allclose(net.score(raw, at), [plain(t) for t in texts], atol=1e-5)


def test_gradients():
    net, r = Qu.Network(), np.random.default_rng(2)
    x, owner, y = r.integers(0, 256, (6, Qu.CHUNK + Qu.WIDTH - 1)).astype(np.uint8), np.array([0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    g = net._gradients(x, owner, y)

    def loss():
        values = sum(net.tables()[t].astype(float)[x[:, t : t + Qu.CHUNK]] for t in range(Qu.WIDTH))
        top = np.maximum(0, values.max(1) + net.p["bias"])
        p = net.head(np.stack([top[owner == d].mean(0) for d in range(3)]))[1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, at in (("bias", (3,)), ("hidden", (2, 1)), ("out", (0,)), ("filters", (1, 2, 3)), ("embed", (int(x[0, 5]), 1))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-4
        up = loss()
        net.p[name][at] = old - 1e-4
        down = loss()
        net.p[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_segments_share_a_text_without_losing_windows(monkeypatch):
    monkeypatch.setattr(B, "SEGMENT", 7)
    offsets = np.array([0, 3, 3, 20, 21])
    seen = [[] for _ in range(4)]
    for a, _, texts, begin, end in B.segments(offsets, 3):
        for d, x, y in zip(range(texts.start, texts.stop), begin, end, strict=True):
            seen[d] += range(a + x, a + y)
    assert seen == [[], [], list(range(3, 17)), []]


def toxic_model(seed=3):
    model = X.Model()
    model.weights[:] = np.random.default_rng(seed).normal(0, 2, len(model.weights))
    model.bias, model.leak = -2.0, 0.02
    return model


def noisy_or(model, text: bytes) -> float:
    """Word by word, sentence by sentence."""
    import math
    import re

    clean = 1 - model.leak
    for sentence in re.split(rb"[.!?\n]", text):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", sentence)
        if words:
            bucket = lambda w: X._words(np.frombuffer(w, np.uint8), np.zeros(1, int))[0][0]
            z = model.bias + sum(float(model.weights[bucket(w)]) for w in words)
            clean *= 1 - 1 / (1 + math.exp(-max(-30, min(30, z))))
    return 1 - clean


def random_texts(seed, n, longest=400):
    r = np.random.default_rng(seed)
    letters = np.frombuffer("abcdeéAB .!?\n 1".encode(), np.uint8)
    texts = ["".join(r.choice(list("abcdeéAB .!?\n 1"), int(k))) for k in r.integers(0, longest, n)]
    assert len(letters)
    return [t.encode() for t in [*texts, "", "no end", ". . !", "é"]]


def laid_out(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_toxicity_against_plain_python():
    model, texts = toxic_model(), random_texts(1, 40)
    assert np.allclose(model.score(*laid_out(texts), 2.0)[0], [noisy_or(model, t) for t in texts], atol=1e-9)


def test_toxicity_is_the_same_in_any_company(monkeypatch):
    model = toxic_model()
    texts = random_texts(2, 30) + [b"x" * 900 + b" alone. " + b"word " * 300, b"one. two. " * 200]
    for size in (50, 333, 10**6):
        monkeypatch.setattr(X, "SEGMENT", size)
        alone = [model.score(*laid_out([t]), 0.5) for t in texts]
        p, found = model.score(*laid_out(texts), 0.5)
        assert p.tolist() == [a[0][0] for a in alone]  # to the last bit
        assert found == [a[1][0] for a in alone]
        back, _ = model.score(*laid_out(texts[::-1]), 0.5)
        assert back[::-1].tolist() == p.tolist()
        assert np.allclose(p, [noisy_or(model, t) for t in texts], atol=1e-9)


def test_toxicity_does_not_depend_on_the_row_before(spark):
    text, model = "alpha beta scoundrel gamma delta epsilon", X.Model()
    model.weights[X._words(np.frombuffer(b"scoundrel", np.uint8), np.zeros(1, int))[0][0]] = 12
    scores = set()
    for n in (10, 1_999_970, 1_999_986):
        rows = spark.createDataFrame([(1, "a" * n), (2, text)], H.DOCS).coalesce(1)
        scores.add(X.score(rows, model).where("doc_id = 2").head()["score"])
    assert len(scores) == 1 and scores.pop() > 0.99


def test_language_counts_against_plain_python():
    r = np.random.default_rng(4)
    own = {k: r.integers(0, 2**32, 300) for k in ("en", "fr", "de")}
    texts = random_texts(5, 20, 200)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    own["en"] = np.concatenate([own["en"], I._grams(raw[0]), I._grams(raw[1])])
    filters = I.Filters(list(own), [g.astype(np.int64) for g in own.values()])
    set_cells = {k: {(int(g) * m % 2**32) >> (32 - I.CELL_BITS) for g in own[k] for m in I._MULTIPLIERS} for k in own}
    got = filters.counts(*laid_out(texts))
    for d, t in enumerate(texts):
        x = [c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else c if c >= 128 else 32 for c in t]
        grams = [int.from_bytes(bytes(x[i : i + I.N]), "big") for i in range(len(x) - I.N + 1)]
        for i, k in enumerate(own):
            false = (len(set_cells[k]) / 2**I.CELL_BITS) ** 2
            hits = sum(all((g * m % 2**32) >> (32 - I.CELL_BITS) in set_cells[k] for m in I._MULTIPLIERS) for g in grams)
            assert abs(got[d, i] - max(0, hits - len(grams) * false) / (1 - false)) < 1e-9


def test_long_texts_teach_too(spark):
    long = "palabra larga y mucho texto en una sola fila " * 3000
    docs = spark.createDataFrame([(1, long, "es")] + [(10 + i, f"the short words of line {i}", "en") for i in range(5)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in I.identify(docs, I.learn(docs)).collect()}
    assert got[1] == "es" and got[12] == "en"
    chunks, doc = Qu.chunked([b"", b"abc", bytes(range(256)) * 5])
    assert np.bincount(doc).tolist() == [1, 1, 5] and chunks[2 + 4, : 256].tobytes() == bytes(range(256))


def test_samples_are_bounded_by_rows_and_bytes_whatever_the_sizes(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('x', CAST(50 + id % 2 * 3000 AS INT)) AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    every = B.labelled(docs, labels, "quality", 10_000, 10**9).collect()
    fewer = B.labelled(docs, labels, "quality", 10_000, 100_000).collect()
    assert len(every) == 400 - docs.where(B.crc_mod(F.col("doc_id"), 4) == 2).count()
    assert 20_000 < sum(len(r["text"]) for r in fewer) < 300_000 and {len(r["text"]) for r in fewer} == {50, 3050}
    assert 20 < len(B.labelled(docs, labels, "quality", 60, 10**9).collect()) < 120


def test_an_id_of_many_rows_does_not_fill_the_sample(spark):
    docs = spark.range(100_000).selectExpr("CAST(7 AS LONG) AS doc_id", "concat('text ', id) AS text").union(spark.range(50).selectExpr("id + 100 AS doc_id", "concat('other ', id) AS text"))
    docs = docs.union(spark.sql("SELECT CAST(9 AS LONG), repeat('x', 5000000)")).union(spark.range(1000).selectExpr("CAST(8 AS LONG)", "'same'"))
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    rows = B.labelled(docs, labels, "quality", 60, 1_000_000).collect()
    assert 5 <= len(rows) < 200 and sum(len(r["text"]) for r in rows) < 1_200_000 and sum(r["text"] == "same" for r in rows) <= 1


def test_equal_texts_have_equal_scores_among_odd_columns(spark):
    rows = [(i, t, "en", "s", 1, "w", "l", "d", 0.5, "i", 1, "a", "n", 2) for i, t in enumerate(["some words here", None, "", "some words here", "x" * 50, None, ""])]
    docs = spark.createDataFrame(rows, H.CLASHING).repartition(3)
    filters = I.learn(docs.select("doc_id", "text", "lang"))
    for out, column in ((I.identify(docs, filters), "lang_pred"), (I.identify(docs, filters), "score"), (Qu.score(docs, Qu.Network()), "score"), (X.score(docs, toxic_model()), "score")):
        got = {r["doc_id"]: r[column] for r in out.collect()}
        assert got[0] == got[3] and got[1] == got[2] == got[5] == got[6]
