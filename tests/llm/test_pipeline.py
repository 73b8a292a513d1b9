"""The pipeline against plain Python, stage after stage."""

import random

import numpy as np
import regex

import corpus_pipeline as C
from palimpsest.llm import bpe

from . import helpers as H

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(11)
    word = lambda n: "".join(r.choices("abcdefgh", k=n))
    items = [(i, " ".join(word(5) for _ in range(15))) for i in range(4)]
    rows = []
    for i in range(60):
        lines = [" ".join(word(r.randrange(2, 8)) for _ in range(r.randrange(3, 25))) + "." for _ in range(r.randrange(1, 6))]
        if i % 4 == 0:
            lines.insert(1, " The license line of All.")
        if i % 13 == 5:
            lines.append("before " + items[i % 4][1] + " after")
        rows.append("\n".join(lines))
    rows += [rows[3], rows[7].upper(), rows[9] + " tail", None, "", "12 34 !!", "é", "<|endoftext|> " + word(4)]
    return [(i, t, r.choice(["en", "de", None]), "s", len(t or "")) for i, t in enumerate(rows)], items


def test_stages_against_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(r[0], r[1]) for r in rows if regex.search(r"\p{L}", r[1] or "")]
    docs = [(i, t) for i, t, _, _ in H.line_deduped(docs)]
    first = H.components(docs)
    docs = [(i, t) for i, t in docs if first[i] == i]
    found = H.decontaminated(docs, items)
    docs = [(i, t) for i, t in docs if not found[i][1]]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs}
    want = {(i, len(ids[i]), H.sha(np.array(ids[i], "<u4").tobytes()), H.sha(t)) for i, t in docs}
    got = C.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert all(np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids[r["doc_id"]] for r in got)
    assert 0 < len(want) < len(rows) - 5


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame(rows[:20], SCHEMA)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = docs.selectExpr("source", "doc_id", "text", "lang", "n_chars", "'x' AS digest", "'y' AS lang_pred", "'z' AS contaminated", "1 AS n_lines")
    none = docs.where("false")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0, name
    assert C.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_each_row_is_a_document(spark, tmp_path):
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "a text of some words"
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (None, text, "en", "s", 1), (1, text, None, "s", 1)], SCHEMA)
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).count() == 3, name
    # one of two equal rows stays; of two texts with id 5 the copy goes and the other one stays
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (5, text.upper(), "en", "s", 1), (5, "quite other words that nobody has", "en", "s", 1), (6, None, "en", "s", 0), (6, None, "en", "s", 0)]
    got = C.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in got) == sorted(["(1, 'a text of some words')", "(5, 'quite other words that nobody has')", "(6, None)", "(6, None)"])


def test_contaminated_rows_of_null_or_repeated_ids_go(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"x {item}", "en", "s", 1), (None, "clean", "en", "s", 1), (1, f"y {item}", None, "s", 1), (1, "clean too", None, "s", 1), (2, None, None, "s", 0)]
    got = C.benchmark(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "clean too"), ("2", "None"), ("None", "clean")]
