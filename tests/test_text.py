import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions import vocabularies as V
from palimpsest.functions.chats import chat_pairs
from palimpsest.functions.chunks import chunks_of
from palimpsest.functions.pages import Page, page_paragraphs
from palimpsest.operators.search import contained


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).head()["x"]


def test_source_lines(spark):
    got = one(spark, X.source_queries(F.col("a")), a="  Event :: dentist on the 3rd\n\nimage::\nweather::sunny\nIMAGE::a map::of Lyon\nplain words\n")
    assert [tuple(r) for r in got] == [("event", "dentist on the 3rd"), ("image", "a map::of Lyon")]


def test_profile_lines(spark):
    got = one(spark, X.profile_facts(F.col("a")), a="interest::music::ignored\n---\nInterest::Instruments::cello::since 2011\npets::two cats\n::city::Porto\ncontact_info::city::  Porto ")
    assert [tuple(r) for r in got] == [("interest", "instruments", "cello::since 2011"), ("contact_info", "city", "Porto")]


def test_event_blocks(spark):
    text = "Date: 09-17\nTIME: 18:30\nevent_name: Choir rehearsal\n---\nDESC: nothing fixed\n---\nEVENT_NAME: Marathon\nDATE: 10-02\nDATE: 10-04\nYEAR: 2031"
    got = one(spark, X.event_blocks(F.col("a")), a=text)
    assert [(r["date"], r["event_name"], r["time"], r["year"]) for r in got] == [("09-17", "Choir rehearsal", "18:30", None), ("10-04", "Marathon", None, "2031")]
    assert one(spark, X.event_blocks(F.col("a")), a="no_event here\nDATE: 09-17") == []


def test_image_block(spark):
    text = "notes\nDescription: Harbour at dusk\nOBSERVATIONS:\n-[Boats] three trawlers (confidence: Medium)\n-  a lighthouse\nnot a bullet\n-"
    got = one(spark, X.image_analysis(F.col("a")), a=text)
    assert got["description"] == "Harbour at dusk"
    assert [tuple(r) for r in got["observations"]] == [("boats", "three trawlers", "medium"), ("other", "a lighthouse", None)]


def test_fenced_json(spark):
    rows = '{"annotations": [{"annotation_type": "todo", "severity": "high", "content": "drop the shim"}, {"annotation_type": "poem", "severity": "awful", "content": null}]}'
    for text in (rows, f"Sure.\n```\n{rows}\n```\nbye", f"```json\n{rows}```"):
        got = one(spark, X.code_annotations(F.col("a")), a=text)
        assert [(r["annotation_type"], r["severity"], r["content"]) for r in got] == [("todo", "high", "drop the shim"), ("explanation", None, "")]
    assert one(spark, X.code_annotations(F.col("a")), a="{]") == [] == one(spark, X.code_annotations(F.col("a")), a="{}")
    many = ",".join(f'"t{i}"' for i in range(14))
    got = one(spark, X.code_snippets(F.col("a")), a='{"snippets": [{"content": " heap sort ", "tags": [' + many + ']}, {"content": ""}, {"content": "x", "tags": "one; two, three,", "snippet_type": "config"}]}')
    assert [(r["content"], r["snippet_type"], len(r["tags"])) for r in got] == [("heap sort", "algorithm", 10), ("x", "config", 2)] and got[1]["tags"] == ["one; two", "three"]
    assert one(spark, X.tag_list(F.col("a")), a=" , graph,dfs ,") == ["graph", "dfs"]


def test_bullets(spark):
    assert one(spark, X.bullets(F.col("a")), a="• moved to Oslo\n   \n-- wants a quiet flat   \nplain") == ["moved to Oslo", "wants a quiet flat", "plain"]


@pytest.mark.parametrize(("content", "main", "sub"), [("Interest / board games = Go and chess", "interest_board_games", "Go and chess"), ("3 = x", "", "3 = x"), ("  nothing to split ", "", "nothing to split"), ("p / q = r = s", "p_q", "r = s")])
def test_structured(spark, content, main, sub):
    assert tuple(one(spark, X.structured(F.col("a")), a=content)) == (main, sub)


def test_pipe_records(spark):
    assert tuple(one(spark, X.event_fields(F.col("a")), a="12-24|Dinner| at Ana's || 19:00 |")) == ("12-24", "Dinner", "at Ana's", None, "19:00", None)
    assert tuple(one(spark, X.snippet_fields(F.col("a")), a="Retry with jitter | sleep(r()) | lua | utility | net")) == ("Retry with jitter", "sleep(r())", "lua", "utility", "net")
    assert tuple(one(spark, X.snippet_fields(F.col("a")), a="only | two")) == ("only | two", "", "", "algorithm", "")
    got = one(spark, X.annotation_fields(F.col("a")), a="todo | Cache.evict | lib/cache.rs | store | low | counts twice")
    assert (got["annotation_type"], got["target_symbol"], got["target_file"], got["severity"], got["content"]) == ("todo", "Cache.evict", "lib/cache.rs", "low", "counts twice")
    assert one(spark, X.annotation_fields(F.col("a")), a="warning | slow | on Mondays")["content"] == "slow | on Mondays"


def test_urls_and_paths(spark):
    assert one(spark, X.provider(F.lit(None).cast("string"), F.col("a")), a="https://gemini.google.com/share/7") == "gemini"
    assert tuple(one(spark, X.github_repo(F.col("a")), a=" git@github.com:heron/nest.git ")) == ("heron", "nest")
    assert tuple(one(spark, X.github_repo(F.col("a")), a="https://example.org/heron/nest")) == (None, None)
    assert tuple(one(spark, X.fast_path(F.col("a")), a="'lib/nest/egg.go'")) == ("lib/nest/egg.go", None, False)
    assert tuple(one(spark, X.fast_path(F.col("a")), a="lib/egg.go#Hatch")) == ("lib/egg.go", "Hatch", False)
    assert tuple(one(spark, X.fast_path(F.col("a")), a="what does the nest hold")) == (None, None, True)


def test_rendering_takes_any_number(spark):
    row = spark.sql("SELECT 3 AS n, 'summary' AS d, 0.456 AS s, 'moved' AS t")  # a decimal
    assert row.select(X.evidence(F.col("n"), F.col("d"), F.col("s"), F.col("t")).alias("x")).head()["x"] == "3. [summary] (score: 0.46) moved"
    assert row.select(X.evidence(F.col("n"), F.col("d"), F.lit(0), F.col("t")).alias("x")).head()["x"] == "3. [summary] moved"


def test_dates(spark):
    assert one(spark, X.valid_month_day(F.col("a")), a="02-29") and not one(spark, X.valid_month_day(F.col("a")), a="02-30")
    day = F.lit("2024-05-15").cast("date")
    for said, want in (("Next Friday", "2024-05-17"), ("last wednesday", "2024-05-08"), ("first weekend of September", "2024-09-07"), ("the week before 2024-03-05", "2024-02-27"), ("next month", "2024-06-14")):
        assert str(one(spark, X.relative_date(F.col("a"), day), a=said)) == want
    assert one(spark, X.relative_date(F.col("a"), day), a="some day") is None


def test_secrets_tokens_scopes(spark):
    row = spark.sql("SELECT named_struct('a', map('JWT_Secret_Key', 'x', 'b', 'c'), 'list', array(named_struct('Cookie', 5, 'n', 6)), 'none', CAST(NULL AS struct<token:string>)) AS v")
    masked = row.select(X.masked(F.col("v"), row.schema["v"].dataType).alias("x")).head()["x"].asDict(recursive=True)
    assert masked == {"a": {"JWT_Secret_Key": "***", "b": "c"}, "list": [{"Cookie": "***", "n": 6}], "none": None}
    row = spark.sql("SELECT map('Token', 5, 'n', 6) AS v")
    assert row.select(X.masked(F.col("v"), row.schema["v"].dataType).alias("x")).head()["x"] == {"Token": None if "token" in X.SECRETS else 5, "n": 6}
    assert tuple(one(spark, X.token_usage(F.col("a")), a='{"usage":{"input_tokens":3,"completion_tokens":4}}')) == (3, 4)
    assert one(spark, X.scopes(F.array(F.lit("b"), F.lit(" a "), F.lit("b")))) == ["a", "b"]
    assert one(spark, X.scopes(F.array().cast("array<string>"))) == ["*"]


def test_chunks():
    text = "One sentence here. " * 30
    parts = chunks_of(text, 25, 5)
    assert len(parts) > 1 and all(p.endswith(".") for p in parts[:-1])
    assert parts[1].startswith("One sentence here."[-18:].strip()) or parts[1][:20].strip()
    assert chunks_of("short", 25, 5) == ["short"] and chunks_of("  ", 25, 5) == []
    assert "".join(chunks_of("x" * 250, 25, 0)) == "x" * 250


def test_page_paragraphs(spark):
    page = "<div><p>" + "a" * 60 + "</p><p>short</p><span>" + "a" * 60 + "</span><div>" + "b" * 70 + "</div></div>"
    whole = "\n".join(["a" * 60, "short", "a" * 60, "b" * 70])
    assert one(spark, page_paragraphs(F.col("a")), a=page) == [whole, "a" * 60, "b" * 70]
    assert one(spark, page_paragraphs(F.col("a")), a="<p>first part of it <span>inner</span> second part of it, which isn't lost") == ["first part of it\ninner\nsecond part of it, which isn't lost"]
    assert one(spark, page_paragraphs(F.col("a")), a=None) == [] and one(spark, page_paragraphs(F.col("a")), a="") == []
    assert len(one(spark, page_paragraphs(F.col("a")), a="".join(f"<p>{i} {'x' * 60}" + "</p>" for i in range(90)))) == 50


def pairs(spark, html, url):
    c = one(spark, chat_pairs(F.col("a"), F.lit(url)), a=html)
    return c["method"], [tuple(p) for p in c["pairs"]]


def test_chat_pages_as_they_are(spark):
    bar = '<div class="toolbar">Copy</div>'
    page = f'<main><div data-message-author-role="user">Q1</div>{bar}<div data-message-author-role="assistant"><p>A<br>1</p><p>more<script>x < 1</script></div>{bar}<div data-message-author-role="user">Q2</div></main><footer>Share</footer>'
    assert pairs(spark, page, "https://chatgpt.com/share/1") == ("dom", [("Q1", "A\n1\nmore")])
    page = '<div class="user-query">Q <div>nested</div> tail</div><div class="x model-response y"><div>A</div></div></div>behind<message-content role=user>Q2 &amp; &#60;</message-content><div class="model-responses">no</div>'
    assert pairs(spark, page, "https://gemini.google.com/share/1") == ("dom", [("Q \nnested\n tail", "A")])
    assert pairs(spark, "<div", "https://chatgpt.com/share/1") == pairs(spark, None, "https://chatgpt.com/share/1") == ("none", [])
    assert pairs(spark, "<p>" + "y" * 80, "https://example.org") == ("fallback", [("Extracted text from link", "y" * 80)])
    began = time.time()
    assert len(Page("<div><p>a" * 100_000 + "</span>" * 100_000).elements) == 200_000 and time.time() - began < 10


def test_phrases(spark):
    texts = spark.createDataFrame([(1, "My NAME is Ada. I’m a C++ and c# fan; the CI/CD pipeline, CI/CD!"), (2, None), (3, ""), (4, "the other day at 5 o'clock, today"), (4, "today")], "id int, text string")
    got = {(r["id"], r["class"]): (r["n_hits"], r["n_phrases"]) for r in V.phrase_hits(texts, V.vocabulary(spark)).collect()}
    assert got == {(1, "profile"): (2, 2), (1, "code"): (5, 4), (4, "event"): (4, 3)}
    own = spark.createDataFrame([("x", "a b"), ("x", "a b"), ("y", "a b"), ("z", None)], "class string, phrase string")
    assert {(r["class"], r["n_hits"]) for r in V.phrase_hits(spark.createDataFrame([(1, "A b a b")], "id int, text string"), own).collect()} == {("x", 2), ("y", 2)}
    assert V.topic_list().startswith("- basic_info\n  - Name\n  - Age(integer)\n") and V.topic_list().endswith("\n...")


def test_containment_by_type(spark):
    has = lambda doc, want: one(spark, contained(F.col("a"), want), a=doc)
    for doc, want, found in (
        ('{"a": 5}', {"a": 5}, True), ('{"a": 5.0}', {"a": 5}, True), ('{"a": 5}', {"a": 5.0}, True), ('{"a": "5"}', {"a": 5}, False), ('{"a": 5}', {"a": "5"}, False),
        ('{"a": true}', {"a": True}, True), ('{"a": "true"}', {"a": True}, False), ('{"a": true}', {"a": "true"}, False), ('{"a": 1}', {"a": True}, False), ('{"a": true}', {"a": 1}, False),
        ('{"a": null}', {"a": None}, True), ("{}", {"a": None}, False), ('{"a": "null"}', {"a": None}, False), ('{"a": 12345678901234567}', {"a": 12345678901234568}, False),
        ('{"a": [1, "2"]}', {"a": ["1"]}, False), ('{"a": [1, "2"]}', {"a": ["2", 1.0]}, True), ('{"a": [{"b": 1, "c": 2}]}', {"a": [{"b": 1}]}, True), ('{"a": [[1, 2], 3]}', {"a": [[2]]}, True),
        ('{"a": {"b": 1}}', {"a": {}}, True), ('{"a": []}', {"a": {}}, False), ('{"a": {}}', {"a": []}, False), ('{"a": 1e2}', {"a": 100}, True), ('{"a.b\'c": {"d\\"": 1}}', {"a.b'c": {'d"': 1}}, True),
        ("no json", {}, False), (None, {}, False), ("{}", {}, True), ('{"a": 0.1}', {"a": 0.1}, True), ("[1]", {"a": 1}, False),
    ):
        assert has(doc, want) is found, (doc, want)


def test_documents_of_all_languages_get_classes(spark):
    from palimpsest.plans import core

    from .conftest import SMALL

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert core.QUERIES["keyword_classes_all"](spark, SMALL).count() == docs.count() > docs.where("lang = 'en'").count()
