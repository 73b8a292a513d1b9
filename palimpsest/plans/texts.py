"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocabularies as V
from ..functions.chunks import chunk_text as _chunks
from .core import query


@query("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM documents")
def norm_text(t):
    return t.documents.select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def estimate_tokens(t):
    return t.documents.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents")
def content_hash16(t):
    return t.documents.select("doc_id", X.hash16(F.col("text")).alias("h"))


@query("SELECT c_custkey, lower(replace(trim(c_mktsegment) || '_' || trim(c_name), ' ', '_')) AS key FROM customer")
def profile_key_parse(t):
    return t.customer.select("c_custkey", X.profile_key(F.col("c_mktsegment"), F.col("c_name")).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 != 0 THEN lower(replace(p_brand || '_' || p_type, ' ', '_')) ELSE '' END AS main_content,
CASE WHEN p_partkey % 4 != 0 THEN p_name ELSE trim(p_brand || ' = ' || p_name) END AS subcontent FROM part""")
def structured_facts(t):
    content = F.when(F.col("p_partkey") % 4 != 0, F.concat("p_brand", F.lit(" / "), "p_type", F.lit(" = "), "p_name")).otherwise(F.concat("p_brand", F.lit(" = "), "p_name"))
    return t.part.select("p_partkey", X.structured(content).alias("s")).select("p_partkey", "s.*")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS date, o_orderpriority AS event_name, o_orderstatus AS "desc", CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders""")
def pipe_record_parse(t):
    year = F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate").cast("string"))
    record = X.render_event(F.date_format("o_orderdate", "MM-dd"), F.col("o_orderpriority"), F.col("o_orderstatus"), year)
    return t.orders.select("o_orderkey", X.event_fields(record).alias("e")).select("o_orderkey", "e.date", "e.event_name", "e.desc", "e.year")


@query("""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'profile' ELSE 'code' END AS source, trim(regexp_extract(text, '^[^\\n\\r]*')) AS query FROM conversations WHERE role != 'system' AND trim(regexp_extract(text, '^[^\\n\\r]*')) != ''""")
def source_query_lines(t):
    first = F.regexp_extract("text", r"^[^\n\r]*", 0)
    answer = F.concat(F.lit("thinking\n"), F.when(F.col("role") == "user", "profile").when(F.col("role") == "system", "unknown").otherwise("Code"), F.lit("::"), first, F.lit("\nnothing"))
    rows = t.conversations.select("conv_id", "turn", F.explode(X.source_queries(answer)).alias("q"))
    return rows.select("conv_id", "turn", "q.*")


@query("""SELECT page_id, CASE WHEN page_id % 3 != 0 THEN 'org' || page_id % 7 END AS org, CASE WHEN page_id % 3 != 0 THEN 'r' || page_id END AS repo FROM pages""")
def url_parse(t):
    """Owner and name out of repository URLs of several forms."""
    k = F.col("page_id")
    name = F.concat(F.lit("org"), k % 7, F.lit("/r"), k)
    url = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit(" https://github.com/"), name, F.lit(".git/"))).otherwise(F.concat(F.lit("git@github.com:"), name))
    return t.pages.select("page_id", X.github_repo(url).alias("r")).select("page_id", "r.*")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'chatgpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' ELSE 'unknown' END AS provider FROM pages")
def provider_detect(t):
    m = F.col("page_id") % 4
    url = F.when(m == 0, F.concat(F.lit("https://CHATGPT.com/share/"), "page_id")).when(m == 1, F.concat(F.lit("https://claude.ai/share/"), "page_id")).when(m == 2, F.concat(F.lit("https://g.co/gemini/"), "page_id")).otherwise(F.col("url"))
    return t.pages.select("page_id", X.provider(F.lit(None).cast("string"), url).alias("provider"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def truncate_preview(t):
    return t.documents.select("doc_id", X.truncated(F.col("text"), 200).alias("preview"))


@query("SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 200) || chr(10) || '...' || chr(10) || right(text, 200) ELSE text END AS cut FROM documents")
def head_tail_truncate(t):
    return t.documents.select("doc_id", X.head_tail(F.col("text"), 400).alias("cut"))


@query()
def chunk_text(t):
    """Chunks of 200 tokens; each cut depends on the one before it."""
    rows = t.documents.select("doc_id", F.posexplode(_chunks(F.col("text"))).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", "chunk")


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a\\s')) AS n_links FROM pages""")
def html_title_and_links(t):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r"<a\s"), F.lit(0))).cast("long").alias("n_links"))


@query("""SELECT row_number() OVER (ORDER BY doc_id) AS n, printf('%d. [%s] (score: %.2f) %s', row_number() OVER (ORDER BY doc_id), lang, n_chars / 100.0, source) AS line FROM documents QUALIFY n <= 15""")
def evidence_lines(t):
    from ..operators.search import ranked, top

    rows = ranked(top(t.documents, 15, F.asc("doc_id")), F.asc("doc_id"))
    return rows.select(F.col("rank").cast("long").alias("n"), X.evidence(F.col("rank"), F.col("lang"), F.col("n_chars") / 100.0, F.col("source")).alias("line"))


def _classes_sql(**words: tuple[str, ...]) -> str:
    cases = [f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({'|'.join(w)})($|[^a-z0-9_])') THEN '{name}' END" for name, w in sorted(words.items())]
    return f"SELECT doc_id, list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL) AS classes FROM documents"


_FEW = {"insult": ("idiot",), "legal": ("license",)}
_MORE = {"code": ("function", "class"), "event": ("today", "tomorrow"), **_FEW}


@query(_classes_sql(**_FEW))
def keyword_classes(t):
    """The rule-based classifier with a small vocabulary, on documents of all languages."""
    return t.documents.select("doc_id", X.keyword_classes(F.col("text"), _FEW).alias("classes"))


@query(_classes_sql(**_MORE))
def keyword_classes_all(t):
    """The rule-based classifier with more classes, on documents of all languages."""
    return t.documents.select("doc_id", X.keyword_classes(F.col("text"), _MORE).alias("classes"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hits_sql(table: str, key: str) -> str:
    values = ", ".join(f"({_quoted(c)}, {_quoted(p.lower())})" for c, phrases in V.CLASSES.items() for p in phrases)
    grams = " UNION ALL ".join(f"SELECT id, array_to_string(t[i:i + {n - 1}], ' ') AS gram FROM (SELECT id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM x)" for n in range(1, 6))
    return f"""WITH v(class, phrase) AS (VALUES {values}), x AS (SELECT {key} AS id, regexp_extract_all(replace(lower(coalesce(text, '')), chr(8217), chr(39)), {_quoted(V.TOKEN)}) AS t FROM {table}), g AS ({grams})
SELECT id, class, count(*) AS n_hits, count(DISTINCT phrase) AS n_phrases FROM g JOIN v ON gram = phrase GROUP BY id, class"""


@query(_hits_sql("documents", "doc_id"))
def vocabulary_hits(t):
    """How often phrases of the three vocabularies occur in each document."""
    return V.phrase_hits(t.documents, V.vocabulary(t.spark), "doc_id")


@query(_hits_sql("conversations", "conv_id * 1000 + turn"))
def vocabulary_hits_of_turns(t):
    """The same for each turn of the conversations."""
    return V.phrase_hits(t.conversations.withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), V.vocabulary(t.spark))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_partkey % 3 = 0 ELSE true END AS known FROM part""")
def known_sub_topics(t):
    """Whether a profile fact's sub-topic belongs to its topic."""
    k = F.col("p_partkey")
    topic = F.when(k % 4 == 0, "work").when(k % 4 == 1, "education").when(k % 4 == 2, "interest").otherwise("Basic_Info")
    sub = F.when(k % 4 == 0, "Company").when(k % 4 == 1, "salary").when((k % 4 == 2) & (k % 3 == 0), "books").when(k % 4 == 2, "email").otherwise("age")
    return t.part.select("p_partkey", V.known_sub_topic(topic, sub).alias("known"))


@query("SELECT c_custkey, regexp_matches(replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '#' END), '^[a-zA-Z0-9_-]{3,30}$') AS valid FROM customer")
def username_rule(t):
    name = F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("#"), F.lit("-"))).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", X.valid_username(name).alias("valid"))


# --- grammars: texts are put together from the tables and taken apart again ------------------------------------------------------


@query("""SELECT p_partkey, p_name AS content, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS code_snippet, CASE WHEN p_partkey % 3 = 0 THEN 'go' ELSE '' END AS language, 'algorithm' AS snippet_type, '' AS tags FROM part WHERE p_partkey % 3 != 1
UNION ALL SELECT p_partkey, p_name, p_brand, 'sql', 'fix', 'a,b' FROM part WHERE p_partkey % 3 = 1""")
def snippet_records_parsed(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" | ", "p_name", "p_brand", F.lit("go"))).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" | ", "p_name", "p_brand", F.lit("sql"), F.lit("fix"), F.lit("a,b"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.snippet_fields(text).alias("s")).select("p_partkey", "s.*")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'fix' ELSE 'explanation' END AS annotation_type, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS target_symbol, CASE WHEN p_partkey % 3 = 0 THEN 'high' END AS severity, CASE WHEN p_partkey % 3 = 1 THEN p_name || ' | ' || p_brand ELSE p_name END AS content FROM part""")
def annotation_records_parsed(t):
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("|", F.lit("warning"), "p_brand", F.lit("f.py"), F.lit("repo"), F.lit("high"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" | ", F.lit("fix"), "p_name", "p_brand")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", X.annotation_fields(text).alias("s")).select("p_partkey", "s.annotation_type", "s.target_symbol", "s.severity", "s.content")


@query("""SELECT c_custkey, 'work' AS topic, 'segment' AS sub_topic, c_mktsegment || '::' || c_nationkey AS memo FROM customer UNION ALL SELECT c_custkey, 'basic_info', 'name', c_name FROM customer WHERE c_custkey % 2 = 0""")
def profile_lines_parsed(t):
    second = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Basic_Info :: name :: "), "c_name")).otherwise("::no topic::x")
    answer = F.concat(F.lit("a::b::before\n---\n Work::Segment::"), "c_mktsegment", F.lit("::"), "c_nationkey", F.lit("\nshort::line\n"), second)
    return t.customer.select("c_custkey", F.explode(X.profile_facts(answer)).alias("f")).select("c_custkey", "f.*")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS date, o_orderpriority AS event_name, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 5 != 0 UNION ALL SELECT o_orderkey, '01-02', NULL, NULL FROM orders WHERE o_orderkey % 5 != 0""")
def event_blocks_parsed(t):
    answer = F.concat(F.lit("DATE: "), F.date_format("o_orderdate", "MM-dd"), F.lit("\nEVENT_NAME: "), "o_orderpriority", F.lit("\nyear: "), F.year("o_orderdate"), F.lit("\n---\nEVENT_NAME: undated\n---\n  date:  01-02 \n"), F.when(F.col("o_orderkey") % 5 == 0, "NO_EVENT").otherwise(""))
    return t.orders.select("o_orderkey", F.explode(X.event_blocks(answer)).alias("e")).select("o_orderkey", "e.date", "e.event_name", "e.year")


@query("""SELECT page_id, 'page ' || page_id AS description, 'size' AS category, length(html) || ' characters' AS seen, 'high' AS confidence FROM pages UNION ALL SELECT page_id, 'page ' || page_id, 'other', url, NULL FROM pages""")
def image_blocks_parsed(t):
    answer = F.concat(F.lit("Description: page "), "page_id", F.lit("\nOBSERVATIONS:\n- [Size] "), F.length("html"), F.lit(" characters (confidence: HIGH)\n- "), "url", F.lit("\n-\nno bullet"))
    got = t.pages.select("page_id", X.image_analysis(answer).alias("a")).select("page_id", "a.description", F.explode("a.observations").alias("o"))
    return got.select("page_id", "description", F.col("o.category").alias("category"), F.col("o.description").alias("seen"), F.col("o.confidence").alias("confidence"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'todo' ELSE 'explanation' END AS annotation_type, CASE WHEN p_partkey % 3 = 0 THEN 'low' END AS severity, p_name AS content FROM part WHERE p_partkey % 7 != 0""")
def json_annotations_parsed(t):
    item = F.struct(F.when(F.col("p_partkey") % 2 == 0, "todo").otherwise("strange").alias("annotation_type"), F.when(F.col("p_partkey") % 3 == 0, "low").otherwise("odd").alias("severity"), F.col("p_name").alias("content"))
    answer = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(F.array(item).alias("annotations"))), F.when(F.col("p_partkey") % 7 == 0, " broken").otherwise("\n"), F.lit("```"))
    answer = F.when(F.col("p_partkey") % 7 == 0, F.lit("none today")).otherwise(answer)
    return t.part.select("p_partkey", F.explode(X.code_annotations(answer)).alias("a")).select("p_partkey", "a.annotation_type", "a.severity", "a.content")


@query("""SELECT p_partkey, p_name AS content, CASE WHEN p_partkey % 2 = 0 THEN 'pattern' ELSE 'algorithm' END AS snippet_type, CASE WHEN p_partkey % 2 = 0 THEN 'a/b' ELSE 'c/d' END AS tags FROM part""")
def json_snippets_parsed(t):
    even = F.col("p_partkey") % 2 == 0
    answer = F.concat(F.lit('{"snippets": [{"content": " '), "p_name", F.lit(' ", "snippet_type": "'), F.when(even, "pattern").otherwise("x"), F.lit('", "tags": '), F.when(even, F.lit('["a", "b"]')).otherwise(F.lit('" c, d ,,"')), F.lit('}, {"content": " "}]}'))
    got = t.part.select("p_partkey", F.explode(X.code_snippets(answer)).alias("s"))
    return got.select("p_partkey", "s.content", "s.snippet_type", F.array_join("s.tags", "/").alias("tags"))


@query("SELECT p_partkey, unnest([p_name, p_brand]) AS item FROM part")
def bullets_parsed(t):
    answer = F.concat(F.lit("- "), "p_name", F.lit("  \n\n • "), "p_brand", F.lit("\n-"))
    return t.part.select("p_partkey", F.explode(X.bullets(answer)).alias("item"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'src/m' || p_partkey || '.py' END AS path, CASE WHEN p_partkey % 4 = 1 THEN 'Main' END AS symbol, p_partkey % 4 = 3 AS explain FROM part""")
def fast_paths(t):
    k = F.col("p_partkey")
    path = F.concat(F.lit("src/m"), k, F.lit(".py"))
    asked = F.when(k % 4 == 0, F.concat(F.lit("`"), path, F.lit("`"))).when(k % 4 == 1, F.concat(path, F.lit("#Main"))).when(k % 4 == 2, "m.py").otherwise("Why is it so?")
    return t.part.select("p_partkey", X.fast_path(asked).alias("f")).select("p_partkey", "f.*")


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate - INTERVAL 1 DAY WHEN 1 THEN o_orderdate + INTERVAL 30 DAY WHEN 2 THEN o_orderdate + INTERVAL 1 DAY * ((5 - isodow(o_orderdate) + 6) % 7 + 1) WHEN 3 THEN o_orderdate - INTERVAL 1 DAY * ((isodow(o_orderdate) - 1 + 6) % 7 + 1) END AS DATE) AS day FROM orders""")
def relative_dates(t):
    k = F.col("o_orderkey") % 5
    said = F.when(k == 0, "Yesterday").when(k == 1, "next month").when(k == 2, " next  Friday").when(k == 3, "last monday").otherwise("some day")
    return t.orders.select("o_orderkey", X.relative_date(said, F.to_date("o_orderdate")).alias("day"))


@query("SELECT p_partkey, p_size AS input_tokens, CASE WHEN p_partkey % 3 != 2 THEN p_size + 1 END AS output_tokens FROM part")
def token_usages(t):
    k, a, b = F.col("p_partkey") % 3, F.col("p_size"), F.col("p_size") + 1
    payload = F.when(k == 0, F.to_json(F.struct(F.struct(a.alias("prompt_tokens"), b.alias("completion_tokens")).alias("usage")))).when(k == 1, F.to_json(F.struct(F.struct(a.alias("promptTokenCount"), b.alias("candidatesTokenCount")).alias("usageMetadata")))).otherwise(F.to_json(F.struct(F.struct(a.alias("input_tokens")).alias("usage_metadata"))))
    return t.part.select("p_partkey", X.token_usage(payload).alias("u")).select("p_partkey", F.col("u.input_tokens").cast("int").alias("input_tokens"), F.col("u.output_tokens").cast("int").alias("output_tokens"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '***' ELSE c_name END AS outer_value, '***' AS inner_value, c_mktsegment AS open_value FROM customer""")
def secrets_masked(t):
    """Secrets in structs and maps at any depth."""
    key = F.when(F.col("c_custkey") % 2 == 0, "API-Key").otherwise("name")
    value = F.struct(F.create_map(key, F.col("c_name")).alias("m"), F.array(F.struct(F.col("c_acctbal").alias("token"), F.col("c_mktsegment").alias("segment"))).alias("parts"))
    rows = t.customer.select("c_custkey", key.alias("k"), value.alias("v"))
    rows = rows.select("c_custkey", "k", X.masked(F.col("v"), rows.schema["v"].dataType).alias("v"))
    return rows.select("c_custkey", F.col("v.m")[F.col("k")].alias("outer_value"), F.col("v.parts")[0]["token"].alias("inner_value"), F.col("v.parts")[0]["segment"].alias("open_value"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN text ELSE 'a' || text END AS text FROM conversations""")
def model_contents(t):
    """Contents that are a string or a list of parts."""
    parts = F.to_json(F.array(F.to_json(F.struct(F.lit("a").alias("text"))), F.to_json(F.struct("text"))))
    content = F.when(F.col("role") == "system", F.col("text")).otherwise(parts)
    return t.conversations.select("conv_id", "turn", X.content_text(content).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 <= 5 THEN 'low' ELSE 'medium' END AS bucket FROM orders")
def complexity_buckets(t):
    return t.orders.select("o_orderkey", X.complexity_bucket(F.col("o_orderkey") % 10).alias("bucket"))


@query("SELECT conv_id, CASE WHEN count(*) % 2 = 0 THEN 'cursor' ELSE 'unknown' END AS format FROM conversations GROUP BY conv_id")
def transcript_formats(t):
    c = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", X.transcript_format(F.when(F.col("n") % 2 == 0, "_Exported on x from Cursor_").otherwise("# Chat Conversation")).alias("format"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '*' WHEN p_partkey % 3 = 1 THEN 'a,' || p_brand ELSE p_brand END AS scopes FROM part""")
def scopes_normalised(t):
    k = F.col("p_partkey") % 3
    given = F.when(k == 0, F.array(F.lit(" "))).when(k == 1, F.array(F.concat(F.lit(" "), "p_brand"), F.lit("a"), F.lit("a"))).otherwise(F.array("p_brand"))
    # upper case sorts before lower case in both engines
    return t.part.select("p_partkey", F.array_join(F.reverse(X.scopes(given)), ",").alias("scopes"))


@query("SELECT doc_id, left(text, 100) AS text, length(text) > 100 AS truncated FROM documents")
def capped_reads(t):
    return t.documents.select("doc_id", X.capped(F.col("text"), 100).alias("c")).select("doc_id", "c.*")


@query("""SELECT event_id, '{"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","who":{"id":' || user_id || ',"none":null}}' AS json FROM events""")
def json_safe_rows(t):
    """Nested values with times as JSON."""
    value = F.struct(F.col("ts").alias("at"), F.struct(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("none")).alias("who"))
    return t.events.select("event_id", X.json_safe(value).alias("json"))
