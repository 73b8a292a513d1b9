"""Text: normalisation, record grammars and their inverses, limits, URLs, hashes. Columns in, columns out; no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACES = " \t\n\x0b\x0c\r"


def trimmed(c: Column) -> Column:
    """Without ASCII white space at both ends; null stays null."""
    return F.btrim(c, F.lit(_SPACES))


def norm_text(c: Column) -> Column:
    """Null is empty; trimmed, lower case, white space collapsed: two facts are equal if these are."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")))


def profile_key(topic: Column, sub_topic: Column) -> Column:
    """topic_sub_topic in lower case with underscores; empty if either is missing or blank."""
    t, s = trimmed(F.coalesce(topic, F.lit(""))), trimmed(F.coalesce(sub_topic, F.lit("")))
    return F.when((t == "") | (s == ""), "").otherwise(F.lower(F.replace(F.concat_ws("_", t, s), F.lit(" "), F.lit("_"))))


def structured(content: Column) -> Column:
    """(main_content, subcontent) of ``topic / sub = memo``; of other text an empty key and the text."""
    at = F.instr(content, " = ")
    key, memo = F.substring(content, F.lit(1), at - 1), F.substring(content, at + 3, F.length(content))
    fact = (at > 0) & F.contains(key, F.lit(" / "))
    main = F.lower(F.replace(F.replace(trimmed(key), F.lit(" / "), F.lit("_")), F.lit(" "), F.lit("_")))
    return F.struct(F.when(fact, main).otherwise("").alias("main_content"), trimmed(F.when(fact, memo).otherwise(content)).alias("subcontent"))


def _parts(content: Column, pattern: str) -> Column:
    return F.transform(F.split(content, pattern), trimmed)


def event_fields(content: Column) -> Column:
    """``date | event_name | desc | year | time | date_expression``: the first three as they are, the others null if empty."""
    p = _parts(content, r"\|")
    names = ("date", "event_name", "desc", "year", "time", "date_expression")
    return F.struct(*[(F.get(p, F.lit(i)) if i < 3 else F.nullif(F.get(p, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)])


def snippet_fields(content: Column) -> Column:
    """``content | code | language | type | tags``: with three or four parts type and tags are the defaults, with fewer all is content."""
    p = _parts(content, r" \| ")
    n = F.size(p)
    at = lambda i: F.get(p, F.lit(i))
    return F.struct(
        F.when(n >= 3, at(0)).otherwise(content).alias("content"),
        F.when(n >= 3, at(1)).otherwise("").alias("code_snippet"),
        F.when(n >= 3, at(2)).otherwise("").alias("language"),
        F.when(n >= 5, at(3)).otherwise("algorithm").alias("snippet_type"),
        F.when(n >= 5, at(4)).otherwise("").alias("tags"),
    )


def annotation_fields(content: Column) -> Column:
    """``type | symbol | file | repo | severity | content``; two to five parts are a type and the rest joined again, one is content."""
    p = _parts(content, r"\|")
    n = F.size(p)
    at = lambda i: F.when(n >= 6, F.get(p, F.lit(i)))
    kind = F.when(n >= 2, F.coalesce(F.nullif(F.get(p, F.lit(0)), F.lit("")), F.lit("explanation"))).otherwise("explanation")
    rest = F.when(n >= 6, F.get(p, F.lit(5))).when(n >= 2, F.array_join(F.slice(p, 2, F.greatest(n - 1, F.lit(0))), " | ")).otherwise(content)
    return F.struct(kind.alias("annotation_type"), at(1).alias("target_symbol"), at(2).alias("target_file"), at(3).alias("repo"), at(4).alias("severity"), rest.alias("content"))


def render_fact(topic: Column, sub_topic: Column, memo: Column) -> Column:
    return F.concat(topic, F.lit(" / "), sub_topic, F.lit(" = "), memo)


def render_event(*fields: Column) -> Column:
    return F.array_join(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), " | ")


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\r\n|\n|\r"), trimmed), lambda x: x != "")


def source_queries(answer: Column, sources: tuple[str, ...] = ("code", "profile", "event", "image")) -> Column:
    """array<(source, query)> of ``SOURCE::QUERY`` lines with a known source and a query; other lines are left out."""
    parsed = F.transform(_lines(answer), lambda x: F.struct(F.lower(trimmed(F.split(x, "::", 2)[0])).alias("source"), trimmed(F.get(F.split(x, "::", 2), F.lit(1))).alias("query")))
    return F.filter(parsed, lambda x: x["source"].isin(*sources) & (F.coalesce(x["query"], F.lit("")) != ""))


def profile_facts(answer: Column) -> Column:
    """array<(topic, sub_topic, memo)> of ``TOPIC::SUB::MEMO`` lines after the first ``---``, if any; a memo may hold ``::``."""
    at = F.instr(answer, "---")
    body = F.when(at > 0, F.substring(answer, at + 3, F.length(answer))).otherwise(answer)
    part = lambda x, i: trimmed(F.get(F.split(x, "::", 3), F.lit(i)))
    parsed = F.transform(_lines(body), lambda x: F.struct(F.lower(part(x, 0)).alias("topic"), F.lower(part(x, 1)).alias("sub_topic"), part(x, 2).alias("memo")))
    return F.filter(parsed, lambda x: (x["topic"] != "") & (x["sub_topic"] != "") & (F.coalesce(x["memo"], F.lit("")) != ""))


def event_blocks(answer: Column) -> Column:
    """array of events from ``FIELD: value`` blocks parted by ``---``; none if NO_EVENT occurs anywhere; a block needs a date."""

    def field(block: Column, name: str) -> Column:
        found = F.regexp_extract_all(block, F.lit(rf"(?im)^[ \t]*{name}:[ \t]*(\S.*?)[ \t\r]*$"), F.lit(1))
        return F.get(found, F.size(found) - 1)  # the last one wins

    names = ("date", "event_name", "year", "desc", "time", "date_expression")
    blocks = F.transform(F.split(answer, "---"), lambda b: F.struct(*[field(b, n.upper()).alias(n) for n in names]))
    none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    return F.when(F.contains(F.upper(answer), F.lit("NO_EVENT")), none).otherwise(F.filter(blocks, lambda x: x["date"].isNotNull()))


def image_analysis(answer: Column) -> Column:
    """(description, observations): the DESCRIPTION line, and ``- [category] text (confidence: level)`` lines after OBSERVATIONS."""
    entry = r"(?i)^-\s*(?:\[([^\]]*)\])?\s*(.*?)\s*(?:\(confidence:\s*([^)]*)\)*)?$"
    at = F.instr(F.upper(answer), "OBSERVATIONS:")
    rows = F.filter(_lines(F.substring(answer, at + 13, F.length(answer))), lambda x: x.startswith("-") & (at > 0))
    seen = F.transform(
        rows,
        lambda x: F.struct(
            F.coalesce(F.nullif(F.lower(F.trim(F.regexp_extract(x, entry, 1))), F.lit("")), F.lit("other")).alias("category"),
            F.regexp_extract(x, entry, 2).alias("description"),
            F.nullif(F.lower(F.trim(F.regexp_extract(x, entry, 3))), F.lit("")).alias("confidence"),
        ),
    )
    title = F.trim(F.regexp_extract(answer, r"(?im)^\s*DESCRIPTION:[ \t]*(.*)$", 1))
    return F.struct(title.alias("description"), F.filter(seen, lambda x: x["description"] != "").alias("observations"))


def fenced(answer: Column) -> Column:
    """The JSON between code fences, or the text itself."""
    return F.coalesce(F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), trimmed(answer))


#: Kinds and severities of annotations, kinds of snippets.
ANNOTATIONS = ("bug_report", "fix", "feature_idea", "explanation", "warning", "instruction", "architecture", "best_practice", "todo", "technical_debt")
SEVERITIES = ("low", "medium", "high", "critical")
SNIPPETS = ("algorithm", "config", "pattern", "fix", "utility", "explanation")


def _of(value: Column, names: tuple[str, ...], default: str | None) -> Column:
    return F.when(value.isin(*names), value).otherwise(F.lit(default).cast("string"))


def code_annotations(answer: Column) -> Column:
    """array of annotations from (fenced) JSON ``{"annotations": [...]}``; unknown kinds are explanations, unknown severities null; broken JSON gives none."""
    kind = "array<struct<annotation_type:string,target_symbol:string,target_file:string,content:string,severity:string,repo:string,assigned_to_name:string>>"
    rows = F.coalesce(F.from_json(fenced(answer), f"struct<annotations:{kind}>")["annotations"], F.array().cast(kind))
    known = lambda x: x.withField("annotation_type", _of(x["annotation_type"], ANNOTATIONS, "explanation")).withField("severity", _of(x["severity"], SEVERITIES, None))
    return F.transform(rows, lambda x: known(x).withField("content", F.coalesce(x["content"], F.lit(""))))


def code_snippets(answer: Column) -> Column:
    """array of snippets from (fenced) JSON ``{"snippets": [...]}``: those with content; tags may be a list or a string, ten at most."""
    kind = "array<struct<content:string,code_snippet:string,language:string,snippet_type:string,tags:string>>"
    rows = F.coalesce(F.from_json(fenced(answer), f"struct<snippets:{kind}>")["snippets"], F.array().cast(kind))
    listed = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), trimmed), lambda t: t != ""))
    empty = lambda x: F.coalesce(x, F.lit(""))
    fields = lambda x: F.struct(trimmed(x["content"]).alias("content"), empty(x["code_snippet"]).alias("code_snippet"), empty(x["language"]).alias("language"), _of(x["snippet_type"], SNIPPETS, "algorithm").alias("snippet_type"), F.slice(listed(x["tags"]), 1, 10).alias("tags"))
    return F.transform(F.filter(rows, lambda x: trimmed(empty(x["content"])) != ""), fields)


def tag_list(tags: Column, most: int = 10) -> Column:
    """Tags of a comma-separated string, trimmed, without empty ones."""
    return F.slice(F.filter(F.transform(F.split(tags, ","), trimmed), lambda x: x != ""), 1, most)


def bullets(answer: Column) -> Column:
    """Lines without leading blanks, hyphens and bullets; empty ones are left out."""
    return F.filter(F.transform(F.split(answer, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"^[\s\-•]+", ""))), lambda x: x != "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def hash16(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def provider(*urls: Column) -> Column:
    """Chat provider of the first URL that names one."""
    rules = {"chatgpt": ("chatgpt.com", "openai.com"), "claude": ("claude.ai", "claude.com"), "gemini": ("gemini.google.com", "g.co/gemini")}

    def one(url: Column) -> Column:
        low, out = F.lower(url), F
        for name, marks in rules.items():
            hit = F.lit(False)
            for m in marks:
                hit = hit | F.contains(low, F.lit(m))
            out = out.when(hit, name)
        return out

    return F.coalesce(*[one(u) for u in urls], F.lit("unknown"))


def github_repo(url: Column) -> Column:
    """(org, repo) of a GitHub URL; nulls if it is none."""
    pattern = r"github\.com[/:]([^/]+)/([^/.]+?)(?:\.git)?$"
    u = F.regexp_replace(F.trim(url), "/+$", "")
    return F.struct(*[F.nullif(F.regexp_extract(u, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(("org", "repo"))])


_PATH = r"[a-zA-Z0-9_./-]+\.[a-zA-Z]{1,10}"


def fast_path(query: Column) -> Column:
    """(path, symbol, explain): a question that is a bare path, or ``path:Symbol`` or ``path#Symbol``; and whether it asks why."""
    q = F.btrim(query, F.lit("'\"` \t\n"))
    path = F.when(q.rlike(rf"^{_PATH}$") & F.contains(q, F.lit("/")), q)
    ref = rf"^({_PATH})[:#](.*)$"
    owner = F.regexp_extract(q, ref, 1)
    symbol = F.when(F.contains(owner, F.lit("/")), F.regexp_extract(q, ref, 2))
    explain = F.lower(query).rlike("explain|why|how|what does|describe|analyze|review|purpose|reason")
    return F.struct(F.coalesce(path, F.when(symbol.isNotNull(), owner)).alias("path"), symbol.alias("symbol"), explain.alias("explain"))


def evidence(n: Column, domain: Column, score: Column, text: Column) -> Column:
    """A numbered line; a score of 0 or less isn't shown."""
    shown = F.when(score > 0, F.format_string(" (score: %.2f)", score.cast("double"))).otherwise("")
    return F.format_string("%d. [%s]%s %s", n.cast("long"), domain, shown, text)


def truncated(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def head_tail(text: Column, size: int) -> Column:
    """The first and last halves of a text longer than ``size``, with a mark between."""
    half = size // 2
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half)))).otherwise(text)


def scopes(values: Column) -> Column:
    """Sorted and distinct; none means all (``*``)."""
    kept = F.array_sort(F.array_distinct(F.filter(F.transform(values, trimmed), lambda x: x != "")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("*")))


def transcript_format(text: Column) -> Column:
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("_Exported on") & has("from Cursor"), "cursor").when(has("# Chat Conversation") & (has("### User Input") | has("### Planner Response")), "antigravity").otherwise("unknown")


def relative_date(expression: Column, today: Column) -> Column:
    """Dates of yesterday, today, tomorrow, ``next`` and ``last <weekday>``, last and next week or month, ``first weekend of
    <month>`` (its first Saturday, this year) and ``the week before <yyyy-mm-dd>``; null for others."""
    e = norm_text(expression)
    days = ("mon", "tues", "wednes", "thurs", "fri", "satur", "sun")
    months = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    of = lambda word: F.regexp_extract(e, f"^{word} ({'|'.join(days)})day$", 1)
    on = lambda word, start: F.coalesce(*[F.when(of(word) == d, F.next_day(start, d[:3])) for d in days])
    month = F.array_position(F.array(*[F.lit(m) for m in months]), F.regexp_extract(e, "^first weekend of ([a-z]+)$", 1)).cast("int")
    before = F.try_to_date(F.regexp_extract(e, r"^(?:the )?week before (\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")
    return (
        F.when(e == "today", today).when(e == "yesterday", F.date_sub(today, 1)).when(e == "tomorrow", F.date_add(today, 1))
        .when(e == "last week", F.date_sub(today, 7)).when(e == "next week", F.date_add(today, 7))
        .when(e == "last month", F.date_sub(today, 30)).when(e == "next month", F.date_add(today, 30))
        .when(month > 0, F.next_day(F.date_sub(F.make_date(F.year(today), month, F.lit(1)), 1), "sat"))
        .otherwise(F.coalesce(on("next", today), on("last", F.date_sub(today, 8)), F.date_sub(before, 7)))
    )


def valid_month_day(date: Column) -> Column:
    """MM-DD of a leap year."""
    return F.coalesce(date.rlike(r"^\d{2}-\d{2}$") & F.try_to_date(F.concat(F.lit("2024-"), date), "yyyy-MM-dd").isNotNull(), F.lit(False))


#: Names of fields that hold secrets.
SECRETS = (
    "api_key", "apikey", "api-key", "password", "secret", "token", "authorization", "cookie", "pinecone_api_key", "gemini_api_key", "claude_api_key",
    "openai_api_key", "openrouter_api_key", "aws_secret_access_key", "neo4j_password", "jwt_secret_key",
)


def masked(value: Column, kind: T.DataType, names: tuple[str, ...] = SECRETS) -> Column:
    """A value of the type with what secret names hold replaced, at any depth of structs, maps and arrays; secrets become strings.

    A map's values have one type: where that is no string, what a secret key holds becomes null, as it can't be masked by a text.
    """
    if isinstance(kind, T.StructType):
        fields = [(F.lit("***") if f.name.lower() in names else masked(value[f.name], f.dataType, names)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: masked(x, kind.elementType, names))
    if isinstance(kind, T.MapType):
        inner = F.transform_values(value, lambda _, v: masked(v, kind.valueType, names))
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(inner, lambda k, v: F.when(F.lower(k).isin(*names), "***").otherwise(v))
        return F.transform_values(inner, lambda k, v: F.when(~F.lower(k).isin(*names), v))
    return value


def valid_username(name: Column) -> Column:
    """3 to 30 ASCII letters, digits, hyphens and underscores."""
    return F.coalesce(name.rlike("^[a-zA-Z0-9_-]{3,30}$"), F.lit(False))


def complexity_bucket(n: Column) -> Column:
    return F.when(n <= 5, "low").when(n <= 15, "medium").otherwise("high")


def token_usage(payload: Column) -> Column:
    """(input, output) tokens of a JSON response, by whichever of the usual names is there."""
    first = lambda *paths: F.coalesce(*[F.get_json_object(payload, p) for p in paths]).cast("long")
    return F.struct(
        first("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usage_metadata.input_tokens", "$.usageMetadata.promptTokenCount").alias("input_tokens"),
        first("$.usage.completion_tokens", "$.usage.output_tokens", "$.usage_metadata.output_tokens", "$.usageMetadata.candidatesTokenCount").alias("output_tokens"),
    )


def keyword_classes(text: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Names whose words occur in the text, whole and in any case: the deterministic stand-in for a classifying model."""
    low = F.lower(text)
    hits = [F.when(low.rlike(r"(?<!\w)(" + "|".join(r"\Q" + w + r"\E" for w in ws) + r")(?!\w)"), F.lit(name)) for name, ws in words.items()]
    return F.array_compact(F.array(*hits))


def ndjson_text(lines: Column) -> Column:
    """The texts of ``{"type": "chunk", "text": ...}`` lines, joined; other and broken lines are left out."""
    rows = F.transform(_lines(lines), lambda x: F.from_json(x, "type string, text string"))
    return F.array_join(F.transform(F.filter(rows, lambda r: (r["type"] == "chunk") & r["text"].isNotNull()), lambda r: r["text"]), "")


def content_text(content: Column) -> Column:
    """A model's content that is a string or a JSON list of strings and ``{"text": ...}`` parts."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.when(~F.startswith(F.trim(p), F.lit("{")), p), F.lit("")))
    return F.when(F.startswith(F.trim(content), F.lit("[")) & parts.isNotNull(), F.array_join(texts, "")).otherwise(content)


#: Topics of profile facts.
TOPICS = ("basic_info", "contact_info", "education", "demographics", "work", "interest", "life_event")


def topic_of(key: Column, topics: tuple[str, ...] = TOPICS) -> Column:
    """(topic, sub_topic) of a profile key: the longest known topic that it begins with, else what stands before the first underscore."""
    out = F
    for t in sorted(topics, key=lambda t: (-len(t), t)):
        out = out.when(F.startswith(key, F.lit(f"{t}_")), F.struct(F.lit(t).alias("topic"), F.substring(key, F.lit(len(t) + 2), F.length(key)).alias("sub_topic")))
    at = F.instr(key, "_")
    first = F.struct(F.when(at > 0, F.substring(key, F.lit(1), at - 1)).otherwise(key).alias("topic"), F.when(at > 0, F.substring(key, at + 1, F.length(key))).otherwise("").alias("sub_topic"))
    return out.otherwise(first)


def capped(text: Column, size: int = 12_000) -> Column:
    """(text, truncated): a text's first characters, and whether there are more."""
    return F.struct(F.substring(text, 1, size).alias("text"), F.coalesce(F.length(text) > size, F.lit(False)).alias("truncated"))


def json_safe(value: Column) -> Column:
    """A value of any type as JSON, timestamps as ISO 8601 in UTC; null fields stay."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'", "timeZone": "UTC", "ignoreNullFields": "false"})
