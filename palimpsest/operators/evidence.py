"""What a search returns to a reader or a model: records (domain, content, score, id), rendered as text, of each kind of memory and code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated
from . import graph, search

#: How many records each lane of a question gets, whatever number was asked for.
LANES = {"temporal": 10, "summary": 15, "snippet": 5, "auto_summary": 20}


def _given(c: str | Column) -> Column:
    """Null where a text is empty."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _with(text: Column, *parts: Column) -> Column:
    """The text and the parts that are not null."""
    return F.concat_ws("", text, *parts)


def _records(df: DataFrame, domain: str, content: Column, score: Column | float = 1.0, key: str = "id") -> DataFrame:
    score = score if isinstance(score, Column) else F.lit(score)
    return df.select(F.lit(domain).alias("domain"), content.alias("content"), score.cast("double").alias("score"), F.col(key).cast("string").alias("id"))


def summaries(hits: DataFrame) -> DataFrame:
    """Of (id, content, score)."""
    return _records(hits, "summary", F.col("content"), F.col("score"))


def events(hits: DataFrame) -> DataFrame:
    """Of (id, date, year, event_name, desc, time, score): ``Date: .. | Event: .. | Description: .. | Time: ..`` with what is given."""
    date = _given("date")
    parts = (F.concat(F.lit("Date: "), _with(date, F.concat(F.lit(", "), _given("year")))), F.concat(F.lit("Event: "), _given("event_name")), F.concat(F.lit("Description: "), _given("desc")), F.concat(F.lit("Time: "), _given("time")))
    return _records(hits, "temporal", F.concat_ws(" | ", F.when(date.isNotNull(), parts[0]), *parts[1:]), F.col("score"))


def snippets(hits: DataFrame) -> DataFrame:
    """Of a user's (id, content, language, code_snippet, score): the code follows in a fence."""
    code = F.concat(F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), _given("code_snippet"), F.lit("\n```"))
    return _records(hits, "snippet", _with(F.col("content"), code), F.col("score"))


def snippet_previews(hits: DataFrame, size: int = 200) -> DataFrame:
    """Of (id, content, snippet_type, language, tags, code_snippet, score): kind, language, tags and the beginning of the code."""
    head = F.concat(F.lit("["), F.coalesce("snippet_type", F.lit("")), F.lit("] "), F.col("content"))
    parts = (F.concat(F.lit(" ("), _given("language"), F.lit(")")), F.concat(F.lit(" tags: "), _given("tags")), F.concat(F.lit("\n```\n"), truncated(_given("code_snippet"), size), F.lit("\n```")))
    return _records(hits, "snippet", _with(head, *parts), F.col("score"))


def files(hits: DataFrame) -> DataFrame:
    """Of (file_path, language, summary, score)."""
    text = F.concat(F.lit("File `"), F.col("file_path"), F.lit("` ("), F.coalesce("language", F.lit("")), F.lit("): "), F.coalesce("summary", F.lit("")))
    return _records(hits, "file", text, F.col("score"), "file_path")


def annotations(hits: DataFrame, project_id: str | None) -> DataFrame:
    """Of active team annotations (annotation_id, annotation_type, author_name, author_role, severity, status, content, score); none without a project."""
    who = F.concat(F.coalesce("author_name", F.lit("Unknown")), F.lit(" ("), F.coalesce("author_role", F.lit("member")), F.lit("): "), F.col("content"))
    text = F.concat(F.lit("["), F.coalesce("annotation_type", F.lit("explanation")), F.lit("] by "), who)
    severity = F.concat(F.lit("["), _given("severity"), F.lit("] "))
    active = hits.where(F.lit(bool(project_id)) & (F.coalesce("status", F.lit("active")) == "active"))
    return _records(active, "team_annotation", F.concat_ws("", severity, text), F.col("score"), "annotation_id")


def annotations_of(annotations: DataFrame, target_kind: str, target: str, status: str | None = None) -> DataFrame:
    """Annotations of a symbol or file, newest first."""
    rows = annotations.where((F.col("target_kind") == target_kind) & (F.col("target") == target))
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc("created_at"), "annotation_id")


def symbols(hits: DataFrame) -> DataFrame:
    """Of (qualified_name, symbol_type, file_path, signature, summary, score)."""
    text = F.concat(F.col("symbol_type"), F.lit(" `"), F.col("qualified_name"), F.lit("` in `"), F.col("file_path"), F.lit("`"))
    signature = F.concat(F.lit("\n  Signature: `"), _given("signature"), F.lit("`"))
    return _records(hits, "symbol", _with(text, signature, F.concat(F.lit("\n  Summary: "), F.coalesce("summary", F.lit("")))), F.col("score"), "qualified_name")


def hybrid_symbols(table: DataFrame, edges: DataFrame, query: str, query_vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """(qualified_name, score, place): the k best symbols by four lanes of 3 k each, fused by rank: the vectors of summaries and of code,
    words of name, signature, code and summary together, and the number of callers. Ties keep the order of first sight.

    table: (qualified_name, signature, raw_code, summary, summary_embedding, code_embedding, ...), edges (src, dst).
    """
    table = table if where is None else table.where(where)
    best = F.desc("score"), F.asc("qualified_name")
    lane = lambda df: search.ranked(df.select("qualified_name", "score"), *best)
    vector = lambda c: lane(search.knn(table, query_vector, 3 * k, "qualified_name", c))
    words = search.bm25(table, query, 3 * k, "qualified_name", ("qualified_name", "signature", "raw_code", "summary")).withColumnRenamed("id", "qualified_name")
    called = graph.in_degree(edges).join(table.select(F.col("qualified_name").alias("node")), "node", "left_semi")
    called = search.top(called.select(F.col("node").alias("qualified_name"), F.col("callers").alias("score")), 3 * k, *best)
    fused = search.rrf([vector("summary_embedding"), vector("code_embedding"), lane(words), lane(called)], "qualified_name", limit=k)
    order = F.desc("score"), F.asc("first_lane"), F.asc("first_rank")
    return search.ranked(fused, *order).select("qualified_name", "score", F.col("rank").alias("place"))


def search_symbols(table: DataFrame, edges: DataFrame, query: str, query_vector: list[float], k: int = 10, seeds: int = 3) -> DataFrame:
    """Records of the symbols that ``hybrid_symbols`` finds, and of the callers and callees of the first ones."""
    found = hybrid_symbols(table, edges, query, query_vector, k)
    hits = symbols(found.join(table, "qualified_name").select("qualified_name", "symbol_type", "file_path", "signature", "summary", "score"))
    near = graph.seed_expand(edges, found.where(F.col("place") <= seeds).select(F.col("qualified_name").alias("node")))
    text = F.concat(F.upper("direction"), F.lit(" of `"), F.col("seed"), F.lit("`: `"), F.col("node"), F.lit("`"))
    return hits.union(_records(near, "symbol", text, F.col("score"), "node"))


def impact(table: DataFrame, calls: DataFrame, parents: DataFrame, symbol: str, depth: int = 2, n: int = 20) -> DataFrame:
    """Records of what calls a symbol, what it calls (n each, nearest first), and its parents and children; one record if there is nothing.

    table: (qualified_name, file_path, summary), calls (src, dst), parents (child, parent, relation ``extends`` or ``implements``).
    """
    start = table.sparkSession.createDataFrame([(symbol,)], "node string")
    names = table.select(F.col("qualified_name").alias("node"), "file_path", "summary")

    def side(inbound: bool, label: str) -> DataFrame:
        rows = search.top(graph.k_hop(calls, start, depth, inbound).join(names, "node"), n, F.asc("distance"), F.asc("node"))
        hops = F.concat(F.lit(" (distance: "), F.col("distance").cast("string"), F.when(F.col("distance") > 1, " hops)").otherwise(" hop)"))
        text = F.concat(F.lit(f"{label}: `"), F.col("node"), F.lit("` in `"), F.col("file_path"), F.lit("`"), hops)
        return _records(rows, f"impact_{label.lower()}", _with(text, F.concat(F.lit(" — "), _given("summary"))), 0.0, "node")

    up = parents.where(F.col("child") == symbol).select(F.when(F.col("relation") == "implements", "IMPLEMENTS").otherwise("PARENT").alias("label"), F.col("parent").alias("node"))
    down = parents.where((F.col("parent") == symbol) & (F.col("relation") == "extends")).select(F.lit("CHILD").alias("label"), F.col("child").alias("node"))
    kin = up.union(down).distinct().join(names, "node", "left")
    text = F.concat(F.col("label"), F.lit(": `"), F.col("node"), F.lit("` in `"), F.coalesce("file_path", F.lit("")), F.lit("`"))
    found = side(True, "CALLER").union(side(False, "CALLEE")).union(_records(kin, "impact_inheritance", text, 0.0, "node"))
    return _or_none(found, "impact", f"No dependencies found for `{symbol}`.", symbol)


def _or_none(found: DataFrame, domain: str, text: str, key: str) -> DataFrame:
    """The records, or one that says that there are none."""
    none = found.sparkSession.createDataFrame([(domain, text, 0.0, key)], found.schema)
    some = found.limit(1).select(F.lit(True).alias("some"))
    return found.union(none.join(F.broadcast(some), F.lit(True), "left_anti"))  # one row


def file_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, imports, imported_by): distinct, in order, for each file; imports (importer_file, imported_file)."""
    sets = lambda key, other, name: imports.groupBy(F.col(key).alias("file_path")).agg(F.array_sort(F.collect_set(other)).alias(name))
    none = F.array().cast("array<string>")
    both = files.select("file_path").distinct().join(sets("importer_file", "imported_file", "imports"), "file_path", "left").join(sets("imported_file", "importer_file", "imported_by"), "file_path", "left")
    return both.select("file_path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def file_context(table: DataFrame, imports: DataFrame, path: str) -> DataFrame:
    """Records of a file: its symbols by line, what it imports and what imports it; one record if nothing is known. ``place`` orders them."""
    own = table.where(F.col("file_path") == path)
    head = F.concat(F.col("symbol_type"), F.lit(" `"), F.col("qualified_name"), F.when(F.coalesce("is_public", F.lit(False)), "` (public)").otherwise("` (private)"))
    lines = F.when(F.col("start_line") > 0, F.concat(F.lit("\n  Lines: "), F.col("start_line").cast("string"), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?"))))
    text = _with(head, F.concat(F.lit("\n  Signature: `"), _given("signature"), F.lit("`")), F.concat(F.lit("\n  Summary: "), _given("summary")), lines)
    found = own.select(F.lit("file_symbol").alias("domain"), text.alias("content"), F.coalesce("start_line", F.lit(0)).cast("int").alias("place"))

    def listed(rows: DataFrame, other: str, domain: str, words: str, place: int) -> DataFrame:
        names = F.array_join(F.transform(F.array_sort(F.collect_set(other)), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
        rows = rows.agg(names.alias("names"), F.count(F.lit(1)).alias("n")).where("n > 0")
        return rows.select(F.lit(domain).alias("domain"), F.concat(F.lit(f"FILE `{path}` {words}: "), F.col("names")).alias("content"), F.lit(place).alias("place"))

    found = found.union(listed(imports.where(F.col("importer_file") == path), "imported_file", "file_imports", "IMPORTS", 1 << 30)).union(listed(imports.where(F.col("imported_file") == path), "importer_file", "file_imported_by", "IMPORTED BY", (1 << 30) + 1))
    none = found.sparkSession.createDataFrame([("file", f"No indexed information found for `{path}`.", 0)], found.schema)
    return found.union(none.join(F.broadcast(found.limit(1).select(F.lit(1).alias("some"))), F.lit(True), "left_anti"))


def structure(directories: DataFrame, repo: str) -> DataFrame:
    """One record: the directories (dir_path, file_count, summary) of a repository as a list, in order."""
    line = F.concat(F.lit("- `/"), F.col("dir_path"), F.lit("` ("), F.coalesce("file_count", F.lit(0)).cast("string"), F.lit(" files)"))
    rows = directories.select("dir_path", _with(line, F.concat(F.lit(": "), _given("summary"))).alias("line"))
    text = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("dir_path", "line"))), lambda x: x["line"]).alias("lines"))
    none = F.lit(f"No directory structure found for repository '{repo}'.")
    content = F.when(F.size("lines") > 0, F.concat_ws("\n", F.lit(f"Directory Structure for `{repo}`:"), "lines")).otherwise(none)
    return text.select(F.lit("repo_structure").alias("domain"), content.alias("content"), F.when(F.size("lines") > 0, 1.0).otherwise(0.0).alias("score"))


def directory_members(files: DataFrame, path: str, deep: bool = False) -> DataFrame:
    """Files in a directory, named with or without its slash; with ``deep`` also those below. The directory itself is none of them."""
    plain = path.strip("/") + "/" if path.strip("/") else "/"
    under = F.lit(True) if plain == "/" else F.startswith("file_path", F.lit(plain))
    return files.where((under if deep else graph.parent(F.col("file_path")) == plain) & ~F.col("file_path").isin(path, plain))


def top_files(files: DataFrame, n: int = 30, size: int = 200) -> DataFrame:
    """(dir_path, listing): each directory's n files with most symbols, as lines ``path: summary`` with the summary's beginning."""
    rows = search.top_per(files.where(F.col("file_path").isNotNull()).withColumn("dir_path", graph.parent(F.col("file_path"))), ["dir_path"], n, F.desc("symbol_count"), F.asc("file_path"))
    line = F.concat("file_path", F.lit(": "), F.substring(F.coalesce("summary", F.lit("")), 1, size))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("dir_path").agg(F.array_join(lines, "\n").alias("listing"))


def rendered(records: DataFrame, *order: Column) -> DataFrame:
    """One row, ``text``: a short list of records as numbered lines, or that there are none."""
    numbered = search.ranked(records, *order)
    shown = F.when(F.col("score") > 0, F.format_string(" (score: %.2f)", F.col("score").cast("double"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), F.col("domain"), F.lit("]"), shown, F.lit(" "), F.col("content"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return numbered.agg(text.alias("text")).select(F.when(F.col("text") == "", "No results found.").otherwise(F.col("text")).alias("text"))


def catalog_text(topics: DataFrame) -> DataFrame:
    """One row, ``text``: the topic catalog (topic, sub_topic, place) as lines, in order of their places."""
    line = F.concat(F.lit("  - "), F.col("topic"), F.lit(" / "), F.col("sub_topic"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    return topics.agg(text.alias("text")).select(F.when(F.col("text") == "", "(No profile data stored yet)").otherwise(F.col("text")).alias("text"))


def answer(*lanes: DataFrame) -> DataFrame:
    """Records of several lanes, in their order (column ``lane``)."""
    return reduce(DataFrame.unionByName, [lane.withColumn("lane", F.lit(i)) for i, lane in enumerate(lanes)])


def directory_summary(directories: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """One record: a directory's summary, the directories below it and the files right in it, in order; named with or without its slash.

    directories: (dir_path with a slash behind it, file_count, summary), files: (file_path, summary). Without a summary that is all that is said.
    """
    plain = path.rstrip("/") + "/" if path != "/" else "/"
    said = lambda c: F.coalesce(_given(c), F.lit("(no summary)"))
    own = directories.where(F.col("dir_path").isin(path, plain) & _given("summary").isNotNull()).select(F.lit(0).alias("part"), F.col("dir_path").alias("at"), F.concat(F.lit("## Directory `"), "dir_path", F.lit("` Summary\n"), "summary").alias("line"))
    below = directories.where(F.startswith("dir_path", F.lit(plain)) & (F.col("dir_path") != plain))
    below = below.select(F.lit(1).alias("part"), F.col("dir_path").alias("at"), F.concat(F.lit("- `"), "dir_path", F.lit("` ("), F.coalesce("file_count", F.lit(0)).cast("string"), F.lit(" files): "), said("summary")).alias("line"))
    inside = files.where(graph.parent(F.col("file_path")) == plain).select(F.lit(2).alias("part"), F.col("file_path").alias("at"), F.concat(F.lit("- `"), "file_path", F.lit("`: "), said("summary")).alias("line"))
    lines = own.union(below).union(inside).groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))
    part = lambda i, head: F.array_join(F.flatten(F.collect_list(F.when(F.col("part") == i, F.concat(F.array(*[F.lit(h) for h in head]), "lines")))), "\n")
    parts = lines.agg(part(0, []).alias("own"), part(1, ["\n### Subdirectories:"]).alias("below"), part(2, ["\n### Files in this directory:"]).alias("inside"))
    there = F.col("own") != ""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    content = F.when(there, F.concat_ws("\n", some("own"), some("below"), some("inside"))).otherwise(F.lit(f"No summary found for directory `{path}`."))
    return parts.select(F.lit("directory_summary").alias("domain"), content.alias("content"), F.when(there, 1.0).otherwise(0.0).alias("score"))


def file_summaries(files: DataFrame, paths: DataFrame) -> DataFrame:
    """A record for each of ``paths`` (file_path): its file's summary, or that there is none."""
    known = files.where(_given("summary").isNotNull()).groupBy("file_path").agg(F.min("summary").alias("summary"))
    both = paths.select("file_path").join(known, "file_path", "left")
    there = F.col("summary").isNotNull()
    content = F.when(there, F.concat(F.lit("File `"), "file_path", F.lit("` Summary: "), "summary")).otherwise(F.concat(F.lit("No summary found for file `"), "file_path", F.lit("`.")))
    return both.select(F.lit("file_summary").alias("domain"), content.alias("content"), F.when(there, 1.0).otherwise(0.0).alias("score"))
