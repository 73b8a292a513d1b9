"""An index of source code kept up to date: changed files and symbols, what is to be embedded, and edges of the current state."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import complexity_bucket, hash16, head_tail
from ..sources import code
from ..workspace import Workspace
from . import graph

#: Characters of a summary text, of its docstring and of a code text.
SUMMARY_CHARS, DOCSTRING_CHARS, CODE_CHARS = 1_200, 500, 36_000


def symbol_summary(docstring: Column, kind: Column, name: Column, parameters: Column) -> Column:
    """The docstring's first line, cut to 200 characters; without one kind, name and parameters."""
    line = F.trim(F.split(F.trim(docstring), "\n")[0])
    cut = F.when(F.length(line) > 200, F.concat(F.substring(line, 1, 200), F.lit("..."))).otherwise(line)
    made = F.concat(kind, F.lit(" "), name, F.lit("("), F.array_join(F.coalesce(parameters, F.array().cast("array<string>")), ", "), F.lit(")"))
    return F.when(F.coalesce(docstring, F.lit("")) != "", cut).otherwise(made)


def file_summary(path: Column, language: Column, names: Column, shown: int = 10) -> Column:
    """``Defines: ..`` with the first names and how many more there are."""
    more = F.when(F.size(names) > shown, F.concat(F.lit(" and "), (F.size(names) - shown).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.size(names) > 0, F.concat(F.lit("Defines: "), F.array_join(F.slice(names, 1, shown), ", "), more)).otherwise(F.concat(F.lit("File "), path, F.lit(" ("), language, F.lit(")")))


def summary_text(name: Column, signature: Column, docstring: Column, summary: Column) -> Column:
    """What the summary lane embeds: the parts that are given, cut to SUMMARY_CHARS."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.substring(F.concat_ws(" ", some(name), some(signature), some(F.substring(docstring, 1, DOCSTRING_CHARS)), some(summary)), 1, SUMMARY_CHARS)


def code_text(name: Column, signature: Column, raw_code: Column) -> Column:
    """What the code lane embeds: name, signature and code, of long code both ends; never the summary."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", some(name), some(signature), some(head_tail(raw_code, CODE_CHARS)))


def file_text(path: Column, language: Column, summary: Column, names: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.substring(F.concat_ws(" ", some(path), some(language), some(summary), names), 1, SUMMARY_CHARS)


@dataclass(frozen=True)
class Index:
    """The tables of an index of source code.

    files (file_path, language, content_hash), symbols (SYMBOLS with ``summary`` and ``embed``), call_names (CALLS) and import_names
    (IMPORTS) as they stand in the files, and the edges they are resolved to: calls (caller_file, caller_name, caller_qname,
    callee_name, callee_file, callee_qname, is_ambiguous) and imports (importer_file, module, imported_file).
    """

    files: DataFrame
    symbols: DataFrame
    call_names: DataFrame
    import_names: DataFrame
    calls: DataFrame
    imports: DataFrame


def empty_index(spark: SparkSession) -> Index:
    none = lambda schema: spark.createDataFrame([], schema)
    calls = code.CALLS + ", caller_qname string, callee_file string, callee_qname string, is_ambiguous boolean"
    return Index(none("file_path string, language string, content_hash string"), none(code.SYMBOLS + ", summary string, embed boolean"), none(code.CALLS), none(code.IMPORTS), none(calls), none(code.IMPORTS + ", imported_file string"))


def _kept(fates: DataFrame) -> DataFrame:
    return fates.where("fate = 'kept'").select("file_path")


def _todo(fates: DataFrame) -> DataFrame:
    return fates.where("fate IN ('new', 'changed')").select("file_path")


@dataclass(frozen=True)
class Scan:
    """The files and symbols of the next state of an index, the fate of each file (new, changed, kept, gone), what the parsed files hold, and one row of counts."""

    files: DataFrame
    symbols: DataFrame
    fates: DataFrame
    parsed: DataFrame
    audit: DataFrame


def scan_symbols(files: DataFrame, old_files: DataFrame, old_symbols: DataFrame, work: Workspace) -> Scan:
    """The part of ``scan`` that needs no edges: for who reads symbols or counts only."""
    new = work.save(files.select("file_path", "language", hash16(F.col("content")).alias("content_hash")), "files")
    both = new.withColumn("__new", F.lit(True)).join(old_files.select("file_path", F.col("content_hash").alias("__hash"), F.lit(True).alias("__old")), "file_path", "full")
    fate = F.when(F.col("__new").isNull(), "gone").when(F.col("__old").isNull(), "new").when(F.col("content_hash").eqNullSafe(F.col("__hash")), "kept").otherwise("changed")
    fates = work.save(both.select("file_path", fate.alias("fate")), "fates")
    kept, todo = _kept(fates), _todo(fates)
    parsed = work.save(code.parsed(files.join(todo, "file_path", "left_semi")), "parsed")

    # symbols: kept files' as they are, others' compared by hash
    made = symbol_summary(F.col("docstring"), F.col("symbol_type"), F.col("qualified_name"), F.col("parameters"))
    stored = old_symbols.groupBy("file_path", "qualified_name").agg(F.min_by(F.struct(F.col("content_hash").alias("hash"), "summary"), "start_line").alias("was"))
    fresh = code.symbols_of(parsed).where("error IS NULL").join(stored, ["file_path", "qualified_name"], "left")
    unchanged = F.col("content_hash").eqNullSafe(F.col("was.hash"))
    columns = [*[c for c in old_symbols.columns if c not in ("summary", "embed")]]
    fresh = fresh.select(*columns, F.when(unchanged, F.col("was.summary")).otherwise(made).alias("summary"), (~unchanged).alias("embed"))
    carried = old_symbols.join(kept, "file_path", "left_semi").select(*columns, "summary", F.lit(False).alias("embed"))
    symbols = work.save(carried.unionByName(fresh), "symbols")
    redone = fates.where("fate != 'kept'").select("file_path")
    lost = old_symbols.join(redone, "file_path", "left_semi").select("file_path", "qualified_name").distinct().join(symbols.select("file_path", "qualified_name"), ["file_path", "qualified_name"], "left_anti")
    n = lambda w: F.count(F.when(F.expr(w), 1))
    audit = fates.agg(n("fate IN ('new', 'changed')").alias("files_processed"), n("fate = 'kept'").alias("files_unchanged"), n("fate = 'gone'").alias("files_deleted"))
    audit = audit.crossJoin(symbols.agg(n("embed").alias("symbols_indexed"))).crossJoin(lost.agg(F.count(F.lit(1)).alias("symbols_deleted")))  # one row each
    audit = audit.crossJoin(parsed.agg(n("error IS NOT NULL").alias("parse_errors")))
    return Scan(new, symbols, fates, parsed, audit)


def scan(files: DataFrame, old: Index, work: Workspace | None = None) -> tuple[Index, DataFrame]:
    """(the next state of an index, one row of counts). Work goes with what changed, but for reading the tables.

    files: (file_path, language, content) of the whole tree, a row a file, in all languages that have a reader. Each file whose hash isn't the
    stored one is parsed once, into a stored table. Of the others, symbols, calls and imports are kept. Symbols whose hash is the
    stored one keep their summary; the rest are written with ``embed`` true, for the embedding lanes to take. Files and what
    was in them go when they are no longer there.

    Edges are kept as a join is by its delta: a call is resolved anew if its file changed, or if a symbol of the called name was
    added, moved or removed anywhere; an import, if its file changed or a file that it may mean came or went. All others are carried over. The
    result equals that of an index built from nothing, but for summaries and ``embed``. Files that can't be parsed have
    no symbols, calls and imports. The tables of the state lie in the workspace for as long as they are used.
    """
    work = work or Workspace(files.sparkSession, "index")
    done = scan_symbols(files, old.files, old.symbols, work)
    new, symbols, fates, parsed = done.files, done.symbols, done.fates, done.parsed
    kept, todo = _kept(fates), _todo(fates)
    names = [old.call_names.join(kept.withColumnRenamed("file_path", "caller_file"), "caller_file", "left_semi").unionByName(code.calls_of(parsed).distinct())]
    names.append(old.import_names.join(kept.withColumnRenamed("file_path", "importer_file"), "importer_file", "left_semi").unionByName(code.imports_of(parsed).distinct()))
    call_names, import_names = work.save(names[0], "call-names"), work.save(names[1], "import-names")

    # calls: anew where the caller's file isn't kept, or the definitions of the called name differ
    place = ["symbol_name", "file_path", "qualified_name", "start_line"]
    moved = lambda now, was: now.select(*place).exceptAll(was.select(*place)).select(F.col("symbol_name").alias("callee_name"))
    redone = fates.where("fate != 'kept'").select("file_path")
    changed_now, changed_old = (x.join(redone, "file_path", "left_semi") for x in (symbols, old.symbols))
    touched = work.save(moved(changed_now, changed_old).union(moved(changed_old, changed_now)).distinct(), "touched-names")
    valid = old.calls.join(kept.withColumnRenamed("file_path", "caller_file"), "caller_file", "left_semi").join(touched, "callee_name", "left_anti")
    open_ = call_names.join(todo.select(F.col("file_path").alias("caller_file"), F.lit(True).alias("__a")), "caller_file", "left").join(touched.select("callee_name", F.lit(True).alias("__b")), "callee_name", "left")
    open_ = open_.where("__a OR __b").select("caller_file", "caller_name", "callee_name")
    placed = symbols.select("file_path", "symbol_name", "qualified_name", F.struct("file_path", "start_line", "qualified_name").alias("pos"))
    calls = work.save(valid.unionByName(graph.resolve_calls(open_, placed)), "calls")

    # imports: anew where the file isn't kept, or a file of a name it may mean came or went
    came = work.save(fates.where("fate IN ('new', 'gone')").select(F.explode(graph.bases_of(F.col("file_path"))).alias("__base")).distinct(), "touched-bases")
    based = lambda df: df.withColumn("__base", graph.base_of(F.col("module")))
    valid = based(old.imports.join(kept.withColumnRenamed("file_path", "importer_file"), "importer_file", "left_semi")).join(came, "__base", "left_anti").drop("__base")
    open_ = based(import_names).join(todo.select(F.col("file_path").alias("importer_file"), F.lit(True).alias("__a")), "importer_file", "left").join(came.withColumn("__b", F.lit(True)), "__base", "left")
    imports = work.save(valid.unionByName(graph.resolve_imports(open_.where("__a OR __b").select("importer_file", "module"), new)), "imports")

    return Index(new, symbols, call_names, import_names, calls, imports), done.audit


def edges_of(files: DataFrame, symbols: DataFrame | None = None, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, imports) of the current state, from the files (file_path, language, content) and their symbols, those in the files if none are given.

    Each file is parsed once, into a stored table of names; a table of symbols that is given is read twice.
    """
    parsed, place = code.parsed(files), ("symbol_name", "qualified_name", "start_line")
    names = F.transform("symbols", lambda s: F.struct(*[s[c].alias(c) for c in place])).alias("symbols")
    parsed = (work or Workspace(files.sparkSession, "edges")).save(parsed.select("file_path", names, "calls", "imports"), "parsed")
    if symbols is None:
        symbols = parsed.select("file_path", F.explode("symbols").alias("s")).select("file_path", "s.*")
    placed = symbols.select("file_path", "symbol_name", "qualified_name", F.struct("file_path", "start_line", "qualified_name").alias("pos"))
    return graph.build_calls(code.calls_of(parsed), placed), graph.build_imports(code.imports_of(parsed), files)


def drop_files(gone: DataFrame, *tables: DataFrame, key: str = "file_path") -> list[DataFrame]:
    """Tables without what belongs to the files that go: files, symbols, annotations."""
    names = gone.select(key).distinct()
    return [t.join(names, key, "left_anti") for t in tables]


def drop_repo(index: Index, org_id: str, repo: str) -> Index:
    """An index of several repositories (its tables have org_id and repo) without one of them."""
    there = ~(F.col("org_id").eqNullSafe(F.lit(org_id)) & F.col("repo").eqNullSafe(F.lit(repo)))
    return Index(*[getattr(index, f.name).where(there) for f in fields(index)])


def with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols whose file is known."""
    return symbols.join(files.select("file_path").distinct(), "file_path", "left_semi")


def enrich(symbols: DataFrame, n: int, summarise, code_chars: int = 12_000, summary_chars: int = 300) -> DataFrame:
    """The table with new summaries of the first n symbols without one by a model: public ones first, then entry points, then by name.

    ``summarise`` maps (name column, code column) to a text column; code is given by both its ends. Only summary and its source change.
    """
    waiting = symbols.where(~F.col("summary_source").eqNullSafe("llm"))
    queue = waiting.orderBy(F.desc("is_public"), F.desc("is_entrypoint"), "qualified_name", "file_path").limit(n)
    text = F.substring(summarise(F.col("qualified_name"), head_tail(F.col("raw_code"), code_chars)), 1, summary_chars)
    done = queue.select("file_path", "qualified_name", text.alias("__text")).where(F.coalesce("__text", F.lit("")) != "")
    both = symbols.join(done, ["file_path", "qualified_name"], "left")
    new = {"summary": F.coalesce("__text", "summary"), "summary_source": F.when(F.col("__text").isNotNull(), "llm").otherwise(F.col("summary_source"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in symbols.columns])


def directories(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dir_path, file_count, symbol_count, complexity): with the bucket of the most complex symbol."""
    place = graph.parent(F.col("file_path")).alias("dir_path")
    f = files.groupBy(place).agg(F.count(F.lit(1)).alias("file_count"))
    s = symbols.groupBy(place).agg(F.count(F.lit(1)).alias("symbol_count"), complexity_bucket(F.coalesce(F.max("complexity"), F.lit(0))).alias("complexity"))
    return f.join(s, "dir_path", "left").select("dir_path", "file_count", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"), F.coalesce("complexity", F.lit("low")).alias("complexity"))
