"""Code graph: building edges, bounded traversal, ranks, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (caller_file, caller_name, callee_name) by flat names against symbols (file_path, symbol_name, qualified_name, pos), with what they were resolved to.

    The caller is the last symbol of that name in its file, the callee the first of that name by pos; several candidates
    make the edge ambiguous. Dotted callee names match nothing.
    """
    callers = symbols.groupBy(F.col("file_path").alias("caller_file"), F.col("symbol_name").alias("caller_name")).agg(F.max_by("qualified_name", "pos").alias("caller_qname"))
    callees = symbols.groupBy(F.col("symbol_name").alias("callee_name")).agg(F.min_by(F.struct("file_path", "qualified_name"), "pos").alias("callee"), F.count(F.lit(1)).alias("n"))
    rows = calls.distinct().join(callers, ["caller_file", "caller_name"]).join(callees, "callee_name")
    return rows.select("caller_file", "caller_name", "callee_name", "caller_qname", F.col("callee.file_path").alias("callee_file"), F.col("callee.qualified_name").alias("callee_qname"), (F.col("n") > 1).alias("is_ambiguous"))


def build_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The distinct edges (caller_file, caller_qname, callee_file, callee_qname, is_ambiguous) of ``resolve_calls``."""
    return resolve_calls(calls, symbols).select("caller_file", "caller_qname", "callee_file", "callee_qname", "is_ambiguous").distinct()


def base_of(module: Column) -> Column:
    """The path that a module name means, without what may follow it."""
    return F.replace(module, F.lit("."), F.lit("/"))


def bases_of(path: Column) -> Column:
    """What ``base_of`` gives for the modules that may mean a file: of a/b.py a/b, of a/b/__init__.py a/b too."""
    bases = F.array(F.regexp_extract(path, r"(?s)^(.*)/__init__\.py$", 1), F.regexp_extract(path, r"(?s)^(.*)\.py$", 1))
    return F.filter(bases, lambda s: s != "")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (importer_file, module) with the known file they mean: a/b.py, else a/b/__init__.py; not of the importer itself."""
    base = base_of(F.col("module"))
    rows = imports.select("importer_file", "module").withColumns({"plain": F.concat(base, F.lit(".py")), "package": F.concat(base, F.lit("/__init__.py"))})
    known = files.select("file_path").distinct()
    rows = rows.join(known.select(F.col("file_path").alias("plain"), F.lit(True).alias("p")), "plain", "left")
    rows = rows.join(known.select(F.col("file_path").alias("package"), F.lit(True).alias("q")), "package", "left")
    found = rows.select("importer_file", "module", F.when(F.col("p"), F.col("plain")).when(F.col("q"), F.col("package")).alias("imported_file"))
    return found.where("imported_file IS NOT NULL AND imported_file != importer_file").distinct()


def build_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The distinct edges (importer_file, imported_file) of ``resolve_imports``."""
    return resolve_imports(imports, files).select("importer_file", "imported_file").distinct()


def with_endpoints(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges between known nodes, once each."""
    a, b = (nodes.select(F.col(node).alias(x)).distinct() for x in (src, dst))
    return edges.join(a, src, "left_semi").join(b, dst, "left_semi").dropDuplicates([src, dst])


def k_hop(edges: DataFrame, start: DataFrame, depth: int, inbound: bool = False, least: bool = False) -> DataFrame:
    """(start, node, distance): nodes at the end of walks of 1..depth edges, a row for each length, or with ``least`` for the shortest.

    edges (src, dst), start (node). Each hop joins the distinct (start, node) pairs of the last one, so it grows with the nodes
    that are reached and not with the paths. A walk of two edges doesn't take a loop twice; longer ones may come by an edge
    again, which ``least`` leaves out.
    """
    e = edges.select(F.col("dst" if inbound else "src").alias("at"), F.col("src" if inbound else "dst").alias("next")).distinct()
    frontier = start.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct()
    out = None
    for d in range(1, depth + 1):
        step = frontier.join(e, "at")
        if d == 2:
            step = step.where(~((F.col("at") == F.col("start")) & (F.col("next") == F.col("at"))))
        frontier = step.select("start", F.col("next").alias("at")).distinct()
        if least and out is not None:
            frontier = frontier.join(out.select("start", F.col("node").alias("at")), ["start", "at"], "left_anti")
        rows = frontier.select("start", F.col("at").alias("node"), F.lit(d).alias("distance"))
        out = rows if out is None else out.union(rows)
    return out


def in_degree(edges: DataFrame, dst: str = "dst") -> DataFrame:
    return edges.groupBy(F.col(dst).alias("node")).agg(F.count(F.lit(1)).alias("callers"))


def seed_expand(edges: DataFrame, seeds: DataFrame, n: int = 5) -> DataFrame:
    """(seed, direction, node, score): the first n callees and callers of each seed by name; edges (src, dst), seeds (node)."""
    outs = seeds.join(edges, seeds["node"] == edges["src"]).select(F.col("node").alias("seed"), F.lit("callee").alias("direction"), F.col("dst").alias("found"))
    ins = seeds.join(edges, seeds["node"] == edges["dst"]).select(F.col("node").alias("seed"), F.lit("caller").alias("direction"), F.col("src").alias("found"))
    both = outs.unionByName(ins).distinct().withColumn("rank", F.row_number().over(W.partitionBy("seed", "direction").orderBy("found"))).where(F.col("rank") <= n)
    return both.select("seed", "direction", F.col("found").alias("node"), F.lit(0.5).alias("score"))


def parent(path: Column) -> Column:
    """The directory of a path, with a slash at its end; the root is a slash."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)[^/]+/?$", 1), F.lit("")), F.lit("/"))


def dir_tree(files: DataFrame, path: str = "file_path") -> DataFrame:
    """(path, parent, depth, type): every prefix of a path is a node; what no path goes on from is a file."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size("parts")
    rows = files.select(parts.alias("parts")).where(n > 0).select("parts", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    join = lambda k: F.array_join(F.slice("parts", 1, k), "/")
    nodes = rows.select(join(F.col("depth")).alias("path"), join(F.col("depth") - 1).alias("parent"), "depth", F.when(F.col("depth") == n, "file").otherwise("directory").alias("type"))
    return nodes.groupBy("path", "parent", "depth").agg(F.min("type").alias("type"))


def dir_rollup(files: DataFrame, names: int = 20) -> DataFrame:
    """files (file_path, language, symbol_count): for each directory its languages, files, symbols, and its first names with how many more there are."""
    rows = files.withColumn("dir_path", parent(F.col("file_path")))
    agg = rows.groupBy("dir_path").agg(F.array_sort(F.collect_set("language")).alias("languages"), F.count(F.lit(1)).alias("file_count"), F.sum("symbol_count").alias("symbol_count"))
    first = rows.withColumn("rn", F.row_number().over(W.partitionBy("dir_path").orderBy("file_path"))).where(F.col("rn") <= names)
    first = first.groupBy("dir_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "file_path"))), lambda x: x["file_path"]), ", ").alias("names"))
    more = F.when(F.col("file_count") > names, F.concat("names", F.lit(" and "), (F.col("file_count") - names).cast("string"), F.lit(" more files"))).otherwise(F.col("names"))
    return agg.join(first, "dir_path").select("dir_path", F.array_join("languages", ",").alias("languages"), "file_count", "symbol_count", more.alias("names"))


def files_under(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """(dir_path, file_path) of files below each directory at any depth: an equi join on the files' ancestors instead of a prefix join."""
    parts = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return files.select("file_path", F.explode(up).alias("dir_path")).join(dirs.select("dir_path").distinct(), "dir_path").select("dir_path", "file_path")


def inheritance(edges: DataFrame, start: DataFrame, depth: int = 5) -> DataFrame:
    """Ancestors and descendants of classes with their least distance; edges (src child, dst parent)."""
    up = k_hop(edges, start, depth, least=True).withColumn("direction", F.lit("ancestor"))
    return up.unionByName(k_hop(edges, start, depth, inbound=True, least=True).withColumn("direction", F.lit("descendant")))


def adjacent_events(events: DataFrame, user: str = "user_id") -> DataFrame:
    """Each event with the user's next one by date and name: (user, event_name, next_name, kind, weight)."""
    w = W.partitionBy(user).orderBy("date", "event_name")
    rows = events.withColumns({"next_name": F.lead("event_name").over(w), "next_date": F.lead("date").over(w)}).where("next_name IS NOT NULL")
    same = F.col("date") == F.col("next_date")
    return rows.select(user, "date", "event_name", "next_date", "next_name", F.when(same, "date_cluster").otherwise("temporal").alias("kind"), F.when(same, 0.9).otherwise(0.4).alias("weight"))


def calendar(spark) -> DataFrame:
    """The 366 MM-DD dates of a leap year."""
    return spark.sql("SELECT date_format(d, 'MM-dd') AS date FROM (SELECT explode(sequence(date'2024-01-01', date'2024-12-31')) AS d)")


def build_calls_by_file(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The older rule: calls (caller_file, caller_name, callee_name) whose callee is a name or qualified name of a symbol; its file is the last one
    by ``pos`` that defines the name. symbols (file_path, symbol_name, qualified_name, pos)."""
    names = symbols.select(F.explode(F.array_distinct(F.array("symbol_name", "qualified_name"))).alias("callee_name"), "file_path", "pos")
    last = names.groupBy("callee_name").agg(F.max_by("file_path", "pos").alias("callee_file"))
    return calls.distinct().join(last, "callee_name").select("caller_file", "caller_name", "callee_file", "callee_name")


def clear_user(rows: DataFrame, user_id: str | int, user: str = "user_id") -> DataFrame:
    """The table without a user's rows."""
    return rows.where(~F.col(user).eqNullSafe(user_id))


def memory_totals(memory: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges and the domains in use, in order."""
    return memory.agg(F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_set("domain")).alias("domains")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row each
