"""Code graph queries. A part that follows another on the next line of an order is called by it; suppliers' nations are directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .core import query

_EDGES = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey != b.l_partkey"


def _edges(t):
    """Both sides are read by the same key, so the shuffle of one serves the other."""
    line = lambda name, step: t.lineitem.select("l_orderkey", (F.col("l_linenumber") + step).alias("l_linenumber"), F.col("l_partkey").alias(name))
    return line("src", 1).join(line("dst", 0), ["l_orderkey", "l_linenumber"]).where("src != dst").select("src", "dst").distinct()


@query(_EDGES)
def call_edges(t):
    return _edges(t)


@query(f"SELECT dst AS node, count(*) AS callers FROM ({_EDGES}) GROUP BY dst ORDER BY callers DESC, node LIMIT 50")
def in_degree_rank(t):
    return G.in_degree(_edges(t)).orderBy(F.desc("callers"), "node").limit(50)


def _hops(inbound: bool) -> str:
    a, b = ("dst", "src") if inbound else ("src", "dst")
    return f"""WITH RECURSIVE e AS ({_EDGES}), p AS (SELECT {b} AS node, 1 AS distance, [src || ':' || dst] AS used FROM e WHERE {a} IN (1, 2)
UNION ALL SELECT e.{b}, distance + 1, list_append(used, src || ':' || dst) FROM p JOIN e ON e.{a} = p.node WHERE distance < 3 AND NOT list_contains(used, src || ':' || dst)),
s AS (SELECT unnest([1, 2]) AS start)
SELECT DISTINCT node, distance FROM p"""


def _k_hop(t, inbound: bool):
    start = t.part.where("p_partkey IN (1, 2)").select(F.col("p_partkey").alias("node"))
    return G.k_hop(_edges(t), start, 2, inbound).select("node", "distance").distinct()


@query(_hops(True).replace("distance < 3", "distance < 2"))
def callers_k_hop(t):
    return _k_hop(t, True)


@query(_hops(False).replace("distance < 3", "distance < 2"))
def callees_k_hop(t):
    return _k_hop(t, False)


@query(f"""WITH e AS ({_EDGES}), b AS (SELECT src AS seed, 'callee' AS direction, dst AS node FROM e WHERE src IN (1, 2, 3) UNION SELECT dst, 'caller', src FROM e WHERE dst IN (1, 2, 3))
SELECT seed, direction, node, 0.5::DOUBLE AS score FROM b QUALIFY row_number() OVER (PARTITION BY seed, direction ORDER BY node) <= 5""")
def seed_expand(t):
    return G.seed_expand(_edges(t), t.part.where("p_partkey IN (1, 2, 3)").select(F.col("p_partkey").alias("node")))


@query("""WITH e AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS event_name FROM orders),
n AS (SELECT *, lead(date) OVER w AS next_date, lead(event_name) OVER w AS next_name FROM e WINDOW w AS (PARTITION BY user_id ORDER BY date, event_name))
SELECT user_id, date, event_name, next_date, next_name, CASE WHEN date = next_date THEN 'date_cluster' ELSE 'temporal' END AS kind, CASE WHEN date = next_date THEN 0.9 ELSE 0.4 END::DOUBLE AS weight FROM n WHERE next_name IS NOT NULL""")
def adjacent_events(t):
    e = t.orders.select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "MM-dd").alias("date"), F.col("o_orderkey").cast("string").alias("event_name"))
    return G.adjacent_events(e)


_FILES = "SELECT lower(r_name) || '/' || lower(replace(n_name, ' ', '_')) || '/' || s_suppkey || '.py' AS file_path, CASE WHEN s_suppkey % 3 = 0 THEN 'go' ELSE 'python' END AS language, CAST(s_suppkey % 11 AS BIGINT) AS symbol_count FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _files(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lower("r_name"), F.lit("/"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("/"), F.col("s_suppkey"), F.lit(".py"))
    return rows.select(path.alias("file_path"), F.when(F.col("s_suppkey") % 3 == 0, "go").otherwise("python").alias("language"), (F.col("s_suppkey") % 11).alias("symbol_count"))


@query(f"""WITH f AS ({_FILES}), d AS (SELECT regexp_extract(file_path, '^(.*/)[^/]+$', 1) AS dir_path, * FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY dir_path ORDER BY file_path) AS rn FROM d)
SELECT dir_path, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(*) AS file_count, CAST(sum(symbol_count) AS BIGINT) AS symbol_count,
string_agg(file_path, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) || CASE WHEN count(*) > 3 THEN ' and ' || (count(*) - 3) || ' more files' ELSE '' END AS names FROM r GROUP BY dir_path""")
def dir_rollup(t):
    return G.dir_rollup(_files(t), names=3)


@query(f"""WITH p AS (SELECT string_split(file_path, '/') AS p FROM ({_FILES})), n AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM p)
SELECT array_to_string(p[1:depth], '/') AS path, array_to_string(p[1:depth - 1], '/') AS parent, CAST(depth AS INT) AS depth, min(CASE WHEN depth = len(p) THEN 'file' ELSE 'directory' END) AS type FROM n GROUP BY 1, 2, 3""")
def dir_tree(t):
    return G.dir_tree(_files(t))


@query(f"SELECT file_path FROM ({_FILES}) WHERE regexp_extract(file_path, '^(.*/)[^/]+$', 1) = 'asia/china/'")
def children_filter(t):
    return _files(t).where(G.parent(F.col("file_path")) == "asia/china/").select("file_path")


@query(f"""WITH f AS ({_FILES}), d AS (SELECT DISTINCT lower(r_name) || '/' AS dir_path FROM region UNION ALL SELECT '/' )
SELECT dir_path, count(*) AS n FROM d JOIN f ON dir_path = '/' OR starts_with(file_path, dir_path) GROUP BY dir_path""")
def files_under_directories(t):
    """The prefix join as an equi join on ancestors."""
    dirs = t.region.select(F.concat(F.lower("r_name"), F.lit("/")).alias("dir_path")).union(t.spark.sql("SELECT '/'"))
    return G.files_under(dirs, _files(t)).groupBy("dir_path").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_brand AS file_path, split_part(p_type, ' ', 1) AS symbol_name, p_brand || '.' || p_name AS qualified_name, p_partkey AS pos FROM part),
c AS (SELECT DISTINCT p_brand AS caller_file, split_part(p_type, ' ', 1) AS caller_name, split_part(p_type, ' ', 2) AS callee_name FROM part),
k AS (SELECT DISTINCT p_brand AS caller_file, split_part(p_type, ' ', 1) AS caller_name, CASE WHEN p_partkey % 2 = 0 THEN 'ECONOMY' ELSE 'STANDARD' END AS callee_name FROM part),
a AS (SELECT file_path, symbol_name, arg_max(qualified_name, pos) AS q FROM s GROUP BY ALL),
b AS (SELECT symbol_name, arg_min(file_path, pos) AS f, arg_min(qualified_name, pos) AS q, count(*) AS n FROM s GROUP BY ALL)
SELECT DISTINCT caller_file, a.q AS caller_qname, b.f AS callee_file, b.q AS callee_qname, n > 1 AS is_ambiguous FROM k JOIN a ON a.file_path = caller_file AND a.symbol_name = caller_name JOIN b ON b.symbol_name = callee_name""")
def call_build(t):
    """Calls by flat names, resolved to symbols."""
    p = t.part
    first = F.split_part("p_type", F.lit(" "), F.lit(1))
    symbols = p.select(F.col("p_brand").alias("file_path"), first.alias("symbol_name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_partkey").alias("pos"))
    calls = p.select(F.col("p_brand").alias("caller_file"), first.alias("caller_name"), F.when(F.col("p_partkey") % 2 == 0, "ECONOMY").otherwise("STANDARD").alias("callee_name"))
    return G.build_calls(calls, symbols)


@query("""WITH f AS (SELECT 'm/' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '/__init__.py' ELSE '.py' END AS file_path, p_partkey FROM part WHERE p_partkey % 5 != 0),
i AS (SELECT f.file_path AS importer_file, 'm.' || (p_partkey + 1) AS module, 'm/' || (p_partkey + 1) AS b FROM f)
SELECT importer_file, g.file_path AS imported_file FROM i JOIN f g ON g.file_path IN (b || '.py', b || '/__init__.py')""")
def import_build(t):
    f = t.part.where("p_partkey % 5 != 0").select(F.concat(F.lit("m/"), F.col("p_partkey"), F.when(F.col("p_partkey") % 3 == 0, "/__init__.py").otherwise(".py")).alias("file_path"), "p_partkey")
    imports = f.select(F.col("file_path").alias("importer_file"), F.concat(F.lit("m."), F.col("p_partkey") + 1).alias("module"))
    return G.build_imports(imports, f)


@query("""WITH d AS (SELECT strftime(d, '%m-%d') AS date FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS d))
SELECT date, count(o_orderkey) AS n_events FROM d LEFT JOIN orders ON strftime(o_orderdate, '%m-%d') = date GROUP BY date""")
def calendar(t):
    """Each date of a leap year, with the orders as its events."""
    dates = t.orders.groupBy(F.date_format("o_orderdate", "MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return G.calendar(t.spark).join(dates, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n_events"))


@query(f"""WITH e AS ({_EDGES}) SELECT src, dst FROM e WHERE src % 3 != 0 AND dst % 3 != 0""")
def edges_with_endpoints(t):
    """Edges both of whose ends are known, once each."""
    known = t.part.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("node"))
    return G.with_endpoints(_edges(t), known, "src", "dst", "node")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS c, p_partkey // 3 AS p FROM part WHERE p_partkey // 3 > 0), u AS (SELECT p AS node, 1 AS d FROM e WHERE c = 100 UNION ALL SELECT e.p, d + 1 FROM u JOIN e ON e.c = u.node WHERE d < 5),
v AS (SELECT c AS node, 1 AS d FROM e WHERE p = 5 UNION ALL SELECT e.c, d + 1 FROM v JOIN e ON e.p = v.node WHERE d < 5)
SELECT 100 AS start, node, d AS distance, 'ancestor' AS direction FROM u UNION ALL SELECT 5, node, d, 'descendant' FROM v""")
def class_inheritance(t):
    """Ancestors of one class and descendants of another, five steps at most."""
    e = t.part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst")).where("dst > 0")
    both = G.inheritance(e, t.part.where("p_partkey IN (5, 100)").select(F.col("p_partkey").alias("node")))
    return both.where("(start = 100 AND direction = 'ancestor') OR (start = 5 AND direction = 'descendant')").select("start", "node", "distance", "direction")


@query("""WITH n AS (SELECT split_part(p_type, ' ', 1) AS n, p_brand AS f, p_partkey AS pos FROM part UNION ALL SELECT p_brand || '.' || p_name, p_brand, p_partkey FROM part),
l AS (SELECT n, arg_max(f, pos) AS callee_file FROM n GROUP BY n), c AS (SELECT DISTINCT p_brand AS caller_file, split_part(p_type, ' ', 2) AS caller_name, CASE WHEN p_partkey % 2 = 0 THEN 'ECONOMY' ELSE p_brand || '.' || p_name END AS callee_name FROM part)
SELECT caller_file, caller_name, callee_file, callee_name FROM c JOIN l ON n = callee_name""")
def call_build_by_file(t):
    """The older rule: the last file that defines the name, plain or qualified."""
    word = lambda i: F.split_part("p_type", F.lit(" "), F.lit(i))
    qualified = F.concat_ws(".", "p_brand", "p_name")
    symbols = t.part.select(F.col("p_brand").alias("file_path"), word(1).alias("symbol_name"), qualified.alias("qualified_name"), F.col("p_partkey").alias("pos"))
    calls = t.part.select(F.col("p_brand").alias("caller_file"), word(2).alias("caller_name"), F.when(F.col("p_partkey") % 2 == 0, "ECONOMY").otherwise(qualified).alias("callee_name"))
    return G.build_calls_by_file(calls, symbols)


@query("""SELECT (SELECT count(*) FROM documents) AS nodes, (SELECT string_agg(DISTINCT lang, ',' ORDER BY lang) FROM documents) AS domains, (SELECT count(*) FROM nation) AS edges""")
def memory_totals(t):
    both = G.memory_totals(t.documents.select(F.col("lang").alias("domain")), t.nation)
    return both.select("nodes", F.array_join("domains", ",").alias("domains"), "edges")


@query("SELECT o_orderkey FROM orders WHERE o_custkey != 7")
def user_cleared(t):
    return G.clear_user(t.orders, 7, "o_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def cascading_delete(t):
    """Lines of parts that go, go too."""
    from ..operators.codebase import drop_files

    gone = t.part.where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return drop_files(gone, t.lineitem, key="l_partkey")[0].select("l_orderkey", "l_linenumber")
