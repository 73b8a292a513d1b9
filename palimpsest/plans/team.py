"""Team memory queries: customers are annotations with their segment as kind and their balance as score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import team as T
from .core import query

_KIND = "CASE c_mktsegment WHEN 'BUILDING' THEN 'warning' WHEN 'MACHINERY' THEN 'instruction' ELSE 'bug_report' END"
_ROLE = "CASE WHEN c_nationkey % 2 = 0 THEN 'manager' ELSE 'sde2' END"


def _annotations(t):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "warning").when(F.col("c_mktsegment") == "MACHINERY", "instruction").otherwise("bug_report")
    return t.customer.select(F.col("c_custkey").alias("annotation_id"), F.col("c_name").alias("content"), kind.alias("annotation_type"), F.when(F.col("c_nationkey") % 2 == 0, "manager").otherwise("sde2").alias("author_role"), F.when(F.col("c_custkey") % 5 == 0, "resolved").when(F.col("c_custkey") % 5 == 1, "active").alias("status"), F.col("c_acctbal").alias("score"))


@query(f"""SELECT c_custkey AS annotation_id, c_acctbal AS score FROM customer WHERE c_custkey % 5 != 0 AND {_ROLE} = 'manager' AND {_KIND} != 'bug_report' ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def manager_instructions(t):
    return T.manager_instructions(_annotations(t)).select("annotation_id", "score")


@query(f"""(SELECT 'annotation' AS part, CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS score, c_name AS content FROM customer WHERE c_custkey % 5 != 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5)
UNION ALL (SELECT 'instruction', CAST(c_custkey AS VARCHAR), c_acctbal, c_name FROM customer WHERE c_custkey % 5 != 0 AND {_ROLE} = 'manager' AND {_KIND} != 'bug_report' ORDER BY c_acctbal DESC, c_custkey LIMIT 10)
UNION ALL (SELECT 'memory', CAST(s_suppkey AS VARCHAR), s_acctbal, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5)""")
def team_chat_context(t):
    memory = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("s_name").alias("content"))
    return T.chat_context(_annotations(t), memory, "intern")


@query("""WITH k AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'basic_info_' || lower(p_brand) WHEN p_partkey % 3 = 1 THEN 'odd_' || lower(p_brand) ELSE '' END AS k, p_partkey FROM part)
SELECT CASE WHEN starts_with(k, 'basic_info_') THEN 'basic_info' ELSE 'odd' END AS topic, regexp_replace(k, '^(basic_info|odd)_', '') AS sub_topic, min(p_partkey) AS place FROM k WHERE k != '' GROUP BY k""")
def topic_catalog(t):
    """Keys split at the longest known topic."""
    brand = F.lower("p_brand")
    key = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("basic_info_"), brand)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("odd_"), brand)).otherwise("")
    return T.topic_catalog(t.part.select(key.alias("main_content"), F.col("p_partkey").alias("id")))


@query("""SELECT a.c_nationkey AS user_id, a.c_custkey AS a, b.c_custkey AS b, 0.8::DOUBLE AS weight FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey""")
def topic_edges(t):
    return T.topic_edges(t.customer.select(F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("topic"), F.col("c_custkey").alias("id")))


@query("""SELECT l_orderkey, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) FILTER (WHERE l_returnflag != 'N') AS flag, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag)) AS supplier FROM lineitem GROUP BY l_orderkey""")
def merge_chunk_results(t):
    """Lines as chunks of an order: the last flag that is set, and the last supplier."""
    rows = t.lineitem.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag").alias("pos"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"), F.col("l_suppkey").alias("supplier"), F.array().cast("array<string>").alias("errors"))
    return T.merge_chunks(rows, "l_orderkey", "pos", ("flag", "supplier")).select("l_orderkey", "flag", "supplier")


@query("""SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey = 1) AS starred FROM part""")
def starred_by_me(t):
    mine = t.lineitem.where("l_suppkey = 1").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("starred", F.lit(True))
    return t.part.select("p_partkey").join(mine, "p_partkey", "left").withColumn("starred", F.coalesce("starred", F.lit(False)))


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' AND text != '' GROUP BY conv_id""")
def stream_text(t):
    """Answers out of their NDJSON stream."""
    line = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("chunk").alias("type"), "text"))).otherwise("{broken")
    c = t.conversations.where("text != ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("s")))).alias("s"), F.bool_or(F.col("role") == "assistant").alias("any"))
    return c.where("any").select("conv_id", X.ndjson_text(F.array_join(F.transform("s", lambda x: x["s"]), "\n")).alias("text"))


@query("""WITH k AS (SELECT p_brand AS b, min(p_partkey) AS place FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT string_agg('  - work / ' || lower(b), chr(10) ORDER BY place) AS text FROM k""")
def topic_catalog_text(t):
    """The catalog as a model reads it."""
    from ..operators import evidence as E

    key = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("work_"), F.lower("p_brand"))).otherwise("")
    return E.catalog_text(T.topic_catalog(t.part.select(key.alias("main_content"), F.col("p_partkey").alias("id"))))


@query("""SELECT n_nationkey AS item, 'NEW: ' || n_name || chr(10) || CASE WHEN n_regionkey = 0 THEN '(none)' ELSE n_regionkey || ' | ' || printf('%.3f', n_nationkey / 7.0) || ' | old' END AS block FROM nation""")
def neighbour_blocks(t):
    near = F.when(F.col("n_regionkey") == 0, F.array().cast("array<struct<id:int,score:double,content:string>>")).otherwise(F.array(F.struct(F.col("n_regionkey").alias("id"), (F.col("n_nationkey") / 7.0).alias("score"), F.lit("old").alias("content"))))
    return t.nation.select(F.col("n_nationkey").alias("item"), T.neighbour_block(F.col("n_name"), near).alias("block"))


_TURNS = """SELECT p_partkey AS turn_id, p_size AS project_id, p_brand AS repo, 'u' || (p_partkey % 5) AS user_id, CASE p_partkey % 4 WHEN 0 THEN 'manager' WHEN 1 THEN 'sde2' WHEN 2 THEN 'intern' END AS role, CASE WHEN p_partkey % 3 = 0 THEN ' fix: ' || p_type || ' ' ELSE p_name END AS query FROM part"""


def _turns(t):
    k = F.col("p_partkey")
    role = F.when(k % 4 == 0, "manager").when(k % 4 == 1, "sde2").when(k % 4 == 2, "intern")
    said = F.when(k % 3 == 0, F.concat(F.lit(" fix: "), "p_type", F.lit(" "))).otherwise(F.col("p_name"))
    return t.part.select(k.alias("turn_id"), F.col("p_size").alias("project_id"), F.lit("o").alias("org_id"), F.col("p_brand").alias("repo"), F.concat(F.lit("u"), k % 5).alias("user_id"), F.lit(None).cast("string").alias("user_name"), role.alias("role"), said.alias("query"), F.lit(None).cast("string").alias("file_path"), F.lit("f").alias("symbol_name"))


def _found(text: str) -> list[tuple]:
    """An agent that finds what stands behind the word fix."""
    return [(text.split(":", 1)[1], "fix", None, None, None, None, None)] if text.startswith("fix:") else []


@query(f"""SELECT turn_id, project_id, user_id AS author_name, role AS author_role, trim(substr(trim(query), 5)) AS content, 'fix' AS annotation_type, 'f' AS symbol_name, repo FROM ({_TURNS}) WHERE role IN ('manager', 'sde2') AND starts_with(trim(query), 'fix:')""")
def annotations_extracted(t):
    """Annotations of members that may annotate, by an agent that sees each distinct text once."""
    from ..operators import agents

    turns = _turns(t)
    made = agents.annotations(turns, _found)
    ids = turns.select("turn_id", F.substring(F.sha2(F.concat_ws("\x00", F.col("turn_id").cast("string"), F.trim(F.substring(F.trim("query"), 5, 1000))), 256), 1, 16).alias("annotation_id"))
    return made.join(ids, "annotation_id").select("turn_id", "project_id", "author_name", "author_role", "content", "annotation_type", "symbol_name", "repo")


@query(f"""WITH n AS (SELECT project_id, count(*) AS n FROM ({_TURNS}) WHERE role IN ('manager', 'sde2') AND starts_with(trim(query), 'fix:') GROUP BY 1)
SELECT p.project_id, CAST(p.project_id * 10 + coalesce(n.n, 0) AS BIGINT) AS annotation_count FROM (SELECT DISTINCT p_size AS project_id FROM part) p LEFT JOIN n USING (project_id)""")
def annotation_counts(t):
    """Counts of projects go up by the annotations created for them."""
    from ..operators import agents

    projects = t.part.select(F.col("p_size").alias("project_id")).distinct().withColumn("annotation_count", F.col("project_id").cast("long") * 10)
    return agents.counted(projects, agents.annotations(_turns(t), _found)).select("project_id", "annotation_count")


@query("""SELECT 'u' || c_nationkey AS user_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, lower(c_mktsegment) AS domain, c_name AS content, c_acctbal AS score FROM customer QUALIFY rank <= 5""")
def team_memory(t):
    """Each user's five best sources, however many are asked for."""
    sources = t.customer.select(F.concat(F.lit("u"), "c_nationkey").alias("user_id"), F.col("c_custkey").alias("id"), F.lower("c_mktsegment").alias("domain"), F.col("c_name").alias("content"), F.col("c_acctbal").alias("score"))
    return T.relevant_memory(sources, top_k=20).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT conv_id * 1000 + turn AS turn_id, CASE WHEN role = 'user' THEN text ELSE '' END AS user_query, CASE WHEN role = 'assistant' AND text != '' THEN text ELSE 'Acknowledged.' END AS agent_response, CASE WHEN role = 'system' OR trim(text) = '' THEN NULL ELSE 'profile,temporal,summary,image' END AS lanes, CASE WHEN role = 'system' OR trim(text) = '' THEN 'empty conversation' END AS error FROM conversations""")
def team_ingest(t):
    """Turns as they are stored with the lanes of code and snippets off."""
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.lit("u").alias("user_id"), F.when(F.col("role") == "user", F.col("text")).alias("query"), F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("answer"))
    return T.ingestible(c).select("turn_id", "user_query", "agent_response", F.array_join("lanes", ",").alias("lanes"), "error")


@query("""SELECT o_custkey % 50 AS org_id, 'r' AS repo, o_orderkey AS scan_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CASE o_orderstatus WHEN 'F' THEN 'c' || o_orderkey ELSE 's' || o_orderkey END AS commit_sha, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS error FROM orders WHERE o_orderkey % 9 != 0""")
def scan_states(t):
    """Scans run, end or fail; what was never started has no state."""
    from ..operators import records

    k = F.col("o_orderkey")
    base = t.orders.select((F.col("o_custkey") % 50).alias("org_id"), F.lit("r").alias("repo"), k.alias("scan_id"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("day"))
    start = base.where("scan_id % 9 != 0").select("org_id", "repo", "scan_id", F.lit("started").alias("event"), F.col("day").alias("at"), F.concat(F.lit("s"), "scan_id").alias("commit_sha"), F.lit(None).cast("string").alias("error"))
    done = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed")
    end = base.select("org_id", "repo", "scan_id", done.alias("event"), (F.col("day") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("c"), "scan_id")).alias("commit_sha"), F.col("o_orderpriority").alias("error")).where("event IS NOT NULL")
    early = end.where("scan_id % 4 = 0").withColumns({"event": F.lit("failed"), "at": F.col("at") - F.expr("INTERVAL 9 DAYS")})
    return records.scan_states(start.union(end).union(early)).drop("started_at", "finished_at")


@query("""WITH m AS (SELECT c_custkey AS k, c_custkey % 6 AS w FROM customer)
SELECT k % 20 AS project_id, k AS user_id, CASE WHEN w = 1 THEN 'again' WHEN w = 5 THEN 'new' ELSE 'old' END AS username, CASE WHEN w = 2 THEN 'manager' WHEN w IN (1, 5) THEN 'sde2' ELSE 'intern' END AS role, w != 3 AS is_active FROM m WHERE w != 4""")
def team_changes(t):
    """Members are added again, removed and get other roles; changes of unknown ones do nothing, nobody is deleted."""
    from ..operators import records

    k, w = F.col("c_custkey"), F.col("c_custkey") % 6
    row = lambda df, name, role, active: df.select((k % 20).alias("project_id"), k.alias("user_id"), F.lit(name).alias("username"), F.lit(role).alias("role"), active.alias("is_active"))
    members = row(t.customer.where(w < 4), "old", "intern", w != 1)
    change = lambda df, seq, kind, name=None, role=None: df.select((k % 20).alias("project_id"), k.alias("user_id"), F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.lit(name).cast("string").alias("username"), F.lit(role).cast("string").alias("role"))
    c = t.customer
    changes = change(c.where(w.isin(1, 5)), 2, "add", "again", "sde2").union(change(c.where(w == 2), 3, "role", role="manager")).union(change(c.where(w.isin(3, 4)), 4, "remove")).union(change(c.where(w.isin(1, 4, 5)), 1, "role", role="manager"))
    changes = changes.withColumn("username", F.when(F.col("user_id") % 6 == 5, "new").otherwise(F.col("username")))
    return records.members_after(members, changes)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_name ELSE p_name END AS summary, CASE WHEN p_partkey % 3 = 0 THEN 'llm' ELSE 'ast' END AS summary_source, p_brand AS code_embedding FROM part""")
def summary_updates(t):
    """New summaries of symbols; the embedding of their code is never touched."""
    from ..operators import records

    stored = t.part.select("p_partkey", F.col("p_name").alias("summary"), F.lit("ast").alias("summary_source"), F.col("p_brand").alias("code_embedding"))
    new = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("summary"), F.lit("llm").alias("summary_source"), F.lit("lost").alias("code_embedding"))
    return records.whitelisted(stored, new, ["p_partkey"], records.SUMMARY)


@query("""SELECT 'project' AS kind, CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_regionkey != 2 UNION ALL SELECT 'member', c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey != 2""")
def projects_deleted(t):
    """Projects that go take their members along."""
    from ..operators import records

    projects = t.nation.select(F.col("n_nationkey").alias("project_id"), "n_regionkey")
    members = t.customer.select(F.col("c_nationkey").alias("project_id"), "c_custkey")
    p, m = records.without_projects(projects.where("n_regionkey = 2"), projects, members)
    return p.select(F.lit("project").alias("kind"), F.col("project_id").cast("long").alias("id")).union(m.select(F.lit("member"), "c_custkey"))
