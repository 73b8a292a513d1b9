"""Reconciliation of incoming facts and events with stored ones.

Customers are users: a stored fact is a customer's market segment and balance, an incoming one comes from orders. Orders are
events, named by their priority.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as R
from .core import query

#: Stored facts: segment of each customer but every seventh; incoming: one for each of a customer's orders, the last counts.
_STORED = """SELECT c_custkey AS user_id, 'c' || c_custkey AS id, 'work_segment' AS main_content, c_mktsegment AS subcontent FROM customer WHERE c_custkey % 7 != 0"""
_ITEMS = """SELECT o_custkey AS user_id, o_orderkey AS pos, 'Work' AS topic, 'segment' AS sub_topic,
CASE WHEN o_orderkey % 3 = 0 THEN '  ' || lower(c_mktsegment) ELSE o_orderpriority END AS memo FROM orders JOIN customer ON o_custkey = c_custkey"""


def _profile(t):
    stored = t.customer.where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.lit("work_segment").alias("main_content"), F.col("c_mktsegment").alias("subcontent"))
    both = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    memo = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"))).otherwise(F.col("o_orderpriority"))
    items = both.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("pos"), F.lit("Work").alias("topic"), F.lit("segment").alias("sub_topic"), memo.alias("memo"))
    return items, stored


_LAST = f"SELECT user_id, arg_max(memo, pos) AS memo, min(pos) AS pos FROM ({_ITEMS}) GROUP BY user_id"


@query(f"SELECT user_id, memo, pos AS place FROM ({_LAST})")
def dedupe_last_wins(t):
    items, _ = _profile(t)
    return R.dedupe_last(items, ["user_id"], "pos").select("user_id", "memo", "place")


_JUDGED = f"""SELECT i.user_id, i.pos, CASE WHEN s.id IS NULL THEN 'ADD'
WHEN lower(trim(regexp_replace(i.memo, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(s.subcontent, '\\s+', ' ', 'g'))) THEN 'NOOP' ELSE 'UPDATE' END AS type,
'Work / segment = ' || i.memo AS content, s.id AS embedding_id FROM ({_LAST}) i LEFT JOIN ({_STORED}) s USING (user_id)"""


@query(_JUDGED)
def judge_profile(t):
    return R.judge_profile(*_profile(t)).drop("reason")


def _ops(t):
    judged = R.judge_profile(*_profile(t))
    return judged.select(F.col("user_id").alias("op_id"), "type", "content", "embedding_id")


@query(f"""WITH o AS ({_JUDGED})
SELECT id, coalesce(o.content, s.content) AS content FROM (SELECT id, subcontent AS content FROM ({_STORED})) s LEFT JOIN (SELECT * FROM o WHERE type = 'UPDATE') o ON s.id = o.embedding_id
UNION ALL SELECT 'new-' || user_id, content FROM o WHERE type = 'ADD'""")
def apply_ops_snapshot(t):
    stored = _profile(t)[1].select("id", F.col("subcontent").alias("content"))
    return R.apply_ops(stored, _ops(t))[0]


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE type != 'NOOP') AS succeeded, count(*) FILTER (WHERE type = 'NOOP') AS skipped, 0::BIGINT AS failed FROM ({_JUDGED})""")
def ops_audit_counts(t):
    stored = _profile(t)[1].select("id", F.col("subcontent").alias("content"))
    return R.weaver_result(R.apply_ops(stored, _ops(t))[1])


_EVENTS = """SELECT o_custkey AS user_id, strftime(o_orderdate, '%m-%d') AS date, o_orderpriority AS event_name, o_orderstatus AS "desc", CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey FROM orders"""


def _event_tables(t):
    e = t.orders.select(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "MM-dd").alias("date"), F.col("o_orderpriority").alias("event_name"), F.col("o_orderstatus").alias("desc"), F.year("o_orderdate").cast("string").alias("year"), F.lit(None).cast("string").alias("time"), F.lit("").alias("date_expression"), "o_orderkey")
    stored = e.groupBy("user_id", "event_name").agg(F.min_by(F.struct("date", "desc", "year", "time", "date_expression"), "o_orderkey").alias("r")).select("user_id", "event_name", "r.*")
    return e.withColumnRenamed("o_orderkey", "pos").withColumn("event_name", F.upper("event_name")), stored


@query(f"""WITH e AS ({_EVENTS}),
s AS (SELECT user_id, event_name, arg_min(date, o_orderkey) AS date, arg_min("desc", o_orderkey) AS "desc", arg_min(year, o_orderkey) AS year FROM e GROUP BY ALL),
i AS (SELECT user_id, event_name, min(o_orderkey) AS pos, arg_max(date, o_orderkey) AS date, arg_max("desc", o_orderkey) AS "desc", arg_max(year, o_orderkey) AS year FROM e GROUP BY ALL),
b AS (SELECT i.*, s.date AS od, s."desc" AS ds, s.year AS oy FROM i JOIN s USING (user_id, event_name))
SELECT user_id, pos, 0 AS step, CASE WHEN date = od AND "desc" = ds AND year = oy THEN 'NOOP' WHEN date != od THEN 'DELETE' ELSE 'UPDATE' END AS type, od || '_' || event_name AS embedding_id FROM b
UNION ALL SELECT user_id, pos, 1, 'ADD', NULL FROM b WHERE date != od""")
def judge_temporal(t):
    """Each user's latest order of a priority against the first one: moved dates give a delete and an add."""
    return R.judge_temporal(*_event_tables(t)).select("user_id", "pos", "step", "type", "embedding_id")


@query("""WITH f AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS first_id FROM documents)
SELECT doc_id, first_id FROM f WHERE doc_id != first_id""")
def exact_duplicate_docs(t):
    """Documents whose normalised text an earlier one has: hashes are grouped, not texts."""
    from ..functions.text import norm_text

    d = t.documents.select("doc_id", F.sha2(norm_text(F.col("text")), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return d.join(first, "h").where("doc_id != first_id").select("doc_id", "first_id")


@query("""SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment,
c_acctbal FROM customer""")
def partial_update_merge(t):
    changes = t.customer.where("c_custkey % 10 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return R.partial_update(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), changes, "c_custkey")


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 4 != 1
UNION ALL SELECT s_suppkey, 'replaced', s_acctbal FROM supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT s_suppkey + 1000000, 'added', 1.0 FROM supplier WHERE s_suppkey % 4 = 2""")
def upsert_merge(t):
    """Replaced rows keep the stored balance, as a creation time would be kept."""
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = s.where("s_suppkey % 4 = 1").select("s_suppkey", F.lit("replaced").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    add = s.where("s_suppkey % 4 = 2").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), F.lit("added").alias("s_name"), F.lit(1.0).alias("s_acctbal"))
    return R.upsert(s, new.unionByName(add), ["s_suppkey"], keep=("s_acctbal",))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 9 != 4")
def delete_by_ids(t):
    e = t.embeddings.select("vec_id", "label")
    return R.delete(e, e.where("vec_id % 9 = 4"), ["vec_id"])


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_wins(t):
    return R.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN '02-30' ELSE strftime(o_orderdate, '%m-%d') END AS date FROM orders)
SELECT o_orderkey, date, CASE WHEN date = '02-30' THEN 'failed' ELSE 'succeeded' END AS status FROM o""")
def event_date_check(t):
    """Events join the calendar of 366 days; those of other dates fail."""
    from ..operators.graph import calendar

    o = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "02-30").otherwise(F.date_format("o_orderdate", "MM-dd")).alias("date"))
    days = calendar(t.spark).withColumn("known", F.lit(True))
    return o.join(F.broadcast(days), "date", "left").select("o_orderkey", "date", F.when(F.col("known"), "succeeded").otherwise("failed").alias("status"))  # 366 rows


# --- temporal, code and snippet operations: orders are operations -----------------------------------------------------------------

_EVENT_OPS = """e AS (SELECT o_custkey AS user_id, CASE WHEN o_orderkey % 10 = 5 THEN '02-30' ELSE strftime(o_orderdate, '%m-%d') END AS date, CAST(o_orderkey AS VARCHAR) AS event_name, o_orderstatus AS "desc", CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey AS k FROM orders)"""


def _event_ops(t):
    k = F.col("o_orderkey")
    e = t.orders.select(F.col("o_custkey").alias("user_id"), F.when(k % 10 == 5, "02-30").otherwise(F.date_format("o_orderdate", "MM-dd")).alias("date"), k.cast("string").alias("event_name"), F.col("o_orderstatus").alias("desc"), F.year("o_orderdate").cast("string").alias("year"), k.alias("k"))
    stored = e.where("k % 3 = 0").select("user_id", "date", "event_name", "desc", "year", F.lit("note").alias("origin"))
    op = lambda where, kind, step, desc, year: e.where(where).select((F.col("k") * 10 + step).alias("op_id"), "user_id", F.lit(kind).alias("type"), "date", "event_name", desc.alias("desc"), year.alias("year"))
    none = F.lit(None).cast("string")
    ops = op("k % 3 = 1", "ADD", 1, F.col("desc"), F.col("year")).union(op("k % 6 = 0", "UPDATE", 2, F.lit("moved"), none)).union(op("k % 9 = 0", "DELETE", 3, none, none)).union(op("k % 3 = 2", "UPDATE", 4, F.lit("nothing there"), none)).union(op("k % 7 = 0", "NOOP", 5, none, none))
    return stored, ops


@query(f"""WITH {_EVENT_OPS}
SELECT user_id, date, event_name, CASE WHEN k % 6 = 0 AND date != '02-30' THEN 'moved' ELSE "desc" END AS "desc", year, 'note' AS origin FROM e WHERE k % 3 = 0 AND (k % 9 != 0 OR date = '02-30')
UNION ALL SELECT user_id, date, event_name, "desc", year, NULL FROM e WHERE k % 3 = 1 AND date != '02-30'""")
def event_operations(t):
    """Additions, changes and deletions of events; other columns stay."""
    return R.apply_event_ops(*_event_ops(t))[0]


@query(f"""WITH {_EVENT_OPS}, o AS (SELECT k * 10 + 1 AS op_id, date, 'ADD' AS t FROM e WHERE k % 3 = 1 UNION ALL SELECT k * 10 + 2, date, 'UPDATE' FROM e WHERE k % 6 = 0 UNION ALL SELECT k * 10 + 3, date, 'DELETE' FROM e WHERE k % 9 = 0 UNION ALL SELECT k * 10 + 4, date, 'UPDATE' FROM e WHERE k % 3 = 2 UNION ALL SELECT k * 10 + 5, date, 'NOOP' FROM e WHERE k % 7 = 0)
SELECT op_id, CASE WHEN t = 'NOOP' THEN 'skipped' WHEN date = '02-30' THEN 'failed' ELSE 'succeeded' END AS status FROM o""")
def event_operations_audit(t):
    return R.apply_event_ops(*_event_ops(t))[1].select("op_id", "status")


@query("""WITH s AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%m-%d') AS date, CAST(o_orderkey AS VARCHAR) AS event_name, o_orderstatus AS "desc" FROM orders),
u AS (SELECT o_custkey AS user_id, strftime(o_orderdate, '%m-%d') AS date, arg_max(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderkey % 4 = 0 GROUP BY ALL)
SELECT user_id, date, event_name, coalesce(p, "desc") AS "desc" FROM s LEFT JOIN u USING (user_id, date)""")
def events_of_a_date_updated(t):
    """An update of a date rewrites all events of it."""
    date = F.date_format("o_orderdate", "MM-dd")
    stored = t.orders.select(F.col("o_custkey").alias("user_id"), date.alias("date"), F.col("o_orderkey").cast("string").alias("event_name"), F.col("o_orderstatus").alias("desc"))
    ops = t.orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("op_id"), F.col("o_custkey").alias("user_id"), F.lit("UPDATE").alias("type"), date.alias("date"), F.lit(None).cast("string").alias("event_name"), F.col("o_orderpriority").alias("desc"))
    return R.apply_event_ops(stored, ops, match_name=False)[0]


_CONTENT = "'warning | s' || p_partkey || ' | f.py | repo | high | ' || p_name"


@query(f"""SELECT 'c' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN {_CONTENT} ELSE p_name END AS content, CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'old' END AS annotation_type, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey ELSE '' END AS target_symbol FROM part WHERE p_partkey % 5 != 0
UNION ALL SELECT 'new-' || (p_partkey * 3 + 2), {_CONTENT}, 'warning', 's' || p_partkey FROM part WHERE p_partkey % 4 = 0""")
def code_operations(t):
    """Code annotations: the parts of their content are columns of the stored row."""
    p = t.part
    stored = p.select(F.concat(F.lit("c"), "p_partkey").alias("id"), F.col("p_name").alias("content"), F.lit("old").alias("annotation_type"), F.lit("").alias("target_symbol"))
    content = F.concat(F.lit("warning | s"), "p_partkey", F.lit(" | f.py | repo | high | "), "p_name")
    op = lambda where, kind, step, target: p.where(where).select((F.col("p_partkey") * 3 + step).alias("op_id"), F.lit(kind).alias("type"), content.alias("content"), target.alias("embedding_id"))
    own, none = F.concat(F.lit("c"), "p_partkey"), F.lit(None).cast("string")
    ops = op("p_partkey % 3 = 0", "UPDATE", 0, own).union(op("p_partkey % 5 = 0", "DELETE", 1, own)).union(op("p_partkey % 4 = 0", "ADD", 2, none))
    return R.apply_ops(stored, R.code_ops(ops))[0]


@query("""SELECT 'new-' || p_partkey AS id, p_name AS content, 'def x' AS code_snippet, 'python' AS language, 'fix' AS snippet_type, 'a,b' AS tags FROM part WHERE p_partkey % 2 = 0""")
def snippet_operations(t):
    """Snippets: the description alone is the content."""
    content = F.concat("p_name", F.lit(" | def x | python | fix | a,b"))
    ops = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("op_id"), F.lit("ADD").alias("type"), content.alias("content"), F.lit(None).cast("string").alias("embedding_id"))
    stored = t.spark.createDataFrame([], "id string, content string, code_snippet string, language string, snippet_type string, tags string")
    return R.apply_ops(stored, R.snippet_ops(ops))[0]


@query("""SELECT p_partkey AS op_id, p_size AS author_id, 'fix' AS annotation_type, CASE WHEN p_partkey % 3 = 0 THEN 'symbol' WHEN p_partkey % 3 = 1 THEN 'file' ELSE 'none' END AS target_kind, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN 'f.py' END AS target, p_name AS content FROM part""")
def annotation_nodes(t):
    """What an added annotation is about: a symbol, else a file, else nothing."""
    k = F.col("p_partkey") % 3
    content = F.concat_ws("|", F.lit("fix"), F.when(k == 0, F.col("p_brand")).otherwise(""), F.when(k != 2, F.lit("f.py")).otherwise(""), F.lit("r"), F.lit("low"), F.col("p_name"))
    ops = t.part.select(F.col("p_partkey").alias("op_id"), F.lit("ADD").alias("type"), content.alias("content"), F.col("p_size").alias("user_id"))
    return R.annotation_nodes(ops).select("op_id", "author_id", "annotation_type", "target_kind", "target", "content")


@query("""SELECT c_custkey AS annotation_id, CASE WHEN c_custkey % 3 = 0 THEN 'resolved' WHEN c_custkey % 3 = 1 THEN 'archived' ELSE 'active' END AS status, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS resolved_at, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS resolved_by FROM customer""")
def annotation_status(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("annotation_id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("resolved_at"), F.lit(None).cast("int").alias("resolved_by"))
    changes = t.customer.where("c_custkey % 3 != 2").select(k.alias("annotation_id"), F.when(k % 3 == 0, "resolved").otherwise("archived").alias("new_status"), F.col("c_nationkey").alias("user_id"))
    return R.change_status(rows, changes, F.lit("2024-01-01").cast("timestamp_ntz"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'ADD' WHEN p_partkey % 3 = 1 THEN 'UPDATE' ELSE 'ADD' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS content, CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM part""")
def judgements_parsed(t):
    """A model's answers; what is no JSON adds the items."""
    k = F.col("p_partkey") % 3
    answer = F.when(k == 0, "I cannot tell").otherwise(F.concat(F.lit('```json\n{"confidence": 0.9, "operations": [{"type": "'), F.when(k == 1, "update").otherwise("strange"), F.lit('", "content": "'), "p_name", F.lit('"}]}\n```')))
    got = t.part.select("p_partkey", R.parse_judgement(answer, F.array("p_brand")).alias("j"))
    return got.select("p_partkey", F.explode("j.operations").alias("o"), "j.confidence").select("p_partkey", "o.type", "o.content", "confidence")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus != 'O')""")
def batches_with_writes(t):
    """A customer's orders are a batch; open ones write nothing."""
    ops = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", "NOOP").otherwise("ADD").alias("type"))
    return R.with_writes(ops, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey % 2 = 0""")
def insert_missing(t):
    """Only rows of new keys are added."""
    s = t.supplier.select("s_suppkey", "s_name")
    rows = s.select("s_suppkey", F.lit("ignored").alias("s_name")).union(s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey") + 1_000_000, F.lit("new")))
    return R.insert_missing(s, rows, ["s_suppkey"])
