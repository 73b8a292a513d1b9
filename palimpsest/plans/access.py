"""Catalog, jobs, projects, keys and roles: parts are repositories, orders of them are stars, orders are jobs, customers are users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from .core import query


@query("SELECT p_partkey, count(l_orderkey) AS stars FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey")
def star_counts(t):
    return C.counts_with_zero(t.part.select("p_partkey"), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "stars")


@query("""WITH s AS (SELECT p_partkey, p_name AS name, count(l_orderkey) AS stars FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_partkey, name, stars, (SELECT count(*) FROM s) AS total FROM s ORDER BY stars DESC, name DESC LIMIT 20 OFFSET 10""")
def catalog_page(t):
    rows = C.counts_with_zero(t.part.select("p_partkey", F.col("p_name").alias("name")), t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "stars")
    return C.catalog_page(rows, "stars", 10, 20, "p_partkey")


@query("""WITH f AS (SELECT p_partkey, p_partkey % 2 = 0 AS share_index_publicly FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey FROM part LEFT JOIN f USING (p_partkey) WHERE coalesce(share_index_publicly, true)""")
def visibility_default_true(t):
    flags = t.part.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("share_index_publicly"))
    return C.visible(t.part.select("p_partkey"), flags, "p_partkey").select("p_partkey")


@query("""SELECT s_suppkey AS project_id FROM supplier WHERE s_nationkey = 7
UNION SELECT l_suppkey FROM lineitem WHERE l_orderkey % 50 = 7 AND l_linestatus = 'O'""")
def visible_projects(t):
    projects = t.supplier.select(F.col("s_suppkey").alias("project_id"), F.col("s_nationkey").cast("long").alias("owner_id"))
    members = t.lineitem.select(F.col("l_suppkey").alias("project_id"), (F.col("l_orderkey") % 50).alias("user_id"), (F.col("l_linestatus") == "O").alias("is_active"))
    return C.visible_projects(projects, members, F.lit(7)).select("project_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_anti_join(t):
    name = lambda c: F.concat(F.lit("Repo"), c)
    found = t.customer.select("c_custkey", name(F.col("c_custkey")).alias("name"))
    return C.orphans(found, t.orders.where("o_orderstatus = 'F'").select(name(F.col("o_custkey")).alias("name"))).select("c_custkey")


_JOBS = """SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 ELSE 2 END AS r1, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS r2 FROM orders"""


@query(f"SELECT o_custkey, arg_max(o_orderkey, (r1, r2, o_orderdate, o_orderkey)) AS o_orderkey FROM ({_JOBS}) GROUP BY o_custkey")
def best_job_pick(t):
    phase2 = F.get(F.array(*[F.lit(p) for p in C.PHASES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    jobs = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "complete").otherwise("running").alias("phase1"), phase2.alias("phase2"), F.struct("o_orderdate", "o_orderkey").alias("updated_at"))
    return C.best_job(jobs, ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(CAST(o_orderkey AS VARCHAR), (o_orderdate, o_orderkey)) AS commit_sha FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def latest_scan(t):
    scans = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "O", "complete").otherwise("failed").alias("status"), F.col("o_orderkey").cast("string").alias("commit_sha"), F.struct("o_orderdate", "o_orderkey").alias("finished_at"))
    return C.latest_scan(scans, ["o_custkey"])


_ROLE = "(c_custkey + c_nationkey) % 4"
_EDITS = f"""WITH m AS (SELECT c_custkey AS id, c_nationkey AS team, CAST({_ROLE} AS INT) AS r FROM customer)
SELECT a.id, count(*) FILTER (WHERE a.id != b.id AND (a.r = 3 OR (a.r = 2 AND b.r < 2))) AS editable, bool_or(a.r > 0) AS annotates"""


def _members(t):
    role = F.get(F.array(*[F.lit(r) for r in C.ROLES]), ((F.col("c_custkey") + F.col("c_nationkey")) % 4).cast("int"))
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("team"), role.alias("role"))


@query(f"{_EDITS}, bool_or(a.r = 3) AS manages FROM m a JOIN m b USING (team) GROUP BY a.id")
def role_rank_self_join(t):
    """How many others of their team all members may edit, and who manages it."""
    members = _members(t)
    return C.editable_counts(members).join(members.select("id", C.may_manage(F.col("role")).alias("manages")), "id")


@query(f"{_EDITS} FROM m a JOIN m b USING (team) GROUP BY a.id")
def role_rank_counts(t):
    """How many others of their team all members may edit."""
    return C.editable_counts(_members(t))


@query("""SELECT o_orderkey, o_orderstatus != 'P' AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1995-06-17') AND (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AND (o_orderkey % 6 = 0 OR o_custkey % 2 = 0) AS valid FROM orders""")
def key_validity(t):
    """Orders as API keys: status, expiry, scopes and binding."""
    o = F.col("o_orderkey")
    scopes = F.array_compact(F.array(F.when(o % 3 == 0, "*"), F.when(o % 5 == 0, "read"), F.lit("other")))
    keys = t.orders.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("is_active"), F.when(o % 4 != 0, F.col("o_orderdate")).alias("expires_at"), scopes.alias("scopes"), F.when(o % 6 != 0, F.when(F.col("o_custkey") % 2 == 0, "acme").otherwise("other")).alias("org_id"), F.lit(None).cast("string").alias("repo"))
    return keys.select("o_orderkey", C.key_valid(F.lit("1995-06-17").cast("timestamp_ntz"), "read", "acme", "any").alias("valid"))


@query("SELECT c_custkey, count(o_orderkey) AS n_keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def user_key_counts(t):
    return C.counts_with_zero(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "n_keys")


@query("""WITH j AS (SELECT DISTINCT l_suppkey AS org_id, l_partkey AS repo FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS org_id, l_partkey AS repo FROM lineitem WHERE l_returnflag = 'A')
SELECT *, 'job' AS origin FROM j UNION ALL SELECT *, 'bookmark' FROM b WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.org_id = b.org_id AND j.repo = b.repo)""")
def repo_list(t):
    pair = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("org_id"), F.col("l_partkey").alias("repo"))
    return C.repo_list(pair("R"), pair("A"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM part WHERE NOT (p_partkey % 7 = 0 AND p_partkey % 11 = 0)""")
def incremental_diff(t):
    """Files of two scans by the hash of their content."""
    from ..functions.text import hash16

    p = t.part
    new = p.where("p_partkey % 11 != 0").select("p_partkey", hash16(F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(F.col("p_name"))).alias("content_hash"))
    old = p.where("p_partkey % 7 != 0").select("p_partkey", hash16(F.col("p_name")).alias("content_hash"))
    return C.changed(new, old, ["p_partkey"])


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL""")
def jobs_by_status(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_users(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("""SELECT c_custkey AS token_id, CASE WHEN c_custkey % 9 = 0 THEN 5000 ELSE CAST(c_custkey % 4000 AS INT) END AS remaining FROM customer WHERE c_custkey % 2 = 1 ORDER BY remaining DESC, token_id LIMIT 1""")
def token_with_quota(t):
    now = F.lit("2024-01-01").cast("timestamp")
    tokens = t.customer.select(F.col("c_custkey").alias("token_id"), (F.col("c_custkey") % 2 == 1).alias("is_active"), (F.col("c_custkey") % 4000).cast("int").alias("remaining"), F.when(F.col("c_custkey") % 9 == 0, now).otherwise(F.lit("2025-01-01").cast("timestamp")).alias("reset_at"))
    return C.best_token(tokens, now).select("token_id", "remaining")


@query("""SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'mer#00000001') OR contains(lower(c_mktsegment), 'mer#00000001') ORDER BY c_custkey LIMIT 40""")
def user_search(t):
    """Case-insensitive search for user text, which is taken as it is, not as a pattern."""
    return C.matching(t.customer, ["c_name", "c_mktsegment"], "MER#00000001").orderBy("c_custkey").limit(40).select("c_custkey")


@query("""WITH w AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'no blank' WHEN c_custkey % 3 = 1 THEN 'u' || (c_custkey // 10 + 100) ELSE 'v' || (c_custkey + 100) END AS username FROM customer)
SELECT min(user_id) AS user_id, username FROM w WHERE username != 'no blank' AND username NOT IN (SELECT 'v' || (s_suppkey + 100) FROM supplier) GROUP BY username""")
def new_usernames(t):
    """Names by the rule that no one has; the first who asks gets one."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, "no blank").when(k % 3 == 1, F.concat(F.lit("u"), F.floor(k / 10) + 100)).otherwise(F.concat(F.lit("v"), k + 100))
    taken = t.supplier.select(F.concat(F.lit("v"), F.col("s_suppkey") + 100).alias("username"))
    return C.new_names(t.customer.select(k.alias("user_id"), name.alias("username")), taken)


# --- repositories: a customer's jobs are orders, their repositories the order's clerk number and priority -------------------------

_SCAN_JOBS = """SELECT o_custkey AS user_id, o_orderkey % 40 AS org_id, o_orderpriority AS repo, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'running' END AS phase1, CASE WHEN o_orderkey % 3 = 0 THEN 'complete' END AS phase2, o_orderkey AS updated_at FROM orders"""
_FLAGS = "SELECT n_nationkey AS org_id, '1-URGENT' AS repo, n_nationkey % 2 = 0 AS share_index_publicly FROM nation"


def _jobs(t):
    o = t.orders
    phase1 = F.when(o["o_orderstatus"] == "F", "COMPLETE").when(o["o_orderstatus"] == "O", "running")
    return o.select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 40).alias("org_id"), F.col("o_orderpriority").alias("repo"), phase1.alias("phase1"), F.when(F.col("o_orderkey") % 3 == 0, "complete").alias("phase2"), F.col("o_orderkey").alias("updated_at"))


def _flags(t):
    return t.nation.select(F.col("n_nationkey").cast("long").alias("org_id"), F.lit("1-URGENT").alias("repo"), (F.col("n_nationkey") % 2 == 0).alias("share_index_publicly"))


@query(f"""WITH j AS ({_SCAN_JOBS}), f AS ({_FLAGS})
SELECT updated_at, coalesce(lower(phase1) = 'complete' AND (coalesce(share_index_publicly, true) OR user_id = 7), false) AS allowed FROM j LEFT JOIN f USING (org_id, repo)""")
def chat_allowed(t):
    return C.chat_allowed(_jobs(t), _flags(t), ["org_id", "repo"], F.lit(7)).select("updated_at", "allowed")


@query(f"""WITH j AS ({_SCAN_JOBS}) SELECT c_custkey, c_mktsegment, EXISTS (SELECT 1 FROM j WHERE user_id = c_custkey AND lower(phase1) = 'complete') AS completed FROM customer""")
def has_completed_job(t):
    pairs = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return C.has_completed(pairs, _jobs(t), ["user_id"]).select(F.col("user_id").alias("c_custkey"), "c_mktsegment", "completed")


@query(f"""WITH j AS ({_SCAN_JOBS}), f AS ({_FLAGS}) SELECT DISTINCT org_id, repo FROM f WHERE share_index_publicly AND EXISTS (SELECT 1 FROM j WHERE j.org_id = f.org_id AND j.repo = f.repo AND lower(phase1) = 'complete')""")
def public_pairs(t):
    return C.public_pairs(_flags(t), _jobs(t), ["org_id", "repo"])


_RANK = "greatest(coalesce(list_position(['not_started', 'pending', 'running', 'failed', 'complete'], lower({})), 1), 1)"


@query(f"""WITH j AS ({_SCAN_JOBS}), f AS ({_FLAGS}), a AS (SELECT c_custkey AS user_id, c_custkey % 60 AS org_id, '1-URGENT' AS repo FROM customer),
own AS (SELECT user_id, org_id, repo, arg_max({{'p1': phase1, 'p2': phase2}}, updated_at) AS o FROM j GROUP BY ALL),
best AS (SELECT org_id, repo, arg_max({{'p1': phase1, 'p2': phase2}}, ({_RANK.format('phase1')}, {_RANK.format('phase2')}, updated_at)) AS b FROM j GROUP BY ALL),
s AS (SELECT s_suppkey % 60 AS org_id, '1-URGENT' AS repo, arg_max(CASE WHEN s_nationkey % 2 = 0 THEN 'completed' ELSE 'failed' END, s_suppkey) AS st FROM supplier GROUP BY ALL),
r AS (SELECT a.*, o, b, CASE WHEN st = 'completed' THEN st END AS st, coalesce(share_index_publicly, true) AS share_index_publicly FROM a LEFT JOIN own USING (user_id, org_id, repo) LEFT JOIN best USING (org_id, repo) LEFT JOIN s USING (org_id, repo) LEFT JOIN f USING (org_id, repo))
SELECT user_id, org_id, repo, CASE WHEN o IS NOT NULL THEN 'user_job' WHEN b IS NOT NULL THEN 'catalog' WHEN st IS NOT NULL THEN 'scan_runs' ELSE 'none' END AS source,
CASE WHEN o IS NOT NULL THEN coalesce(o.p1, 'not_started') WHEN b IS NOT NULL THEN coalesce(b.p1, 'not_started') WHEN st IS NOT NULL THEN 'complete' ELSE 'not_started' END AS phase1,
CASE WHEN o IS NOT NULL THEN coalesce(o.p2, 'not_started') WHEN b IS NOT NULL THEN coalesce(b.p2, 'not_started') WHEN st IS NOT NULL THEN 'complete' ELSE 'not_started' END AS phase2, share_index_publicly FROM r""")
def catalog_snapshot(t):
    """Own job, else the best one, else the last completed scan, else nothing."""
    asked = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 60).alias("org_id"), F.lit("1-URGENT").alias("repo"))
    scans = t.supplier.select((F.col("s_suppkey") % 60).alias("org_id"), F.lit("1-URGENT").alias("repo"), F.when(F.col("s_nationkey") % 2 == 0, "completed").otherwise("failed").alias("status"), F.col("s_suppkey").alias("finished_at"))
    return C.snapshot(asked, _jobs(t), scans, _flags(t))


@query("""SELECT o_orderkey AS token_id, CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN 'session' WHEN o_orderkey % 4 = 1 AND o_orderstatus != 'P' AND o_custkey % 3 != 0 THEN 'key' WHEN o_orderkey % 4 = 2 THEN 'static' END AS via,
CASE WHEN o_orderkey % 4 = 0 AND o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 4 = 1 AND o_orderstatus != 'P' AND o_custkey % 3 != 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 4 = 2 THEN substr(sha256('fixed'), 1, 16) END AS user_id FROM orders""")
def authenticate(t):
    """Sessions, then keys by their hash, then static keys."""
    k = F.col("o_orderkey")
    token = F.when(k % 4 == 0, F.concat(F.lit("s"), k)).when(k % 4 == 1, F.concat(F.lit("key_"), k)).when(k % 4 == 2, "fixed").otherwise("nothing")
    tokens = t.orders.select(k.alias("token_id"), token.alias("token"))
    sessions = t.orders.where("o_custkey % 2 = 0").select(F.concat(F.lit("s"), k).alias("token"), F.col("o_custkey").alias("user_id"))
    keys = t.orders.select(F.sha2(F.concat(F.lit("key_"), k), 256).alias("key_hash"), F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") != "P").alias("is_active"), F.lit(None).cast("timestamp").alias("expires_at"))
    users = t.orders.where("o_custkey % 3 != 0").select(F.col("o_custkey").alias("user_id"))
    return C.authenticate(tokens, sessions, keys, users, ("fixed",), F.lit("2024-01-01").cast("timestamp"))


@query("""SELECT o_orderkey, o_orderstatus != 'P' AND (o_orderkey % 4 = 0 OR o_orderdate > TIMESTAMP '1995-06-17') AS is_active FROM orders""")
def expired_keys(t):
    """Keys of which the expired ones are switched off."""
    keys = t.orders.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("is_active"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("expires_at"))
    return C.expire(keys, F.lit("1995-06-17").cast("timestamp_ntz")).select("o_orderkey", "is_active")


@query("""SELECT o_orderkey, o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1995-06-16 23:59:30' AS alive FROM orders""")
def job_alive(t):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return t.orders.select("o_orderkey", C.alive(status, F.col("o_orderdate"), F.lit("1995-06-17").cast("timestamp_ntz")).alias("alive"))


@query("""SELECT l_suppkey AS user_id, l_partkey AS repo FROM lineitem WHERE l_returnflag != 'N' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 2""")
def star_set(t):
    """Stars given and taken away, as a set."""
    pairs = lambda where: t.lineitem.where(where).select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("repo"))
    return C.star(pairs("l_returnflag = 'R'"), pairs("l_returnflag = 'A'"), pairs("l_linenumber = 2"), ("user_id", "repo"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def users_not_scanned(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_anti")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def newest_jobs_of_users(t):
    return C.per_user(t.orders, "o_custkey", 3, F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT n_regionkey, n_nationkey % 2 = 0 AS share_index_publicly, count(*) AS n FROM nation GROUP BY ALL")
def visibility_breakdown(t):
    return t.nation.groupBy("n_regionkey", (F.col("n_nationkey") % 2 == 0).alias("share_index_publicly")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS org_id, n_regionkey AS updated_at FROM nation WHERE n_nationkey % 2 = 0 ORDER BY n_regionkey DESC, org_id LIMIT 5")
def public_index(t):
    """Repositories that are marked public, newest first."""
    rows = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("org_id"), F.col("n_regionkey").alias("updated_at"))
    return rows.orderBy(F.desc("updated_at"), "org_id").limit(5)


@query("SELECT DISTINCT l_suppkey AS org_id, l_partkey AS repo FROM lineitem")
def repos_of_orgs(t):
    return t.lineitem.select(F.col("l_suppkey").alias("org_id"), F.col("l_partkey").alias("repo")).distinct()


@query("""SELECT c_custkey AS annotation_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 5 = 1 ORDER BY c_acctbal DESC, c_custkey""")
def annotations_of_a_symbol(t):
    from ..operators import evidence as E

    rows = t.customer.select(F.col("c_custkey").alias("annotation_id"), F.lit("symbol").alias("target_kind"), F.col("c_mktsegment").alias("target"), F.when(F.col("c_custkey") % 5 == 1, "active").otherwise("resolved").alias("status"), F.col("c_acctbal").alias("created_at"))
    return E.annotations_of(rows, "symbol", "BUILDING", "active").select("annotation_id")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), 'auto')")
def repo_search(t):
    """Repositories whose organisation or name has the text, in any case."""
    rows = t.customer.select("c_custkey", F.col("c_name").alias("org_id"), F.col("c_mktsegment").alias("repo"))
    one, other = C.matching(rows, ["org_id"], "00012"), C.matching(rows, ["repo"], "AuTo")
    return one.union(other).select("c_custkey").distinct()


@query("SELECT DISTINCT user_id, event_type AS path FROM events WHERE user_id IS NOT NULL")
def accessed_paths(t):
    """The distinct paths that each user has called."""
    return C.accessed(t.events.withColumnRenamed("event_type", "path"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' WHEN o_orderkey % 11 = 0 THEN 'Y' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 13 != 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0
UNION ALL SELECT -1, 'new'""")
def snapshot_batches(t):
    """A table in buckets after three batches, each of which was applied twice: deletions, changes and additions."""
    from ..operators.reconcile import delete
    from ..operators.snapshots import Snapshot
    from ..workspace import Workspace

    orders = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    s = Snapshot(t.spark, Workspace(t.spark, "snapshot-table").at, ["o_orderkey"], buckets=8)
    s.create(orders)
    some = lambda m, v: orders.where(F.col("o_orderkey") % m == 0).withColumn("status", F.lit(v))
    new = t.spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit("new").alias("status"))
    for _ in range(2):
        s.apply(some(13, None), "first", lambda old, b: delete(old, b, ["o_orderkey"]))
        s.apply(some(11, "Y").where(F.col("o_orderkey") % 7 != 0), "second")
        s.apply(some(7, "Z").union(new), "third")
    return s.rows()
