"""States out of logs of changes: scans, team members, whitelisted updates and projects with what belongs to them. Aggregates and one join each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_states(log: DataFrame, keys: tuple[str, ...] = ("org_id", "repo", "scan_id")) -> DataFrame:
    """(*keys, status, commit_sha, started_at, finished_at, error) of a log (*keys, event, at, commit_sha, error): running from its start, then completed or failed.

    A scan that was never started has no row, whatever else is logged of it. Of several ends the last one counts (a failure of two at once);
    ends before the start don't. A completed scan has the commit that its end names, else that of its start.
    """
    start = F.min(F.when(F.col("event") == "started", F.struct("at", "commit_sha"))).alias("start")
    ends = F.collect_set(F.when(F.col("event").isin("completed", "failed"), F.struct("at", "event", "commit_sha", "error"))).alias("ends")
    last = F.array_max(F.filter("ends", lambda x: x["at"] >= F.col("start.at"))).alias("end")  # a scan has few ends
    rows = log.groupBy(*keys).agg(start, ends).where(F.col("start").isNotNull()).select(*keys, "start", last)
    status = F.coalesce("end.event", F.lit("running"))
    error = F.when(status == "failed", F.col("end.error"))
    return rows.select(*keys, status.alias("status"), F.coalesce("end.commit_sha", "start.commit_sha").alias("commit_sha"), F.col("start.at").alias("started_at"), F.col("end.at").alias("finished_at"), error.alias("error"))


def members_after(members: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("project_id", "user_id")) -> DataFrame:
    """Team members after changes (*keys, seq, kind, ...) in the order of ``seq``: ``add`` writes all columns and makes active again, ``remove`` makes inactive,
    ``role`` writes the role. Only an addition makes a member; before it, the other changes of an unknown one do nothing. Nobody is deleted."""
    fields = [c for c in members.columns if c not in (*keys, "is_active")]
    kind, seq = F.col("kind"), F.col("seq")
    added = F.max(F.when(kind == "add", F.struct("seq", *fields))).alias("added")
    first = F.min(F.when(kind == "add", seq)).alias("first")
    last = lambda kinds, *what: F.max(F.when(kind.isin(*kinds), F.struct("seq", *what)))
    found = changes.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(added, first, last(["remove"], "kind").alias("removed"), last(["role"], "role").alias("roled"))
    on = [members[k] == F.col(f"__{k}") for k in keys]
    both = members.withColumn("__there", F.lit(True)).join(found, on, "full").where("__there OR added IS NOT NULL")
    counts = lambda c: F.col(f"{c}.seq").isNotNull() & (F.col("__there") | (F.col(f"{c}.seq") > F.col("first")))
    after = lambda c: F.coalesce(counts(c), F.lit(False)) & (F.col("added").isNull() | (F.col(f"{c}.seq") > F.col("added.seq")))

    def value(c: str) -> Column:
        own = F.when(F.col("added").isNotNull(), F.col(f"added.{c}")).otherwise(F.col(c))
        return F.when(after("roled"), F.col("roled.role")).otherwise(own) if c == "role" else own

    active = F.when(after("removed"), False).when(F.col("added").isNotNull(), True).otherwise(F.col("is_active"))
    out = {**{k: F.coalesce(members[k], F.col(f"__{k}")) for k in keys}, **{c: value(c) for c in fields}, "is_active": active}
    return both.select(*[out[c].alias(c) for c in members.columns])


def whitelisted(stored: DataFrame, changes: DataFrame, keys: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """The table with the ``allowed`` columns of the changes, of one row a key, where they aren't null; other columns of a change are never written, unknown keys do nothing."""
    names = [c for c in allowed if c in changes.columns and c in stored.columns and c not in keys]
    new = changes.select(*keys, F.struct(*names).alias("__new"))
    return stored.join(new, keys, "left").select(*[F.coalesce(F.col(f"__new.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


#: What a new summary may write: never the embedding of the code.
SUMMARY = ("summary", "summary_source", "summary_embedding")


def without_projects(gone: DataFrame, *tables: DataFrame, key: str = "project_id") -> list[DataFrame]:
    """Projects and what belongs to them (members, annotations), without those that go."""
    ids = gone.select(key).distinct()
    return [t.join(ids, key, "left_anti") for t in tables]
