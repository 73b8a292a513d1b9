"""Repository catalog, scan jobs, visibility, projects, keys and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Job phases and team roles from the lowest rank up.
PHASES = ("not_started", "pending", "running", "failed", "complete")
ROLES = ("intern", "sde2", "staff_engineer", "manager")


def rank_of(value: Column, names: tuple[str, ...]) -> Column:
    """Place in the list, in any case; unknown values and null are as the first one."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(value)) - 1
    return F.greatest(F.coalesce(place, F.lit(-1)), F.lit(0)).cast("int")


def best_job(jobs: DataFrame, keys: list[str]) -> DataFrame:
    """The job of each key that is furthest in phase 1, then phase 2, then newest."""
    rest = [c for c in jobs.columns if c not in keys]
    order = F.struct(rank_of(F.col("phase1"), PHASES), rank_of(F.col("phase2"), PHASES), F.col("updated_at"))
    return jobs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("job")).select(*keys, "job.*")


def latest_scan(scans: DataFrame, keys: list[str]) -> DataFrame:
    """The commit of the last completed scan of each key."""
    return scans.where("status = 'complete'").groupBy(*keys).agg(F.max_by("commit_sha", "finished_at").alias("commit_sha"))


def counts_with_zero(rows: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with its number of facts, 0 without any; facts are counted before the join."""
    return rows.join(facts.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def visible(rows: DataFrame, flags: DataFrame, key: str, flag: str = "share_index_publicly") -> DataFrame:
    """Rows whose flag isn't false; without a flag a row is visible."""
    return rows.join(flags.select(key, flag), key, "left").where(F.coalesce(F.col(flag), F.lit(True)))


def catalog_page(rows: DataFrame, sort: str, offset: int, limit: int, key: str | None = None) -> DataFrame:
    """A page by ``stars`` (most first, then name from the end) or ``recent`` (newest first, none last), with the total.

    Rows equal in both go by their key, so that the pages of a table hold each row once; without a key their order is open.
    """
    order = [F.desc("stars") if sort == "stars" else F.desc_nulls_last("completed_at"), F.desc("name"), *([F.asc(key)] if key else [])]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def visible_projects(projects: DataFrame, members: DataFrame, user: Column) -> DataFrame:
    """Projects that the user made or is an active member of."""
    own = projects.where(F.col("owner_id") == user)
    joined = projects.join(members.where((F.col("user_id") == user) & F.col("is_active")).select("project_id").distinct(), "project_id", "left_semi")
    return own.unionByName(joined).dropDuplicates(["project_id"])


def key_valid(now: Column, scope: str, org: str, repo: str) -> Column:
    """Of rows (is_active, expires_at, scopes, org_id, repo): active, not expired, with the scope or ``*``, bound to nothing else."""
    return (
        F.coalesce("is_active", F.lit(False))
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        & (F.array_contains("scopes", F.lit("*")) | F.array_contains("scopes", F.lit(scope)))
        & (F.col("org_id").isNull() | (F.col("org_id") == org))
        & (F.col("repo").isNull() | (F.col("repo") == repo))
    )


def may_annotate(role: Column) -> Column:
    """All members but interns; without a role one is no member."""
    return F.coalesce(role.isNotNull() & (rank_of(role, ROLES) > 0), F.lit(False))


def may_manage(role: Column) -> Column:
    return F.coalesce(role == "manager", F.lit(False))


def may_edit(role: Column, other: Column, same: Column) -> Column:
    """A manager edits anyone else, staff engineers those of lower rank; no one themself."""
    return ~same & other.isNotNull() & (may_manage(role) | F.coalesce((role == "staff_engineer") & (rank_of(other, ROLES) < rank_of(role, ROLES)), F.lit(False)))


def editable_counts(members: DataFrame) -> DataFrame:
    """(id, editable, annotates) of members (id, team, role): how many others of the team each may edit, by ``may_edit``.

    Members are counted for each team first, so that no pairs of members are made; ids are unique, and members without a team are left out.
    """
    teams = members.groupBy("team").agg(F.count(F.lit(1)).alias("size"), F.count_if(rank_of(F.col("role"), ROLES) < ROLES.index("staff_engineer")).alias("below_staff"))
    editable = F.when(F.col("role") == "manager", F.col("size") - 1).when(F.col("role") == "staff_engineer", F.col("below_staff")).otherwise(F.lit(0))
    return members.join(teams, "team").select("id", editable.cast("long").alias("editable"), may_annotate(F.col("role")).alias("annotates"))


def repo_list(jobs: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Jobs, then bookmarks of repositories that have none: (org_id, repo, origin)."""
    first = jobs.select("org_id", "repo").distinct()
    rest = bookmarks.select("org_id", "repo").distinct().join(first, ["org_id", "repo"], "left_anti")
    return first.withColumn("origin", F.lit("job")).unionByName(rest.withColumn("origin", F.lit("bookmark")))


def orphans(found: DataFrame, *known: DataFrame) -> DataFrame:
    """Names that none of the tables has, in any case."""
    every = known[0].select(F.lower("name").alias("k"))
    for t in known[1:]:
        every = every.union(t.select(F.lower("name")))
    return found.join(every.distinct(), F.lower(found["name"]) == F.col("k"), "left_anti")


def changed(new: DataFrame, old: DataFrame, keys: list[str], digest: str = "content_hash") -> DataFrame:
    """(keys, state): added, changed, unchanged or removed, by the hash of the content."""
    both = new.select(*keys, F.col(digest).alias("new")).join(old.select(*keys, F.col(digest).alias("old")), keys, "full")
    return both.select(*keys, F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed").alias("state"))


def relevance(semantic: DataFrame, specific: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Specific hits first, then semantic ones by rank, each once, the first k; both (id, rank)."""
    both = specific.select(key, "rank", F.lit(0).alias("part")).unionByName(semantic.select(key, "rank", F.lit(1).alias("part")))
    once = both.groupBy(key).agg(F.min(F.struct("part", "rank")).alias("at"))
    return once.select(key, "at.*").orderBy("part", "rank", key).limit(k)


def best_token(tokens: DataFrame, now: Column, full: int = 5000) -> DataFrame:
    """The active token with most quota left; one whose reset time is past has the full quota again."""
    left = F.when(F.col("reset_at") <= now, F.lit(full)).otherwise(F.col("remaining"))
    return tokens.where("is_active").withColumn("remaining", left).orderBy(F.desc("remaining"), "token_id").limit(1)


def chat_allowed(jobs: DataFrame, flags: DataFrame, keys: list[str], user: Column) -> DataFrame:
    """Jobs (keys, user_id, phase1, ...) with ``allowed``: phase 1 is complete, and the repository is public (also without a flag) or the job the user's."""
    both = jobs.join(flags.select(*keys, "share_index_publicly"), keys, "left")
    allowed = (F.lower("phase1") == "complete") & (F.coalesce("share_index_publicly", F.lit(True)) | F.coalesce(F.col("user_id") == user, F.lit(False)))
    return both.select(*[jobs[c] if c not in keys else F.col(c) for c in jobs.columns], F.coalesce(allowed, F.lit(False)).alias("allowed"))


def has_completed(pairs: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with ``completed``: whether a job of the pair has completed; a blank key has none. Jobs are made distinct before the join."""
    done = jobs.where(F.lower("phase1") == "complete").select(*keys).distinct().withColumn("completed", F.lit(True))
    blank = F.lit(False)
    for k in keys:
        blank = blank | (F.trim(F.coalesce(F.col(k).cast("string"), F.lit(""))) == "")
    return pairs.join(done, keys, "left").withColumn("completed", F.coalesce(F.col("completed") & ~blank, F.lit(False)))


def public_pairs(flags: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """Public repositories with at least one completed job."""
    done = jobs.where(F.lower("phase1") == "complete").select(*keys).distinct()
    return flags.where(F.coalesce("share_index_publicly", F.lit(True))).select(*keys).distinct().join(done, keys, "left_semi")


def alive(status: Column, updated_at: Column, now: Column, seconds: int = 30) -> Column:
    """A job that runs and was heard of in the last seconds; other running ones are left over."""
    return F.coalesce((status == "running") & (updated_at > now - F.make_dt_interval(secs=F.lit(seconds))), F.lit(False))


def snapshot(asked: DataFrame, jobs: DataFrame, scans: DataFrame, flags: DataFrame) -> DataFrame:
    """(user_id, org_id, repo, source, phase1, phase2, share_index_publicly) of each asked (user_id, org_id, repo): the user's own
    job, else the repository's best one, else its last scan if completed, else none."""
    keys = ["org_id", "repo"]
    own = jobs.groupBy("user_id", *keys).agg(F.max_by(F.struct("phase1", "phase2"), "updated_at").alias("own"))
    best = best_job(jobs.select(*keys, "phase1", "phase2", "updated_at"), keys).select(*keys, F.struct("phase1", "phase2").alias("best"))
    scan = scans.groupBy(*keys).agg(F.max_by("status", "finished_at").alias("scan")).where("scan = 'completed'")
    both = asked.join(own, ["user_id", *keys], "left").join(best, keys, "left").join(scan, keys, "left").join(flags.select(*keys, "share_index_publicly"), keys, "left")
    source = F.when(F.col("own").isNotNull(), "user_job").when(F.col("best").isNotNull(), "catalog").when(F.col("scan").isNotNull(), "scan_runs").otherwise("none")
    phase = lambda p: F.when(source.isin("user_job", "catalog"), F.coalesce(F.coalesce("own", "best")[p], F.lit("not_started"))).when(source == "scan_runs", "complete").otherwise("not_started").alias(p)
    return both.select("user_id", *keys, source.alias("source"), phase("phase1"), phase("phase2"), F.coalesce("share_index_publicly", F.lit(True)).alias("share_index_publicly"))


def star(stars: DataFrame, new: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("user_id", "org_id", "repo")) -> DataFrame:
    """The set of stars after some are given and some taken away."""
    return stars.select(*keys).union(new.select(*keys)).distinct().join(gone.select(*keys).distinct(), list(keys), "left_anti")


def authenticate(tokens: DataFrame, sessions: DataFrame, keys: DataFrame, users: DataFrame, static: tuple[str, ...], now: Column, prefix: str = "key_") -> DataFrame:
    """(token_id, via, user_id) of each bearer token (token_id, token): a session token, unless it begins as a key does; else an
    active, unexpired key by its hash, if its user is known; else a static key, whose user is the hash's beginning; else null.

    sessions: (token, user_id), keys: (key_hash, user_id, is_active, expires_at), users: (user_id).
    """
    known = users.select("user_id").distinct()
    live = keys.where(F.coalesce("is_active", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    by_key = live.groupBy("key_hash").agg(F.min("user_id").alias("user_id")).join(known, "user_id", "left_semi").select("key_hash", F.col("user_id").cast("string").alias("key_user"))
    by_session = sessions.groupBy("token").agg(F.min("user_id").cast("string").alias("session_user"))
    rows = tokens.withColumn("key_hash", F.sha2("token", 256)).join(by_session, "token", "left").join(by_key, "key_hash", "left")
    session = F.when(~F.startswith("token", F.lit(prefix)), F.col("session_user"))
    fixed = F.when(F.col("token").isin(*static), F.substring("key_hash", 1, 16)) if static else F.lit(None).cast("string")
    via = F.when(session.isNotNull(), "session").when(F.col("key_user").isNotNull(), "key").when(fixed.isNotNull(), "static")
    return rows.select("token_id", via.alias("via"), F.coalesce(session, "key_user", fixed).alias("user_id"))


def expire(keys: DataFrame, now: Column) -> DataFrame:
    """Keys of which the expired ones are no longer active."""
    return keys.withColumn("is_active", F.coalesce("is_active", F.lit(False)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def matching(rows: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Rows one of whose fields holds the text, in any case; the text is no pattern."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(f, F.lit(""))), F.lower(F.lit(text)))
    return rows.where(hit)


def new_names(wanted: DataFrame, taken: DataFrame, pattern: str = "^[a-zA-Z0-9_-]{3,30}$") -> DataFrame:
    """Wanted (user_id, username) that keep to the rule and no one has; of several users who want one the least gets it."""
    good = wanted.where(F.col("username").rlike(pattern)).groupBy("username").agg(F.min("user_id").alias("user_id"))
    return good.join(taken.select("username").distinct(), "username", "left_anti").select("user_id", "username")


def per_user(df: DataFrame, user: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(user).orderBy(*order))).where(F.col("rn") <= n)


def accessed(events: DataFrame, user: str = "user_id", path: str = "path") -> DataFrame:
    """(user, path): the distinct paths of each known user."""
    return events.where(F.col(user).isNotNull()).select(user, path).distinct()
