"""Incoming facts against stored ones: what to add, update, delete or leave, and the new state with an audit of each operation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import annotation_fields, fenced, norm_text, profile_key, render_event, render_fact, snippet_fields, structured, trimmed, valid_month_day

_EVENT = ("date", "event_name", "desc", "year", "time", "date_expression")


def dedupe_last(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``, at the key's first place (column ``place``); rows with an empty key all stay, after the others."""
    keyless = F.coalesce(F.col(keys[-1]).cast("string"), F.lit("")) == ""
    others = [c for c in items.columns if c not in keys]
    last = items.where(~keyless).groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("last"), F.min(order).alias("place"))
    last = last.select(*keys, "last.*", "place", F.lit(0).alias("part"))
    return last.unionByName(items.where(keyless).select(*keys, *others, F.col(order).alias("place"), F.lit(1).alias("part")))


def _first_match(stored: DataFrame, keys: list[str]) -> DataFrame:
    rest = F.struct(*[c for c in stored.columns if c not in keys])
    return stored.groupBy(*keys).agg(F.min_by(rest, "id").alias("old")).select(*keys, "old.*")


def judge_profile(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (user_id, pos, topic, sub_topic, memo) against stored (user_id, id, main_content, subcontent): (user_id, pos, type, content, embedding_id, reason).

    Of several items with one key the last counts. No stored fact of the key: ADD; the same memo after normalisation: NOOP;
    else UPDATE. Items without topic or sub-topic are added. One join on (user, key), partial aggregates before it.
    """
    keyed = items.withColumn("key", profile_key(F.col("topic"), F.col("sub_topic")))
    keyed = dedupe_last(keyed, ["user_id", "key"], "pos")
    old = _first_match(stored.select("user_id", F.col("main_content").alias("key"), "id", "subcontent"), ["user_id", "key"]).where("key != ''")
    both = keyed.join(old, ["user_id", "key"], "left")
    same = norm_text(F.col("memo")) == norm_text(F.col("subcontent"))
    kind = F.when(F.col("id").isNull(), "ADD").when(same, "NOOP").otherwise("UPDATE")
    return both.select("user_id", F.col("place").alias("pos"), kind.alias("type"), render_fact(F.col("topic"), F.col("sub_topic"), F.col("memo")).alias("content"), F.col("id").alias("embedding_id"), _reason(kind).alias("reason"))


def _reason(kind: Column) -> Column:
    return F.when(kind == "ADD", "nothing stored under this key").when(kind == "NOOP", "stored value is the same").when(kind == "DELETE", "moved to another date").otherwise("stored value differs")


def judge_temporal(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (user_id, pos, date, event_name, desc, year, time, date_expression) against stored events (user_id, and the same fields).

    Matched by user and name, in any case. Nothing stored: ADD; all fields equal: NOOP; another date: DELETE of the old event and ADD;
    else UPDATE. An event's id is its date and name.
    """
    keyed = dedupe_last(items.withColumn("key", norm_text(F.col("event_name"))), ["user_id", "key"], "pos")
    own = stored.withColumn("key", norm_text(F.col("event_name"))).withColumn("id", F.concat_ws("_", "date", "event_name"))
    old = _first_match(own.select("user_id", "key", "id", *[F.col(c).alias(f"old_{c}") for c in _EVENT]), ["user_id", "key"]).where("key != ''")
    both = keyed.join(old, ["user_id", "key"], "left")
    differs = F.lit(False)
    for c in _EVENT:
        differs = differs | (norm_text(F.col(c)) != norm_text(F.col(f"old_{c}")))
    moved = norm_text(F.col("date")) != norm_text(F.col("old_date"))
    new, gone = render_event(*[F.col(c) for c in _EVENT]), render_event(*[F.col(f"old_{c}") for c in _EVENT])
    op = lambda kind, content, id_: F.struct(F.lit(kind).alias("type"), content.alias("content"), id_.alias("embedding_id"))
    no_id = F.lit(None).cast("string")
    ops = (
        F.when(F.col("id").isNull(), F.array(op("ADD", new, no_id)))
        .when(~differs, F.array(op("NOOP", new, F.col("id"))))
        .when(moved, F.array(op("DELETE", gone, F.col("id")), op("ADD", new, no_id)))
        .otherwise(F.array(op("UPDATE", new, F.col("id"))))
    )
    out = both.select("user_id", F.col("place").alias("pos"), F.posexplode(ops).alias("step", "op")).select("user_id", "pos", "step", "op.*")
    return out.withColumn("reason", _reason(F.col("type")))


def judge_semantic(items: DataFrame, neighbours: DataFrame, same: float = 0.95, related: float = 0.8) -> DataFrame:
    """The deterministic stand-in for a judging model: items (item_id, content), neighbours (item_id, id, score).

    The nearest stored row decides: from ``same`` on NOOP, from ``related`` on UPDATE, else ADD.
    """
    best = neighbours.groupBy("item_id").agg(F.max(F.struct("score", "id")).alias("best"))
    both = items.join(best, "item_id", "left")
    score = F.col("best.score")
    kind = F.when(score >= same, "NOOP").when(score >= related, "UPDATE").otherwise("ADD")
    return both.select("item_id", kind.alias("type"), "content", F.when(kind != "ADD", F.col("best.id")).alias("embedding_id"))


def parse_judgement(answer: Column, items: Column) -> Column:
    """(operations, confidence) from a model's JSON; unknown types become ADD. Broken JSON adds all items (array<string>) with confidence 0.5."""
    kind = "array<struct<type:string,content:string,embedding_id:string,reason:string>>"
    found = F.from_json(fenced(answer), f"struct<operations:{kind},confidence:double,broken:string>", {"columnNameOfCorruptRecord": "broken"})
    known = lambda x: F.coalesce(F.when(F.upper(x).isin("ADD", "UPDATE", "DELETE", "NOOP"), F.upper(x)), F.lit("ADD"))
    rows = F.transform(F.coalesce(found["operations"], F.array().cast(kind)), lambda x: F.struct(known(x["type"]).alias("type"), F.coalesce(x["content"], F.lit("")).alias("content"), x["embedding_id"].alias("embedding_id"), F.coalesce(x["reason"], F.lit("")).alias("reason")))
    added = F.transform(items, lambda x: F.struct(F.lit("ADD").alias("type"), x.alias("content"), F.lit(None).cast("string").alias("embedding_id"), F.lit("the answer is not JSON").alias("reason")))
    broken = found.isNull() | found["broken"].isNotNull()
    return F.when(broken, F.struct(added.alias("operations"), F.lit(0.5).alias("confidence"))).otherwise(F.struct(rows.alias("operations"), F.coalesce(found["confidence"], F.lit(0.0)).alias("confidence")))


def apply_ops(stored: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, audit). stored: (id, content, ...); ops: (op_id, type, content, embedding_id), applied in the order of op_id.

    Further columns that both have, such as the parts of the content, are written with it; other columns of ``stored`` stay.

    UPDATE and DELETE without an id become ADD; UPDATE of an id that isn't there adds a row of that id; ADD without content and NOOP are skipped; deleting
    what isn't there succeeds. A new row's id is derived from its op. Several ops on one id: the last one counts for the
    state, all are in the audit (op_id, type, status, content, embedding_id, new_id, error). One full outer join on the id.
    """
    blank = trimmed(F.coalesce("content", F.lit(""))) == ""
    no_id = F.coalesce("embedding_id", F.lit("")) == ""
    kind = F.when(F.col("type").isin("UPDATE", "DELETE") & no_id, "ADD").otherwise(F.col("type"))
    status = F.when((kind == "NOOP") | (kind.isin("ADD", "UPDATE") & blank), "skipped").otherwise("succeeded")
    target = F.when(kind == "ADD", F.concat(F.lit("new-"), F.col("op_id").cast("string"))).otherwise(F.col("embedding_id"))
    done = ops.select("op_id", kind.alias("type"), status.alias("status"), "content", "embedding_id", F.when(kind == "ADD", target).alias("new_id"), F.when((status == "skipped") & (kind != "NOOP"), "content is empty").alias("error"), target.alias("target"))
    values = ["content", *[c for c in stored.columns if c in ops.columns and c not in ("id", "content", "op_id", "type", "embedding_id")]]
    written = ops.select(F.col("op_id").alias("__op"), F.struct(*values).alias("values"))
    last = done.where("status = 'succeeded'").join(written, F.col("op_id") == F.col("__op")) if len(values) > 1 else done.where("status = 'succeeded'").withColumn("values", F.struct("content"))
    last = last.groupBy("target").agg(F.max_by(F.struct("type", "values"), "op_id").alias("op"))
    both = stored.join(last, stored["id"] == last["target"], "full")
    state = both.where(F.coalesce(F.col("op.type") != "DELETE", F.lit(True)))
    pick = lambda c: F.coalesce(F.col(f"op.values.{c}"), stored[c]).alias(c) if c in values else F.coalesce("id", "target").alias("id") if c == "id" else stored[c]
    return state.select(*[pick(c) for c in stored.columns]), done.drop("target")


def code_ops(ops: DataFrame) -> DataFrame:
    """Operations on code annotations with the parts of their content as columns, for ``apply_ops``."""
    return ops.select("*", annotation_fields(F.col("content")).dropFields("content").alias("__p")).select(*ops.columns, "__p.*", F.lit("code").alias("domain"))


def snippet_ops(ops: DataFrame) -> DataFrame:
    """Operations on snippets: what is stored and embedded is the description alone; code, language, type and tags are columns."""
    return ops.select(*[c for c in ops.columns if c != "content"], snippet_fields(F.col("content")).alias("__p")).select(*[c for c in ops.columns if c != "content"], "__p.*", F.lit("snippet").alias("domain"))


def annotation_nodes(ops: DataFrame, author: str = "user_id") -> DataFrame:
    """(op_id, author_id, annotation_type, severity, content, repo, target_kind, target) of the annotations that are added: a symbol, else a file, else nothing."""
    p = ops.where("type = 'ADD'").select("op_id", F.col(author).alias("author_id"), annotation_fields(F.col("content")).alias("p"))
    symbol, file = (F.nullif(F.col(f"p.{c}"), F.lit("")) for c in ("target_symbol", "target_file"))
    kind = F.when(symbol.isNotNull(), "symbol").when(file.isNotNull(), "file").otherwise("none")
    return p.select("op_id", "author_id", "p.annotation_type", "p.severity", "p.content", "p.repo", kind.alias("target_kind"), F.coalesce(symbol, file).alias("target"))


def change_status(annotations: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Annotations (annotation_id, status, resolved_at, resolved_by, ...) with the status of changes (annotation_id, new_status, user_id).

    ``resolved`` also sets when and by whom; another status leaves both as they are.
    """
    both = annotations.join(changes.select("annotation_id", "new_status", F.col("user_id").alias("__by")), "annotation_id", "left")
    done = F.col("new_status") == "resolved"
    new = {"status": F.coalesce("new_status", "status"), "resolved_at": F.when(done, now).otherwise(F.col("resolved_at")), "resolved_by": F.when(done, F.col("__by")).otherwise(F.col("resolved_by"))}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in annotations.columns])


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows replace those of the same key; columns in ``keep`` (such as created_at) keep the stored value. One full outer join."""
    new = rows.select(*[F.col(k) for k in keys], F.struct(*[c for c in rows.columns if c not in keys]).alias("__new"))
    old = stored.select(*[F.col(k) for k in keys], F.struct(*[c for c in stored.columns if c not in keys]).alias("__old"))
    both = old.join(new, keys, "full")
    pick = lambda c: F.coalesce(F.col(f"__old.{c}"), F.col(f"__new.{c}")) if c in keep else F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}"))
    return both.select(*keys, *[pick(c).alias(c) for c in stored.columns if c not in keys])


def partial_update(stored: DataFrame, changes: DataFrame, key: str = "id", maps: tuple[str, ...] = ()) -> DataFrame:
    """Given (non-null) fields replace the stored ones, maps are merged with the new values winning; changes of unknown keys do nothing."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in changes.columns if c != key])
    both = stored.join(new, key, "left")
    changed = set(changes.columns)

    def pick(c: str) -> Column:
        if c == key or c not in changed:
            return F.col(c)
        if c in maps:
            kept = F.map_filter(c, lambda k, v: ~F.array_contains(F.map_keys(f"__{c}"), k))
            return F.when(F.col(f"__{c}").isNull(), F.col(c)).when(F.col(c).isNull(), F.col(f"__{c}")).otherwise(F.map_concat(kept, f"__{c}"))
        return F.coalesce(f"__{c}", c)

    return both.select(*[pick(c).alias(c) for c in stored.columns])


def delete(stored: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return stored.join(keys.select(*on).distinct(), on, "left_anti")


def weaver_result(audit: DataFrame) -> DataFrame:
    """One row: how many operations there were, succeeded, were skipped and failed."""
    n = lambda s: F.sum((F.col("status") == s).cast("long")).alias(s)
    return audit.agg(F.count(F.lit(1)).alias("total"), n("succeeded"), n("skipped"), n("failed"))


def memory_rows(ops: DataFrame) -> DataFrame:
    """Structured columns of contents to be stored: (..., main_content, subcontent)."""
    return ops.select("*", structured(F.col("content")).alias("__s")).select(*ops.columns, "__s.*")


def apply_event_ops(events: DataFrame, ops: DataFrame, match_name: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, audit) for temporal operations (op_id, user_id, type, date, event_name, ...), applied in the order of op_id.

    An event is told by user, date and name. ADD makes it, or writes what is given (not null) into the one that is there; UPDATE writes
    into the one that is there, or with ``match_name=False`` into all of that date, their name included; DELETE takes it away,
    or without a name all of that date. Only calendar dates are accepted. All columns of the events stay.

    What an event ends as follows from aggregates: its last deletion, the first addition after that, and of each field the last value
    given from there on; so an event may have any number of operations. With ``match_name=False`` updates change the events
    that others tell them by, and the operations of one user and date are folded over an array.
    """
    good = valid_month_day(F.col("date"))
    status = F.when(~F.col("type").isin("ADD", "UPDATE", "DELETE"), "skipped").when(good, "succeeded").otherwise("failed")
    error = F.when(F.coalesce("date", F.lit("")) == "", "no date").otherwise("not a calendar date")
    audit = ops.withColumns({"status": status, "error": F.when(status == "failed", error)})
    keys = ["user_id", "date", "event_name"]
    fields = ["event_name", *[c for c in events.columns if c not in keys and c in ops.columns]]
    wide = (F.col("type") == "DELETE") & (F.coalesce("event_name", F.lit("")) == "")
    wide = wide if match_name else wide | (F.col("type") == "UPDATE")
    live = audit.where("status = 'succeeded'")
    if match_name:
        return _last_writes(events, live, wide, keys, fields), audit
    step = F.collect_list(F.struct("op_id", "type", F.struct(*fields).alias("new")))
    named = live.where(~wide).groupBy(*keys).agg(step.alias("named"))
    dated = live.where(wide).groupBy("user_id", "date").agg(step.alias("dated"))
    old = events.select("*", F.lit(True).alias("__there"))
    both = old.join(named, keys, "full").join(dated, ["user_id", "date"], "left")
    steps = F.array_sort(F.concat(F.coalesce("named", F.slice("dated", 1, 0), F.lit(None)), F.coalesce("dated", F.slice("named", 1, 0))))
    start = F.struct(F.coalesce("__there", F.lit(False)).alias("there"), F.struct(*[F.col(c) for c in fields]).alias("now"))
    gone = F.struct(*[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in fields])
    merged = lambda now, new: F.struct(*[F.coalesce(new[c], now[c]).alias(c) for c in fields])

    def apply(state: Column, op: Column) -> Column:
        written = F.struct(F.lit(True).alias("there"), merged(state["now"], op["new"]).alias("now"))
        deleted = F.struct(F.lit(False).alias("there"), gone.alias("now"))
        return F.when(op["type"] == "DELETE", deleted).when((op["type"] == "ADD") | state["there"], written).otherwise(state)

    end = F.when(steps.isNull(), start).otherwise(F.aggregate(steps, start, apply))
    rest = [c for c in events.columns if c not in ("user_id", "date", *fields)]
    out = both.select("user_id", "date", *rest, end.alias("__end")).where("__end.there")
    return out.select("user_id", "date", *rest, "__end.now.*").select(*events.columns), audit


def _last_writes(events: DataFrame, live: DataFrame, wide: Column, keys: list[str], fields: list[str]) -> DataFrame:
    """The events after the operations, each on one event by its keys, or if ``wide`` the deletion of a whole date."""
    place = [F.col(k).alias(f"__{k}") for k in keys]
    same = lambda df, names: reduce(lambda a, b: a & b, [df[k] == F.col(f"__{k}") for k in names])
    named = live.where(~wide).select(*keys, "op_id", "type", F.struct(*fields).alias("new"))
    dated = live.where(wide).groupBy(*place[:2]).agg(F.max("op_id").alias("swept"))
    cut = named.where("type = 'DELETE'").groupBy(*place).agg(F.max("op_id").alias("cut"))
    rows = named.join(cut, same(named, keys), "left").select(*keys, "op_id", "type", "new", "cut")
    rows = rows.join(dated, same(rows, keys[:2]), "left").select(*keys, "op_id", "type", "new", F.greatest("cut", "swept").alias("cut"))
    after = (F.col("type") != "DELETE") & (F.col("cut").isNull() | (F.col("op_id") > F.col("cut")))
    last = [F.max(F.when(after & F.col(f"new.{c}").isNotNull(), F.struct("op_id", F.col(f"new.{c}").alias("value")))).alias(f"last_{c}") for c in fields]
    ends = rows.groupBy(*place).agg(F.max("cut").alias("cut"), F.min(F.when(after & (F.col("type") == "ADD"), F.col("op_id"))).alias("added"), *last)
    old = events.withColumn("__there", F.lit(True))
    both = old.join(ends, same(old, keys), "full")
    both = both.select(*[F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in keys], *[old[c] for c in events.columns if c not in keys], "__there", F.col("cut").alias("__cut"), F.col("added").alias("__added"), *[F.col(f"last_{c}").alias(f"__last_{c}") for c in fields])
    # events that no operation names are swept by their date alone
    both = both.join(dated, same(both, keys[:2]), "left").withColumn("__cut", F.coalesce("__cut", "swept"))
    stays = F.coalesce("__there", F.lit(False)) & F.col("__cut").isNull()

    def value(c: str) -> Column:
        new = F.when(stays | (F.col(f"__last_{c}.op_id") >= F.col("__added")), F.col(f"__last_{c}.value"))
        return F.coalesce(new, F.when(stays, F.col(c)))

    return both.where(stays | F.col("__added").isNotNull()).select(*[F.col(c) if c in keys else value(c).alias(c) if c in fields else F.when(stays, F.col(c)).alias(c) for c in events.columns])


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row of each key: the one that is last by ``order``. A partial aggregate, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def with_writes(ops: DataFrame, batch: str) -> DataFrame:
    """Operations of the batches that write at all; a batch of NOOPs only has nothing to execute. One aggregate and a semi join, no window over a batch."""
    return ops.join(ops.where("type != 'NOOP'").select(batch).distinct(), batch, "left_semi")


def insert_missing(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and those of new keys; of several new rows of one key an arbitrary one."""
    return stored.unionByName(rows.select(*stored.columns).dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti"))
