"""Pairing the turns of conversations: who answered what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trimmed


def _window(key: str, order: str):
    return W.partitionBy(key).orderBy(order)


def pair_last_user(turns: DataFrame, key: str = "conv_id", order: str = "turn", user: str = "user", assistant: str = "assistant", leftover: bool = True) -> DataFrame:
    """Each assistant turn with the last user turn before it, which is used once: (key, turn, user_query, agent_response).

    An assistant turn without a user turn of its own gets the empty query, or with ``leftover=False`` is left out.
    """
    said = turns.where(F.col("role").isin(user, assistant))
    w = _window(key, order)
    fresh = F.lag("role").over(w) == user
    rows = said.withColumns({"query": F.when(fresh, F.lag("text").over(w)), "fresh": F.coalesce(fresh, F.lit(False))}).where(F.col("role") == assistant)
    rows = rows if leftover else rows.where("fresh")
    return rows.select(key, order, F.coalesce("query", F.lit("")).alias("user_query"), F.col("text").alias("agent_response"))


def pair_zip(turns: DataFrame, key: str = "conv_id", order: str = "turn", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """The i-th user turn with the i-th assistant turn; what is left over is dropped. One window and one aggregate on the key."""
    said = turns.where(F.col("role").isin(user, assistant))
    n = said.withColumn("i", F.row_number().over(W.partitionBy(key, "role").orderBy(order)))
    both = n.groupBy(key, "i").agg(F.max(F.when(F.col("role") == user, F.col("text"))).alias("user_query"), F.max(F.when(F.col("role") == assistant, F.col("text"))).alias("agent_response"))
    return both.where("user_query IS NOT NULL AND agent_response IS NOT NULL")


def pair_runs(turns: DataFrame, key: str = "conv_id", order: str = "turn", user: str = "user", assistant: str = "assistant") -> DataFrame:
    """Each user turn with all assistant turns up to the next user turn, joined by a blank line; user turns without an answer are dropped."""
    said = turns.where(F.col("role").isin(user, assistant))
    group = said.withColumn("g", F.sum((F.col("role") == user).cast("int")).over(_window(key, order))).where("g > 0")
    answers = F.array_sort(F.collect_list(F.when(F.col("role") == assistant, F.struct(order, "text"))))
    rows = group.groupBy(key, "g").agg(F.max(F.when(F.col("role") == user, F.col("text"))).alias("user_query"), F.transform(answers, lambda x: x["text"]).alias("answers"))
    return rows.where(F.size("answers") > 0).select(key, "g", "user_query", F.array_join("answers", "\n\n").alias("agent_response"))


def trivial(text: Column, words: int = 4) -> Column:
    """Turns of fewer words need no summary."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", True).otherwise(F.size(F.split(t, r"\s+")) < words)


def transcript_turns(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text) of transcripts whose sections begin with ``**User**``, ``**Cursor**`` or ``**Assistant**``, parted by ``---`` lines,
    or have ``### User Input`` and ``### Planner Response`` headings."""
    t = F.col(text_col)
    cursor = F.transform(
        F.split(t, r"(?m)^---[ \t]*$"),
        lambda s: F.struct(
            F.when(trimmed(s).startswith("**User**"), "user").when(trimmed(s).rlike(r"^\*\*(Cursor|Assistant)\*\*"), "assistant").alias("role"),
            F.btrim(F.regexp_replace(trimmed(s), r"^\*\*(User|Cursor|Assistant)\*\*", ""), F.lit(" \t\r\n")).alias("text"),
        ),
    )
    heading = r"(?im)^###\s+(User Input|Planner Response)[ \t]*$"
    names = F.regexp_extract_all(t, F.lit(heading), F.lit(1))
    bodies = F.slice(F.split(t, heading), 2, 1_000_000_000)
    planner = F.zip_with(names, bodies, lambda n, b: F.struct(F.when(F.lower(n) == "user input", "user").otherwise("assistant").alias("role"), F.btrim(b, F.lit(" \t\r\n")).alias("text")))
    rows = F.when(F.contains(t, F.lit("**User**")), cursor).otherwise(planner)
    return texts.select(F.col(id_col).alias("id"), F.posexplode(rows).alias("turn", "r")).select("id", "turn", "r.*").where("role IS NOT NULL AND text != ''")
