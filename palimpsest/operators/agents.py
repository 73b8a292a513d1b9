"""Agents as table functions: a function from a text to records, called once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import may_annotate

#: What an agent finds in what someone said; all but the content may be null.
ANNOTATIONS = "content string, annotation_type string, severity string, target_symbol string, target_file string, repo string, assigned_to_name string"


def records(rows: DataFrame, text_col: str, agent: Callable[[str], Iterable[tuple]], returns: str) -> DataFrame:
    """The rows, once for each record of their text, with the columns of ``returns``; rows without any are left out.

    ``agent`` maps a text to tuples. It runs where the texts are dealt to, once a distinct text, whatever the number of rows that have it; null and
    blank texts aren't given to it. What it raises fails the query: it may return nothing instead.
    """
    names = [c.split()[0] for c in returns.split(",")]

    class Agent:
        def eval(self, row):
            for found in agent(row["__text"]):
                yield (row["__text"], *found)

    texts = rows.select(F.col(text_col).alias("__text")).where(F.trim("__text") != "").distinct()
    # a table argument is dealt by its text, so that one long list of texts isn't one task's
    found = F.udtf(Agent, returnType=f"__text string, {returns}")(texts.asTable().partitionBy("__text"))
    return rows.join(found, rows[text_col] == found["__text"]).select(*[rows[c] for c in rows.columns if c not in names], *names)


def annotations(turns: DataFrame, agent: Callable[[str], Iterable[tuple]]) -> DataFrame:
    """Annotations that an agent finds in turns of a team chat, by members that may annotate.

    turns: (turn_id, project_id, org_id, repo, user_id, user_name, role, query, file_path, symbol_name). Only what the user said is read, never the
    answer. Annotations without content are left out; kind, file, symbol and repository default to an explanation and the turn's.
    Ids are hashes of the turn and the content, so that a turn that comes again gives the same ones.
    """
    own = turns.where(may_annotate(F.col("role"))).select(*[F.col(c).alias(f"t_{c}") for c in turns.columns], F.trim("query").alias("said"))
    rows = records(own, "said", agent, ANNOTATIONS).where(F.trim("content") != "")
    some = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b)).alias(b.removeprefix("t_"))
    out = rows.select(
        F.substring(F.sha2(F.concat_ws("\x00", F.col("t_turn_id").cast("string"), F.trim("content")), 256), 1, 16).alias("annotation_id"),
        F.col("t_project_id").alias("project_id"), F.col("t_org_id").alias("org_id"), some("repo", "t_repo"), F.trim("content").alias("content"),
        F.coalesce(F.nullif("annotation_type", F.lit("")), F.lit("explanation")).alias("annotation_type"), F.nullif("severity", F.lit("")).alias("severity"), F.lit("active").alias("status"),
        F.col("t_user_id").alias("author_id"), F.coalesce("t_user_name", "t_user_id").alias("author_name"), F.col("t_role").alias("author_role"),
        some("target_file", "t_file_path"), some("target_symbol", "t_symbol_name"), "assigned_to_name",
    )
    return out.distinct()


def counted(projects: DataFrame, created: DataFrame, count: str = "annotation_count") -> DataFrame:
    """Projects with the number of annotations created for them added to their count; those of unknown projects count nowhere."""
    new = created.groupBy(F.col("project_id").alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    both = projects.join(new, projects["project_id"] == new["__id"], "left")
    total = F.coalesce(F.col(count), F.lit(0)) + F.coalesce("__n", F.lit(0))
    return both.select(*[total.alias(c) if c == count else projects[c] for c in projects.columns])
