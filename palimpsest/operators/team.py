"""Team memory: annotations and instructions for a question, catalogs, and the tools by name."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import topic_of

#: Kinds of annotations that instruct, and the roles that they are for.
INSTRUCTIONS = ("instruction", "explanation", "warning", "feature_idea")
INSTRUCTED = ("intern", "sde2")
#: Facts of a topic that are paired with as many others in one go, or so.
TOPIC_BLOCK = 1_024


def manager_instructions(annotations: DataFrame, n: int = 10) -> DataFrame:
    """Active annotations by managers, of the kinds that instruct; (annotation_id, score, ...) with the best score first."""
    rows = annotations.where((F.coalesce("status", F.lit("active")) == "active") & (F.col("author_role") == "manager") & F.coalesce("annotation_type", F.lit("explanation")).isin(*INSTRUCTIONS))
    return rows.orderBy(F.desc("score"), "annotation_id").limit(n)


def chat_context(annotations: DataFrame, memory: DataFrame, role: str, n_annotations: int = 5, n_instructions: int = 10, n_memory: int = 5) -> DataFrame:
    """(part, id, score, content): annotations, instructions if the role gets them, and memory, each cut to its size."""
    own = lambda df, part, key, n: df.orderBy(F.desc("score"), key).limit(n).select(F.lit(part).alias("part"), F.col(key).cast("string").alias("id"), "score", "content")
    active = annotations.where(F.coalesce("status", F.lit("active")) == "active")
    parts = [own(active, "annotation", "annotation_id", n_annotations), own(memory, "memory", "id", n_memory)]
    if role in INSTRUCTED:
        parts.insert(1, own(manager_instructions(annotations, n_instructions), "instruction", "annotation_id", n_instructions))
    return reduce(DataFrame.unionByName, parts)


def topic_catalog(memory: DataFrame, key: str = "main_content", order: str = "id") -> DataFrame:
    """(topic, sub_topic, place) of the distinct non-empty keys, placed where they are seen first."""
    seen = memory.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.min(order).alias("place"))
    return seen.select(topic_of(F.col(key)).alias("t"), "place").select("t.topic", "t.sub_topic", "place")


def topic_edges(memory: DataFrame, user: str = "user_id", key: str = "topic", id_col: str = "id") -> DataFrame:
    """(user, a, b, weight): pairs of a user's facts of one topic, which are what is asked for: their number is the square of a topic's.

    A topic's facts are dealt to blocks of TOPIC_BLOCK by their ids, and each two blocks meet once: a large topic is many tasks,
    of which none holds more than a few blocks at a time, and half of the pairs aren't made. Topics of one block aren't copied.
    """
    spark = memory.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = memory.select(user, key, F.col(id_col).alias("__id")).where(F.col("__id").isNotNull())
    blocks = rows.groupBy(user, key).agg(F.ceil(F.count(F.lit(1)) / TOPIC_BLOCK).cast("int").alias("__n"))
    rows = rows.join(blocks, [user, key]).withColumn("__block", F.pmod(F.xxhash64("__id"), F.col("__n")).cast("int"))
    first = rows.select(user, key, F.col("__id").alias("__x"), F.col("__block").alias("__i"), F.explode(F.sequence("__block", F.col("__n") - 1)).alias("__j"))
    second = rows.select(user, key, F.col("__id").alias("__y"), F.explode(F.sequence(F.lit(0), "__block")).alias("__i"), F.col("__block").alias("__j"))
    meet = [user, key, "__i", "__j"]
    pairs = first.repartition(n, *meet).join(second, meet).where("__i != __j OR __x < __y")
    return pairs.select(user, F.least("__x", "__y").alias("a"), F.greatest("__x", "__y").alias("b"), F.lit(0.8).alias("weight"))


def merge_chunks(parts: DataFrame, key: str, order: str, fields: tuple[str, ...], errors: str = "errors") -> DataFrame:
    """Results of the chunks of one text: the last non-null value of each field, all errors in order."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    every = F.transform(F.array_sort(F.collect_list(F.struct(order, errors))), lambda x: x[errors])
    return parts.groupBy(key).agg(*last, F.flatten(F.array_compact(every)).alias(errors))


class Tools:
    """Functions to DataFrames by name; case and underscores don't matter."""

    def __init__(self, **tools: Callable[..., DataFrame]):
        self.tools = {self._plain(k): f for k, f in tools.items()}

    @staticmethod
    def _plain(name: str) -> str:
        return re.sub("_", "", name).lower()

    def __call__(self, name: str, **arguments) -> DataFrame:
        if (plain := self._plain(name)) not in self.tools:
            raise ValueError(f"no such tool: {name}")
        return self.tools[plain](**arguments)


def neighbour_block(item: Column, rows: Column) -> Column:
    """The stored rows nearest to an item, as lines ``id | score | text`` for a judge; rows: array<(id, score, content)>."""
    lines = F.transform(rows, lambda r: F.format_string("%s | %.3f | %s", r["id"].cast("string"), r["score"].cast("double"), r["content"]))
    return F.concat(F.lit("NEW: "), item, F.lit("\n"), F.when(F.size(rows) > 0, F.array_join(lines, "\n")).otherwise("(none)"))


#: Lanes of an ingested turn, and those that a team chat leaves to its annotations.
LANES, TEAM_OFF = ("profile", "temporal", "summary", "code", "snippet", "image"), ("code", "snippet")


def relevant_memory(sources: DataFrame, top_k: int = 5, limit: int = 5) -> DataFrame:
    """(user_id, rank, domain, content, score): each user's best sources of a question, ``top_k`` of them, but one at least and ``limit`` at most.

    sources: (user_id, id, domain, content, score); users without any have no rows.
    """
    k = min(limit, max(1, min(top_k, limit)))
    w = W.partitionBy("user_id").orderBy(F.desc_nulls_last("score"), "id")
    return sources.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "rank", "domain", "content", "score")


def ingestible(turns: DataFrame, off: tuple[str, ...] = TEAM_OFF) -> DataFrame:
    """The turns (turn_id, user_id, query, answer) as they are stored: (turn_id, user_id, user_query, agent_response, lanes, error).

    A turn that says nothing on both sides is an error; an empty answer is an acknowledgement. ``lanes`` are all but those switched off.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = blank("query") & blank("answer")
    lanes = F.array(*[F.lit(x) for x in LANES if x not in off])
    answer = F.when(F.coalesce("answer", F.lit("")) == "", "Acknowledged.").otherwise(F.col("answer"))
    return turns.select("turn_id", "user_id", F.coalesce("query", F.lit("")).alias("user_query"), answer.alias("agent_response"), F.when(~empty, lanes).alias("lanes"), F.when(empty, "empty conversation").alias("error"))
