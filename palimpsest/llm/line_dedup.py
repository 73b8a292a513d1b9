"""Line dedup: lines that many documents share go from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, documents_of

_SPACES = " \t\n\x0b\x0c\r"


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops every line whose key is in at least ``min_docs`` documents: (doc_id, text, n_lines, n_dropped, *keep).

    A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of fewer than
    ``min_chars`` code points are never dropped. Lines are exploded, keys hashed to 128 bits and counted once for each
    document that has them (partial counts before the shuffle, so a line of all documents is one row a task), and
    the positions of the dropped lines come back to the document, which is put together again from the others.
    Only keys, ids and positions are shuffled for the count; the texts are shuffled once, for the last join.

    Null text counts as the empty text, which is one empty line. Each row is a document, also if its id is null or
    repeated. All lines dropped: the empty text. No documents: no rows.
    """
    base = documents_of(docs, id_col, text_col, keep).withColumn("__text_hash", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    lines = base.select("doc_id", "__text_hash", F.posexplode(F.split(ascii_lower(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(_SPACES)))
    key = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")]
    keyed = lines.where(F.length("line") >= min_chars) if min_chars > 0 else lines

    # a document counts once for a key: distinct within its row, before any shuffle
    own = base.select(F.explode(F.array_distinct(F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(_SPACES))))).alias("line"))
    own = own.where(F.length("line") >= min_chars) if min_chars > 0 else own
    common = own.select(*key).groupBy("h1", "h2").count().where(F.col("count") >= min_docs).drop("count")
    common = Workspace(docs.sparkSession, "line-dedup").save(common, "common")  # a table, so that a line of very many documents can be dealt to several tasks

    dropped = keyed.select("doc_id", "__text_hash", "pos", *key).join(common, ["h1", "h2"], "left_semi").groupBy("doc_id", "__text_hash").agg(F.collect_list("pos").alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("__id"), F.col("__text_hash").alias("__hash"), F.array_distinct("dropped").alias("dropped"))
    found = base.join(dropped, base["doc_id"].eqNullSafe(dropped["__id"]) & (base["__text_hash"] == dropped["__hash"]), "left")
    whole = F.split(text, "\n")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), gone)
    return found.select(
        base["doc_id"],
        F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.transform(left, lambda i: F.get(whole, i)), "\n")).alias("text"),
        F.size(whole).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        *[base[c] for c in keep],
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them share: (doc_id, n_lines, n_dropped, kept_sha256); a null text is one empty line."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH spaces AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS s),
lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, s), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines, spaces),
common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM common) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
