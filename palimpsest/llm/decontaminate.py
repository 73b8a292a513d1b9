"""Benchmark decontamination: phrase and proximity search of test items in a positional inverted index of the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, checked_broadcast, documents_of

#: What stands between words, after A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before.
_BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN_RAW), "")).cast("long")


def windows_of(benchmark: DataFrame, size: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_id, terms): the runs of ``size`` words of each item; an item of fewer words, but not none, is one window."""
    items = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")).alias("item_id"), words_of(benchmark[text_col].cast("string")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
    found = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("terms"))
    return found.distinct().select(F.xxhash64("item_id", "terms").alias("window"), "item_id", "terms")


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))


def find_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0, lists: int = 2, work: Workspace | None = None) -> DataFrame:
    """Occurrences of the items' windows in the documents: (doc_id, text_hash, item_id, window, start, n, exact).

    1. Each test term is counted over all documents.
    2. For each window, its ``lists`` rarest terms are picked; a window with a term that no document has is out.
       Postings (term, document, position, and as payload the words around it that a window can reach) of these
       terms only are stored; the lists of more frequent terms are never read and so not written.
    3. The lists, moved by the term's offset in the window, are intersected on (window, document, start), from the
       rarest on; with ``slop`` their starts may differ by that many words.
    4. A window that is left is compared word by word with the payload. ``exact``: the phrase itself. With ``slop``
       also windows of which each word stands at most ``slop`` words from its place, counted from the rarest term's.

    Rows are documents; (doc_id, hash of text) tells them apart, so exact repeats of a row give each match twice.
    The test terms, the picked terms and the windows follow the benchmark alone; they are broadcast only if counted
    below the bound, else joined by a shuffle. Null texts and texts without words match nothing.
    """
    work = work or Workspace(docs.sparkSession, "decontaminate")
    windows = work.save(windows_of(benchmark, size), "windows")
    at = windows.select("window", F.posexplode("terms").alias("off", "term"), F.size("terms").alias("n"))
    vocabulary = work.save(at.select("term").distinct(), "vocabulary")
    words = _document_words(docs)
    small, every = checked_broadcast(vocabulary), words.select(F.explode("words").alias("term"))
    # a vocabulary that is too large for a broadcast meets counts, not words: no frequent word is one key of a join
    counted = every.join(small, "term").groupBy("term").count() if small is not vocabulary else every.groupBy("term").count().join(vocabulary, "term")
    counts = work.save(counted, "counts")

    by_rarity = W.partitionBy("window").orderBy("count", "off")
    ranked = at.join(counts, "term", "left").withColumns({"place": F.row_number().over(by_rarity), "absent": F.max(F.col("count").isNull()).over(W.partitionBy("window"))})
    uses = work.save(ranked.where(~F.col("absent") & (F.col("place") <= lists)).select("window", "term", "off", "n", "place"), "uses")
    picked = work.save(uses.groupBy("term").agg((F.max("off") + slop).alias("before"), (F.max(F.col("n") - 1 - F.col("off")) + slop).alias("after")), "picked")

    placed, small = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term")), checked_broadcast(picked)
    first = F.greatest(F.col("pos") - F.col("before"), F.lit(0))
    around = F.slice("words", first + 1, F.col("pos") - first + 1 + F.col("after"))
    if small is picked:  # a shuffle deals the words, each with what any window can reach and never with all of its text
        reach = picked.agg(F.coalesce(F.max("before"), F.lit(0)).alias("before"), F.coalesce(F.max("after"), F.lit(0)).alias("after")).head()
        begin = F.greatest(F.col("pos") - F.lit(reach["before"]), F.lit(0))
        cut = F.slice("words", begin + 1, F.col("pos") - begin + 1 + F.lit(reach["after"]))
        placed = placed.select("doc_id", "text_hash", "pos", "term", begin.alias("begin"), cut.alias("words"))
        around = F.slice("words", first - F.col("begin") + 1, F.col("pos") - first + 1 + F.col("after"))
    found = placed.join(small, "term")
    postings = work.save(found.select("term", "doc_id", "text_hash", "pos", (F.col("pos") - first).alias("lead"), around.alias("around")), "postings")

    def moved(place: int) -> DataFrame:
        """The list of the windows' place-th rarest term, moved to where the window would start."""
        here = checked_broadcast(uses.where(F.col("place") == place).drop("place"))
        return postings.join(here, "term").withColumn("start", F.col("pos") - F.col("off"))

    left = moved(1)
    for place in range(2, lists + 1):
        right = moved(place).select(F.col("window").alias("w"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("start").alias("s")).distinct()
        same = (F.col("window") == F.col("w")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))
        near = F.col("start") == F.col("s") if not slop else F.abs(F.col("start") - F.col("s")) <= slop
        long = left.where(F.col("n") >= place).join(right, same & near, "left_semi")
        left = long.unionByName(left.where(F.col("n") < place))
    texts = checked_broadcast(windows)
    left = left.join(texts.select("window", "item_id", "terms"), "window")
    begin = F.col("lead") - F.col("off")  # the window's start in the payload
    exact = (begin >= 0) & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("n")) == F.col("terms"))
    left = left.withColumn("exact", exact)
    if slop:
        low = lambda i: F.greatest(begin + i - slop, F.lit(0))
        near_by = F.transform("terms", lambda t, i: F.array_contains(F.slice("around", low(i) + 1, F.greatest(begin + i + slop - low(i) + 1, F.lit(0))), t))
        left = left.where(F.forall(near_by, lambda x: x))
    else:
        left = left.where("exact")
    return left.select("doc_id", "text_hash", "item_id", "window", "start", "n", "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", work: Workspace | None = None) -> DataFrame:
    """Per document (doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated).

    A document word inside any match of a window is hit; item_ids are the ids, as strings and sorted, of the items with
    matching windows. A null item id counts as the empty string, items of one id as one item. Each row of ``docs``
    gives a row, also if its text or id is null or repeated; no benchmark leaves all documents clean.
    """
    base = documents_of(docs, id_col, text_col)
    matches = find_matches(base, benchmark, size, slop, work=work)
    before = W.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    spans = matches.withColumn("end", F.col("start") + F.col("n"))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))))
    hits = spans.groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "n_hit", "item_ids")
    all_docs = base.select("doc_id", F.xxhash64("text").alias("text_hash"), _n_words(F.col("text")).alias("n_words"))
    out = all_docs.join(hits, all_docs["doc_id"].eqNullSafe(hits["d"]) & (all_docs["text_hash"] == hits["h"]), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated).

    A null or wordless text has no words and is clean. The stage tables lie in ``spark.checkpoint.dir`` for as long as the result is to be read.
    """
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
matches AS (
  SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows USING (n, gram)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM matches) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
