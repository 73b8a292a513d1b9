"""From raw documents to token ids: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes all documents that the one before kept and returns the columns of documents; the last returns ids. Columns
beyond doc_id and text pass through, whatever their names. Each row is a document: stages that drop rows find them by doc_id
and text together, so that ids may be null or repeat. Near-dedup links documents with a null doc_id with nothing; they stay.

What a stage has decided lies in ``spark.checkpoint.dir`` as a table of ids and hashes for as long as its result is to be read
or computed anew; the stage's own tables are deleted before it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import round_trip, vocabulary_path
from palimpsest.llm.common import Workspace, checked_broadcast
from palimpsest.llm.decontaminate import decontaminate
from palimpsest.llm.language_id import identify, learn
from palimpsest.llm.line_dedup import line_dedup
from palimpsest.llm.near_dedup import near_duplicates


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with other names for the columns besides doc_id and text, and these names' old ones."""
    names = {f"kept_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *[docs[c].alias(k) for k, c in names.items()]), names


def _restored(docs: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    back = {c: F.col(k).alias(c) for k, c in names.items()} | {c: F.col(c) for c in ("doc_id", "text")}
    return docs.select(*[back[c] for c in columns])


def _stored(decided: DataFrame, work: Workspace) -> DataFrame:
    """(decided_id, decided_hash, ...): all that is left of a stage's tables, which go; broadcast if it is below the bound."""
    out = Workspace(decided.sparkSession, "decided").save(decided.select(F.col("doc_id").alias("decided_id"), F.col("text_hash").alias("decided_hash"), *decided.columns[2:]), "rows")
    work.drop()
    return out


def _same(docs: DataFrame, decided: DataFrame):
    return docs["doc_id"].eqNullSafe(decided["decided_id"]) & (F.xxhash64(docs["text"].cast("string")) == decided["decided_hash"])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; texts without a letter (``und``) go."""
    plain, names = _plain(docs)
    filters = learn(docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang"))
    found = identify(plain, filters, keep=tuple(names))
    return _restored(found.where(F.col("lang_pred") != "und"), names, docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents or more share; n_chars is counted anew."""
    plain, names = _plain(docs)
    out = _restored(line_dedup(plain, keep=tuple(names)), names, docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, and of rows with its doc_id and text one."""
    work = Workspace(spark, "near-dedup")
    linked = near_duplicates(docs, work=work).where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    rows = linked.groupBy("doc_id", "text_hash").agg(F.bool_and("representative").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = _stored(rows.where("NOT stays OR n > 1"), work)
    decided, repeated = checked_broadcast(rows), rows.where("stays")
    out = docs.join(decided, _same(docs, decided), "left_anti")
    if repeated.isEmpty():
        return out
    repeated = checked_broadcast(repeated)
    return out.union(docs.join(repeated, _same(docs, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item (or a shorter item as a whole)."""
    work = Workspace(spark, "decontaminate")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), work=work)
    decided = checked_broadcast(_stored(found.where("contaminated").select("doc_id", "text_hash").distinct(), work))
    return docs.join(decided, _same(docs, decided), "left_anti")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): ids of each text, which decode to the text again."""
    both = round_trip(docs, vocabulary_path())
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("bpe", bpe)]

#: SQL has no BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each one's result is stored before the next reads it."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
