"""Repository files and diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed

#: Languages by extension; directories and files that aren't read.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rb": "ruby", "rs": "rust",
    "cpp": "cpp", "c": "c", "h": "c", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "scala": "scala", "swift": "swift", "php": "php",
}
SKIPPED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".next", ".nuxt", "vendor", "target", ".tox", ".mypy_cache", ".pytest_cache", "egg-info")
SKIPPED_FILES = ("package-lock.json", "yarn.lock", "poetry.lock", "Pipfile.lock", "go.sum")


def language(path: Column) -> Column:
    """Null for other extensions."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.lower(F.element_at(F.split(path, r"\."), -1))]


def skipped(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in SKIPPED_DIRS])) | F.element_at(parts, -1).isin(*SKIPPED_FILES)


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, language, content, content_hash) of a checked-out tree; bytes that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    begin = r"^\w+:/*\Q" + root.split(":", 1)[-1].strip("/").replace(r"\E", r"\E\\E\Q") + r"\E/"
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), begin, "")
    rows = raw.select(path.alias("file_path"), "content").where(~skipped(F.col("file_path")))
    rows = rows.withColumn("language", language(F.col("file_path"))).where(F.col("language").isNotNull())
    return rows.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))


def diff_rows(lines: DataFrame, col: str = "value") -> DataFrame:
    """(status, file_path) of name-status lines; a rename is its new path RENAMED and its old one DELETED."""
    p = F.split(col, "\t")
    row = lambda s, i: F.struct(F.lit(s).alias("status"), F.get(p, F.lit(i)).alias("file_path"))
    kinds = F.when(F.startswith(col, F.lit("R")), F.array(row("RENAMED", 2), row("DELETED", 1)))
    for letter, name in (("A", "ADDED"), ("M", "MODIFIED"), ("D", "DELETED")):
        kinds = kinds.when(F.startswith(col, F.lit(letter)), F.array(row(name, 1)))
    return lines.select(F.explode(kinds).alias("r")).select("r.*")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; bytes that are not UTF-8 are dropped, empty files are left out."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text")).where(trimmed(F.col("text")) != "")


def retained(df: DataFrame, now: Column, days: int = 90, ts: str = "ts") -> DataFrame:
    """Rows not older than the retention."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def newer_than(df: DataFrame, last_id: int, n: int = 500, key: str = "id") -> DataFrame:
    """Incremental read of a log: what came after the last id seen, the newest n."""
    return df.where(F.col(key) > last_id).orderBy(F.desc(key)).limit(n)
