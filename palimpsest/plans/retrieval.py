"""Vector, lexical and hybrid search; embeddings are the vector store with the label as namespace, documents the text store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search
from .core import Tables, query

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _vector(t: Tables, vec_id: int = 0) -> list[float]:
    return t.embeddings.where(F.col("vec_id") == vec_id).head()["embedding"]


def _knn(t: Tables, k: int = 10, **kw):
    found = search.knn(t.embeddings, _vector(t), k, "vec_id", **kw)
    return found.select("vec_id", F.round("score", 6).alias("score"))


def _knn_sql(score: str, k: int = 10, where: str = "true") -> str:
    return f"""SELECT e.vec_id, round({score}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE {where} ORDER BY {score} DESC, e.vec_id LIMIT {k}"""


@query(_knn_sql(_COS))
def knn_cosine(t):
    return _knn(t)


@query(_knn_sql(_COS, where="e.label = 3"))
def knn_filtered(t):
    return _knn(t, where=F.col("label") == 3)


@query(_knn_sql("0 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def knn_euclidean(t):
    return _knn(t, metric="euclidean")


@query(_knn_sql("list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def knn_dot(t):
    return _knn(t, metric="dot")


@query(_knn_sql(f"greatest(0, least(1, ({_COS} + 1) / 2))"))
def score_scale_unit(t):
    return _knn(t, mode="unit")


@query(_knn_sql(f"greatest(0, least(1, {_COS}))", k=20))
def score_scale_clamp(t):
    return _knn(t, k=20, mode="clamp")


@query(_knn_sql(_COS, k=50, where=f"{_COS} >= 0.15"))
def threshold_search(t):
    return _knn(t, k=50, least=0.15)


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_COS} AS score FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def knn_join_top3(t):
    """Each twentieth vector against all of its label: the semantic match of new items with stored ones."""
    e = t.embeddings
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    found = search.knn_join(q, e.select(F.col("vec_id").alias("id"), "embedding", "label"), ["label"], 3)
    return found.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE label = 2 ORDER BY vec_id LIMIT 10")
def metadata_lookup(t):
    rows = t.embeddings.withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    return search.top(rows.where(search.matches(F.col("metadata"), {"label": "2"})), 10, F.asc("vec_id")).select("vec_id", "label", F.lit(1.0).alias("score"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (3, 5, 8, 1000000)")
def get_by_ids(t):
    return search.by_ids(t.embeddings, [3, 5, 8, 1_000_000], "vec_id").select("vec_id", "label")


@query("SELECT CAST(label AS VARCHAR) AS namespace, count(*) AS n FROM embeddings GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM embeddings")
def namespace_stats(t):
    return search.namespaces(t.embeddings, "label")


@query("""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS term FROM documents)
WHERE term != '' GROUP BY term ORDER BY df DESC, term LIMIT 100""")
def token_df(t):
    rows = t.documents.select(F.explode(F.array_distinct(search.terms(F.col("text")))).alias("term"))
    return search.top(rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")), 100, F.desc("df"), F.asc("term"))


_QUERY = "the thand of anhe der"


def _bm25_sql(k: int) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') AS t FROM documents),
q AS (SELECT DISTINCT unnest(string_split('{_QUERY}', ' ')) AS w),
s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT id, w, len(t) AS dl, len(list_filter(t, lambda x: x = w)) AS tf FROM d, q),
df AS (SELECT w, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY w),
sc AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (w), s GROUP BY id)
SELECT id, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY score DESC, id LIMIT {k}"""


@query(_bm25_sql(20))
def bm25_topk(t):
    return search.bm25(t.documents, _QUERY, 20, "doc_id").select("id", F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT vec_id AS k, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings WHERE label = 1),
b AS (SELECT vec_id AS k, row_number() OVER (ORDER BY vec_id DESC) AS rank FROM embeddings WHERE label IN (1, 2)),
u AS (SELECT k, rank, 0 AS lane FROM a WHERE rank <= 30 UNION ALL SELECT k, rank, 1 FROM b WHERE rank <= 30)
SELECT k, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY k""")
def rrf_fuse(t):
    e = t.embeddings
    a = search.ranked(search.top(e.where("label = 1").select(F.col("vec_id").alias("k")), 30, F.asc("k")), F.asc("k"))
    b = search.ranked(search.top(e.where("label IN (1, 2)").select(F.col("vec_id").alias("k")), 30, F.desc("k")), F.desc("k"))
    return search.rrf([a, b], "k").select("k", F.round("score", 9).alias("score"))


@query(f"""WITH b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_bm25_sql(30)})),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, {_COS} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY s DESC, vec_id LIMIT 30)),
l AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 30)),
u AS (SELECT id, rank, 0 AS lane FROM b UNION ALL SELECT id, rank, 1 FROM v UNION ALL SELECT id, rank, 2 FROM l),
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, min(lane * 1000 + rank) AS o FROM u GROUP BY id)
SELECT id, round(score, 9) AS score FROM f ORDER BY f.score DESC, o LIMIT 10""")
def hybrid_search(t):
    """Lexical, vector and size lanes of three times the wanted rows each, fused by rank."""
    lexical = search.bm25(t.documents, _QUERY, 30, "doc_id").select("id", F.round("score", 6).alias("score"))
    lexical = search.ranked(lexical, F.desc("score"), F.asc("id"))
    vector = search.ranked(search.knn(t.embeddings, _vector(t), 30, "vec_id").select(F.col("vec_id").alias("id"), "score"), F.desc("score"), F.asc("id"))
    longest = search.top(t.documents.select(F.col("doc_id").alias("id"), "n_chars"), 30, F.desc("n_chars"), F.asc("id"))
    lanes = [lexical, vector, search.ranked(longest, F.desc("n_chars"), F.asc("id"))]
    return search.rrf(lanes, "id", limit=10).select("id", F.round("score", 9).alias("score"))


@query("""WITH q AS (SELECT source, count(*) AS n FROM documents WHERE contains(text, 'license') OR contains(text, 'License') GROUP BY source)
SELECT source, n, CASE WHEN n = 0 THEN 0.1 ELSE least(1.0, n * 0.2) END::DOUBLE AS confidence FROM q""")
def evidence_confidence(t):
    rows = t.documents.where(F.contains("text", F.lit("license")) | F.contains("text", F.lit("License"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("confidence", search.confidence(F.col("n")).cast("double"))


@query("""(SELECT 'profile' AS domain, 0 AS o, doc_id AS id FROM documents WHERE source = 'src0' ORDER BY doc_id LIMIT 100)
UNION ALL (SELECT 'temporal', 1, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)
UNION ALL (SELECT 'summary', 2, item_id FROM benchmark ORDER BY item_id LIMIT 15)""")
def cross_domain_search(t):
    """Profile facts, then events, then summaries, each cut to its own size."""
    row = lambda df, domain, o, key: df.select(F.lit(domain).alias("domain"), F.lit(o).alias("o"), F.col(key).alias("id"))
    a = row(search.top(t.documents.where("source = 'src0'"), 100, F.asc("doc_id")), "profile", 0, "doc_id")
    b = row(search.top(t.events, 10, F.desc("ts"), F.desc("event_id")), "temporal", 1, "event_id")
    return a.unionByName(b).unionByName(row(search.top(t.benchmark, 15, F.asc("item_id")), "summary", 2, "item_id"))


@query("""WITH s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en'),
x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE source = 'src3'),
u AS (SELECT id, rank, 0 AS part FROM x WHERE rank <= 5 UNION ALL SELECT id, rank, 1 FROM s WHERE rank <= 20),
o AS (SELECT id, min(part * 1000 + rank) AS place FROM u GROUP BY id)
SELECT id FROM o ORDER BY place, id LIMIT 10""")
def relevance_list(t):
    from ..operators.catalog import relevance

    d = t.documents.select(F.col("doc_id").alias("id"), "n_chars", "lang", "source")
    s = search.ranked(search.top(d.where("lang = 'en'"), 20, F.desc("n_chars"), F.asc("id")), F.desc("n_chars"), F.asc("id"))
    x = search.ranked(search.top(d.where("source = 'src3'"), 5, F.asc("id")), F.asc("id"))
    return relevance(s, x, 10).select("id")


@query("""SELECT p_partkey, p_type, p_size, row_number() OVER (ORDER BY (p_type LIKE '%STEEL%') DESC, (p_size > 25) DESC, p_name, p_partkey) AS place
FROM part QUALIFY place <= 25""")
def work_queue(t):
    """Symbols waiting for a summary: public ones first, then entry points, then by name."""
    order = [F.desc(F.contains("p_type", F.lit("STEEL"))), F.desc(F.col("p_size") > 25), F.asc("p_name"), F.asc("p_partkey")]
    return search.ranked(search.top(t.part, 25, *order), *order).select("p_partkey", "p_type", "p_size", F.col("rank").cast("long").alias("place"))


@query("""SELECT doc_id AS id FROM documents WHERE starts_with(source, 'src1')""")
def facts_by_topic(t):
    """Facts whose key begins with a topic, however it is written."""
    facts = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("work_"), "source").alias("main_content"))
    return search.facts_of(facts, " Work src1").select("id")


@query("""WITH b AS (SELECT item_id, list_transform(range(0, 64), lambda i: len(list_filter(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w != ''), lambda w: ascii(w) % 64 = i))::DOUBLE) AS v FROM benchmark),
q AS (SELECT v FROM b WHERE item_id = (SELECT min(item_id) FROM benchmark))
SELECT item_id AS id, round(list_cosine_similarity(b.v, q.v), 6) AS score FROM b, q ORDER BY list_cosine_similarity(b.v, q.v) DESC, item_id LIMIT 5""")
def text_search(t):
    """Search by the text of an item, with an embedding by the words' first letters."""
    rows = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("content"))

    def embed(text):
        first = F.transform(search.terms(F.lower(text)), lambda w: F.pmod(F.ascii(w), F.lit(64)))
        return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter(first, lambda p: p == i)).cast("float"))

    query_text = rows.orderBy("id").head()["content"]
    return search.search_by_text(rows, query_text, 5, embed=embed).select("id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT 'snippet' AS domain, doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5), u AS (SELECT 'summary' AS domain, item_id AS id, length(text) AS n FROM benchmark ORDER BY n DESC, id LIMIT 15)
SELECT domain, CAST(id AS VARCHAR) AS id, 0 AS lane FROM s UNION ALL SELECT domain, CAST(id AS VARCHAR), 1 FROM u""")
def lanes_of_an_answer(t):
    """Each lane gets its own number of records, whatever was asked for."""
    from ..operators import evidence as E

    snippets = search.top(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("content"), F.col("lang").alias("language"), F.lit("").alias("code_snippet"), F.col("n_chars").alias("score")), E.LANES["snippet"], F.desc("score"), F.asc("id"))
    summaries = search.top(t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("content"), F.length("text").alias("score")), E.LANES["summary"], F.desc("score"), F.asc("id"))
    return E.answer(E.snippets(snippets), E.summaries(summaries)).select("domain", "id", "lane")


@query("SELECT CAST(n AS BIGINT) AS n, label FROM (SELECT count(*) AS n, 3 AS label FROM embeddings WHERE label = 3 UNION ALL SELECT count(*), NULL FROM embeddings UNION ALL SELECT 0, 1000)")
def namespace_count(t):
    """Vectors of one namespace, of all, and of an unknown one."""
    parts = [search.count_in(t.embeddings, x, "label").withColumn("label", F.lit(x).cast("int")) for x in (3, None, 1000)]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 4) q
WHERE e.label != 2 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 15""")
def knn_pruned(t):
    """Exact nearest vectors out of an index of clusters, of which those too far away aren't read; filtered before the ranking."""
    from ..operators import vector_index as V
    from ..workspace import Workspace

    query = _vector(t, 4)
    index = V.build(t.embeddings, Workspace(t.spark, "vector-index").at, len(query), "vec_id")
    return index.nearest(query, 15, where=F.col("label") != 2).select("id", F.round("score", 6).alias("score"))
