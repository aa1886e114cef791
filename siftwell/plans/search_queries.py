"""Retrieval queries over the documents' chunks and the vectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, search
from . import fixtures as fx
from .registry import query

TOP = 10
SEEN = search.overscan(TOP)
WORDS = r"'[\p{L}\p{N}]+'"


def _bm25(queries: str, chunks: str = "chunks") -> str:
    """CTEs that end in bm25 (query_id, document_id, chunk_id, score, rank)."""
    return rf"""asked AS (
        SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[''"]', ' ', 'g')), {WORDS}))) AS term FROM {queries}
    ), bag AS (SELECT document_id, chunk_id, regexp_extract_all(lower(content), {WORDS}) AS words FROM {chunks}),
    stat AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM bag),
    tf AS (
        SELECT term, document_id, chunk_id, dl, count(*) AS tf FROM (SELECT document_id, chunk_id, len(words) AS dl, unnest(words) AS term FROM bag)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    scored AS (
        SELECT query_id, document_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
        FROM asked JOIN tf USING (term) JOIN df USING (term), stat GROUP BY ALL
    ), bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)"""


def _vec(vectors: str = "vectors") -> str:
    return f"""vec AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
        FROM (SELECT q.query_id, v.document_id, v.chunk_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM {vectors} v, query_vectors q)
    )"""


def _per_document(source: str, name: str) -> str:
    return f"""{name} AS (
        SELECT * FROM (
            SELECT query_id, document_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS nth FROM {source} WHERE rank <= {SEEN}) WHERE nth = 1
        ) WHERE rank <= {TOP}
    )"""


FUSED = """fused AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank
        FROM (SELECT query_id, document_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM best_vec UNION ALL SELECT * FROM best_bm25) GROUP BY ALL)
    )"""


def _rolled(source: str) -> str:
    return f"""rolled AS (
        SELECT * FROM (
            SELECT query_id, document_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, document_id) AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(score, 12) DESC, rank) AS nth FROM {source}) WHERE nth = 1
        ) WHERE rank <= {TOP}
    )"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(ctes) + " " + body


HYBRID = (fx.VECTORS, fx.QUERY_VECTORS, fx.TEXT_QUERIES, _bm25("text_queries"), _vec(), _per_document("vec", "best_vec"), _per_document("bm25", "best_bm25"), FUSED, _rolled("fused"))
RANKED = "SELECT query_id, document_id, chunk_id, round(score, 6) AS score, rank FROM "


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "document_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _both(spark: SparkSession, d: str) -> DataFrame:
    """Queries with text and vector: every hundredth document's words and the vector of the same number; either may be missing."""
    return fx.text_queries(spark, d).join(fx.query_vectors(spark, d), "query_id", "full_outer")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    asked = _both(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return search.hybrid(fx.keyword_index(spark, d), fx.vectors(spark, d), asked, TOP)


@query(_sql(RANKED + f"bm25 WHERE rank <= {TOP}", fx.CHUNKS, fx.TEXT_QUERIES, _bm25("text_queries")))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.bm25(fx.keyword_index(spark, d), fx.text_queries(spark, d), TOP))


@query(_sql("SELECT count(*) AS chunks, CAST(sum(len(words)) AS BIGINT) AS words, (SELECT count(DISTINCT term) FROM (SELECT unnest(words) AS term FROM bag)) AS terms FROM bag", fx.CHUNKS, f"bag AS (SELECT regexp_extract_all(lower(content), {WORDS}) AS words FROM chunks)"))
def write_keyword_index(spark: SparkSession, d: str) -> DataFrame:
    """Writes a keyword index of all chunks and counts what is in it."""
    t = fx.write_keyword_index(spark, d).store.begin()
    whole = t.read("stats").agg(F.sum("n").alias("chunks"), F.sum("words").alias("words"))
    return whole.crossJoin(t.read("blocks").agg(F.count_distinct("term").alias("terms")))


CHANGED = """kept AS (SELECT document_id, chunk_id, CASE WHEN document_id % 5 = 1 THEN content || ' the and' ELSE content END AS content FROM chunks WHERE document_id % 7 <> 0)"""


@query(_sql(RANKED + f"bm25 WHERE rank <= {TOP}", fx.CHUNKS, CHANGED, fx.TEXT_QUERIES, _bm25("text_queries", "kept")))
def keyword_index_upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Searches an index after a seventh of the documents was removed and a fifth was written anew."""
    index, chunks = fx.write_keyword_index(spark, d), fx.chunks(spark, d)
    index.update(chunks.where("document_id % 5 = 1").withColumn("content", F.concat("content", F.lit(" the and"))))
    index.update(remove=chunks.where("document_id % 7 = 0").select("chunk_id"))
    return _ranked(index.search(fx.text_queries(spark, d), TOP))


@query(_sql(RANKED + f"vec WHERE rank <= {TOP}", fx.VECTORS, fx.QUERY_VECTORS, _vec()))
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.vector_arm(fx.vectors(spark, d), fx.query_vectors(spark, d), TOP))


@query()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """Approximate search: the cells nearest to each query, candidates by their codes, exact scores."""
    return _ranked(fx.vector_index(spark, d).search(fx.query_vectors(spark, d), TOP))


@query(_sql(RANKED + f"vec WHERE rank <= {TOP}", fx.VECTORS, fx.QUERY_VECTORS, _vec()))
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same search through all cells and with every row as a candidate: nothing is lost by the index itself."""
    index = fx.vector_index(spark, d)
    return _ranked(index.search(fx.query_vectors(spark, d), TOP, probes=1 << 30, depth=1 << 30))


@query(_sql(f"SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS enough FROM vec WHERE rank <= {TOP}", fx.VECTORS, fx.QUERY_VECTORS, _vec()))
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search finds nine tenths of the exact neighbours of all queries."""
    exact = search.vector_arm(fx.vectors(spark, d), fx.query_vectors(spark, d), TOP).select("query_id", "chunk_id")
    found = fx.vector_index(spark, d).search(fx.query_vectors(spark, d), TOP).select("query_id", "chunk_id", F.lit(True).alias("hit"))
    told = exact.join(found, ["query_id", "chunk_id"], "left")
    return told.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(_sql(RANKED + "best_vec", fx.VECTORS, fx.QUERY_VECTORS, _vec(), _per_document("vec", "best_vec")))
def best_chunk_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.one_per_document(search.vector_arm(fx.vectors(spark, d), fx.query_vectors(spark, d), SEEN), TOP))


@query(_sql(RANKED + "rolled", fx.CHUNKS, fx.TEXT_QUERIES, _bm25("text_queries"), _per_document("bm25", "best_bm25"), "fused AS (SELECT query_id, document_id, chunk_id, 1.0::DOUBLE / rank AS score, rank FROM best_bm25)", _rolled("fused")))
def keyword_degrade(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.keyword_only(fx.keyword_index(spark, d), fx.text_queries(spark, d), TOP))


@query(_sql(RANKED + "fused", fx.CHUNKS, *HYBRID[:-1]))
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    left = search.one_per_document(search.vector_arm(fx.vectors(spark, d), fx.query_vectors(spark, d), SEEN), TOP)
    right = search.one_per_document(search.bm25(fx.keyword_index(spark, d), fx.text_queries(spark, d), SEEN), TOP)
    return _ranked(search.rrf(left, right))


@query(_sql("SELECT query_id, document_id, chunk_id, round(score, 6) AS score, rank, 'hybrid' AS mode FROM rolled", fx.CHUNKS, *HYBRID))
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: both arms over all chunks, fused, rolled up to documents."""
    hits = _hits(spark, d)
    return hits.withColumn("score", F.round("score", 6))


FILTERED = """picked AS (
        SELECT document_id FROM docs WHERE kind IN ('document', 'code') AND created_at >= TIMESTAMP '2024-01-01 01:00:00' AND created_at <= TIMESTAMP '2024-01-20' AND superseded_at IS NULL
        AND document_id IN (SELECT document_id FROM doc_tags WHERE name IN ('en', 'long') GROUP BY document_id HAVING count(DISTINCT name) = 2)
    ), some_chunks AS (SELECT * FROM chunks SEMI JOIN picked USING (document_id)), some_vectors AS (SELECT * FROM vectors SEMI JOIN picked USING (document_id))"""


@query(_sql(RANKED + "rolled", fx.CHUNKS, fx.DOCUMENT_TAGS, fx.VECTORS, FILTERED, fx.QUERY_VECTORS, fx.TEXT_QUERIES, _bm25("text_queries", "some_chunks"), _vec("some_vectors"), _per_document("vec", "best_vec"), _per_document("bm25", "best_bm25"), FUSED, _rolled("fused")))
def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Kind, date, live rows and all of two tags, below the ranking; the unknown tag name is dropped."""
    docs = search.live(search.filter_documents(fx.documents(spark, d), ["document", "code"], "2024-01-01 01:00:00", "2024-01-20 00:00:00"))
    tags = fx.tag_names(spark, d)
    tagged = fx.document_tag_names(spark, d).join(tags, "name")
    picked = search.with_all_tags(docs, tagged, tags, ["en", "long", "no such tag"])
    asked = _both(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    return _ranked(search.hybrid(search.only_documents(fx.keyword_index(spark, d).postings(), picked), search.only_documents(fx.vectors(spark, d), picked), asked, TOP))


RERANKED = f"""told AS (
        SELECT r.query_id, r.document_id, r.chunk_id, r.score, r.rank AS was, list_distinct(regexp_extract_all(lower(substr(q.text, 1, 512)), {WORDS})) AS a,
               regexp_extract_all(lower(substr(d.text, 1, 4096)), {WORDS}) AS b
        FROM rolled r JOIN docs d USING (document_id) JOIN text_queries q USING (query_id)
    ), blended AS (
        SELECT query_id, document_id, chunk_id, was, 0.2 * coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0)
               + 0.8 * CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS score FROM told
    ), reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, was) AS rank FROM blended)"""


@query(_sql(RANKED + "reranked WHERE rank <= 5", fx.CHUNKS, *HYBRID, RERANKED))
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.rerank(_hits(spark, d), fx.text_queries(spark, d), fx.documents(spark, d), 5))


@query()
def rag_sources(spark: SparkSession, d: str) -> DataFrame:
    """Numbered source lines of the best hits of every query."""
    return search.sources(_hits(spark, d), fx.documents(spark, d))


EVAL = ("items AS (SELECT item_id AS query_id, text FROM benchmark)", fx.EXPECTED, _bm25("items"), _per_document("bm25", "best_bm25"))
SCORES = """scores AS (
        SELECT e.query_id, (SELECT count(*) FROM best_bm25 b WHERE b.query_id = e.query_id AND b.rank <= 1 AND list_contains(e.expected_ids, b.document_id)) / len(e.expected_ids) AS recall_at_1,
               (SELECT count(*) FROM best_bm25 b WHERE b.query_id = e.query_id AND b.rank <= 3 AND list_contains(e.expected_ids, b.document_id)) / len(e.expected_ids) AS recall_at_3,
               (SELECT count(*) FROM best_bm25 b WHERE b.query_id = e.query_id AND b.rank <= 5 AND list_contains(e.expected_ids, b.document_id)) / len(e.expected_ids) AS recall_at_5,
               coalesce((SELECT 1.0::DOUBLE / min(rank) FROM best_bm25 b WHERE b.query_id = e.query_id AND list_contains(e.expected_ids, b.document_id)), 0) AS rr
        FROM expected e
    )"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    hits = search.one_per_document(search.bm25(fx.keyword_index(spark, d), fx.items(spark, d), SEEN), TOP)
    return evaluation.per_query(fx.expected(spark, d), hits)


@query(_sql("SELECT query_id, round(recall_at_1, 6) AS recall_at_1, round(recall_at_3, 6) AS recall_at_3, round(recall_at_5, 6) AS recall_at_5, round(rr, 6) AS rr FROM scores", fx.CHUNKS, *EVAL, SCORES))
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    found = _scores(spark, d)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in found.columns if c != "query_id"])


@query(_sql("SELECT round(coalesce(avg(recall_at_1), 1), 6) AS recall_at_1, round(coalesce(avg(recall_at_3), 1), 6) AS recall_at_3, round(coalesce(avg(recall_at_5), 1), 6) AS recall_at_5, round(coalesce(avg(rr), 1), 6) AS mrr FROM scores", fx.CHUNKS, *EVAL, SCORES))
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.summary(_scores(spark, d))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(_sql("SELECT metric, round(value, 6) AS value, baseline FROM (SELECT unnest(['recall_at_1', 'mrr']) AS metric, unnest([avg(recall_at_1), avg(rr)]) AS value, unnest([0.99::DOUBLE, 0.1::DOUBLE]) AS baseline FROM scores) WHERE value < baseline - 0.001", fx.CHUNKS, *EVAL, SCORES))
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    found = evaluation.regressions(evaluation.summary(_scores(spark, d)), {"recall_at_1": 0.99, "mrr": 0.1})
    return found.withColumn("value", F.round("value", 6))


@query(r"""
    WITH t AS (SELECT doc_id, replace(replace(replace(replace(substr(text, 1, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents)
    SELECT doc_id AS document_id, regexp_replace(escaped, '(?i)(the|data|des|und)', '<mark>\1</mark>', 'g') AS snippet FROM t
""")
def highlight_snippet(spark: SparkSession, d: str) -> DataFrame:
    snippet = tx.highlight(F.substring("text", 1, 300), F.lit(" The data a des und "))
    return fx.documents(spark, d).select("document_id", snippet.alias("snippet"))
