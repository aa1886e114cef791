"""The driver's tables as the model's relations, in Spark and as SQL. Both say the same, so every query can be held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.keyword_index import Index
from ..operators.vector_index import VectorIndex
from ..sources import shared

AS_OF = "2024-01-31 00:00:00"
JOBS_AS_OF = "2001-08-02 00:00:00"
KIND_LIST = ("document", "code", "image", "email")
PAIRS_BROADCAST = 500_000  # pairs of a document and an item that may be broadcast


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, KIND_LIST)), (F.col("doc_id") % 4 + 1).cast("int"))
    created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    gone = F.when(F.col("doc_id") % 17 == 0, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return base.select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").alias("file_id"), F.substring("source", 4, 10).cast("long").alias("tenant_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        kind.alias("kind"), F.lit(1).alias("page_no"), F.octet_length("text").cast("long").alias("size_bytes"), F.sha2("text", 256).alias("sha256"), created.alias("created_at"), gone.alias("superseded_at"), "lang", "text",
    )


DOCUMENTS = """docs AS (
    SELECT doc_id AS document_id, doc_id AS file_id, CAST(substr(source, 4) AS BIGINT) AS tenant_id, split_part(text, chr(10), 1) AS title,
           ['document', 'code', 'image', 'email'][doc_id % 4 + 1] AS kind, 1 AS page_no, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256,
           TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-30' END AS superseded_at, lang, text
    FROM documents
)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents. The first five of a document have the ids of its vectors, so that both arms can find the same chunk."""
    docs = documents(spark, d)
    split = chunking.chunk(docs.select("document_id", "file_id", "page_no", "text"))
    chunk_id = F.when(F.col("idx") < 5, F.col("document_id") * 5 + F.col("idx")).otherwise(F.lit(1_000_000_000_000).cast("long") + F.col("document_id") * 1_000_000 + F.col("idx"))
    return split.withColumn("chunk_id", chunk_id)


_BUILT: dict[tuple[str, str, str], str] = {}  # index folders that this session has written, by what they were made from


def _mark(spark: SparkSession, path: str) -> str:
    """What a table consists of now: names, lengths and times of its files."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = fs.listFiles(there, True), []
    while found.hasNext():
        file = found.next()
        files.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return str(sorted(files))


def _folder(spark: SparkSession, d: str, table: str, kind: str) -> tuple[str, bool]:
    """The folder of an index over a table as it is now, and whether it must be written first. It goes when the session ends."""
    place = (spark.sparkContext.applicationId, kind, _mark(spark, f"{d}/{table}.parquet"))
    if fresh := place not in _BUILT:
        _BUILT[place] = f"{shared.folder(spark)}/{kind}-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_BUILT[place])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _BUILT[place], fresh


def write_keyword_index(spark: SparkSession, d: str) -> Index:
    """A new keyword index of all chunks."""
    index = Index(spark, f"{shared.folder(spark)}/keywords-{uuid.uuid4().hex}")
    index.update(chunks(spark, d))
    return index


def keyword_index(spark: SparkSession, d: str) -> Index:
    """The keyword index of all chunks. The first search writes it, later ones read it until the table changes."""
    folder, fresh = _folder(spark, d, "documents", "keywords")
    index = Index(spark, folder)
    if fresh or not index.store.version()["number"]:
        index.update(chunks(spark, d))
    return index


def vector_index(spark: SparkSession, d: str) -> VectorIndex:
    """The vector index of all vectors, written by the first search."""
    folder, fresh = _folder(spark, d, "embeddings", "vectors")
    index = VectorIndex(spark, folder)
    if fresh or not index.store.version()["number"]:
        index.build(vectors(spark, d))
    return index


_CONT = "substr(hx, 2 * CAST({p} AS INTEGER) + 1, 1) IN ('8', '9', 'A', 'B')"


def _forward(p: str) -> str:
    c = [_CONT.format(p=f"({p} + {i})") for i in range(3)]
    return f"({p} + CASE WHEN NOT {c[0]} THEN 0 WHEN NOT {c[1]} THEN 1 WHEN NOT {c[2]} THEN 2 ELSE 3 END)"


def _back(p: str) -> str:
    c = [_CONT.format(p=f"({p} - {i})") for i in range(3)]
    return f"({p} - CASE WHEN {p} >= n THEN 0 WHEN NOT {c[0]} THEN 0 WHEN NOT {c[1]} THEN 1 WHEN NOT {c[2]} THEN 2 ELSE 3 END)"


CHUNKS = f"""{DOCUMENTS}, spelled AS (
    SELECT document_id, hex(encode(text)) AS hx, CAST(strlen(text) AS BIGINT) AS n FROM docs
), walked AS (
    SELECT document_id, hx, n, 0 AS idx, CAST(0 AS BIGINT) AS start FROM spelled WHERE n > 0
    UNION ALL
    SELECT document_id, hx, n, idx + 1, {_forward("(start + 1984)")} FROM walked WHERE start + 1984 < n AND {_forward("(start + 1984)")} < n
), chunks AS (
    SELECT document_id, document_id AS file_id, 1 AS page_no, idx, start,
           decode(unhex(substr(hx, CAST(2 * start + 1 AS INTEGER), CAST(2 * ({_back("least(start + 2048, n)")} - start) AS INTEGER)))) AS content,
           CASE WHEN idx < 5 THEN document_id * 5 + idx ELSE 1000000000000 + document_id * 1000000 + idx END AS chunk_id
    FROM walked
)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("document_id"), "embedding", "label")


VECTORS = "vectors AS (SELECT vec_id AS chunk_id, vec_id // 5 AS document_id, embedding, label FROM embeddings)"


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of vector searches: every hundredth vector."""
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


QUERY_VECTORS = "query_vectors AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of keyword searches: the first eight words of every hundredth document."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), 1, 8)
    return read(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("text"))


TEXT_QUERIES = r"""text_queries AS (
    SELECT doc_id AS query_id, array_to_string(list_slice(regexp_extract_all(text, '[\p{L}\p{N}]+'), 1, 8), ' ') AS text
    FROM documents WHERE doc_id % 100 = 0
)"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def expected(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, expected_ids): the documents that hold a benchmark item word for word.

    Words inside an item, all but its first and last, stand whole in any text that holds it, so four of them in a row find the candidates in an equi-join. Items of
    fewer than six words are compared with every text. Candidates are counted before they meet the texts, which few of them don't move.
    """
    docs = read(spark, d, "documents").select("doc_id", "text")
    asked = items(spark, d).withColumnRenamed("text", "passage").withColumn("words", _words("passage"))
    anchors = asked.where(F.size("words") >= 6).select("query_id", F.xxhash64(F.slice("words", 2, 4)).alias("anchor"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - 3), lambda i: F.xxhash64(F.slice("words", i, 4)))
    places = docs.select("doc_id", _words("text").alias("words")).where(F.size("words") >= 4).select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor"))
    pairs = shared.cut(places.join(anchors, "anchor").select("doc_id", "query_id").distinct())
    held = docs.join(F.broadcast(pairs) if pairs.count() <= PAIRS_BROADCAST else pairs, "doc_id").join(asked.select("query_id", "passage"), "query_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = docs.join(asked.where(F.size("words") < 6), F.contains("text", "passage")).select("query_id", "doc_id")
    return held.unionByName(short).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected_ids"))


def _words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


EXPECTED = "expected AS (SELECT item_id AS query_id, list(DISTINCT doc_id) AS expected_ids FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id)"


def tag_names(spark: SparkSession, d: str) -> DataFrame:
    """Tags: languages, sources, and lengths; (tag_id, tenant_id, name)."""
    return document_tag_names(spark, d).select("name").distinct().select(F.xxhash64("name").alias("tag_id"), "name")


def document_tag_names(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return docs.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.col("lang"), F.concat(F.lit("source "), F.col("source")), size)).alias("name"), F.when(F.col("doc_id") % 3 == 0, "user").otherwise("llm").alias("source"), (F.col("doc_id") % 3 == 0).alias("locked"))


DOCUMENT_TAGS = """doc_tags AS (
    SELECT doc_id AS document_id, unnest([lang, 'source ' || source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS name,
           CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'llm' END AS source, doc_id % 3 = 0 AS locked
    FROM documents
)"""


def usage_events(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    role = F.create_map(*[F.lit(x) for pair in (("view", "embed"), ("click", "rerank"), ("purchase", "text"), ("signup", "vision"), ("error", "code")) for x in pair])
    prompt, completion = F.get_json_object("props", "$.k").cast("long"), F.floor("value").cast("long")
    return e.select(
        "event_id", (F.col("user_id") % 20).alias("tenant_id"), F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"), role[F.col("event_type")].alias("role"),
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), F.when(F.col("event_type") != "view", prompt * 3 + completion * 15).alias("cost_micros"), F.col("ts").alias("created_at"), F.col("value"),
    )


USAGE = """usage AS (
    SELECT event_id, user_id % 20 AS tenant_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
           CASE event_type WHEN 'view' THEN 'embed' WHEN 'click' THEN 'rerank' WHEN 'purchase' THEN 'text' WHEN 'signup' THEN 'vision' WHEN 'error' THEN 'code' END AS role,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
           CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 + CAST(floor(value) AS BIGINT) * 15 END AS cost_micros, ts AS created_at, value
    FROM events
)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id").distinct().where("user_id % 7 != 0")
    return e.select((F.col("user_id") % 20).alias("tenant_id"), "user_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"))


USERS = "users AS (SELECT DISTINCT user_id % 20 AS tenant_id, user_id, 'user' || user_id || '@example.com' AS email FROM events WHERE user_id % 7 <> 0)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 5 == 0, "running").otherwise("done")).when(F.col("o_orderstatus") == "O", "queued").otherwise(F.when(F.col("o_orderkey") % 6 == 5, "dead").otherwise("failed"))
    attempts = (F.col("o_orderkey") % 6).cast("int")
    kind = F.element_at(F.array(F.lit("ingest"), F.lit("reembed"), F.lit("export")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 20).alias("tenant_id"), (F.col("o_orderkey") % 1000).alias("document_id"), kind.alias("kind"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        status.alias("status"), attempts.alias("attempts"), (F.col("o_orderdate") + F.make_dt_interval(hours=attempts)).alias("run_after"),
        F.when(status == "running", F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).alias("lease_expires_at"),
        F.when(status == "running", F.concat(F.lit("worker:"), (F.col("o_orderkey") % 4).cast("string"))).alias("locked_by"), F.col("o_orderdate").alias("created_at"),
    )


JOBS = """jobs AS (
    SELECT o_orderkey AS job_id, o_custkey % 20 AS tenant_id, o_orderkey % 1000 AS document_id, ['ingest', 'reembed', 'export'][o_orderkey % 3 + 1] AS kind,
           6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
           CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'running' ELSE 'done' END WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey % 6 = 5 THEN 'dead' ELSE 'failed' END END AS status,
           CAST(o_orderkey % 6 AS INTEGER) AS attempts, o_orderdate + to_hours(CAST(o_orderkey % 6 AS INTEGER)) AS run_after,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 1 DAY END AS lease_expires_at,
           CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'worker:' || o_orderkey % 4 END AS locked_by, o_orderdate AS created_at
    FROM orders
)"""


def tenants(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("tenant_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3).alias("plan_id"), F.when(F.col("c_custkey") % 10 == 0, F.lit(5000).cast("long")).alias("quota_override"), F.floor(F.abs("c_acctbal")).cast("long").alias("budget_cents"))


TENANTS = """tenants AS (
    SELECT c_custkey AS tenant_id, c_name AS name, c_custkey % 3 AS plan_id, CASE WHEN c_custkey % 10 = 0 THEN 5000 END AS quota_override, CAST(floor(abs(c_acctbal)) AS BIGINT) AS budget_cents
    FROM customer
)"""


def plans(spark: SparkSession) -> DataFrame:
    """The three plans."""
    return spark.createDataFrame([(0, "free", 10_000, 0), (1, "pro", 500_000, 900), (2, "team", 2_000_000, 2900)], "plan_id long, code string, quota long, price_cents long")


PLANS = "plans(plan_id, code, quota, price_cents) AS (VALUES (0, 'free', 10000, 0), (1, 'pro', 500000, 900), (2, 'team', 2000000, 2900))"


def tag_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(names, tags): vectors of ids divisible by 5 are tags, the others names to be matched, in four tenants."""
    e = read(spark, d, "embeddings").select((F.col("label") % 4).cast("long").alias("tenant_id"), F.col("vec_id").alias("id"), F.concat(F.lit("tag "), F.col("vec_id").cast("string")).alias("name"), "embedding")
    return e.where("id % 5 != 0").withColumnRenamed("id", "name_id"), e.where("id % 5 = 0").withColumnRenamed("id", "tag_id")


