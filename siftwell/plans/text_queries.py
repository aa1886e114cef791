"""Text shaping, extraction and notes over the documents, pages and conversations, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files, markup, notes, tags
from ..functions import text as tx
from ..operators import chat, chunking
from ..sources import fetch
from . import fixtures as fx
from .registry import query

NOTES_AS_OF = "2024-01-31"


def _chunk_sql(body: str) -> str:
    return f"WITH RECURSIVE {fx.CHUNKS} {body}"


@query(_chunk_sql("SELECT chunk_id, document_id, CAST(idx AS INTEGER) AS idx, CAST(start AS INTEGER) AS start, CAST(strlen(content) AS INTEGER) AS bytes, md5(content) AS digest FROM chunks"))
def chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    return fx.chunks(spark, d).select("chunk_id", "document_id", "idx", "start", F.octet_length("content").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query(_chunk_sql("SELECT document_id, CAST(min(idx) AS INTEGER) AS idx FROM chunks GROUP BY document_id, content"))
def chunk_dedup(spark: SparkSession, d: str) -> DataFrame:
    return chunking.drop_identical(fx.chunks(spark, d)).select("document_id", "idx")


@query(_chunk_sql("SELECT tenant_id, count(*) AS chunks, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM chunks JOIN docs USING (document_id) GROUP BY tenant_id"))
def chunk_count_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    owner = fx.documents(spark, d).select("document_id", "tenant_id")
    return fx.chunks(spark, d).join(owner, "document_id").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


@query(_chunk_sql("SELECT document_id, md5(string_agg(content, '' ORDER BY idx)) AS digest, CAST(count(*) AS INTEGER) AS n_chunks FROM chunks JOIN docs USING (document_id) WHERE superseded_at IS NULL GROUP BY document_id"))
def doc_text_reassemble(spark: SparkSession, d: str) -> DataFrame:
    state = fx.documents(spark, d).select("document_id", "superseded_at")
    return chunking.live_text(fx.chunks(spark, d).join(state, "document_id")).select("document_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chunks")


def _html_sql(html: str) -> str:
    out = rf"regexp_replace({html}, '(?s)<\s*/?\s*(?:{'|'.join(markup.BLOCK_TAGS)})(?:\s[^>]*)?>', chr(10), 'g')"
    out = rf"replace(regexp_replace({out}, '(?s)<[^>]*(?:>|\z)', '', 'g'), '>', '')"
    for entity, char in markup.ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, entity, char.replace("'", "''"))
    return rf"regexp_replace(regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g'), '\A\n+', '')"


@query(f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "pages").select("page_id", markup.strip_html(F.col("html")).alias("text"))


@query(r"SELECT doc_id AS document_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}]', '', 'g')) AS digest FROM documents")
def strip_control(spark: SparkSession, d: str) -> DataFrame:
    return fx.documents(spark, d).select("document_id", F.md5(tx.strip_control(F.col("text")).cast("binary")).alias("digest"))


@query(r"""
    WITH h AS (SELECT page_id, url, nullif(lower(regexp_extract(regexp_replace(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1), '^.*@', ''), '^([^:]*)', 1)), '') AS host FROM pages)
    SELECT page_id, host, host IS NULL OR host = 'localhost' OR regexp_matches(host, '\.(local|internal|localhost)$')
           OR regexp_matches(host, '^(0|10|127|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\.[\d.]+$') AS blocked,
           string_split(list_last(string_split(url, '/')), '?')[1] AS filename, 'https://cdn.example' || regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$', 1) AS cdn
    FROM h
""")
def url_host_guard(spark: SparkSession, d: str) -> DataFrame:
    host = files.host_of(F.col("url"))
    return fx.read(spark, d, "pages").select("page_id", host.alias("host"), files.blocked_host(host).alias("blocked"), tx.url_filename(F.col("url")).alias("filename"), files.cdn_url(F.col("url"), "https://cdn.example/").alias("cdn"))


@query(r"""SELECT page_id, nullif(regexp_replace(replace(regexp_extract(url || '../ a..b.txt ', '([^/\\]*)$', 1), '..', ''), '^\s+|\s+$', '', 'g'), '') AS name FROM pages""")
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return fx.read(spark, d, "pages").select("page_id", tx.sanitize_filename(F.concat("url", F.lit("../ a..b.txt "))).alias("name"))


MIMES = ("text/plain", "image/png", "audio/ogg", "video/mp4", "application/zip", "application/pdf", "application/vnd.ms-excel", "application/x-odd", "application/json")
KIND_SQL = """CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN mime LIKE 'audio/%' THEN 'audio' WHEN mime LIKE 'video/%' THEN 'video' WHEN mime = 'application/zip' THEN 'archive'
              WHEN mime LIKE 'text/%' OR mime IN ('application/pdf', 'application/json') OR mime LIKE 'application/vnd.ms-%' THEN 'document' ELSE 'binary' END"""
MIME_SQL = f"m AS (SELECT doc_id, source, {list(MIMES)!r}[doc_id % {len(MIMES)} + 1] AS mime FROM documents)"


def _mime(d: str, spark: SparkSession) -> DataFrame:
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.col("doc_id") % len(MIMES) + 1).cast("int"))
    return fx.read(spark, d, "documents").select("doc_id", "source", mime.alias("mime"))


@query(f"WITH {MIME_SQL} SELECT doc_id AS document_id, mime, {KIND_SQL} AS kind, CASE WHEN mime LIKE 'text/%' OR mime = 'application/json' THEN 'native' ELSE 'office' END AS route FROM m")
def mime_kind(spark: SparkSession, d: str) -> DataFrame:
    return _mime(d, spark).select(F.col("doc_id").alias("document_id"), "mime", files.kind_of(F.col("mime")).alias("kind"), files.route(F.col("mime")).alias("route"))


@query(f"WITH {MIME_SQL}, k AS (SELECT source, doc_id % 7 AS part, {KIND_SQL} AS kind FROM m) SELECT source, part, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'document' END AS kind FROM k GROUP BY source, part")
def dominant_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = _mime(d, spark).select("source", (F.col("doc_id") % 7).alias("part"), files.kind_of(F.col("mime")).alias("kind"))
    return rows.groupBy("source", "part").agg(files.dominant_kind(F.col("kind")).alias("kind"))


@query(r"""SELECT doc_id AS document_id, CASE WHEN contains(source || '/' || doc_id, '7/') THEN 'size' WHEN doc_id % 5 = 0 THEN 'denied' WHEN doc_id % 3 = 0 THEN 'type' END AS reason FROM documents""")
def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    mime = F.when(F.col("doc_id") % 5 == 0, "application/x-executable").when(F.col("doc_id") % 3 == 0, "application/x-odd").otherwise("text/x-python")
    size = F.when(path.contains("7/"), 100).otherwise(1)
    return fx.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), files.reject_reason(path, mime, size, 10, ["text/plain"], ["application/x-executable"]).alias("reason"))


@query(r"""SELECT doc_id AS document_id, len(regexp_extract_all(text, '[ -~]{4,}'))::INTEGER AS runs, length(array_to_string(regexp_extract_all(text, '[ -~]{4,}'), ''))::INTEGER AS bytes FROM documents""")
def printable_strings(spark: SparkSession, d: str) -> DataFrame:
    runs = markup.printable_strings(F.col("text").cast("binary"))
    return fx.documents(spark, d).select("document_id", F.size(runs).alias("runs"), F.length(F.array_join(runs, "")).alias("bytes"))


def _stem_sql() -> str:
    bytes_of = "strlen({})"
    cases = [f"WHEN {bytes_of.format('w')} < 4 THEN w"]
    for s in tags.SUFFIXES:
        rest = f"left(w, length(w) - {len(s)})"
        doubled = f"length({rest}) >= 4 AND strlen({rest}) - 1 >= 3 AND right({rest}, 1) = substr({rest}, length({rest}) - 1, 1) AND right({rest}, 1) NOT IN ('s', 'l')"
        cases.append(f"WHEN ends_with(w, '{s}') AND strlen(w) > {len(s) + 1} AND strlen({rest}) >= 3 THEN CASE WHEN {doubled} THEN left({rest}, length({rest}) - 1) ELSE {rest} END")
    cases.append("WHEN ends_with(w, 's') AND NOT regexp_matches(w, '(ss|us|is)$') AND strlen(w) - 1 >= 3 THEN left(w, length(w) - 1)")
    return "CASE " + " ".join(cases) + " ELSE w END"


@query(rf"""
    WITH names AS (SELECT DISTINCT p_name || '_running/Boxes.' || p_type AS name FROM part UNION SELECT DISTINCT left(regexp_replace(text, '\s+', '-', 'g'), 60) FROM documents),
    words AS (SELECT name, unnest(string_split(translate(lower(name), '-_/.', '    '), ' ')) AS w, generate_subscripts(string_split(translate(lower(name), '-_/.', '    '), ' '), 1) AS place FROM names)
    SELECT name, coalesce(string_agg({_stem_sql()}, ' ' ORDER BY place) FILTER (WHERE w <> ''), '') AS tag FROM words GROUP BY name
""")
def normalize_tag(spark: SparkSession, d: str) -> DataFrame:
    parts = fx.read(spark, d, "part").select(F.concat("p_name", F.lit("_running/Boxes."), "p_type").alias("name"))
    heads = fx.read(spark, d, "documents").select(F.left(F.regexp_replace("text", r"[ \t\n\f\r]+", "-"), F.lit(60)).alias("name"))
    return parts.union(heads).distinct().where("name is not null").select("name", tags.normalize(F.col("name")).alias("tag"))


@query(r"""
    WITH t AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^A-Za-z0-9 \t\n\f\r]', '', 'g')) AS prose, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS plain FROM documents)
    SELECT doc_id AS document_id, CAST(prose * 250 + (plain - prose) * 1000 + (n - plain) * 2000 AS BIGINT) AS milli, CAST(ceil(n / 4) AS BIGINT) AS rough FROM t
""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return fx.documents(spark, d).select("document_id", tx.token_cost_milli(F.col("text")).alias("milli"), tx.rough_tokens(F.col("text")).alias("rough"))


@query(r"""
    WITH t AS (SELECT doc_id, length(left(text, 4096)) AS n, length(regexp_replace(left(text, 4096), '[^A-Za-z0-9 \t\n\f\r]', '', 'g')) AS prose FROM documents),
    s AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.5 WHEN prose / n >= 0.85 THEN 0.8 ELSE 0.5 END AS factor FROM t)
    SELECT doc_id AS document_id, CAST(factor AS DOUBLE) AS factor, CAST(greatest(0, floor(8192 * factor) - 3300) AS BIGINT) AS text_budget, CAST(1500 AS BIGINT) AS note_budget FROM s
""")
def token_budgets(spark: SparkSession, d: str) -> DataFrame:
    budget = tx.token_budgets(F.col("text"), F.lit(8192))
    return fx.documents(spark, d).select("document_id", tx.safety_factor(F.col("text")).alias("factor"), budget["text_budget"].cast("long").alias("text_budget"), budget["note_budget"].alias("note_budget"))


@query()
def truncate_budget(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes within 200 tokens, bounded heads and tails, and texts shrunk for a retry, by length."""
    text = F.col("text")
    return fx.documents(spark, d).select("document_id", F.length(tx.truncate_tokens(text, 200)).alias("prefix"), F.length(tx.bound_text(text, 200)).alias("bounded"), F.length(tx.shrink_for_context(text, 1)).alias("shrunk"))


@query()
def markup_text(spark: SparkSession, d: str) -> DataFrame:
    """Every document read as Markdown and as CSV."""
    return fx.documents(spark, d).select("document_id", markup.strip_markdown(F.col("text")).alias("markdown"), markup.csv_to_text(F.col("text")).alias("csv"))


@query(r"SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role IN ('user', 'assistant')) WHERE nth <= 3")
def recent_messages(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_messages(fx.read(spark, d, "conversations"), 3)


@query(r"""
    SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations WHERE role IN ('user', 'assistant')) WHERE nth <= 3 GROUP BY conv_id
""")
def chat_context(spark: SparkSession, d: str) -> DataFrame:
    return chat.contexts(fx.read(spark, d, "conversations"), 3)


PHRASES = ("tomorrow", "in 3 days", "friday", "2024-02-10", "March 5", "January 2", "no date")
DUES = ("2024-02-01", "2024-02-03", "2024-02-02", "2024-02-10", "2024-03-05", "2025-01-02", None)


def _phrase() -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(PHRASES))) + 1).cast("int"))


def _due_sql() -> str:
    return "CASE (conv_id + turn) % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(DUES) if v) + " END"


@query(f"""
    SELECT conv_id, turn, CAST(0 AS INTEGER) AS position, 'reminder' AS kind, 'check turn ' || turn AS item, {_due_sql()} AS due FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'task', 'write up ' || role, NULL FROM conversations
    UNION ALL SELECT conv_id, turn, 2, 'decision', 'keep ' || role, NULL FROM conversations
""")
def action_items(spark: SparkSession, d: str) -> DataFrame:
    """What messages announce. The table has no such phrases, so each message is followed by three."""
    said = F.concat(F.lit("Remind me to check turn "), F.col("turn").cast("string"), F.lit(" by "), _phrase(), F.lit("\ntodo: write up "), F.col("role"), F.lit("\nDecided: keep "), F.col("role"))
    return chat.action_items(fx.read(spark, d, "conversations").withColumn("text", said), NOTES_AS_OF)


@query(r"""
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(trim(text)) = 0 THEN 'empty' END, CASE WHEN length(trim(text)) > 0 AND ceil(length(text) / 4) < 30 THEN 'short' END,
           CASE WHEN NOT contains(lower(text), 'remember') THEN 'memory' END], lambda x: x IS NOT NULL), ',') AS issues FROM conversations
""")
def response_checks(spark: SparkSession, d: str) -> DataFrame:
    issues = notes.response_issues(F.lit("Remember what was said about this"), F.col("text"), 30, ("remember",))
    return fx.read(spark, d, "conversations").select("conv_id", "turn", F.array_join(issues, ",").alias("issues"))


@query("""
    SELECT doc_id, path, CASE WHEN list_has_any(string_split(path, '/'), ['de', 'src3']) THEN 'confidential' WHEN contains(path, '/') THEN 'public' ELSE 'internal' END AS class
    FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'note.md' WHEN 1 THEN coalesce(lang, 'xx') || '/note.md' ELSE coalesce(source, 'none') || '/team/note.md' END AS path FROM documents)
""")
def path_class(spark: SparkSession, d: str) -> DataFrame:
    """How confidential the place of each document's file is."""
    at = F.col("doc_id") % 3
    path = F.when(at == 0, "note.md").when(at == 1, F.concat(F.coalesce("lang", F.lit("xx")), F.lit("/note.md"))).otherwise(F.concat(F.coalesce("source", F.lit("none")), F.lit("/team/note.md")))
    return fx.read(spark, d, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", notes.path_class(F.col("path"), ("de", "src3")).alias("class"))


@query(r"""
    WITH t AS (
        SELECT doc_id, split_part(text, chr(10), 1) AS prompt, CAST(floor((400 + doc_id % 5 * 300) * 0.85) AS BIGINT) AS budget,
               list_filter([{'h': '# [USER TASK LIST]' || chr(10), 'b': CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 2000) ELSE '' END}, {'h': '# [RELEVANT PAST CONTEXT]' || chr(10), 'b': text},
                            {'h': '# [THREAD CONTINUITY]' || chr(10), 'b': CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 400) ELSE '' END}], lambda x: x.b <> '') AS s
        FROM documents
    ), w AS (
        SELECT *, '---' || chr(10) || array_to_string(list_transform(s, lambda x: x.h || x.b || chr(10) || chr(10)), '') || '---' || chr(10) || chr(10) || prompt AS whole, (length(prompt) + 5 + 3) // 4 AS own FROM t
    ), p AS (
        SELECT doc_id, CASE WHEN (length(whole) + 3) // 4 <= budget THEN whole WHEN own >= budget THEN prompt
                            ELSE array_to_string(list_transform(s, lambda x: x.h || substr(x.b, 1, CAST((budget - own) * 4 // len(s) AS BIGINT)) || chr(10) || chr(10)), '') || '---' || chr(10) || chr(10) || prompt END AS packed FROM w
    )
    SELECT doc_id AS document_id, length(packed) AS n_chars, md5(packed) AS digest FROM p
""")
def context_packing(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the context of their own first lines, in windows of several sizes."""
    docs, k, text = fx.read(spark, d, "documents"), F.col("doc_id"), F.col("text")
    packed = tx.pack_context(F.split_part("text", F.lit("\n"), F.lit(1)), F.when(k % 3 == 0, F.substring(text, 1, 2000)), F.lit(""), text, F.when(k % 2 == 0, F.substring(text, 1, 400)), 400 + k % 5 * 300)
    return docs.select(k.alias("document_id"), packed.alias("p")).select("document_id", F.length("p").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query(r"""
    WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN replace(url, 'https://', 'ftp://') WHEN 1 THEN replace(url, '://', '://me@') WHEN 2 THEN replace(url, '://', '://10.0.0.1/') WHEN 3 THEN 'http://localhost:80/' || page_id ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i)https?://[^/?#]') THEN 'unsupported_scheme' WHEN contains(regexp_extract(url, '^(?i)https?://([^/?#]*)', 1), '@') THEN 'user_info'
                         WHEN regexp_matches(url, '://(10\.0\.0\.1|localhost)[:/]') THEN 'internal_address' END AS error FROM u
""")
def source_url_check(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose URLs are refused before anything is asked for."""
    k, url = F.col("page_id") % 6, F.col("url")
    told = F.when(k == 0, F.replace(url, F.lit("https://"), F.lit("ftp://"))).when(k == 1, F.replace(url, F.lit("://"), F.lit("://me@"))).when(k == 2, F.replace(url, F.lit("://"), F.lit("://10.0.0.1/"))).when(k == 3, F.concat(F.lit("http://localhost:80/"), F.col("page_id").cast("string"))).otherwise(url)
    return fx.read(spark, d, "pages").select("page_id", fetch.url_error(told).alias("error"))
