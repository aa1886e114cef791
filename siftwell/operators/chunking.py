"""Documents to chunks and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx


def chunk(files: DataFrame, size: int = tx.CHUNK_BYTES, overlap: int = tx.OVERLAP_BYTES) -> DataFrame:
    """files (document_id, file_id, page_no, text) to chunks with idx and content; other columns are dropped. Empty and null texts have none."""
    spread = files.select("document_id", "file_id", "page_no", "text", F.inline(tx.chunk_spans(F.col("text"), size, overlap)))
    return spread.select("document_id", "file_id", "page_no", "idx", "start", F.lit(None).cast("double").alias("ts_offset"), tx.byte_slice(F.col("text"), F.col("start"), F.col("stop")).alias("content"))


def drop_identical(chunks: DataFrame) -> DataFrame:
    """The first of the equal chunks of a file; positions keep their gaps. The least idx of each content is an aggregate, so no chunk text is sorted."""
    first = chunks.groupBy("file_id", F.md5(F.col("content").cast("binary")).alias("digest")).agg(F.min("idx").alias("idx"))
    return chunks.join(first.drop("digest"), ["file_id", "idx"], "left_semi")


def merge_pages(pages: DataFrame) -> DataFrame:
    """(document_id, text) of pages (document_id, page_no, label, text) in page order, each under a header line."""
    head = F.concat(F.lit("--- page "), F.col("page_no").cast("string"), F.coalesce(F.concat(F.lit(" ("), F.col("label"), F.lit(")")), F.lit("")), F.lit(" ---"))
    body = F.when(F.coalesce(F.col("text"), F.lit("")) == "", head).otherwise(F.concat(head, F.lit("\n"), F.col("text")))
    parts = pages.select("document_id", "page_no", body.alias("body")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "body"))).alias("parts"))
    return parts.select("document_id", F.array_join(F.transform("parts", lambda p: p["body"]), "\n\n").alias("text"))


def merge_meta(pages: DataFrame) -> DataFrame:
    """(document_id, meta) as JSON with a page_N object for each page: extracted entries, over which the file's own win."""
    entry = F.struct(F.concat(F.lit("page_"), F.col("page_no").cast("string")).alias("key"), F.map_concat(F.coalesce("extracted", F.create_map().cast("map<string,string>")), F.coalesce("own", F.create_map().cast("map<string,string>"))).alias("value"))
    merged = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_no"), F.to_json(entry["value"]).alias("value"), entry["key"].alias("key")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), p["value"])), ",")
    return merged.select("document_id", F.concat(F.lit("{"), body, F.lit("}")).alias("meta"))


def live_text(chunks: DataFrame) -> DataFrame:
    """(document_id, text, n_chunks) of the chunks that are not superseded, in page and position order; overlaps stay in."""
    live = chunks.where("superseded_at is null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "idx", "content"))).alias("parts"))
    return live.select("document_id", F.array_join(F.transform("parts", lambda p: p["content"]), "").alias("text"), F.size("parts").alias("n_chunks"))


def next_page_numbers(existing: DataFrame, added: DataFrame) -> DataFrame:
    """added (document_id, position) with page_no that goes on after the existing files of the document."""
    last = existing.groupBy("document_id").agg(F.max("page_no").alias("last"))
    order = F.row_number().over(W.partitionBy("document_id").orderBy("position"))
    return added.withColumn("order", order).join(last, "document_id", "left").withColumn("page_no", F.coalesce("last", F.lit(0)) + F.col("order")).drop("order", "last")
