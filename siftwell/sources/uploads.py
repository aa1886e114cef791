"""Uploaded files to documents and files: bytes, digests, kinds, page numbers, archives, e-mail."""

from __future__ import annotations

import email
import email.policy
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import files as fx
from ..functions import markup
from ..functions import text as tx

# Bounds of what is read from an archive.
MOST_ENTRIES, ENTRY_BYTES, TOTAL_BYTES, MOST_RATIO, PRINTABLE_SHARE = 10_000, 4 << 20, 64 << 20, 200, 0.85


def read_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified_at, size_bytes, content) of the files below a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")


def to_files(uploads: DataFrame) -> DataFrame:
    """uploads (tenant_id, document_id, position, path, content) as files: page_no in order of position, sha256, mime, kind, size, key of the stored bytes and the name."""
    page = F.row_number().over(W.partitionBy("document_id").orderBy("position"))
    known = uploads.withColumn("sha256", F.sha2("content", 256)).withColumn("mime", fx.detect_mime(F.col("content")))
    return known.select(
        "tenant_id", "document_id", page.alias("page_no"), "path", tx.sanitize_filename(F.col("path")).alias("name"), "sha256", "mime", fx.kind_of(F.col("mime")).alias("kind"),
        F.length("content").cast("long").alias("size_bytes"), fx.blob_key(F.col("tenant_id"), F.col("sha256")).alias("key"), "content",
    )


def documents_of(files: DataFrame) -> DataFrame:
    """(document_id, tenant_id, kind, page_count) of files."""
    return files.groupBy("document_id", "tenant_id").agg(fx.dominant_kind(F.col("kind")).alias("kind"), F.count(F.lit(1)).alias("page_count"))


def with_text(files: DataFrame) -> DataFrame:
    """files with the text of those that need no other service."""
    return files.withColumn("text", markup.extract_text(F.col("content"), F.col("mime"), F.col("path")))


def _safe(name: str) -> bool:
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and "\x00" not in name and ":" not in name[:3]


def _text_like(data: bytes) -> bool:
    if not data or b"\x00" in data:
        return False
    sample = data[:65536]
    return sum(32 <= b < 127 or b in (9, 10, 13) or b >= 128 for b in sample) / len(sample) >= PRINTABLE_SHARE


def archive_entries(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Text-like entries of a zip, tar, tar.gz or gz within the bounds; what goes beyond them is left out, as are unsafe names."""
    total = 0

    def take(name: str, size: int, packed: int, read) -> Iterator[tuple[str, bytes]]:
        nonlocal total
        if not _safe(name) or size > ENTRY_BYTES or total + size > TOTAL_BYTES or (packed and size / packed > MOST_RATIO):
            return
        body = read(ENTRY_BYTES + 1)
        if len(body) > ENTRY_BYTES or total + len(body) > TOTAL_BYTES:
            return
        total += len(body)
        if _text_like(body):
            yield name, body

    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist()[:MOST_ENTRIES]:
                if not info.is_dir():
                    with z.open(info) as f:
                        yield from take(info.filename, info.file_size, info.compress_size, f.read)
        return
    if data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
            head = g.read(TOTAL_BYTES + 1)
        if len(head) > TOTAL_BYTES or len(head) > MOST_RATIO * max(1, len(data)):
            return
        if head[257:262] != b"ustar":
            yield from take("content", len(head), len(data), lambda n: head[:n])
            return
        data = head
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for k, member in enumerate(t):
            if k >= MOST_ENTRIES:
                return
            if member.isfile() and (f := t.extractfile(member)):
                yield from take(member.name, member.size, 0, f.read)


def harvest(archives: DataFrame) -> DataFrame:
    """(file_id, entry, name, text) of the text-like entries of archives (file_id, content). Broken archives have none; each archive is read in one task within its bounds."""
    schema = pa.schema([("file_id", pa.int64()), ("entry", pa.int32()), ("name", pa.string()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = []
                try:
                    for name, body in archive_entries(content.as_py() or b""):
                        found.append((file_id, len(found), name, body.decode("utf-8", "replace")))
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError, NotImplementedError):
                    pass
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema, strict=True)], schema=schema)

    return archives.select(F.col("file_id").cast("long"), "content").mapInArrow(rows, "file_id long, entry int, name string, text string")


def archive_text(entries: DataFrame) -> DataFrame:
    """(file_id, text): entries under header lines, in order."""
    part = F.concat(F.lit("\n--- "), F.col("name"), F.lit(" ---\n"), F.col("text"), F.lit("\n"))
    lines = entries.select("file_id", "entry", part.alias("part")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("entry", "part"))).alias("parts"))
    return lines.select("file_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))


def _body(part: email.message.EmailMessage) -> str:
    """The text of a part; one in a character set that nobody knows is read as UTF-8 with replacements."""
    try:
        return part.get_content()
    except LookupError:
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def parse_email(data: bytes) -> dict:
    """Headers of interest, plain and HTML bodies, attachment names of a message."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    plain, html, names = [], [], []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            names.append(part.get_filename())
        elif part.get_content_type() in ("text/plain", "text/html"):
            (plain if part.get_content_type() == "text/plain" else html).append(_body(part))
    head = {f"email:{k}": str(m[k]) for k in ("from", "to", "cc", "subject", "date", "message-id") if m[k]}
    return {"meta": list(head.items()), "plain": "\n".join(plain), "html": "\n".join(html), "attachments": names}


EMAIL = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("plain", T.StringType()), T.StructField("html", T.StringType()), T.StructField("attachments", T.ArrayType(T.StringType()))])


def with_email(files: DataFrame) -> DataFrame:
    """files (content) with meta, text (plain parts, then the HTML parts stripped) and attachments of e-mail messages."""

    @F.arrow_udf(EMAIL)
    def parse(contents: pa.Array) -> pa.Array:
        kind = pa.struct([("meta", pa.map_(pa.string(), pa.string())), ("plain", pa.string()), ("html", pa.string()), ("attachments", pa.list_(pa.string()))])
        return pa.array([parse_email(c.as_py() or b"") for c in contents], kind)

    told = files.withColumn("mail", parse("content"))
    body = F.array_join(F.filter(F.array("mail.plain", markup.strip_html(F.col("mail.html"))), lambda p: p != ""), "\n")
    return told.select("*", F.col("mail.meta").alias("meta"), body.alias("text"), F.col("mail.attachments").alias("attachments")).drop("mail")


def watch_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of the files that appear below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
