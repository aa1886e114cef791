"""File kinds, upload checks, URLs of hosts that must not be fetched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media types by kind and magic bytes (hex) with the type they mean.
ARCHIVES = ("application/zip", "application/x-tar", "application/gzip", "application/x-bzip2", "application/x-xz", "application/zstd", "application/x-7z-compressed", "application/x-rar-compressed")
OFFICE_PREFIXES = ("application/vnd.openxmlformats-officedocument", "application/vnd.oasis.opendocument", "application/vnd.ms-")
DOCUMENTS = ("application/pdf", "application/msword", "application/rtf", "application/json", "application/xml", "application/epub+zip")
MAGIC = (
    ("25504446", "application/pdf"),
    ("89504E470D0A1A0A", "image/png"),
    ("FFD8FF", "image/jpeg"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("1F8B", "application/gzip"),
    ("425A68", "application/x-bzip2"),
    ("FD377A585A00", "application/x-xz"),
    ("28B52FFD", "application/zstd"),
    ("377ABCAF271C", "application/x-7z-compressed"),
    ("526172211A07", "application/x-rar-compressed"),
    ("7F454C46", "application/x-executable"),
    ("494433", "audio/mpeg"),
    ("664C6143", "audio/flac"),
    ("4F676753", "audio/ogg"),
    ("1A45DFA3", "video/x-matroska"),
)
SCAN_BYTES = 64 * 1024


def detect_mime(content: Column) -> Column:
    """Media type by magic bytes; ZIP containers are told apart by the entry names in their first 64 KiB."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(16)))
    names = F.decode(F.substring(content, F.lit(1), F.lit(SCAN_BYTES)), "ISO-8859-1")
    office = "application/vnd.openxmlformats-officedocument."
    zipped = (
        F.when(names.contains("[Content_Types].xml") & names.contains("word/"), office + "wordprocessingml.document")
        .when(names.contains("[Content_Types].xml") & names.contains("xl/"), office + "spreadsheetml.sheet")
        .when(names.contains("[Content_Types].xml") & names.contains("ppt/"), office + "presentationml.presentation")
        .when(names.contains("[Content_Types].xml"), office + "wordprocessingml.document")
        .when(names.contains("META-INF/MANIFEST.MF"), "application/java-archive")
        .otherwise("application/zip")
    )
    riff, brand = F.substring(head, 17, 8), F.substring(names, 9, 4)
    out = F.when(F.length(content) == 0, "application/x-empty").when(head.startswith("504B0304"), zipped)
    out = out.when(head.startswith("52494646") & (riff == "57415645"), "audio/wav").when(head.startswith("52494646") & (riff == "57454250"), "image/webp")
    ftyp = F.substring(head, 9, 8) == "66747970"
    out = out.when(ftyp & (brand == "qt  "), "video/quicktime").when(ftyp & brand.isin("heic", "heix", "heim", "heis", "heif"), "image/heic")
    out = out.when(ftyp & brand.isin("mif1", "msf1", "avif"), "image/avif").when(ftyp & brand.startswith("3gp"), "video/3gpp").when(ftyp, "video/mp4")
    for magic, mime in MAGIC:
        out = out.when(head.startswith(magic), mime)
    return out.when(F.is_valid_utf8(content.cast("string")) & ~F.contains(names, F.lit("\x00")), "text/plain").otherwise("application/octet-stream")


def kind_of(mime: Column) -> Column:
    """Document kind of a media type; unknown and null are binary."""
    office = F.lit(False)
    for prefix in OFFICE_PREFIXES:
        office = office | mime.startswith(prefix)
    return (
        F.when(mime.startswith("image/"), "image")
        .when(mime.startswith("audio/"), "audio")
        .when(mime.startswith("video/") | (mime == "application/x-matroska"), "video")
        .when(mime.isin(*ARCHIVES), "archive")
        .when(mime.isin(*DOCUMENTS) | office | mime.startswith("text/"), "document")
        .otherwise("binary")
    )


def dominant_kind(kind: Column) -> Column:
    """Aggregate: the kind that all files share, document for a mixture, binary for none."""
    return F.when(F.count(kind) == 0, "binary").when(F.count_distinct(kind) == 1, F.min(kind)).otherwise("document")


def route(mime: Column) -> Column:
    """Which extractor takes a composite document."""
    return F.when(mime.startswith("text/") | (mime == "application/json"), "native").otherwise("office")


def reject_reason(path: Column, mime: Column, size: Column, most_bytes: int, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """Null for an upload that may go on. Denied types go whatever else; text/x- types are always allowed."""
    unsafe = path.contains("..") | path.startswith("/") | path.contains("\\") | path.contains("\x00")
    allowed = mime.isin(*allow) | mime.startswith("text/x-")
    return F.when(unsafe, "path").when(size > most_bytes, "size").when(mime.isin(*deny), "denied").when(~allowed, "type")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^./]\.([^./]+)$", 1))


def allowed_extension(path: Column, allowed: Sequence[str]) -> Column:
    """Case-insensitive; an empty list allows all, a path without an extension only then."""
    return F.lit(True) if not allowed else (extension(path) != "") & extension(path).isin(*[a.lower().lstrip(".") for a in allowed])


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """Patterns: `*suffix`, `prefix*` of the name, an exact name, or any path component."""
    name, out = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in patterns:
        hit = name.endswith(p[1:]) if p.startswith("*") else name.startswith(p[:-1]) if p.endswith("*") else F.array_contains(F.split(path, "/"), p)
        out = out | hit
    return out


def host_of(url: Column) -> Column:
    """Host of an http or https URL, lower-cased, without user, port and brackets; null for other schemes."""
    authority = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))
    return F.nullif(F.lower(host), F.lit(""))


def blocked_host(host: Column) -> Column:
    """Hosts that must not be fetched: none, local names, and private, loopback, link-local or unspecified addresses."""
    v4 = F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", 1).try_cast("int")
    second = F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.\d{1,3}\.\d{1,3}$", 2).try_cast("int")
    private = (v4.isin(0, 10, 127)) | ((v4 == 172) & second.between(16, 31)) | ((v4 == 192) & (second == 168)) | ((v4 == 169) & (second == 254)) | ((v4 == 100) & second.between(64, 127)) | (v4 >= 224)
    v6 = host.contains(":") & host.rlike(r"^(::1?$|fe[89ab]|f[cd]|::ffff:(0|10|127|192\.168|169\.254)\.)")
    names = (host == "localhost") | host.rlike(r"\.(local|internal|localhost)$")
    return host.isNull() | F.coalesce(names, F.lit(False)) | F.coalesce(private, F.lit(False)) | F.coalesce(v6, F.lit(False))


def cdn_url(url: Column, base: str) -> Column:
    """The URL's path and query under another scheme and host."""
    return F.concat(F.lit(base.rstrip("/")), F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1))


def blob_key(tenant: Column, digest: Column) -> Column:
    return F.concat_ws("/", tenant.cast("string"), digest)
