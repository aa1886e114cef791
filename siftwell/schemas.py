"""Schemas of the model's relations."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "time": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType(), "vector": T.ArrayType(T.FloatType(), False)}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(","))])


DOCUMENTS = _schema("document_id long,tenant_id long,title string,kind string,created_at time,status string")
FILES = _schema("file_id long,tenant_id long,document_id long,page_no int,sha256 string,mime string,size_bytes long,status string,superseded_at time")
CHUNKS = _schema("chunk_id long,document_id long,file_id long,page_no int,idx int,content string,ts_offset double,superseded_at time")
VECTORS = _schema("chunk_id long,document_id long,embedding vector")
TAGS = _schema("tag_id long,tenant_id long,name string")
DOCUMENT_TAGS = _schema("document_id long,tag_id long,source string,locked boolean")
JOBS = _schema("job_id long,tenant_id long,document_id long,kind string,priority int,status string,attempts int,run_after time,lease_expires_at time,locked_by string,created_at time")
USAGE = _schema("event_id long,tenant_id long,user_id long,role string,prompt_tokens long,completion_tokens long,cost_micros long,created_at time")
HITS = _schema("query_id long,document_id long,chunk_id long,score double,rank int,mode string")

KINDS = ("document", "image", "audio", "video", "identity_document", "code", "archive", "binary", "email")
JOB_STATUSES = ("queued", "running", "failed", "dead", "done")
ROLES = ("text", "vision", "code", "embed", "rerank")
