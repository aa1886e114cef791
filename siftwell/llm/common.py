"""What the operators of this subpackage share: table access, checkpoints and Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the contracts call white space: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = b" \t\n\x0b\x0c\r"
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any path Spark can open will do."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, in the session or the context. Where none is named a local one is made, under a local master only: on a cluster it would be lost with
    its machine."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if (known := context._jsc.sc().getCheckpointDir()).isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="siftwell-")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have yet, whatever the case rules of the session."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text, split at the white space of BLANKS; null counts as empty."""
    return text.lower().split() if text else []


def utf8(column: str | Column) -> Column:
    """Text as UTF-8 bytes, so that Python workers see bytes and never build str objects they don't need."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def slices(rows: Iterable[tuple], schema: pa.Schema, max_bytes: int = 4 << 20, max_rows: int = 20_000, weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; weigh is the position of the one wide column."""
    block: list[tuple] = []
    held = 0
    for row in rows:
        block.append(row)
        held += len(row[weigh] or b"") if weigh is not None else 0
        if len(block) >= max_rows or held >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema, strict=True)], schema=schema)
            block, held = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema, strict=True)], schema=schema)


def sized_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Marks df for broadcasting only if its counted rows are within limit; otherwise Spark's own choice stands."""
    return F.broadcast(df) if rows <= limit else df


def use_small_batches(spark: SparkSession) -> None:
    """Arrow and Parquet batches of few rows and bytes from now on in this session. Batches of whole texts are held several times over, on both sides of a Python worker's pipe and
    outside the heap, and a reader's batch grows as one array; what comes out is the same at any batch size."""
    for name, value in BATCHES.items():
        spark.conf.set(name, value)


@contextmanager
def settings_kept(spark: SparkSession) -> Iterator[None]:
    """Gives the session its batch sizes back after the body."""
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def scratch(prefix: str) -> tempfile.TemporaryDirectory:
    """Spill space of one task. No other task or process ever reads it and it goes with the task."""
    return tempfile.TemporaryDirectory(prefix=prefix, dir=os.environ.get("TMPDIR"))
