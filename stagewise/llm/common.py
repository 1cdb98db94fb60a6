"""What the operators share: intermediate tables, shipping of the code, Arrow helpers.

Conventions of all operators unless their docstring says otherwise: a null text counts as
empty; a null id is an id like any other; repeated rows each get their own result row; extra
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Documents whose texts a Python worker holds as bytes at once.
HELD = 1000
_local = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only in a local session that names none."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    return _local.setdefault("folder", tempfile.mkdtemp(prefix="stagewise-"))


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost
    executors, with stable rows."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context = spark.sparkContext
    if _local.get("shipped") == context.applicationId:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="stagewise-"), "stagewise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _local["shipped"] = context.applicationId


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int = HELD) -> Iterator[None]:
    """What runs inside hands Python at most ``rows`` rows at once; a session that asks for
    fewer keeps its number. An executor holds a batch several times, in the JVM and in Python."""
    before = spark.conf.get(BATCH_ROWS)
    most = int(before)  # zero or less: no limit
    spark.conf.set(BATCH_ROWS, str(min(most, rows) if most > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def documents_only(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (null: empty), without any other column."""
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *more)


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most HELD rows; one without rows is one part."""
    for at in range(0, max(1, batch.num_rows), HELD):
        yield batch.slice(at, HELD)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
