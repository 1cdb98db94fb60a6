"""Stored tables: scans, replace and load-once sinks, result bundles."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession


def read_table(
    spark: SparkSession,
    path: str,
    where: Column | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """A Parquet table, with the filter and the column list pushed to its scan."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as Parquet in place of what ``path`` holds.

    The new table is written beside the old one and takes its place when it is complete, so a
    failed write leaves the old table as it was, and ``df`` may read the table it replaces.
    The switch is two renames: whoever reads between them finds no table, never half of one.
    If it is cut off there, the next call puts the old table back first. Partition large
    event tables by ``event_date`` so that date filters prune files.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    restore(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(*partition_by).parquet(staged)
        if not is_complete(spark, staged):
            raise OSError(f"no commit marker in {staged}")
    except BaseException:
        delete_folder(spark, staged)
        raise
    files, _ = _folder(spark, path)
    old = _exists(spark, path)
    if old:
        _rename(files, spark, path, f"{path}{REPLACED}")
    _rename(files, spark, staged, path)
    if old:
        delete_folder(spark, f"{path}{REPLACED}")


def load_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> bool:
    """Write ``df`` unless ``path`` holds a complete table; whether it was written.

    A table is complete when it has its commit marker; a folder that a failed load left half
    written has none and is replaced.
    """
    restore(df.sparkSession, path.rstrip("/"))
    if is_complete(df.sparkSession, path):
        return False
    replace_table(df, path, partition_by)
    return True


#: Spark writes this file last. The old table's name while a new one takes its place.
MARKER, REPLACED = "_SUCCESS", ".replaced"


def is_complete(spark: SparkSession, path: str) -> bool:
    return _exists(spark, f"{path.rstrip('/')}/{MARKER}")


def restore(spark: SparkSession, path: str) -> None:
    """Undoes a switch that was cut off between its two renames, or cleans up after one."""
    if not _exists(spark, f"{path}{REPLACED}"):
        return
    if _exists(spark, path):
        delete_folder(spark, f"{path}{REPLACED}")
    else:
        _rename(_folder(spark, path)[0], spark, f"{path}{REPLACED}", path)


def delete_folder(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system of a path, whatever store that is in, and the path in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _rename(files, spark: SparkSession, old: str, new: str) -> None:
    if not files.rename(_folder(spark, old)[1], _folder(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a catalog table bucketed by ``key``: groupings and joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables available to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_bundle(bundle: Mapping[str, DataFrame], folder: str) -> None:
    """Write each named result to its own Parquet folder, ready for charting."""
    for name, df in bundle.items():
        replace_table(df, f"{folder}/{name}")
