"""Computing once what several results read."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from stagewise.sources.tables import delete_folder

CHECKPOINT_DIR = "spark.checkpoint.dir"


class Store:
    """Frames that are computed once and read by everything built on them, until released."""

    def __init__(self):
        self._held: list[tuple[DataFrame, str | None]] = []

    def share(self, df: DataFrame) -> DataFrame:
        """``df`` written to the session's checkpoint folder and read back from there.

        The folder survives the loss of executors. Without one the frame is cached with its
        lineage, so lost parts are computed again.
        """
        folder = df.sparkSession.conf.get(CHECKPOINT_DIR, None)
        if not folder:
            kept = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._held.append((kept, None))
            return kept
        path = f"{folder.rstrip('/')}/shared-{uuid.uuid4().hex}"
        df.write.parquet(path)
        kept = df.sparkSession.read.schema(df.schema).parquet(path)
        self._held.append((kept, path))
        return kept

    def release(self) -> None:
        """Frees the storage; results built on it can no longer be computed."""
        while self._held:
            df, path = self._held.pop()
            if path is None:
                df.unpersist()
            else:
                delete_folder(df.sparkSession, path)


class Bundle(dict):
    """Named results. Call ``release`` when all that are wanted have been written."""

    def __init__(self, results: Mapping[str, DataFrame], store: Store | None = None):
        super().__init__(results)
        self.store = store or Store()

    def release(self) -> None:
        self.store.release()
