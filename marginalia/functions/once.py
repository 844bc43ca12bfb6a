"""Tables that several parts of a plan read, made once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def once(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again; kept by the executors where no such folder is named."""
    try:
        from marginalia.llm.common import shared_dir, written

        shared_dir(df.sparkSession)
    except (ModuleNotFoundError, ValueError):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return written(df, what)
