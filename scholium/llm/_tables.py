"""Reading of input tables, and column access that tolerates what is missing."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholium.runtime import ship


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns to the system what earlier tasks of this process have freed: workers are reused, and their heaps don't shrink by themselves."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def freeing(run):
    """A function over batches that gives memory back when it has ended, as its process may then sit idle for long."""

    def f(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return f
