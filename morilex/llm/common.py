"""What the training-data operators share; storage and running sums are the core's."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.storage import free, hadoop_path, join_hot, prefix_sum, scratch, spread, written

__all__ = ["distinct", "free", "hadoop_path", "join_hot", "prefix_sum", "read", "scratch", "spread", "written"]


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. By sorting, which is many times faster than np.unique's hashing of large arrays."""
    x = np.sort(x)
    first = np.ones(len(x), dtype=bool)
    first[1:] = x[1:] != x[:-1]
    return x[first]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
