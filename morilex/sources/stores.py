"""Key-value stores as tables: written compressed and partitioned by a hash of the key, looked up by reading only the
partitions of the keys that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys whose partitions are named one by one; more keys read the store as a whole and join with it.
NAMED_KEYS = 10_000


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_store(rows: DataFrame, key: str, path: str, parts: int = 64, codec: str = "zstd") -> None:
    """rows by key, in `parts` folders; a store that exists is replaced."""
    placed = rows.withColumn("part", _part(F.col(key), parts))
    placed.repartition("part").sortWithinPartitions(key).write.mode("overwrite").option("compression", codec).partitionBy("part").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def look_up(keys: DataFrame, key: str, path: str, parts: int = 64) -> DataFrame:
    """Rows of the store for keys(key), whatever else keys has; unknown keys have none."""
    store = keys.sparkSession.read.parquet(path)
    asked = keys.select(key).distinct()
    few = [r[0] for r in asked.select(_part(F.col(key), parts).alias("p")).distinct().limit(parts + 1).collect()] if asked.limit(NAMED_KEYS + 1).count() <= NAMED_KEYS else None
    if few is not None:
        store = store.where(F.col("part").isin(*few)) if few else store.limit(0)
    return keys.join(store.drop("part"), key)


def add_dictionary(settings: str, path: str, block: str = "辞書ファイル") -> str:
    """Settings text of an analyser with one more dictionary folder: before the bracket that closes the block."""
    at = settings.find(f"({block}")
    if at < 0:
        raise ValueError(f"no block {block}")
    depth = 0
    for i in range(at, len(settings)):
        if settings[i] == "(":
            depth += 1
        elif settings[i] == ")":
            depth -= 1
            if not depth:
                return f"{settings[:i].rstrip()}\\n\\t{path}\\n{settings[i:]}".replace("\\n", "\n").replace("\\t", "\t")
    raise ValueError(f"the block {block} is not closed")
