"""Cutting lineage in the shared folder, spreading work, joins with hot keys, distributed running sums and row numbers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it holds more than one row in so many: there are fewer such keys than this number.
HOT_KEYS = 10_000
#: Places over which the rows of a hot key are spread.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir. Only a local session may do without (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(spark, "_morilex_shared", None)
        if not where:
            where = tempfile.mkdtemp(prefix="morilex-")
            spark._morilex_shared = where
    return where


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/morilex/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop sees them, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_dir(spark: SparkSession, path: str) -> bool:
    """Whether path is a folder, on whatever file system it names."""
    fs, p = hadoop_path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df by writing it to the shared folder and reading it back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._morilex_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes what `written` wrote, once all that is made of it is written itself."""
    for t in tables:
        path = getattr(t, "_morilex_path", None)
        if path:
            fs, p = hadoop_path(t.sparkSession, path)
            fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this engine wrote to the shared folder: when the results that were read from it are no longer needed."""
    fs, p = hadoop_path(spark, f"{shared_dir(spark).rstrip('/')}/morilex")
    fs.delete(p, True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Spread a table that is stored in few splits over all cores before heavy per-row work; else leave it as it is.

    Only the splits of a scan are counted: a plan with a shuffle is left alone, as counting its partitions would run it.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Repartition", "Sort", "Window", "Distinct")):
        return df
    want = max(1, df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want * per_core)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed where some keys may hold a large share of rows.

    weight: a column of keyed with how many rows a key has (or a bound of it); it is dropped. Keys with more than one in
    HOT_KEYS of all are fewer than HOT_KEYS, so their list is broadcast; their rows are spread over SALTS places, and the
    keyed side has them once for each place. All other keys are joined as they are. keyed should be a written table.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = keyed.where(F.col(weight) * F.lit(HOT_KEYS) > F.lit(total)) if total > HOT_KEYS * SALTS else keyed.limit(0)
    if total <= HOT_KEYS * SALTS or hot.isEmpty():
        return rows.join(keyed.drop(weight), on, how)
    hot = hot.select(*on).distinct().withColumn("_hot", F.lit(True))
    place = F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot"), place).otherwise(0)).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = keyed.drop(weight).join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def prefix_sum(df: DataFrame, keys: list, value: Column, out: str, name: str = "ranged") -> DataFrame:
    """Adds `out`: the sum of `value` over all rows up to and including this one, in the total order of `keys`.

    Range partitioning, one small row for each partition to the driver (their number is the bound), then a running sum
    within each partition: no task ever sees more than its range. Null values count as zero.
    """
    spark = df.sparkSession
    value = F.coalesce(value, F.lit(0))
    ranged = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), name)
    sums = sorted((r[0], r[1] or 0) for r in ranged.groupBy("_part").agg(F.sum(value)).collect())
    whole = not any(isinstance(x, float) for _, x in sums)
    offsets, before = [], 0
    for part, x in sums:
        offsets.append((part, before if whole else float(before)))
        before += x
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType() if whole else T.DoubleType())])
    w = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(spark.createDataFrame(offsets, schema)), "_part").withColumn(out, F.col("_before") + F.sum(value).over(w)).drop("_part", "_before")


def row_index(df: DataFrame, keys: list, out: str = "row_no") -> DataFrame:
    """Row numbers from 1 in the total order of keys, without a window over all rows."""
    return prefix_sum(df, keys, F.lit(1).cast("long"), out, "numbered")
