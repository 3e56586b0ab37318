"""Instances of nouns, built on the first level where they have enough distinct features; orders and text form of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import row_index


def by_level(features: DataFrame, least: int = 100, core: int = 0, core_types: tuple[str, ...] = ()) -> DataFrame:
    """features(doc_id, domain, name, ftype, fname) -> (origin, name, domain, doc_id, k distinct features, n).

    Complete on a page: emitted as 'page'. The rest is carried up to the domain and emitted there if complete. `core`
    asks for so many features of `core_types` besides.
    """
    f = features.withColumn("f", F.concat_ws("/", "ftype", "fname")).withColumn("c", F.col("ftype").isin(*core_types).cast("int") if core_types else F.lit(0))
    page = f.groupBy("name", "domain", "doc_id").agg(F.count_distinct("f").alias("k"), F.count("*").alias("n"), F.sum("c").alias("core"))
    done = page.where((F.col("k") >= least) & (F.col("core") >= core))
    same = [f["name"].eqNullSafe(done["name"]), f["domain"].eqNullSafe(done["domain"]), f["doc_id"].eqNullSafe(done["doc_id"])]
    rest = f.join(done, same, "left_anti")
    domain = rest.groupBy("name", "domain").agg(F.count_distinct("f").alias("k"), F.count("*").alias("n"), F.sum("c").alias("core")).where((F.col("k") >= least) & (F.col("core") >= core))
    return done.select(F.lit("page").alias("origin"), "name", "domain", "doc_id", "k", "n").unionByName(domain.select(F.lit("domain").alias("origin"), "name", "domain", F.lit(None).cast("long").alias("doc_id"), "k", "n"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds `place`: the place of each row in a random order that depends on the seed and the key alone."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")))
    return row_index(rows.withColumn("_d", digest), ["_d", key], "place").drop("_d")


def block_shuffled(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Adds block and `place`: blocks of `size` rows in the order of key, shuffled within and interleaved."""
    digest = lambda c: F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(c).cast("string")))
    b = row_index(rows, [key], "_i").withColumn("block", F.floor((F.col("_i") - 1) / size)).drop("_i")
    # a window over a block holds `size` rows
    w = W.partitionBy("block").orderBy(digest(key), key)
    return row_index(b.withColumn("_within", F.row_number().over(w)), ["_within", digest("block"), "block"], "place").drop("_within")


class InstanceList:
    """Instances to be gone through several times, each time in another order; `reset` starts the next pass."""

    def __init__(self, rows: DataFrame, key: str, seed: int = 0):
        self.rows, self.key, self.seed, self.passes = rows, key, seed, 0

    def append(self, more: DataFrame) -> None:
        self.rows = self.rows.unionByName(more)

    def reset(self) -> None:
        self.passes += 1

    def shuffled(self) -> DataFrame:
        return shuffled(self.rows, self.key, self.seed + self.passes)


def feature_lines(rows: DataFrame, name: str, label: str, origin: str, feats: str) -> DataFrame:
    """Instances as text: `name<TAB>label<TAB>origin<TAB>fid:value ...`, the form that the reader of instances takes."""
    pairs = F.array_join(F.transform(feats, lambda x: F.concat_ws(":", x["fid"].cast("string"), x["v"].cast("string"))), " ")
    return rows.select(F.concat_ws("\t", F.col(name).cast("string"), F.col(label).cast("string"), F.col(origin).cast("string"), pairs).alias("value"))
