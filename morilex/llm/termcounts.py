"""Problem 3: how often every term occurs, in how many records, and which terms are too rare or too common.

Method: incremental signed deltas. The persistent state is two logs of runs: the signed records (+1 appeared, -1 went),
partitioned by a hash of their document, and the signed changes of the count of every term. A batch of added (+1), deleted
(-1) or changed (-1 of the old, +1 of the new form) records is compared only with the live records of the documents it
touches; what differs is appended as a run of records, and the changes of occurrences and of document counts that follow
are appended as a run of counts. Nothing else is rewritten. Runs of like size are merged, so a record is rewritten a
logarithmic number of times.

Cost of a batch: its own rows and the partitions of its documents. A run has as many partitions as its own size asks for
(powers of two, ROWS_PER_BUCKET rows each), so one scheme serves a thousand rows and 10^13.

Failures: runs have unique names and count only once the manifest names them, so a failed job can be tried again; what it
left, and runs that were merged, are deleted by the next batch. A table that was read from the state stays valid until then.

Defined results: a record that equals a live one is delivered again and changes nothing; a deletion of an unknown record
changes nothing; terms that are null are not counted; a record without document adds occurrences but no document; an
empty batch leaves the state as it is; an empty state has no terms and zero documents. Nothing that grows with the terms
or records is collected: only partition numbers and row counts of runs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookup import small
from . import common

#: Marks that stand for borders between words, not for words.
BORDER_MARKS = ("|", "$", "#")
RARE_COUNT, RARE_DOCUMENTS, COMMON_SHARE = 5, 3, 0.15


def counted_word(midasi: Column) -> Column:
    return midasi.isNotNull() & ~midasi.isin(*BORDER_MARKS)


#: Rows of a run for each of its partitions.
ROWS_PER_BUCKET = 1_000_000


class TermCounts:
    """Persistent counts of the terms of records.

    record: the columns that make a record; doc, cnt: its document and its number of occurrences; terms: names of the
    term columns; counts_if: which records count.
    """

    def __init__(self, spark: SparkSession, path: str, record: T.StructType, doc: str, cnt: str, terms: list[str], counts_if: Column, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.record, self.doc, self.cnt, self.terms, self.counts_if, self.rows_per_bucket = spark, path, record, doc, cnt, terms, counts_if, rows_per_bucket
        self.schemas = {
            "records": T.StructType([*record.fields, T.StructField("_sign", T.IntegerType())]),
            "counts": T.StructType([T.StructField("field", T.StringType()), T.StructField("term", T.StringType()), T.StructField("cnt", T.LongType()), T.StructField("docs", T.LongType())]),
        }
        self.version, self.runs = self._manifest()

    # -- the manifest names the runs of each log, oldest first: [name, level, rows]; a run has 2 ** level partitions
    def _manifest(self) -> tuple[int, dict[str, list]]:
        fs, root = common.hadoop_path(self.spark, f"{self.path}/manifest")
        versions = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root)] if fs.exists(root) else []
        for v in sorted(versions, reverse=True):
            if fs.exists(common.hadoop_path(self.spark, f"{self.path}/manifest/v{v}/_SUCCESS")[1]):
                return v, json.loads(self.spark.read.text(f"{self.path}/manifest/v{v}").first()[0])
        return 0, {"records": [], "counts": []}

    def _commit(self, runs: dict[str, list]) -> None:
        version = self.version + 1
        # a version that a failed attempt began is written again
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/v{version}")
        self.version, self.runs = version, runs

    def vacuum(self) -> None:
        """Deletes the runs that the manifest does not name: merged ones, and what failed attempts left."""
        for log, runs in self.runs.items():
            fs, root = common.hadoop_path(self.spark, f"{self.path}/{log}")
            named = {r[0] for r in runs}
            for s in fs.listStatus(root) if fs.exists(root) else []:
                if s.getPath().getName() not in named:
                    fs.delete(s.getPath(), True)

    def _hash(self) -> Column:
        return F.xxhash64(self.doc)

    def _load(self, log: str, runs: list, hashes: set[int] | None = None, level: int = 0) -> DataFrame:
        """The rows of runs; hashes: only partitions for these remainders of the document's hash modulo 2 ** level."""
        out = self.spark.createDataFrame([], self.schemas[log])
        for name, own, _ in runs:
            path = f"{self.path}/{log}/{name}"
            paths = [path]
            if hashes is not None and own:
                fs, root = common.hadoop_path(self.spark, path)
                there = {int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(root) if "=" in s.getPath().getName()}
                paths = [f"{path}/bucket={b}" for b in sorted(there & {h % 2**own for h in hashes})]
            if paths:
                one = self.spark.read.schema(self.schemas[log]).option("basePath", path).parquet(*paths)
                out = out.unionByName(one.select(*self.schemas[log].names))
        return out

    def _append(self, df: DataFrame, log: str, rows: int) -> list | None:
        """Writes a run of at most `rows` rows."""
        level = max(0, (rows // self.rows_per_bucket).bit_length()) if log == "records" else 0
        name = uuid.uuid4().hex
        path = f"{self.path}/{log}/{name}"
        if level:
            df = df.withColumn("bucket", F.pmod(self._hash(), F.lit(2**level)))
            if level > 4:  # many partitions: their rows are brought together, so that each has few files
                df = df.hint("rebalance", "bucket")
            df.write.partitionBy("bucket").parquet(path)
        else:
            df.write.parquet(path)
        n = self.spark.read.schema(self.schemas[log]).parquet(path).count()
        return [name, level, n] if n else None

    def _merged(self, log: str, runs: list) -> list:
        """Merges the newest runs while one is at least half as large as the one before it."""
        while len(runs) > 1 and runs[-1][2] * 2 >= runs[-2][2]:
            both = self._load(log, runs[-2:])
            keys = self.record.names if log == "records" else ["field", "term"]
            sums = {"_sign": F.sum("_sign").cast("int")} if log == "records" else {"cnt": F.sum("cnt"), "docs": F.sum("docs")}
            df = both.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()]).where(" or ".join(f"{k} <> 0" for k in sums))
            new = self._append(df.select(*self.schemas[log].names), log, runs[-1][2] + runs[-2][2])
            runs = [*runs[:-2], *([new] if new else [])]
        return runs

    def apply(self, changes: DataFrame, sign: str = "sign") -> None:
        """Merge signed records: `changes` has the record's columns and +1 or -1 in `sign`; other columns are ignored."""
        self.vacuum()
        cols = self.record.names
        delta = changes.select(*[F.col(f.name).cast(f.dataType) for f in self.record], F.lit(0).alias("_was"), F.col(sign).cast("int").alias("_sign"))
        runs = self.runs["records"]
        if runs:
            delta = common.written(delta, "term-batch")
            level = max(r[1] for r in runs)
            hashes = {r[0] for r in delta.select(F.pmod(self._hash(), F.lit(2**level))).distinct().collect()}  # at most the partitions of a run
            touched = small(delta.select(self._hash().alias("_h")).distinct())
            old = self._load("records", runs, hashes, level).withColumn("_h", self._hash()).join(touched, "_h", "left_semi").drop("_h")
            delta = delta.unionByName(old.select(*cols, F.col("_sign").alias("_was"), F.lit(0).alias("_sign")))
        # one shuffle by the whole record: no key is hot, however skewed documents or terms are
        state = delta.groupBy(*cols).agg(F.sum("_was").cast("int").alias("_old"), F.signum(F.sum("_sign")).cast("int").alias("_net"))
        state = state.withColumn("_new", F.when(F.col("_net") > 0, 1).when(F.col("_net") < 0, 0).otherwise(F.col("_old")))
        if runs:
            state = common.written(state.where("_old = 1 or _new = 1").select(*cols, F.col("_old").cast("byte"), F.col("_new").cast("byte")), "term-state")
            changed = state.where("_old <> _new").select(*cols, (F.col("_new") - F.col("_old")).cast("int").alias("_sign"))
            rows = changed.count()
            records = self._append(changed, "records", rows) if rows else None
        else:  # the first batch: all that is live is its run
            rows = changes.count()
            records = self._append(state.where("_new = 1").select(*cols, F.lit(1).alias("_sign")), "records", rows) if rows else None
        if not records:
            return
        if not runs:
            state = self._load("records", [records]).select(*cols, F.lit(0).cast("byte").alias("_old"), F.lit(1).cast("byte").alias("_new"))

        # signed changes of every (term, document) whose records changed
        named = F.array(*[F.struct(F.lit(t).alias("field"), F.when(self.counts_if, F.col(t)).alias("term")) for t in self.terms])
        seen = state.select(F.explode(named).alias("k"), F.col(self.doc).alias("doc"), F.col(self.cnt).alias("c"), "_old", "_new").select("k.field", "k.term", "doc", "c", "_old", "_new").where("term is not null")
        per_doc = seen.groupBy("field", "term", "doc").agg(F.sum(F.col("c") * (F.col("_new") - F.col("_old"))).alias("d_cnt"), (F.max("_new") - F.max("_old")).alias("d_doc")).where("d_cnt <> 0 or d_doc <> 0")
        signed = per_doc.groupBy("field", "term").agg(F.sum("d_cnt").alias("cnt"), F.sum(F.when(F.col("doc").isNotNull(), F.col("d_doc")).otherwise(0)).cast("long").alias("docs")).where("cnt <> 0 or docs <> 0")
        # the number of documents is kept as the count of a term without a name
        docs = state.where(F.col(self.doc).isNotNull()).groupBy(self.doc).agg((F.max("_new") - F.max("_old")).alias("d")).agg(F.sum("d").alias("docs")).where("docs <> 0")
        signed = signed.unionByName(docs.select(F.lit("").alias("field"), F.lit("").alias("term"), F.lit(0).cast("long").alias("cnt"), F.col("docs").cast("long").alias("docs")))
        counts = self._append(signed, "counts", rows)
        common.free(state)
        self._commit({"records": self._merged("records", [*self.runs["records"], records]), "counts": self._merged("counts", [*self.runs["counts"], *([counts] if counts else [])])})

    def _totals(self) -> DataFrame:
        return self._load("counts", self.runs["counts"]).groupBy("field", "term").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs")).where("cnt <> 0 or docs <> 0")

    def counts(self) -> DataFrame:
        """(field, term, cnt, docs) of every term."""
        return self._totals().where("field <> ''")

    def documents(self) -> int:
        row = self._load("counts", self.runs["counts"]).where("field = ''").agg(F.sum("docs")).first()
        return row[0] or 0

    def marked(self, rare_count: int = RARE_COUNT, rare_docs: int = RARE_DOCUMENTS, common_share: float = COMMON_SHARE) -> DataFrame:
        """Counts with mark: 'rare', 'common', or 'useful'."""
        total = self.documents()
        rare = (F.col("cnt") < rare_count) | (F.col("docs") < rare_docs)
        return self.counts().withColumn("mark", F.when(rare, "rare").when(F.col("docs") > F.lit(common_share) * F.lit(total), "common").otherwise("useful"))


def vocabulary(spark: SparkSession, sf_dir: str) -> TermCounts:
    """Counts over the whole of ngram_uni: what was there first, then what was loaded late as a second batch."""
    uni = common.read(spark, sf_dir, "ngram_uni")
    record = T.StructType([f for f in uni.schema if f.name in ("shard_id", "document_id", "midasi", "repname", "word_class", "cnt")])
    state = TermCounts(spark, common.scratch(spark, "termcounts"), record, "document_id", "cnt", ["midasi", "repname"], counted_word(F.col("midasi")))
    border = uni.agg(F.expr("percentile_approx(loaded_at, 0.9, 1000)")).first()[0]
    uni = uni.withColumn("sign", F.lit(1))
    if border is None:
        state.apply(uni)
        return state
    late = F.coalesce(F.col("loaded_at") > F.lit(border), F.lit(True))
    state.apply(uni.where(~late))
    state.apply(uni.where(late))
    return state


def p3_terms(spark, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).marked()


def p3_found(spark, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).marked().where("mark <> 'useful'").select("field", "term", "mark")


def p3_after_changes(spark, sf_dir: str) -> DataFrame:
    """The counts after a third batch: every record of shard 1 is corrected (one occurrence more), those of shard 2 go."""
    state = vocabulary(spark, sf_dir)
    uni = common.read(spark, sf_dir, "ngram_uni").select(*state.record.names).where("shard_id in (1, 2)").distinct()
    gone = uni.withColumn("sign", F.lit(-1))
    corrected = uni.where("shard_id = 1 and cnt is not null").withColumn("cnt", (F.col("cnt") + 1).cast("long")).withColumn("sign", F.lit(1))
    state.apply(gone.unionByName(corrected))
    return state.marked()
