"""Structured Streaming: evidence accumulated in keyed state, decisions at a count, results by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import is_dir, scratch


def table_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 50) -> DataFrame:
    """A table's files as a stream; each micro-batch takes at most `files` of them (back-pressure)."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if is_dir(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(df: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """All that is there now, to the end; every micro-batch is appended with its number. Restartable by its checkpoint."""
    spark = df.sparkSession
    out, ckpt = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-ckpt")

    def save(batch: DataFrame, number: int) -> None:
        # a batch that is tried again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])
    got = spark.read.schema(schema).option("basePath", out).parquet(out) if is_dir(spark, out) else spark.createDataFrame([], schema)
    got._morilex_checkpoint = ckpt
    return got


def state_rows(results: DataFrame) -> DataFrame | None:
    """The whole state that a stream which was run to its end has left, as (key, value); None if nothing came."""
    spark, path = results.sparkSession, results._morilex_checkpoint
    return spark.read.format("statestore").load(path).select("key", "value") if is_dir(spark, f"{path}/state") else None


class Observers:
    """Functions that are told of sentences as they come: each of every sentence, or of each distinct one of a document."""

    def __init__(self):
        self.by_id: dict[str, tuple[Callable[[DataFrame], DataFrame], bool]] = {}

    def add(self, name: str, function: Callable[[DataFrame], DataFrame], unique: bool = False) -> None:
        """function: a batch of sentences to the rows it has to say about them."""
        self.by_id[name] = (function, unique)

    def get(self, name: str) -> Callable[[DataFrame], DataFrame]:
        return self.by_id[name][0]

    def remove(self, name: str) -> None:
        del self.by_id[name]

    def run(self, sentences: DataFrame, document: str, text: str) -> dict[str, DataFrame]:
        """One pass over the stream for the observers of all sentences, one for those of distinct ones; rows by observer,
        each with its batch. A batch that is tried again after a failure writes the same folders again."""
        spark, folders = sentences.sparkSession, {name: scratch(sentences.sparkSession, f"observer-{name}") for name in self.by_id}
        for unique in (False, True):
            mine = {n: f for n, (f, u) in self.by_id.items() if u == unique}
            if not mine:
                continue
            stream = sentences.dropDuplicates([document, text]) if unique else sentences

            def tell(batch: DataFrame, number: int, mine=mine) -> None:
                batch.persist(StorageLevel.DISK_ONLY)
                for name, function in mine.items():
                    function(batch).write.mode("overwrite").parquet(f"{folders[name]}/batch={number}")
                batch.unpersist()

            q = stream.writeStream.option("checkpointLocation", scratch(spark, "observers-ckpt")).foreachBatch(tell).trigger(availableNow=True).start()
            q.awaitTermination()
            if q.exception():
                raise q.exception()
        return {name: spark.read.option("basePath", path).parquet(path) for name, path in folders.items() if is_dir(spark, path)}


def accumulate(examples: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n, fired): examples counted in state; `fired` once a key has `least` of them."""
    key_types = [examples.schema[k] for k in keys]
    out = T.StructType([*key_types, T.StructField("n", T.LongType()), T.StructField("fired", T.BooleanType())])
    state = T.StructType([T.StructField("n", T.LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        n = (st.get[0] if st.exists else 0) + sum(len(b) for b in batches)
        st.update((n,))
        yield pd.DataFrame([(*key, n, n >= least)], columns=out.names)

    return examples.groupBy(*keys).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def monitor(events: DataFrame, key: str, kind: str, decide_at: int, order: list[str] | None = None) -> DataFrame:
    """(key, total, decision): the most frequent kind among the first `decide_at` events of a key, kept from then on.

    Events of a micro-batch are taken in the given order, else as they come. State is one count for each kind; only the events that are
    still needed for the decision are held, however many a key has.
    """
    out = T.StructType([events.schema[key], T.StructField("total", T.LongType()), T.StructField("decision", T.StringType())])
    state = T.StructType([T.StructField("total", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("decision", T.StringType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        total, kinds, counts, decision = st.get if st.exists else (0, [], [], None)
        seen, first = dict(zip(kinds, counts)), None
        missing = max(0, decide_at - sum(seen.values()))
        for b in batches:
            total += len(b)
            if decision is None:
                both = b if first is None else pd.concat([first, b])
                first = (both.sort_values(order, kind="stable") if order else both).head(missing)
        if decision is None and first is not None:
            for x, n in first[kind].value_counts().items():
                seen[x] = seen.get(x, 0) + int(n)
            if sum(seen.values()) >= decide_at:
                decision = min(seen, key=lambda x: (-seen[x], x))
        st.update((total, list(seen), list(seen.values()), decision))
        yield pd.DataFrame([(*k, total, decision)], columns=out.names)

    return events.groupBy(key).applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key."""
    rest = [c for c in results.columns if c not in (*keys, "batch")]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")


def windowed_counts(events: DataFrame, time: str, kind: str, unit: str = "day") -> DataFrame:
    """Counts by day (or another unit) of event time, kept in state without a watermark.

    No event is left out, in whatever order the files come and however many make a batch; one without a time counts under
    null. State is one count for each day and kind.
    """
    return events.groupBy(F.date_trunc(unit, time).alias("start"), kind).agg(F.count("*").alias("n"))


def running_sums(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value): sums that go on with every batch."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value))
