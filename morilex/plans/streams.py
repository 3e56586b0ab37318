"""Streaming operators run to the end of a table, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookup
from ..streaming import stateful
from .registry import query, table


@query("select user_id, event_type, count(*) as n, count(*) >= 3 as fired from events group by 1, 2")
def st04_accumulate(spark, sf):
    """Examples accumulated by key in state; groups of three and more fire."""
    s = stateful.table_stream(spark, sf, "events").select("user_id", "event_type")
    return stateful.latest(stateful.run_to_end(stateful.accumulate(s, ["user_id", "event_type"], 3), "st04"), ["user_id", "event_type"])


@query("""with r as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as total from events), d as (select user_id, event_type, any_value(total) as total, count(*) as n from r where rn <= 5 group by 1, 2),
x as (select *, row_number() over (partition by user_id order by n desc, event_type) as k from d) select user_id, total, event_type as decision from x where k = 1 and total >= 5""")
def st05_monitor(spark, sf):
    """Users with enough events for a decision, and what is decided on their first five, from the stream's final state."""
    s = stateful.table_stream(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    last = stateful.latest(stateful.run_to_end(stateful.monitor(s, "user_id", "event_type", 5, ["ts", "event_id"]), "st05"), ["user_id"])
    return last.where("decision is not null").select("user_id", "total", "decision")


@query("""select 'every' as observer, count(*) as sentences, cast(sum(length(raw)) as bigint) as chars from sentences where raw is not null union all select 'distinct', count(*), cast(sum(length(raw)) as bigint) from (select distinct document_id, raw from sentences where raw is not null)""")
def st01_observers(spark, sf):
    """One stream of sentences told to two observers: one hears every sentence, one each distinct sentence of a document."""
    def count(batch):
        return batch.agg(F.count("*").alias("sentences"), F.sum(F.length("raw")).alias("chars"))

    o = stateful.Observers()
    o.add("every", count)
    o.add("distinct", count, unique=True)
    got = o.run(stateful.table_stream(spark, sf, "sentences").where("raw is not null").select("document_id", "raw"), "document_id", "raw")
    parts = [df.agg(F.sum("sentences").alias("sentences"), F.sum("chars").alias("chars")).select(F.lit(n).alias("observer"), "sentences", "chars") for n, df in sorted(got.items())]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "observer string, sentences long, chars long")


def _sums(spark, sf):
    s = stateful.table_stream(spark, sf, "ngram_uni").where("midasi is not null").select("midasi", "cnt")
    return stateful.run_to_end(stateful.running_sums(s, ["midasi"], "cnt"), "st03")


@query("select midasi, cast(sum(cnt) as bigint) as cnt from ngram_uni where midasi is not null group by 1")
def st03_updated_model(spark, sf):
    """Counts of a language model that go on with every batch that is scanned."""
    return stateful.latest(_sums(spark, sf), ["midasi"])


@query("select midasi, cast(sum(cnt) as bigint) as cnt from ngram_uni where midasi is not null group by 1 having sum(cnt) >= 10")
def st12_state_dump(spark, sf):
    """The whole state of a stream read from its checkpoint; words that are counted often are shown."""
    rows = stateful.state_rows(_sums(spark, sf))
    if rows is None:
        return spark.createDataFrame([], "midasi string, cnt long")
    return rows.select("key.midasi", F.col("value.sum").alias("cnt")).where("cnt >= 10")


@query("select event_type, count(*) as events, count(distinct user_id) as users from events group by 1")
def k12_acquisition_log(spark, sf):
    """What has been seen so far, from the metrics that are observed while the data stream through; kept by kind."""
    s = stateful.table_stream(spark, sf, "events").select("event_type", "user_id").groupBy("event_type", "user_id").count()
    last = stateful.latest(stateful.run_to_end(s, "k12"), ["event_type", "user_id"])
    return last.groupBy("event_type").agg(F.sum("count").alias("events"), F.count("user_id").alias("users"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2")
def st01_windowed_counts(spark, sf):
    """Counts by day of event time; late events count as well."""
    s = stateful.table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return stateful.latest(stateful.run_to_end(stateful.windowed_counts(s, "ts", "event_type"), "st01"), ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(r"""with a as (select regexp_extract_all(raw, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|\S') as a from sentences where raw is not null), e as (select a[i] as kata, coalesce(a[i - 1], '') as front from (select a, unnest(range(1, len(a) + 1)) as i from a)), k as (select front, kata, count(*) as n from e where regexp_matches(kata, '^[ァ-ヴー]+$') group by 1, 2)
select front, kata, n from k where n >= 3""")
def st04_katakana_groups(spark, sf):
    """Examples of katakana words accumulated in state by the word and what stands before it; groups of three and more."""
    s = stateful.table_stream(spark, sf, "sentences").where("raw is not null").select(F.regexp_extract_all("raw", F.lit(r"[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|\S"), F.lit(0)).alias("a"))
    pairs = F.filter(F.transform("a", lambda w, i: F.struct(F.when(i > 0, F.get("a", F.greatest(i - 1, F.lit(0)))).otherwise("").alias("front"), w.alias("kata"))), lambda x: x["kata"].rlike("^[ァ-ヴー]+$"))
    e = s.select(F.explode(pairs).alias("x")).select("x.front", "x.kata")
    last = stateful.latest(stateful.run_to_end(stateful.accumulate(e, ["front", "kata"], 3), "st04k"), ["front", "kata"])
    return last.where("fired").select("front", "kata", "n")


@query(r"""with t as (select unnest(regexp_extract_all(raw, '[ァ-ヴー]+')) as w from sentences where raw is not null), k as (select w, count(*) as n from t group by 1), p as (select a.w, sum(b.n) as related from k a join k b on starts_with(a.w, b.w) or starts_with(b.w, a.w) group by 1)
select w as word, n, cast(related as bigint) as grp from k join p using (w) where related >= 3""")
def st04_prefix_groups(spark, sf):
    """Examples whose word begins with, equals or extends each word: the groups of a trie, by equi-joins on prefixes."""
    t = table(spark, sf, "sentences").where("raw is not null").select(F.explode(F.regexp_extract_all("raw", F.lit("[ァ-ヴー]+"), F.lit(0))).alias("w"))
    k = t.groupBy("w").agg(F.count("*").alias("n"))
    pairs = lookup.prefix_pairs(k, "w")
    up = pairs.join(k.select(F.col("w").alias("longer"), "n"), "longer").select(F.col("shorter").alias("w"), "n")
    down = pairs.join(k.select(F.col("w").alias("shorter"), "n"), "shorter").select(F.col("longer").alias("w"), "n")
    related = up.unionByName(down).unionByName(k).groupBy("w").agg(F.sum("n").alias("grp"))
    return k.join(related, "w").where("grp >= 3").select(F.col("w").alias("word"), "n", "grp")
