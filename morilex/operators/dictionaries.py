"""Dictionaries: cleaning, registration, links between variants, and versioned publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars, kana
from .lookup import grams, overlap_pairs


def stems(entries: DataFrame) -> DataFrame:
    """Adds `stem` (marked, or the first spelling by code point) and `pos_s`."""
    first = F.array_min(F.map_keys("midasi"))
    return entries.withColumn("stem", F.coalesce(F.try_element_at("annotation", F.lit("stem")), first)).withColumn("pos_s", F.coalesce(chars.pos_name(F.col("hinsi"), F.col("bunrui"), F.col("katuyou1")), F.col("hinsi")))


def cleaned(entries: DataFrame, suffixes: DataFrame, stop: DataFrame, least_count: int = 0, safe: bool = False) -> DataFrame:
    """Entries without malformed words, function words, stop words and rare ones; stricter in safe mode.

    entries: with stem, pos_s and cnt; suffixes(suffix), stop(stem).
    """
    e = entries.where(~chars.bad_word(F.col("stem"), F.col("pos_s")) & F.length("stem").between(1, 129))
    if safe:
        e = e.where(~chars.unsafe_word(F.col("stem"), F.col("pos_s")))
    function = suffixes.select(F.col("suffix").alias("stem")).where(F.length("stem") <= 5).distinct()
    e = e.join(function, "stem", "left_anti").join(stop.select("stem").distinct(), "stem", "left_anti")
    # katakana nominals are easily found: twice the evidence is asked for
    need = F.when(F.col("stem").rlike("^[ァ-ヴー]+$") & F.col("pos_s").isin(*chars.NOUN_LIKE), 2 * least_count).otherwise(least_count)
    return e.where(F.coalesce("cnt", F.lit(0)) >= need)


def without_conflicts(entries: DataFrame) -> DataFrame:
    """A consonant verb in ra removes the vowel verb of its stem; one in ka removes the vowel verb of stem + い."""
    ra = entries.where("pos_s = '子音動詞ラ行'").select("stem")
    ka = entries.where("pos_s = '子音動詞カ行'").select(F.concat("stem", F.lit("い")).alias("stem"))
    gone = ra.unionByName(ka).distinct().withColumn("pos_s", F.lit("母音動詞"))
    return entries.join(gone, ["stem", "pos_s"], "left_anti")


def majority(rivals: DataFrame) -> DataFrame:
    """rivals(stem, pos_s, score, cnt): the part of speech of the largest score for each stem, counts summed; an adverb
    whose count is larger than all others' wins."""
    best = rivals.groupBy("stem").agg(F.max_by("pos_s", F.struct("score", "cnt", "pos_s")).alias("best"), F.max_by("pos_s", F.struct("cnt", "pos_s")).alias("largest"), F.sum("cnt").alias("cnt"))
    return best.select("stem", F.when(F.col("largest") == "副詞", "副詞").otherwise(F.col("best")).alias("pos_s"), "cnt")


def register(found: DataFrame, known: DataFrame, suffixes: DataFrame, safe: bool = False) -> DataFrame:
    """found(stem, pos_s, cnt) with `outcome`: registered, or why not, in the order of the checks."""
    have = known.select("stem", "pos_s", F.lit(True).alias("_known")).distinct()
    function = suffixes.select(F.col("suffix").alias("stem"), F.lit(True).alias("_function")).where(F.length("stem") <= 5).distinct()
    j = found.join(have, ["stem", "pos_s"], "left").join(function, "stem", "left")
    why = F.when(F.col("_known"), "known").when(F.col("_function"), "function word").when(chars.bad_word(F.col("stem"), F.col("pos_s")), "malformed")
    if safe:
        why = why.when(chars.unsafe_word(F.col("stem"), F.col("pos_s")), "unsafe")
    return j.withColumn("outcome", why.otherwise("registered")).drop("_known", "_function")


def event_log(registered: DataFrame) -> DataFrame:
    """(event, stem, pos_s, n): what happened to found words, from rows with stem, pos_s, cnt and outcome."""
    seen = registered.select(F.lit("example").alias("event"), "stem", "pos_s", F.col("cnt").alias("n"))
    what = F.when(F.col("outcome") == "registered", "append").otherwise(F.concat(F.lit("reject: "), F.col("outcome")))
    done = registered.select(what.alias("event"), "stem", "pos_s", F.lit(1).cast("long").alias("n"))
    # examples are deleted whatever became of the word
    gone = registered.where("cnt > 0").select(F.lit("delete examples").alias("event"), "stem", "pos_s", F.col("cnt").alias("n"))
    return seen.unionByName(done).unionByName(gone)


def variants_by_distance(entries: DataFrame, least_overlap: float = 0.6, most_length: int = 2, most_distance: float = 0.5) -> DataFrame:
    """(a, b, distance): entries whose readings are close: trigrams of the romanised reading, length, part of speech and
    weighted distance. entries(entry_id, yomi, hinsi, bunrui, katuyou1).

    There are few trigrams and all are common, so up to kana.NEAR distinct readings are brought together by the keys of
    their distance; beyond, by trigrams. Entries come to the pairs of readings that are close.
    """
    e = entries.where("yomi is not null")
    readings = e.groupBy("yomi").agg(F.count("*").alias("n"))
    hira = lambda c: F.translate(chars.hiragana(F.col(c)), "ゕ", "ヵ")  # noqa: E731  the tables of letters and costs have ヵ
    roman = lambda c: kana.romanize_udf(hira(c))
    if most_distance <= kana.NEAR:
        keyed = readings.select("yomi", kana.near_keys_udf(hira("yomi")).alias("ks"))
        own = keyed.select(F.col("yomi").alias("x"), F.element_at("ks", 1).alias("k"))
        pairs = keyed.select(F.col("yomi").alias("y"), F.explode("ks").alias("k")).join(own, "k").where("x <> y").select(F.least("x", "y").alias("ya"), F.greatest("x", "y").alias("yb")).distinct()
    else:
        pairs = overlap_pairs(readings.withColumn("roman", roman("yomi")), "yomi", "roman", 3, least_overlap).select(F.col("key_a").alias("ya"), F.col("key_b").alias("yb"))
    pairs = pairs.unionByName(readings.where("n > 1").select(F.col("yomi").alias("ya"), F.col("yomi").alias("yb")))
    pairs = pairs.where(F.abs(F.length("ya") - F.length("yb")) <= most_length).withColumns({"ra": roman("ya"), "rb": roman("yb")}).withColumns({"ga": grams(F.col("ra"), 3), "gb": grams(F.col("rb"), 3)})
    pairs = pairs.where(F.try_divide(F.size(F.array_intersect("ga", "gb")), F.least(F.size("ga"), F.size("gb"))) >= least_overlap)
    close = pairs.select("ya", "yb").withColumn("distance", kana.distance_udf(hira("ya"), hira("yb"))).where(F.col("distance") <= most_distance)
    side = lambda p: e.select(F.col("yomi").alias(f"y{p}"), *[F.col(c).alias(f"{p}_{c}") for c in ("entry_id", "hinsi", "bunrui", "katuyou1")])
    j = close.join(side("a"), "ya").join(side("b"), "yb").where("a_entry_id < b_entry_id or (ya <> yb and a_entry_id <> b_entry_id)")
    j = j.where(chars.pos_consistent(*[F.col(f"{p}_{c}") for p in "ab" for c in ("hinsi", "bunrui", "katuyou1")]))
    return j.select(F.least("a_entry_id", "b_entry_id").alias("a"), F.greatest("a_entry_id", "b_entry_id").alias("b"), F.round("distance", 6).alias("distance"))


def similar(features: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds `cosine` of the feature vectors of each pair: features(item, feature, n), pairs(a, b)."""
    norm = features.groupBy("item").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    fa = features.select(F.col("item").alias("a"), "feature", F.col("n").alias("x"))
    fb = features.select(F.col("item").alias("b"), "feature", F.col("n").alias("y"))
    dot = pairs.select("a", "b").distinct().join(fa, "a").join(fb, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    j = pairs.join(dot, ["a", "b"], "left").join(norm.select(F.col("item").alias("a"), F.col("norm").alias("na")), "a", "left").join(norm.select(F.col("item").alias("b"), F.col("norm").alias("nb")), "b", "left")
    return j.withColumn("cosine", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))).drop("dot", "na", "nb")


def versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def publish(df: DataFrame, path: str) -> int:
    """Writes a dictionary as the next version; readers see it only when it is complete."""
    n = (versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.parquet(f"{path}/version={n}")
    return n


def append(df: DataFrame, path: str) -> int:
    """The next version: the last one and more entries."""
    have = versions(df.sparkSession, path)
    return publish(df.sparkSession.read.parquet(f"{path}/version={have[-1]}").unionByName(df) if have else df, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    have = versions(spark, path)
    if not have:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version={have[-1]}")


