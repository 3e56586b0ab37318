"""Detection of suspicious words: skip marks of rules by a fold over the sentence, and likelihood ratios of n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import likelihood

THRESHOLD = 0.001


def fold_detections(words: Column, features: Column) -> Column:
    """Positions (from 0) that are detected in a sentence, by a fold that skips.

    features: for each word SKIP (the word and two more), SINGLESKIP (this word), another name (detected unless skipped),
    or null. After a detection nothing is looked for until the word before a separator.
    """
    pairs = F.arrays_zip(words.alias("w"), features.alias("f"))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("skip"), F.lit(False).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        word, name = x["w"], x["f"]
        separator = word.rlike("^[、。，．！？…「」『』（）()：；／]$")
        skipping = acc["skip"] > 0
        left = F.greatest(acc["skip"] - 1, F.lit(0))
        hit = ~acc["held"] & name.isNotNull() & ~name.isin("SKIP", "SINGLESKIP") & ~skipping
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(F.coalesce(name == "SKIP", F.lit(False)), 2).otherwise(left).alias("skip"),
            (~separator & (acc["held"] | F.coalesce(hit, F.lit(False)))).alias("held"),
            F.when(F.coalesce(hit, F.lit(False)), F.array_append(acc["out"], acc["i"])).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def suspicious_pairs(pairs: DataFrame, uni: DataFrame, spellings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Observed words whose other spellings hardly ever stand before the word that follows.

    pairs(a, b, n): counts of a before b; uni(w, n): counts of words; spellings(a, other): other spellings of a. For each
    (a, b): P(b | a) and the pooled P(b | other spellings); suspicious if the ratio is below the threshold. Missing counts
    are zero.
    """
    base = pairs.join(uni.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a", "left")
    alt = base.select("a", "b").join(spellings, "a")
    alt = alt.join(pairs.select(F.col("a").alias("other"), "b", F.col("n").alias("k")), ["other", "b"], "left").join(uni.select(F.col("w").alias("other"), F.col("n").alias("u")), "other", "left")
    pooled = alt.groupBy("a", "b").agg(F.sum(F.coalesce("k", F.lit(0))).alias("k"), F.sum(F.coalesce("u", F.lit(0))).alias("u"))
    j = base.join(pooled, ["a", "b"])
    return j.select("a", "b", "n", likelihood(F.col("n"), F.col("n_a")).alias("p"), likelihood(F.col("k"), F.col("u")).alias("p_other")).withColumn("suspicious", F.col("p_other") / F.col("p") < threshold)


def take_while(words: Column, stop: str) -> Column:
    """Words joined up to (without) the first that matches `stop`."""
    start = F.struct(F.lit("").alias("s"), F.lit(True).alias("go"))
    return F.aggregate(words, start, lambda acc, w: F.struct(F.when(acc["go"] & ~w.rlike(stop), F.concat(acc["s"], w)).otherwise(acc["s"]).alias("s"), (acc["go"] & ~w.rlike(stop)).alias("go")), lambda acc: acc["s"])


def boundaries(words: Column, longest: int) -> Column:
    """End offsets of the words until they pass `longest`: where a candidate may end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(words, start, lambda acc, w: F.struct((acc["at"] + F.length(w)).alias("at"), F.when(acc["at"] + F.length(w) <= longest, F.array_append(acc["ends"], acc["at"] + F.length(w))).otherwise(acc["ends"]).alias("ends")), lambda acc: acc["ends"])
