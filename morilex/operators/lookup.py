"""Joins on words: dictionary look-up, prefixes, containment, approximate strings. All are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond, Spark's own planning decides.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven small: its rows are counted up to the bound, never beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def prefixes(c: Column, shortest: int = 1, longest: int | None = None) -> Column:
    """All prefixes of a string, short to long."""
    top = F.length(c) if longest is None else F.least(F.length(c), F.lit(longest))
    return F.when(top >= shortest, F.transform(F.sequence(F.lit(shortest), top), lambda n: F.substring(c, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def grams(c: Column, n: int) -> Column:
    """Distinct n-grams of a string."""
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dictionary_lookup(tokens: DataFrame, entries: DataFrame, on: str, constraints: dict[str, list] | None = None) -> DataFrame:
    """Tokens with the entries of their headword; each constraint names the values an attribute may have."""
    for c, values in (constraints or {}).items():
        entries = entries.where(F.col(c).isin(*values))
    return tokens.join(entries, on)


def prefix_pairs(words: DataFrame, word: str) -> DataFrame:
    """(shorter, longer): distinct words of which one is a proper prefix of the other. Prefixes are exploded, then equal."""
    w = words.select(F.col(word).alias("w")).where(F.length("w") > 0).distinct()
    exploded = w.select(F.col("w").alias("longer"), F.explode(prefixes(F.col("w"))).alias("shorter")).where("shorter <> longer")
    return exploded.join(w.withColumnRenamed("w", "shorter"), "shorter").select("shorter", "longer")


def longest_prefix(words: DataFrame, word: str, listed: DataFrame, prefix: str, longest: int) -> DataFrame:
    """(word, prefix): for each distinct word the longest listed prefix."""
    w = words.select(F.col(word).alias("word")).where(F.length("word") > 0).distinct()
    hits = w.select("word", F.explode(prefixes(F.col("word"), 1, longest)).alias("prefix")).join(listed.select(F.col(prefix).alias("prefix")).distinct(), "prefix")
    return hits.groupBy("word").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def contained_in(inner: DataFrame, a: str, outer: DataFrame, b: str, n: int = 2) -> DataFrame:
    """(a, b): distinct words of `inner` that stand within, and are not, a distinct word of `outer`.

    Candidates share the inner word's n-gram that is rarest in `outer`, so a common n-gram never brings a whole block
    together. Words shorter than n are looked up among the grams of their own length.
    """
    small_words = inner.select(F.col(a).alias("w")).where(F.length(a) > 0).distinct()
    large_words = outer.select(F.col(b).alias("o")).where(F.length(b) > 0).distinct()
    out = None
    for size in range(1, n + 1):
        own = small_words.where(F.length("w") == size) if size < n else small_words.where(F.length("w") >= n)
        by_gram = large_words.select("o", F.explode(grams(F.col("o"), size)).alias("g"))
        often = by_gram.groupBy("g").agg(F.count("*").alias("n"))
        asked = own.select("w", F.explode(grams(F.col("w"), size)).alias("g")).join(often, "g", "left")
        # a word with a gram that no outer word has stands in none
        rarest = asked.groupBy("w").agg(F.min_by("g", F.struct("n", "g")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("all")).where("all").drop("all")
        hit = rarest.join(by_gram, "g").where((F.col("w") != F.col("o")) & (F.instr("o", F.col("w")) > 0)).select(F.col("w").alias(a), F.col("o").alias(b))
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def contained_pairs(words: DataFrame, word: str, n: int = 2) -> DataFrame:
    """(inner, outer): distinct words of any length where inner stands within outer."""
    w = words.select(F.col(word).alias("w"))
    return contained_in(w.select(F.col("w").alias("inner")), "inner", w.select(F.col("w").alias("outer")), "outer", n)


def overlap_pairs(words: DataFrame, key: str, text: str, n: int = 3, least: float = 0.6) -> DataFrame:
    """(key_a, key_b, overlap): distinct texts sharing at least `least` of the n-grams of the one that has fewer.

    Prefix filtering: n-grams are ordered from rare to common; two sets that share so much must share one of the first
    size - ceil(least * size) + 1 grams of the smaller set, so only those of the smaller side are joined.
    """
    w = words.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") >= n).distinct()
    by_gram = w.select("k", F.explode(grams(F.col("t"), n)).alias("g"))
    often = by_gram.groupBy("g").agg(F.count("*").alias("f"))
    ranked = by_gram.join(often, "g").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("gs")).select("k", F.transform("gs", lambda x: x["g"]).alias("gs")).withColumn("size", F.size("gs"))
    probe = ranked.select(F.col("k").alias("ka"), F.col("size").alias("na"), F.explode(F.slice("gs", F.lit(1), F.col("size") - F.ceil(F.lit(least) * F.col("size")).cast("int") + 1)).alias("g"))
    index = ranked.select(F.col("k").alias("kb"), F.col("size").alias("nb"), F.explode("gs").alias("g"))
    # candidates are keys only; the grams of each come to them afterwards
    both = probe.join(index, "g").where("(na < nb) or (na = nb and ka <> kb)").select("ka", "kb", "na").distinct()
    sets = lambda x: ranked.select(F.col("k").alias(f"k{x}"), F.col("gs").alias(f"g{x}"))
    scored = both.join(sets("a"), "ka").join(sets("b"), "kb").withColumn("overlap", F.size(F.array_intersect("ga", "gb")) / F.col("na")).where(F.col("overlap") >= least)
    return scored.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "overlap").distinct()


def unique_candidate(hits: DataFrame, by: str, candidate: str) -> DataFrame:
    """Rows of `by` that have exactly one distinct candidate."""
    return hits.groupBy(by).agg(F.min(candidate).alias(candidate), F.count_distinct(candidate).alias("n")).where("n = 1").drop("n")
