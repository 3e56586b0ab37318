"""Suffix and n-gram counting. Partial and final sums are Spark's own; keys are strings, so merging needs no ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def suffix_counts(rows: DataFrame) -> DataFrame:
    """rows(suffix, pos_s, form) -> counts."""
    return rows.groupBy("suffix", "pos_s", "form").agg(F.count("*").alias("cnt"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Partial suffix lists merged."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("suffix", "pos_s", "form").agg(F.sum("cnt").alias("cnt"))


def truncated(counts: DataFrame, longest: int) -> DataFrame:
    return counts.groupBy(F.substring("suffix", 1, longest).alias("suffix"), "pos_s", "form").agg(F.sum("cnt").alias("cnt"))


def best_form(counts: DataFrame) -> DataFrame:
    """Most frequent form of each (suffix, pos_s); among equals the least by code point."""
    best = counts.groupBy("suffix", "pos_s").agg(F.min_by(F.struct("form", "cnt"), F.struct(-F.col("cnt"), F.col("form"))).alias("b"), F.sum("cnt").alias("total"))
    return best.select("suffix", "pos_s", "b.form", "b.cnt", "total")


def bigrams(tokens: DataFrame, by: list[str], order: list[str], word: str, start: str = "$") -> DataFrame:
    """(prev, word, n): neighbouring words of each sequence, with a start mark."""
    w = W.partitionBy(*by).orderBy(*order)
    return tokens.select(F.coalesce(F.lag(word).over(w), F.lit(start)).alias("prev"), word).groupBy("prev", word).agg(F.count("*").alias("n"))


def likelihood(c_pair, c_word, c_boundary_word=None, c_boundary_next=None, c_boundary=None, vocabulary: int = 30_000, pseudo: float = 0.01, mix: float = 0.99):
    """Smoothed probability of the next word, interpolated with the way over a boundary where its counts are given."""
    base = (F.coalesce(c_pair, F.lit(0)) + pseudo) / (F.coalesce(c_word, F.lit(0)) + pseudo * vocabulary)
    if c_boundary_word is None:
        return base
    over = (F.coalesce(c_boundary_word, F.lit(0)) + pseudo) / (F.coalesce(c_word, F.lit(0)) + pseudo * vocabulary) * (F.coalesce(c_boundary_next, F.lit(0)) + pseudo) / (F.coalesce(c_boundary, F.lit(0)) + pseudo * vocabulary)
    return mix * base + (1 - mix) * over
