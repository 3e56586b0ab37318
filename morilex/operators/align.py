"""Comparing two segmentations of the same text, within the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(words: Column) -> Column:
    """End offsets of the words of an array."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(words, zero, lambda acc, w: F.struct((acc["at"] + F.length(w)).alias("at"), F.array_append(acc["ends"], acc["at"] + F.length(w)).alias("ends")), lambda acc: acc["ends"])


def cut_counts(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adds cuts, common, only_first, only_second: how far two segmentations of one text agree."""
    d = df.withColumn("_x", cuts(F.col(first))).withColumn("_y", cuts(F.col(second)))
    return d.select("row_id", F.size(F.array_union("_x", "_y")).cast("long").alias("cuts"), F.size(F.array_intersect("_x", "_y")).cast("long").alias("common"), F.size(F.array_except("_x", "_y")).cast("long").alias("only_first"), F.size(F.array_except("_y", "_x")).cast("long").alias("only_second"))


def regions(first: list[str], second: list[str]) -> list[tuple[int, int, list[str], list[str]]]:
    """Maximal stretches in which two segmentations disagree: (start, end, words of the first, words of the second)."""
    out, i, j, at_i, at_j, start = [], 0, 0, 0, 0, 0
    a: list[str] = []
    b: list[str] = []
    while i < len(first) or j < len(second):
        if at_i <= at_j and i < len(first):
            a.append(first[i])
            at_i += len(first[i])
            i += 1
        elif j < len(second):
            b.append(second[j])
            at_j += len(second[j])
            j += 1
        else:
            raise ValueError("the segmentations are of different texts")
        if at_i == at_j and a and b:
            if a != b:
                out.append((start, at_i, a, b))
            start, a, b = at_i, [], []
    return out
