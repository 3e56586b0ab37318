"""Agreement, accuracy and divergence. Each needs one or two aggregations over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels: one row (observed, expected, kappa)."""
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    margins = df.select(F.explode(F.array(F.struct(F.col(a).alias("k"), F.lit(1).alias("x"), F.lit(0).alias("y")), F.struct(F.col(b).alias("k"), F.lit(0).alias("x"), F.lit(1).alias("y")))).alias("m")).groupBy("m.k").agg(F.sum("m.x").alias("x"), F.sum("m.y").alias("y"))
    chance = margins.agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    xy = chance.first()["xy"] or 0
    po, pe = F.col("same") / F.col("n"), F.lit(xy) / (F.col("n") * F.col("n"))
    return n.select(F.round(po, 6).alias("observed"), F.round(pe, 6).alias("expected"), F.round((po - pe) / (1 - pe), 6).alias("kappa"))


def precision_recall(df: DataFrame, found: Column, right: Column) -> DataFrame:
    both, f, r = F.count_if(found & right), F.count_if(found), F.count_if(right)
    return df.agg(F.round(both / f, 6).alias("precision"), F.round(both / r, 6).alias("recall"), F.round(F.lit(2.0) * both / (f + r), 6).alias("f1"), F.count_if(found & ~right).alias("false_positives"), F.count_if(~found & right).alias("misses"))


def mcnemar(b: int, c: int) -> tuple[float, float]:
    """Chi-square with continuity correction for discordant counts b and c, and its p-value (one degree of freedom)."""
    import math

    if b + c == 0:
        return 0.0, 1.0
    x = max(0.0, abs(b - c) - 1) ** 2 / (b + c)
    return x, math.erfc(math.sqrt(x / 2))


def cluster_accuracy(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Share of rows whose label is the most frequent one of their cluster."""
    m = df.groupBy(cluster, label).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return m.agg(F.round(F.sum("top") / F.sum("n"), 6).alias("accuracy"), F.sum("n").alias("n"))


def skew_divergence(counts: DataFrame, group: str, item: str, n: str, alpha: float) -> DataFrame:
    """sum q log(q / (alpha r + (1 - alpha) q)) of each group's distribution q from that of all, r."""
    q = counts.groupBy(group).agg(F.sum(n).alias("_total"))
    all_n = counts.groupBy(item).agg(F.sum(n).alias("_r"))
    total = counts.agg(F.sum(n)).first()[0] or 1
    j = counts.join(q, group).join(all_n, item).select(group, (F.col(n) / F.col("_total")).alias("q"), (F.col("_r") / F.lit(total)).alias("r"))
    return j.groupBy(group).agg(F.round(F.sum(F.col("q") * F.log(F.col("q") / (alpha * F.col("r") + (1 - alpha) * F.col("q")))), 6).alias("divergence"))


def share_over(c: Column, *by: str) -> Column:
    return c / F.sum(c).over(W.partitionBy(*by))


def gaussian(key: Column, mean: float, deviation: float) -> Column:
    """A normal draw for each key, the same for the same key: two uniform numbers of its digest, transformed (Box and Muller)."""
    part = lambda at: F.conv(F.substring(F.md5(key), at, 8), 16, 10).cast("double")
    a, b = (part(1) + 1) / 4294967297.0, part(9) / 4294967296.0
    return mean + deviation * F.sqrt(-2 * F.log(a)) * F.cos(2 * F.pi() * b)


def matches(text: Column, pattern: str) -> Column:
    """[(start, end)] of the matches of a pattern in a text, from 0, in the JVM: what stands between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, m):
        # matches come in their order: the next one starts where this text stands next
        start = F.call_function("locate", m, text, acc["at"] + 1) - 1
        return F.struct((start + F.length(m)).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + F.length(m)).alias("end"))).alias("out"))

    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def regions(tagged: Column, tag: str) -> Column:
    """[(start, end)] of the regions <tag>...</tag> of a tagged text, as places in the text without tags. Tags do not nest."""
    parts = F.split(tagged, f"</?{tag}>", -1)
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc, p):
        end = acc["at"] + F.length(p)
        out = F.when(acc["inside"], F.array_append(acc["out"], F.struct(acc["at"].alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])
