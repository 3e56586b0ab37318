"""Problem 2: items that appear together, and how far that exceeds chance.

Method. Exact counts of every pair of items, and of the baskets (documents) it occurs in, are compared with a fitted
bipartite configuration null. Under the null the stubs of items meet the stubs of baskets at random: a basket with s pair
slots holds the pair {a, b} with probability 1 - exp(-s * rate), rate = 2 x_a x_b / Z, where the weights x are fitted so
that every item's expected number of pair slots is the observed one (self-pairs excluded; one fixed-point equation for
each distinct item frequency, one scalar Z). The number of baskets with the pair is then Poisson-binomial over the
baskets' sizes; its upper tail is the p-value, and the Benjamini-Hochberg procedure over all possible pairs controls the
false-discovery rate.

Baskets of like size (within 5 %, exact up to 20 slots) are taken at their mean size, which keeps the number of slots.

What reaches the driver: the histogram of item frequencies and the histogram of basket sizes. Distinct whole numbers that
add up to S are fewer than 2 * sqrt(S), which bounds both. Pairs are counted with map-side partial sums; a pair that
fills a third of all rows is spread over its baskets first.

Defined results: records equal in all columns but loaded_at count once; null items and the border marks form no pairs;
an item does not pair with itself; empty tables give no pairs.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .termcounts import counted_word

ALPHA = 0.05


def fit_null(degrees: np.ndarray, items: np.ndarray, rounds: int = 10_000) -> tuple[np.ndarray, float]:
    """Weights x by item frequency, and Z = 1 - sum x^2: solves x (1 - x) = k Z / (2 S) for every frequency k, sum x = 1.

    Rounds go on until Z stands still; a warning tells if it does not.
    """
    k, n = degrees.astype(float), items.astype(float)
    total = float((k * n).sum())  # = 2 S
    if total <= 0:
        return np.zeros_like(k), 1.0
    x, z = k / total, 1.0
    for _ in range(rounds):
        new = (1 - np.sqrt(np.maximum(0.0, 1 - 4 * k * z / total))) / 2
        share = float((new * n).sum())
        new = new / share if share > 0 else new
        z_new = max(1e-12, 1 - float((new * new * n).sum()))
        done = abs(z_new - z) < 1e-12
        x, z = new, z_new
        if done:
            break
    else:
        warnings.warn(f"the null has not converged: Z still moves at {z}", stacklevel=2)
    return x, z


def size_classes(sizes: np.ndarray, baskets: np.ndarray, ratio: float = 1.05) -> tuple[np.ndarray, np.ndarray]:
    """Basket sizes in classes a ratio wide (exact below 1 / (ratio - 1)), each with its mean size: slots stay exact."""
    if not len(sizes):
        return np.zeros(0), np.zeros(0)
    c = np.where(sizes < 1 / (ratio - 1), sizes, np.floor(np.log(np.maximum(sizes, 1)) / math.log(ratio)) + 1e6)
    frame = pd.DataFrame({"c": c, "slots": sizes * baskets, "m": baskets}).groupby("c").sum()
    return (frame.slots / frame.m).to_numpy(float), frame.m.to_numpy(float)


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def upper_tail(rate: np.ndarray, seen: np.ndarray, sizes: np.ndarray, baskets: np.ndarray) -> np.ndarray:
    """P(D >= seen) for D Poisson-binomial with baskets[c] trials of probability 1 - exp(-sizes[c] * rate).

    One and two baskets are exact; beyond, the saddlepoint approximation with lattice correction (Lugannani and Rice).
    """
    out = np.ones(len(rate))
    if not len(rate) or not len(sizes):
        return out
    step = max(1, 2_000_000 // len(sizes))
    for at in range(0, len(rate), step):
        r, d = rate[at : at + step, None], seen[at : at + step].astype(float)
        p = -np.expm1(-r * sizes)  # rows x classes
        none = np.exp(-(r[:, 0] * float((sizes * baskets).sum())))
        one = none * (baskets * np.expm1(r * sizes)).sum(1)
        mean = (baskets * p).sum(1)
        res = np.where(d <= 1, -np.expm1(-(r[:, 0] * float((sizes * baskets).sum()))), np.where(d <= 2, np.maximum(0, 1 - none - one), 1.0))
        far = (d >= 3) & (d > mean + 1e-9) & (d < baskets.sum())
        if far.any():
            q, df = p[far], d[far] - 0.5  # second lattice correction: shifted by half a basket
            t = np.log(df / np.maximum(mean[far], 1e-300))
            for _ in range(30):
                e = np.exp(np.minimum(t, 700))[:, None]
                w = q * e / (1 - q + q * e)
                k1, k2 = (baskets * w).sum(1), (baskets * w * (1 - w)).sum(1)
                move = (k1 - df) / np.maximum(k2, 1e-300)
                t = t - np.clip(move, -5, 5)
                if np.abs(move).max() < 1e-9:
                    break
            e = np.exp(np.minimum(t, 700))[:, None]
            w = q * e / (1 - q + q * e)
            k2 = (baskets * w * (1 - w)).sum(1)
            k0 = (baskets * np.log1p(q * (e - 1))).sum(1)
            omega = np.sign(t) * np.sqrt(np.maximum(0, 2 * (t * df - k0)))
            u = 2 * np.sinh(t / 2) * np.sqrt(k2)
            dens = np.exp(-omega * omega / 2) / math.sqrt(2 * math.pi)
            ok = (np.abs(t) > 1e-4) & (omega > 1e-6)
            tail = 0.5 * _erfc(omega / math.sqrt(2)) + np.where(ok, dens * (1 / np.where(ok, u, 1) - 1 / np.where(ok, omega, 1)), 0)
            res[far] = np.clip(np.where(ok, tail, 0.5), 0, 1)
        near = (d >= 3) & ~far
        if near.any():
            sd = np.sqrt(np.maximum((baskets * p * (1 - p)).sum(1)[near], 1e-12))
            res[near] = np.where(d[near] > baskets.sum(), 0.0, 0.5 * _erfc((d[near] - 0.5 - mean[near]) / sd / math.sqrt(2)))
        all_of_them = d == baskets.sum()
        if all_of_them.any():
            res[all_of_them] = np.exp((baskets * np.log(np.maximum(p[all_of_them], 1e-300))).sum(1))
        out[at : at + step] = res
    return out


def pair_counts(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events(a, b, basket, cnt), a < b -> (pairs: a, b, n_ab, baskets), (sizes: basket, slots). Both exact."""
    per = common.written(events.groupBy("a", "b", "basket").agg(F.sum("cnt").alias("cnt")), "pair-baskets")
    pairs = per.groupBy("a", "b").agg(F.sum("cnt").alias("n_ab"), F.count("basket").alias("baskets"))
    return common.written(pairs, "pairs"), per.groupBy("basket").agg(F.sum("cnt").alias("slots"))


def surprise(pairs: DataFrame, sizes: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """pairs with expected number of baskets, p_value and significant (false-discovery rate alpha over all pairs)."""
    spark = pairs.sparkSession
    items = pairs.select(F.explode(F.array("a", "b")).alias("item"), "n_ab").groupBy("item").agg(F.sum("n_ab").alias("k"))
    items = common.written(items, "pair-items")
    deg = items.groupBy("k").agg(F.count("*").alias("n")).toPandas().sort_values("k")
    hist = sizes.where(F.col("basket").isNotNull()).groupBy("slots").agg(F.count("*").alias("n")).toPandas().sort_values("slots")
    x, z = fit_null(deg.k.to_numpy(), deg.n.to_numpy())
    s, m = size_classes(hist.slots.to_numpy(float), hist.n.to_numpy(float))
    slots, n_items = float((s * m).sum()), int(deg.n.sum()) if len(deg) else 0
    # weights by frequency: fewer than 2 * sqrt(slots) rows
    weight = spark.createDataFrame(pd.DataFrame({"k": deg.k.astype("int64"), "x": x}), T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType())]))
    w = items.join(F.broadcast(weight), "k").select("item", "x", "k")
    # an item that is in a third of all pairs is spread over many places
    got = common.join_hot(pairs, w.select(F.col("item").alias("a"), F.col("x").alias("x_a"), "k"), ["a"], "k")
    got = common.join_hot(got, w.select(F.col("item").alias("b"), F.col("x").alias("x_b"), "k"), ["b"], "k")
    got = got.withColumn("rate", F.lit(2.0 / z) * F.col("x_a") * F.col("x_b")).drop("x_a", "x_b")
    got = got.withColumn("expected_slots", F.col("rate") * F.lit(slots))

    def tails(batches):
        for b in batches:
            yield b.assign(p=upper_tail(b["rate"].to_numpy(), b["baskets"].to_numpy(), s, m))

    # one or two baskets are closed forms or rare enough to share: the tail is computed once for each distinct (rate, count)
    several = got.where("baskets >= 2").groupBy("rate", "baskets").count().drop("count").mapInPandas(tails, T.StructType([T.StructField("rate", T.DoubleType()), T.StructField("baskets", T.LongType()), T.StructField("p", T.DoubleType())]))
    got = got.join(several, ["rate", "baskets"], "left").withColumn("p_value", F.coalesce("p", -F.expm1(-F.col("expected_slots")))).drop("p", "rate")
    got = common.written(got, "pair-tails")
    tests = n_items * (n_items - 1) / 2
    by_p = common.prefix_sum(got.groupBy("p_value").agg(F.count("*").alias("n")), ["p_value"], F.col("n"), "rank", "pair-ranks")
    cut = by_p.where(F.col("p_value") * F.lit(float(tests)) <= F.col("rank") * F.lit(alpha)).agg(F.max("p_value")).first()[0]
    return got.withColumn("significant", F.col("p_value") <= F.lit(cut) if cut is not None else F.lit(False))


def occurrences(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events a, b, basket, cnt of neighbouring words; distinct counted rows of the single words)."""
    fbi = common.read(spark, sf_dir, "ngram_fbi")
    kept = fbi.where(counted_word(F.col("w1.midasi")) & counted_word(F.col("w2.midasi")) & F.col("w1.repname").isNotNull() & F.col("w2.repname").isNotNull() & (F.col("w1.repname") != F.col("w2.repname")))
    # equal records in a basket count once, by all of their columns: a and b with `turned` are the two names
    kept = kept.select(F.least("w1.repname", "w2.repname").alias("a"), F.greatest("w1.repname", "w2.repname").alias("b"), F.col("document_id").alias("basket"), "cnt", "shard_id", (F.col("w1.repname") > F.col("w2.repname")).alias("turned"), F.col("w1.midasi").alias("m1"), F.col("w2.midasi").alias("m2"), F.col("w1.word_class").alias("c1"), F.col("w2.word_class").alias("c2"))
    # partitioned once by pair and basket: duplicates and sums within a basket need no further shuffle
    events = kept.repartition("a", "b", "basket").distinct()
    uni = common.read(spark, sf_dir, "ngram_uni").where(counted_word(F.col("midasi"))).select("shard_id", "document_id", "midasi", "repname", "word_class", "cnt").distinct()
    return events.select("a", "b", "basket", "cnt"), uni


def p2_surprise(spark, sf_dir: str) -> DataFrame:
    """Every pair of representative names: counts, lift over the single counts, and surprise under the null."""
    events, uni = occurrences(spark, sf_dir)
    pairs, sizes = pair_counts(events)
    n = common.written(uni.groupBy("repname").agg(F.sum("cnt").alias("n")), "uni-counts")
    total = n.agg(F.sum("n")).first()[0] or 0
    got = surprise(pairs, sizes)
    n_a = n.where("repname is not null").select(F.col("repname").alias("a"), F.col("n").alias("n_a"))
    n_b = n.where("repname is not null").select(F.col("repname").alias("b"), F.col("n").alias("n_b"))
    # an item's occurrences bound its pairs only loosely: hot is what holds a large share of them
    got = common.join_hot(got, n_a.withColumn("k", F.col("n_a")), ["a"], "k", "left")
    got = common.join_hot(got, n_b.withColumn("k", F.col("n_b")), ["b"], "k", "left")
    return got.select(F.col("a").alias("repname_a"), F.col("b").alias("repname_b"), "n_ab", F.col("baskets").alias("docs"), "n_a", "n_b", F.lit(total).cast("long").alias("n_all"), "expected_slots", "p_value", "significant")


def p2_counts(spark, sf_dir: str) -> DataFrame:
    """The exact counts of every pair and of its two names, as the operator holds them."""
    return p2_surprise(spark, sf_dir).select("repname_a", "repname_b", "n_ab", "docs", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Pairs far beyond chance: significant under the null at the false-discovery rate, at least 8 times in at least 5
    documents, and ten times the product of the single shares."""
    got = p2_surprise(spark, sf_dir).where("significant and n_ab >= 8 and docs >= 5 and n_a is not null and n_b is not null")
    wide = "decimal(38,0)"
    return got.where(F.col("n_ab").cast(wide) * F.col("n_all") >= F.col("n_a").cast(wide) * F.col("n_b") * 10).select("repname_a", "repname_b")
