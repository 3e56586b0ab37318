"""Linear learners, Naive Bayes and iterative parameter mixing.

Training rows are sparse: (row_id, label, feats array<struct<fid,v>>). Sequential updates run within a shard, which is a
partition of ROWS_PER_SHARD rows that streams through its task in Arrow batches; between epochs the weights of all shards
are averaged. A model has at most classes x features weights; its size is checked before it is broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lookup import small
from .storage import written

MAX_WEIGHTS = 50_000_000
ROWS_PER_SHARD = 100_000
#: Weights up to which a model is broadcast for scoring; beyond, instances are joined with it.
MAX_BROADCAST = 5_000_000


class Learner:
    """Multiclass linear learner; subclasses say how one row moves the weights. Class with the largest score, ties to the lowest."""

    def __init__(self, classes: int, features: int):
        if classes * features > MAX_WEIGHTS:
            raise ValueError(f"{classes * features} weights; at most {MAX_WEIGHTS} are kept in one place")
        self.w = np.zeros((classes, features))

    def scores(self, fid: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.w[:, fid] @ v

    def step(self, y: int, fid: np.ndarray, v: np.ndarray) -> None:
        raise NotImplementedError

    def result(self) -> np.ndarray:
        return self.w


class Perceptron(Learner):
    """Promotes the right class; demotes every class that scores higher than it, but never class 0, the rest."""

    def step(self, y, fid, v):
        s = self.scores(fid, v)
        if int(s.argmax()) == y and (s == s.max()).sum() == 1:
            return
        self.w[y, fid] += v
        for k in np.flatnonzero(s > s[y]) if (s > s[y]).any() else [int(s.argmax())] if int(s.argmax()) != y else []:
            if k:
                self.w[k, fid] -= v


class AveragedPerceptron(Perceptron):
    """Weights averaged over all steps, by the usual running correction."""

    def __init__(self, classes, features):
        super().__init__(classes, features)
        self.sum, self.t = np.zeros_like(self.w), 1

    def step(self, y, fid, v):
        before = self.w[:, fid].copy()
        super().step(y, fid, v)
        self.sum[:, fid] += self.t * (self.w[:, fid] - before)
        self.t += 1

    def result(self):
        return self.w - self.sum / self.t


class PassiveAggressive(Learner):
    """Smallest change that separates the right class from the best other one by a margin of one, bounded by c."""

    def __init__(self, classes, features, c: float = 1.0):
        super().__init__(classes, features)
        self.c = c

    def step(self, y, fid, v):
        s = self.scores(fid, v)
        rival = int(np.where(np.arange(len(s)) == y, -np.inf, s).argmax())
        loss = max(0.0, 1.0 - s[y] + s[rival])
        norm = float(v @ v)
        if loss and norm:
            tau = min(self.c, loss / (2 * norm))
            self.w[y, fid] += tau * v
            self.w[rival, fid] -= tau * v


class ConfidenceWeighted(Learner):
    """Weights with a variance each: rare features move further. One constraint for each row, against the best rival."""

    def __init__(self, classes, features, eta: float = 0.9, c: float = 1.0):
        super().__init__(classes, features)
        self.var, self.c = np.ones_like(self.w), c
        self.phi = quantile(eta)

    def step(self, y, fid, v):
        s = self.scores(fid, v)
        rival = int(np.where(np.arange(len(s)) == y, -np.inf, s).argmax())
        margin = s[y] - s[rival]
        spread = float((v * v) @ (self.var[y, fid] + self.var[rival, fid]))
        if spread <= 0 or margin >= self.phi * math.sqrt(spread):
            return
        alpha = min(self.c, (self.phi * math.sqrt(spread) - margin) / spread)
        for k, sign in ((y, 1), (rival, -1)):
            self.w[k, fid] += sign * alpha * self.var[k, fid] * v
            self.var[k, fid] = 1 / (1 / self.var[k, fid] + 2 * alpha * self.phi * v * v / math.sqrt(spread))


class Binary(Learner):
    """Two classes by the sign of one score: class 1 has weights, class 0 none."""

    def __init__(self, classes: int, features: int):
        if classes != 2:
            raise ValueError("a binary learner has two classes")
        super().__init__(2, features)

    def margin(self, y: int, fid: np.ndarray, v: np.ndarray) -> tuple[int, float]:
        """(sign of the right class, score times sign)."""
        sign = 1 if y else -1
        return sign, sign * float(self.w[1, fid] @ v)


class BinaryPerceptron(Binary):
    """The averaged perceptron for two classes."""

    def __init__(self, classes, features):
        super().__init__(classes, features)
        self.sum, self.t = np.zeros(features), 1

    def step(self, y, fid, v):
        sign, m = self.margin(y, fid, v)
        if m <= 0:
            self.w[1, fid] += sign * v
            self.sum[fid] += self.t * sign * v
        self.t += 1

    def result(self):
        out = self.w.copy()
        out[1] -= self.sum / self.t
        return out


class BinaryPassiveAggressive(Binary):
    """Smallest change that gives a margin of one, bounded by c."""

    c = 1.0

    def step(self, y, fid, v):
        sign, m = self.margin(y, fid, v)
        norm = float(v @ v)
        if m < 1 and norm:
            self.w[1, fid] += sign * min(self.c, (1 - m) / norm) * v


class BinarySoftConfidenceWeighted(Binary):
    """Weights with a variance each; the margin is asked for with probability eta, softly (its exact closed form)."""

    eta, c = 0.9, 1.0

    def __init__(self, classes, features):
        super().__init__(classes, features)
        self.var, self.phi = np.ones(features), quantile(self.eta)

    def step(self, y, fid, v):
        sign, m = self.margin(y, fid, v)
        var, phi = float((v * v) @ self.var[fid]), self.phi
        if var <= 0 or phi * math.sqrt(var) - m <= 0:
            return
        zeta, psi = 1 + phi * phi, 1 + phi * phi / 2
        alpha = min(self.c, max(0.0, (-m * psi + math.sqrt(m * m * phi**4 / 4 + var * phi * phi * zeta)) / (var * zeta)))
        root = (-alpha * var * phi + math.sqrt(alpha * alpha * var * var * phi * phi + 4 * var)) / 2
        beta = alpha * phi / (root + var * alpha * phi)
        self.w[1, fid] += alpha * sign * self.var[fid] * v
        self.var[fid] -= beta * (self.var[fid] * v) ** 2


LEARNERS = {"perceptron": Perceptron, "averaged": AveragedPerceptron, "pa": PassiveAggressive, "cw": ConfidenceWeighted, "binary_perceptron": BinaryPerceptron, "binary_pa": BinaryPassiveAggressive, "binary_scw": BinarySoftConfidenceWeighted}


def quantile(p: float) -> float:
    """Standard normal quantile, by bisection on the error function."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


_W = T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("fid", T.IntegerType()), T.StructField("weight", T.DoubleType())])


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, fid, v) of the feats of a batch."""
    feats = batch.column("feats")
    inner = feats.flatten()
    return np.append(0, np.cumsum(np.diff(feats.offsets.to_numpy()))), inner.field("fid").to_numpy(zero_copy_only=False).astype(int), inner.field("v").to_numpy(zero_copy_only=False).astype(float)


def _epoch(kind: str, classes: int, features: int, start):
    """One pass over a shard in the order of its rows, from the broadcast weights."""

    def run(batches):
        m, seen = LEARNERS[kind](classes, features), False
        m.w = start.value.copy()
        for b in batches:
            offsets, fid, v = _sparse(b)
            for i, y in enumerate(b.column("label").to_pylist()):
                seen = True
                m.step(int(y), fid[offsets[i] : offsets[i + 1]], v[offsets[i] : offsets[i + 1]])
        if seen:
            w = m.result()
            k, f = np.nonzero(w)
            # a row of class -1 says that the shard has taken part
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1).astype(np.int32)), pa.array(np.append(f, 0).astype(np.int32)), pa.array(np.append(w[k, f], 1.0))], names=_W.names)

    return run


def average(parts: DataFrame, shards: int) -> DataFrame:
    """Uniform mixture of the weights of shards; a weight a shard lacks is zero."""
    return parts.groupBy("class_id", "fid").agg((F.sum("weight") / shards).alias("weight"))


def train_mixed(rows: DataFrame, classes: int, features: int, kind: str = "perceptron", shards: int | None = None, epochs: int = 3) -> DataFrame:
    """Iterative parameter mixing: each epoch every shard trains from the averaged weights, then they are averaged again.

    rows(row_id, label, feats). Rows go to shards by a hash of row_id and are taken in the order of row_id; without
    `shards` there is one for ROWS_PER_SHARD rows.
    """
    spark = rows.sparkSession
    shards = shards or max(1, -(-rows.count() // ROWS_PER_SHARD))
    sharded = rows.repartition(shards, "row_id").sortWithinPartitions("row_id").select("label", "feats").persist(StorageLevel.DISK_ONLY)
    weights = np.zeros((classes, features))
    for _ in range(epochs):
        start = spark.sparkContext.broadcast(weights)
        got = sharded.mapInArrow(_epoch(kind, classes, features, start), _W).groupBy("class_id", "fid").agg(F.sum("weight").alias("weight")).toPandas()  # at most classes * features rows
        took_part = float(got.weight[got.class_id < 0].sum()) or 1.0
        got = got[got.class_id >= 0]
        weights = np.zeros((classes, features))
        weights[got.class_id.to_numpy(), got.fid.to_numpy()] = got.weight.to_numpy() / took_part
        start.unpersist()
    sharded.unpersist()
    k, f = np.nonzero(weights)
    return spark.createDataFrame(pd.DataFrame({"class_id": k.astype("int32"), "fid": f.astype("int32"), "weight": weights[k, f]}), _W)


_SCORE = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("class_id", T.IntegerType()), T.StructField("score", T.DoubleType())])


def linear_scores(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(row_id, class_id, score) of instances, for the classes of the model. A model of bounded size is broadcast as one
    matrix and whole batches are multiplied; a larger one is joined on the feature."""
    got = weights.select(F.col("class_id").cast("int"), F.col("fid").cast("int"), F.col("weight").cast("double")).limit(MAX_BROADCAST + 1).toPandas()
    ids = np.unique(got.class_id.to_numpy())
    size = int(got.fid.max()) + 1 if len(got) else 0
    if len(got) > MAX_BROADCAST or size * len(ids) > 10 * MAX_BROADCAST:
        flat = rows.select("row_id", F.explode("feats").alias("x")).select("row_id", F.col("x.fid").alias("fid"), F.col("x.v").alias("v"))
        return flat.join(weights, "fid").groupBy("row_id", "class_id").agg(F.sum(F.col("v") * F.col("weight")).alias("score"))
    w = np.zeros((size, len(ids)))
    w[got.fid.to_numpy(), np.searchsorted(ids, got.class_id.to_numpy())] = got.weight.to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((ids.astype(np.int32), w))

    def score(batches):
        ids, w = shared.value
        for b in batches:
            offsets, fid, v = _sparse(b)
            owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            known = (fid >= 0) & (fid < len(w))
            out = np.zeros((b.num_rows, len(ids)))
            np.add.at(out, owner[known], w[fid[known]] * v[known, None])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("row_id").to_numpy(zero_copy_only=False), len(ids))), pa.array(np.tile(ids, b.num_rows)), pa.array(out.ravel())], names=_SCORE.names)

    return rows.where("row_id is not null and feats is not null").select(F.col("row_id").cast("long"), "feats").mapInArrow(score, _SCORE)


def best_class(scores: DataFrame) -> DataFrame:
    """The class of the largest score; among equals the lowest."""
    return scores.groupBy("row_id").agg(F.min_by("class_id", F.struct(-F.round("score", 9), F.col("class_id"))).alias("class_id"))


def naive_bayes(events: DataFrame, label: str, feature: str, floor: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """events(label, feature) -> (priors: label, log_prior; likelihoods: label, feature, log_p), log-probabilities floored."""
    n = events.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    priors = n.select(label, "n", F.log(F.col("n") / F.lit(total)).alias("log_prior"))
    c = events.groupBy(label, feature).agg(F.count("*").alias("c"))
    like = c.join(small(priors.select(label, "n")), label).select(label, feature, F.greatest(F.log(F.col("c") / F.col("n")), F.lit(math.log(floor))).alias("log_p"))
    return priors.select(label, "log_prior"), like


def naive_bayes_em(documents: DataFrame, labels: list[str], rounds: int = 5, floor: float = 1e-4, hard: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Naive Bayes from documents of which only some have a label: documents(doc_id, label, feature, n).

    Expectation: how much of a document without a label belongs to each label, by the words of each; with `hard` all of it
    to the likeliest. Maximisation: counts weighted by that. A document with a label belongs to it. Returns (priors,
    likelihoods, memberships); each round is two grouped sums and a join on the words, whatever the size.
    """
    words = written(documents.where("feature is not null").groupBy("doc_id", "feature").agg(F.sum("n").alias("n")), "em-words")
    known = documents.groupBy("doc_id").agg(F.max("label").alias("label"))
    each = known.withColumn("k", F.explode(F.array(*[F.lit(x) for x in labels]).cast("array<string>")))
    fixed = written(each.select("doc_id", F.col("k").alias("label"), F.when(F.col("label").isNull(), F.lit(1.0 / max(1, len(labels)))).otherwise((F.col("label") == F.col("k")).cast("double")).alias("w"), F.col("label").isNull().alias("open")), "em-start")
    member = fixed
    for _ in range(rounds):
        mass = member.groupBy("label").agg(F.sum("w").alias("mass"))
        total = mass.agg(F.sum("mass")).first()[0] or 1.0
        priors = mass.select("label", F.log(F.greatest(F.col("mass") / F.lit(total), F.lit(1e-12))).alias("log_prior"))
        counts = words.join(member.where("w > 0"), "doc_id").groupBy("label", "feature").agg(F.sum(F.col("w") * F.col("n")).alias("c"))
        like = written(counts.join(counts.groupBy("label").agg(F.sum("c").alias("all")), "label").select("label", "feature", F.greatest(F.log(F.col("c") / F.col("all")), F.lit(math.log(floor))).alias("log_p")), "em-words-of-labels")
        # a word that a label lacks has the floor
        asked = words.join(fixed.where("open").select("doc_id", "label"), "doc_id").join(like, ["label", "feature"], "left")
        score = asked.groupBy("doc_id", "label").agg(F.sum(F.col("n") * F.coalesce("log_p", F.lit(math.log(floor)))).alias("s")).join(F.broadcast(priors), "label").withColumn("s", F.col("s") + F.col("log_prior"))
        w = W.partitionBy("doc_id")  # as many rows as labels
        share = F.exp(F.col("s") - F.max("s").over(w))
        if hard:
            share = (F.row_number().over(w.orderBy(F.desc("s"), "label")) == 1).cast("double")
        soft = score.withColumn("_e", share).select("doc_id", "label", (F.col("_e") / F.sum("_e").over(w)).alias("w"), F.lit(True).alias("open"))
        member = written(fixed.where("not open").unionByName(soft), "em-members")
    return priors, like, member


def save_model(weights: DataFrame, path: str) -> None:
    """A model as a table, readable by any session; an older one is replaced only when the new one is complete."""
    weights.select("class_id", "fid", "weight").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_W).parquet(path)


def softmax(score: Column, over) -> Column:
    top = F.max(score).over(over)
    return F.exp(score - top) / F.sum(F.exp(score - top)).over(over)
