"""Problem 10: reading level of documents.

Method: a Rasch-style latent model that links the level of a document with the difficulty of the words in it. The count of
word w in document d (N_d words) is Poisson with rate N_d * exp(psi_w + beta_w * theta_d): psi is how common the word is,
beta how strongly its occurrence speaks for a demanding text, theta the level. Parameters are estimated by distributed
alternating optimisation: given the words, every document's level is the mode of its posterior on a fixed grid; given the
levels, the sufficient statistics of every word (its count, and its count weighted by level) are summed over all documents
and each word's two parameters follow by Newton steps. Readers' grades anchor the levels of the graded documents, so the
scale runs from easy to hard; the two borders between the bands are placed where the grades are parted best.

Plan: words are hashed into 2**20 buckets, which bounds all that is broadcast (4 MB) or collected (a slope for each bucket);
the word vectors of documents are written once. Each round has two distributed halves: the levels of all documents, whose
statistics are summed within a task before anything is shuffled, and the Newton steps of all words on those sums. Rounds
end when the levels no longer move. At most MAX_ANCHORS graded documents (a hash order picks them) serve as anchors; all
documents take part in every round.

Defined results: only documents whose running text is mainly Japanese get a level. All lines count: running text (lines with
final marks and at least 12 letters) fully, other lines (headings, menus) by LIGHT; a document without running text is
judged by its other lines alone. A heading of ideographs only goes with the other lines of its document; running text
without kana is not Japanese. Null and empty texts
and rows without an id are left out. Without any grade every document is 'medium', the middle of the scale.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BUCKETS, MAX_ANCHORS = 1 << 20, 20_000
#: Rounds end when the words have moved along the grid by less than MOVED of its steps on average, or after ROUNDS.
ROUNDS, MOVED = 20, 0.2
#: What a word counts outside running text.
LIGHT = 0.1
GRID = np.linspace(-2, 2, 41)
#: Grades 1 to 6 on the scale of levels; how tightly a grade binds; weight of the (dependent) words of a document.
MIDDLE, SPREAD, ANCHOR, TEMPER, RIDGE = 3.5, 1.5 / 2.5, 0.3, 0.2, 2.0
JAPANESE_SHARE = 0.75
BANDS = ("easy", "medium", "hard")

_KANA = re.compile(r"[ぁ-ヿｦ-ﾟ]")
_FINAL = re.compile(r"[。！？!?．.]")
_WORD = re.compile(r"[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+")
_LETTERS = re.compile(r"[^\W\d_]")
_HAN_ONLY = re.compile(r"[^\w]*[一-鿿々](?:[一-鿿々\d]|[^\w])*\Z")


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


@lru_cache(300_000)
def _run_words(run: str) -> tuple[int, ...]:
    if "ぁ" <= run[0] <= "ゖ" and len(run) > 3:
        return tuple([_bucket(run[i : i + 3]) for i in range(len(run) - 2)])
    return (_bucket(run),)


def words(text: str) -> list[int]:
    """Buckets of a text's words: runs of ideographs or katakana, and kana in stretches of three."""
    return list(chain.from_iterable(map(_run_words, _WORD.findall(text))))


@lru_cache(None)
def _kinds() -> np.ndarray:
    """For every character below U+10000: 1 a letter, 2 kana, 4 a final mark, 8 anything but white space."""
    out = np.zeros(1 << 16, dtype=np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        out[code] = (1 if _LETTERS.match(c) else 0) | (2 if _KANA.match(c) else 0) | (4 if _FINAL.match(c) else 0) | (0 if c.isspace() else 8)
    return out


def weighted_lines(texts: list[str]) -> list[tuple[list[tuple[str, float]], float]]:
    """For each text ([(Japanese line, weight)], the share of Japanese in all lines by letters and weight).

    The characters of all texts are looked at as one array.
    """
    parts = [[x if x.isascii() else unicodedata.normalize("NFKC", x) for x in t.split("\n")] for t in texts]
    flat = [x for p in parts for x in p]
    code = np.frombuffer("\n".join(flat).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    flags = np.where(code < 1 << 16, _kinds()[np.minimum(code, 0xFFFF)], 9)  # characters beyond are letters
    ends = np.cumsum([len(x) + 1 for x in flat]) if flat else np.zeros(0, dtype=np.int64)
    count = lambda bit: np.diff(np.concatenate([[0], np.cumsum(flags & bit != 0)])[np.concatenate([[0], np.minimum(ends, len(code))])]).tolist()
    letters, kana, final, filled = (count(bit) for bit in (1, 2, 4, 8)) if flat else ([], [], [], [])
    out, i = [], 0
    for p in parts:
        lines: list[tuple[str, float, str]] = []
        mass, top = {"ja": 0.0, "han": 0.0, "other": 0.0}, LIGHT
        for line in p:
            n, running = letters[i], letters[i] >= 12 and final[i] > 0
            if filled[i]:
                # running text without kana is Chinese; a heading of ideographs may be either
                kind = "ja" if kana[i] else "han" if not running and _HAN_ONLY.match(line) else "other"
                weight = 1.0 if running else LIGHT
                top = max(top, weight)
                mass[kind] += weight * n
                lines.append((line, weight, kind))
            i += 1
        own = ("ja", "han") if mass["ja"] > mass["other"] else ("ja",)  # ideographs alone go with the rest
        out.append(([(line, w / top) for line, w, kind in lines if kind in own], sum(mass[k] for k in own) / sum(mass.values()) if mass["ja"] else 0.0))
    return out


_VECTORS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType())), T.StructField("n_words", T.LongType())])


def _vectors(batches):
    for b in batches:
        ids, offsets, buckets, counts, sizes = [], [0], [], [], []
        doc_ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) < 1_000_000):  # bounds the arrays in memory
                size += len(texts[end])
                end += 1
            for i, (kept, share) in zip(doc_ids[at:end], weighted_lines(texts[at:end])):
                if share < JAPANESE_SHARE:
                    continue
                full, light = (words("\n".join([x for x, w in kept if (w == 1.0) == running])) for running in (True, False))
                u, place = np.unique(np.array(full + light, dtype=np.int32), return_inverse=True)
                weight = np.ones(len(place), dtype=np.float32)
                weight[len(full) :] = LIGHT
                ids.append(i)
                buckets.append(u)
                counts.append(np.bincount(place, weight, len(u)).astype(np.float32))
                sizes.append(len(place))
                offsets.append(offsets[-1] + len(u))
            at = end
        if ids:
            offs = pa.array(np.array(offsets, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(buckets))), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(counts))), pa.array(sizes, pa.int64())], names=_VECTORS.names)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, and row, bucket, count of every entry."""
    ids = b.column("ids")
    size = np.diff(ids.offsets.to_numpy())
    start, end = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
    return b.column("doc_id").to_numpy(), np.repeat(np.arange(len(size)), size), ids.values.to_numpy()[start:end], b.column("counts").values.to_numpy()[b.column("counts").offsets[0].as_py() : b.column("counts").offsets[-1].as_py()].astype(float)


def levels(score: np.ndarray, total: np.ndarray, z: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Grid index of each document's level: score = sum of n * beta, total = words, anchor = graded level or nan."""
    ll = TEMPER * (score[:, None] * GRID - total[:, None] * z) - GRID**2 / 2
    graded = ~np.isnan(anchor)
    ll[graded] -= (GRID - anchor[graded, None]) ** 2 / (2 * ANCHOR**2)
    return ll.argmax(1)


def fit_words(s0: np.ndarray, s1: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """psi and beta of words from their counts, level-weighted counts, and the words at each level of the grid."""
    psi, beta = np.log((s0 + 0.5) / max(mass.sum(), 1.0)), np.zeros(len(s0))
    for at in range(0, len(s0), 20_000):
        p, e, a, b = psi[at : at + 20_000], beta[at : at + 20_000], s0[at : at + 20_000], s1[at : at + 20_000]
        for _ in range(30):
            mu = mass * np.exp(p[:, None] + e[:, None] * GRID)
            h00, h01, h11 = mu.sum(1), mu @ GRID, mu @ GRID**2 + RIDGE
            g0, g1 = a + 0.5 - h00, b - h01 - RIDGE * e
            det = np.maximum(h00 * h11 - h01**2, 1e-12)
            step = np.clip((h00 * g1 - h01 * g0) / det, -2, 2)
            p += np.clip((h11 * g0 - h01 * g1) / det, -2, 2)
            e += step
            if np.abs(step).max(initial=0.0) < 1e-5:
                break
        psi[at : at + 20_000], beta[at : at + 20_000] = p, e
    return psi, beta


def borders(level: np.ndarray, band: np.ndarray) -> tuple[float, float]:
    """The two borders on the grid that part the graded bands best; the middle of all that do equally well."""
    steps = (GRID[1:] + GRID[:-1]) / 2
    at = np.digitize(level, steps)  # grid index
    count = np.zeros((3, len(GRID)))
    np.add.at(count, (band, at), 1)
    below = np.concatenate([np.zeros((3, 1)), np.cumsum(count, 1)], 1)  # documents under each border
    total = count.sum(1)
    low = below[1] + 2 * below[2] + (total[0] - below[0])  # cost of the first border: others below it, easy ones above
    high = below[2] + (total[1] - below[1]) + (total[0] - below[0])
    best, pick = np.inf, []
    for i in range(1, len(GRID)):
        for k in range(i, len(GRID)):
            cost = low[i] + high[k]
            if cost < best - 1e-9:
                best, pick = cost, [(i, k)]
            elif cost <= best + 1e-9:
                pick.append((i, k))
    i, k = pick[len(pick) // 2]
    edge = lambda x: steps[min(max(x - 1, 0), len(steps) - 1)]
    return float(edge(i)), float(edge(k))


_STATS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("s0", T.DoubleType()), T.StructField("s1", T.DoubleType())])
_SLOPES = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("slopes", T.BinaryType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
_LEVELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("level", T.DoubleType()), T.StructField("n_words", T.LongType())])


def word_step(stats: DataFrame, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of all buckets and z by level, from stats(id, s0, s1): Newton steps where the sums are, a few numbers back."""

    def fit(batches):
        for b in batches:
            # most words are rare and share their sums with many others: each pair of sums is fitted once
            sums = b.column("s0").to_numpy().round(6) + 1j * b.column("s1").to_numpy().round(6)
            pairs, which, times = np.unique(sums, return_inverse=True, return_counts=True)
            psi, slope = fit_words(pairs.real, pairs.imag, mass)
            z = np.zeros(len(GRID))
            for at in range(0, len(psi), 20_000):
                z += (times[at : at + 20_000, None] * np.exp(psi[at : at + 20_000, None] + slope[at : at + 20_000, None] * GRID)).sum(0)
            yield pa.RecordBatch.from_pylist([{"ids": b.column("id").to_numpy().astype(np.int32).tobytes(), "slopes": slope[which].astype(np.float32).tobytes(), "z": z.tolist()}], schema=pa.schema([("ids", pa.binary()), ("slopes", pa.binary()), ("z", pa.list_(pa.float64()))]))

    beta, z = np.zeros(BUCKETS, dtype=np.float32), np.zeros(len(GRID))
    for r in stats.where("id >= 0").mapInArrow(fit, _SLOPES).collect():  # eight bytes a bucket, at most BUCKETS of them
        beta[np.frombuffer(r["ids"], dtype=np.int32)] = np.frombuffer(r["slopes"], dtype=np.float32)
        z += np.array(r["z"])
    return beta, z


def reading_levels(docs: DataFrame, grades: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text), grades(doc_id, grade) -> (doc_id, level, n_words, band) of mainly Japanese documents."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    kept = common.spread(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")).select("doc_id", "text"))
    vectors = common.written(kept.mapInArrow(_vectors, _VECTORS), "word-vectors")
    mean = grades.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    graded = mean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ANCHORS).toPandas()
    if not len(graded):
        return vectors.select("doc_id", F.lit(0.0).alias("level"), "n_words", F.lit("medium").alias("band"))
    order = np.argsort(graded.doc_id.to_numpy())
    anchors = sc.broadcast((graded.doc_id.to_numpy()[order], ((graded.grade.to_numpy() - MIDDLE) * SPREAD)[order]))

    def anchor_of(ids: np.ndarray) -> np.ndarray:
        keys, at = anchors.value
        p = np.minimum(np.searchsorted(keys, ids), len(keys) - 1)
        return np.where(keys[p] == ids, at[p], np.nan)

    def document_step(shared, anchored_only: bool) -> DataFrame:
        """Level of every document, given the words: the words' sums, and (id < 0) the words at each level of the grid."""

        def stats(batches):
            s0, s1, mass = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(len(GRID))
            for b in batches:
                ids, row, bucket, n = _flat(b)
                anchor, total = anchor_of(ids), np.bincount(row, n, len(ids))
                if anchored_only:
                    at, use = np.abs(np.nan_to_num(anchor)[:, None] - GRID).argmin(1), ~np.isnan(anchor)
                else:
                    beta, z = shared.value
                    at, use = levels(np.bincount(row, n * beta[bucket], len(ids)), total, z, anchor), np.ones(len(ids), bool)
                w = n * use[row]
                s0 += np.bincount(bucket, w, BUCKETS)
                s1 += np.bincount(bucket, w * GRID[at][row], BUCKETS)
                mass += np.bincount(at, total * use, len(GRID))
            there = np.flatnonzero(s0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([there, -1 - np.arange(len(GRID))]).astype(np.int32)), pa.array(np.concatenate([s0[there], mass])), pa.array(np.concatenate([s1[there], np.zeros(len(GRID))]))], names=_STATS.names)

        return common.written(vectors.mapInArrow(stats, _STATS).groupBy("id").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1")), "word-sums")

    shared, before = None, None
    for k in range(rounds):
        sums = document_step(shared, k == 0)
        mass = np.zeros(len(GRID))
        for r in sums.where("id < 0").collect():  # one row for each level of the grid
            mass[-1 - r["id"]] = r["s0"]
        if shared is not None:
            shared.unpersist()
        shared = sc.broadcast(word_step(sums, mass))
        common.free(sums)
        share = mass / max(mass.sum(), 1e-12)
        # how far the words have moved along the grid, in steps
        moved = np.inf if before is None else np.abs(np.cumsum(share - before)).sum()
        before = share
        if k > 1 and moved < MOVED:
            break
    final = shared

    def judge(batches):
        beta, z = final.value
        for b in batches:
            ids, row, bucket, n = _flat(b)
            total = np.bincount(row, n, len(ids))
            at = levels(np.bincount(row, n * beta[bucket], len(ids)), total, z, np.full(len(ids), np.nan))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(GRID[at]), b.column("n_words")], names=_LEVELS.names)

    judged = common.written(vectors.mapInArrow(judge, _LEVELS), "levels")
    common.free(vectors)
    marks = spark.createDataFrame(graded, "doc_id long, grade double")
    seen = judged.join(F.broadcast(marks), "doc_id").select("level", "grade").toPandas()  # at most MAX_ANCHORS rows
    low, high = borders(seen.level.to_numpy(), np.digitize(seen.grade.to_numpy(), [2.5, 4.5])) if len(seen) else (GRID[0] - 1, GRID[-1] + 1)
    return judged.withColumn("band", F.when(F.col("level") < low, BANDS[0]).when(F.col("level") < high, BANDS[1]).otherwise(BANDS[2]))


def p10_levels(spark, sf_dir: str) -> DataFrame:
    return reading_levels(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "reading_labels").select("doc_id", "grade"))


def p10_found(spark, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).select("doc_id", "band")
