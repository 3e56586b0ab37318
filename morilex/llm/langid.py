"""Problem 4: language of short documents and of the segments of mixed ones.

Method: sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to 4, hashed), trained with
follow-the-regularised-leader and elastic-net penalties, followed by temperature calibration on a held-out fifth.
Labels are noisy: after a first fit, rows whose own label the model finds very unlikely are left out, and the model is
fitted again.

The classifier is fitted on a bounded sample: at most MAX_TRAIN labelled rows in the order of a hash, which a threshold on
the hash picks before anything is shuffled. Document frequencies of n-grams cover all texts (2**18 buckets are collected,
which is their bound). A text is split into segments
at final marks, line ends, brackets, erased links, mentions and RT, and changes of script (kana with ideographs, Hangul,
Thai, Cyrillic, other letters); segments are classified and joined; a language counts for a
mixed text if its segments hold a clause (CLAUSE letters), so single foreign words, names, tags, links and mentions do not
make a text mixed.

Segments in a script that none of the ten languages is written in, and texts whose best language has a confidence below
REJECT, are in another language: UNKNOWN ('und'), which is reported but is no case.

Defined results: a text that is null or has no words has no language; repeated statuses give one row. A label is held for
wrong only if the text's language has at least DOUBT.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import chars
from . import common

LANGS = ("ja", "en", "zh", "ko", "es", "pt", "de", "fr", "ru", "th")
# Other codes of the same languages.
CODES = chars.LANGUAGES
BITS, ORDERS, MAX_TRAIN, EPOCHS = 18, 4, 10_000, 3
#: Letters that make a clause, by kind of script.
CLAUSE = {"wide": 5, "hangul": 5, "narrow": 14, "cyrillic": 14, "thai": 10, "foreign": 10}
DOUBT, REJECT, UNKNOWN = 0.75, 0.3, "und"

_NOISE = re.compile(r"https?://\S+|www\.\S+|[@＠]\w+|[#＃]\w+|\bRT\b:?|>>\s*\d+")
#: Left where a link, a mention or RT is erased: a passage ends there.
BORDER = "\x1f"
_SPLIT = re.compile(r"(?<=[。！？!?…])|(?<=[.])(?=\s)|[\x1f\n\r()（）「」『』“”„«»\[\]【】]|\s[-–—]\s|(?<=\s)(?=[|｜])")
_KIND = (
    ("wide", re.compile(r"[぀-ヿㇰ-ㇿ一-鿿々]")),
    ("hangul", re.compile(r"[가-힣ᄀ-ᇿ]")),
    ("thai", re.compile(r"[ก-๛]")),
    ("cyrillic", re.compile(r"[Ѐ-ԯ]")),
    ("narrow", re.compile(r"[A-Za-zªºÀ-ɏḀ-ỿ]")),
    ("foreign", re.compile(r"[^\W\d_]")),
)


def label(c: Column) -> Column:
    """A label as one of the codes of LANGS, another code as it is, or null if it names no language."""
    base = F.element_at(F.split(F.lower(F.trim(c)), "[-_]"), 1)
    table = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    base = F.coalesce(F.element_at(table, base), base)
    return F.when(base.rlike("^[a-z]{2,3}$") & ~base.isin("und", "xx", "zxx", "mul", "mis", "unk"), base)


def cleaned(text: str, border: str = " ") -> str:
    """The text without links, mentions, RT (`border` stands for each), tags and anchors."""
    return unicodedata.normalize("NFKC", _NOISE.sub(lambda m: " " if m[0][0] in "#＃>" else border, text))


@lru_cache(None)
def kind(c: str) -> str:
    """The kind of script of a character, or ''; at most as many as there are characters."""
    for name, pattern in _KIND:
        if pattern.match(c):
            return name
    return ""


def segments(text: str) -> list[tuple[str, str]]:
    """(kind of script, segment) of a cleaned text: parts between marks, cut again where the script changes."""
    out = []
    for part in _SPLIT.split(text):
        if not part or not part.strip():
            continue
        start, now = 0, ""
        for i, c in enumerate(part):
            k = kind(c)
            if k and k != now:
                if now:
                    out.append((now, part[start:i]))
                    start = i
                now = k
        if now:
            out.append((now, part[start:]))
    return out


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, buckets): hashed character n-grams of every text, in one vectorised pass."""
    bodies = [" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " " for t in texts]
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    if not len(sizes):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    rows, buckets = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, ORDERS + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + (c[n - 1 : n - 1 + m] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            x = h ^ (h >> np.uint64(29))
            x = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            ok = owner[:m] == owner[n - 1 : n - 1 + m]
            if n == 1:
                ok &= c[:m] != 32
            rows.append(owner[:m][ok])
            buckets.append(x[ok].astype(np.int64))
    rows, buckets = np.concatenate(rows), np.concatenate(buckets)
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(bodies)))]), buckets[order]


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, buckets, values): TF-IDF vectors of unit length; term frequency 1 + log tf. In blocks, to bound memory."""
    sizes, all_buckets, all_values = [np.zeros(1, dtype=np.int64)], [], []
    for at in range(0, len(texts), 1000):
        block = texts[at : at + 1000]
        offsets, buckets = ngrams(block)
        rows = np.repeat(np.arange(len(block)), np.diff(offsets))
        key, count = np.unique(rows << BITS | buckets, return_counts=True)
        rows, buckets = key >> BITS, key & ((1 << BITS) - 1)
        value = (1 + np.log(count)) * idf[buckets]
        norm = np.sqrt(np.bincount(rows, value * value, len(block)))
        sizes.append(np.bincount(rows, minlength=len(block)))
        all_buckets.append(buckets.astype(np.int32))
        all_values.append((value / np.maximum(norm[rows], 1e-12)).astype(np.float32))
    none = np.zeros(0)
    return np.cumsum(np.concatenate(sizes)), np.concatenate(all_buckets or [none.astype(np.int32)]), np.concatenate(all_values or [none.astype(np.float32)])


def train(data: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.2, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """FTRL-proximal for the multinomial loss with elastic net; weights (buckets + 1 bias) x languages."""
    offsets, buckets, values = data
    k, size = len(LANGS), (1 << BITS) + 1
    z, n = np.zeros((size, k), dtype=np.float32), np.zeros((size, k), dtype=np.float32)
    rng = np.random.default_rng(seed)
    # every row with its bias, once for all epochs
    rows = [(np.append(buckets[a:b], size - 1), np.append(values[a:b], np.float32(0.1))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def weights(zi, root):
        """Shrunk by l1, then scaled; root: the square root of the sums of squares."""
        return -(zi - np.clip(zi, -l1, l1)) / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for r in rng.permutation(len(y)).tolist():
            i, x = rows[r]
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = weights(zi, root)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[r]] -= 1
            g = x[:, None] * (p * weight[r])
            ni += g * g
            z[i] = zi + g - (np.sqrt(ni) - root) / alpha * w
            n[i] = ni
    return weights(z, np.sqrt(n)).astype(np.float32)


def scores(data: tuple[np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    offsets, buckets, values = data
    out = np.zeros((len(offsets) - 1, w.shape[1]))
    if len(buckets):
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = np.add.reduceat(w[buckets] * values[:, None], offsets[full], axis=0)
    return out + 0.1 * w[-1]


def softmax(s: np.ndarray, t: float = 1.0) -> np.ndarray:
    e = np.exp((s - s.max(1, keepdims=True)) / t)
    return e / e.sum(1, keepdims=True)


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on held-out rows."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(s, t)[np.arange(len(y)), y], 1e-9)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    def __init__(self, idf: np.ndarray, w: np.ndarray, t: float, accuracy: float):
        self.idf, self.w, self.t, self.accuracy = idf, w, t, accuracy

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(scores(vectors(texts, self.idf), self.w), self.t) if texts else np.zeros((0, len(LANGS)))


def fit(texts: list[str], labels: list[str], idf: np.ndarray) -> Model:
    """Fits on texts with noisy labels of LANGS."""
    y = np.array([LANGS.index(x) for x in labels], dtype=np.int64)
    if not len(y):
        return Model(idf, np.zeros(((1 << BITS) + 1, len(LANGS)), dtype=np.float32), 1.0, 0.0)
    data = vectors(texts, idf)
    rng = np.random.default_rng(11)
    held = rng.random(len(y)) < 0.2
    share = np.bincount(y, minlength=len(LANGS)) / len(y)
    weight = np.minimum(4.0, (1 / (len(LANGS) * np.maximum(share, 1e-9))) ** 0.5)[y]

    def part(mask):
        rows = np.flatnonzero(mask)
        offsets, buckets, values = data
        take = np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows]) if len(rows) else np.zeros(0, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(np.diff(offsets)[rows])]), buckets[take], values[take]

    keep = np.ones(len(y), bool)
    for _ in range(2):  # every half judged by the other: rows whose label is very unlikely are left out
        half = rng.random(len(y)) < 0.5
        p = np.zeros((len(y), len(LANGS)))
        for side in (half, ~half):
            use = side & keep
            if use.any() and (~side).any():
                p[~side] = softmax(scores(part(~side), train(part(use), y[use], weight[use], epochs=2)), 0.3)
        keep = p[np.arange(len(y)), y] > 0.25
        if keep.sum() < 20:
            keep[:] = True
    use = keep & ~held
    w = train(part(use), y[use], weight[use])
    test = keep & held
    if not test.any():
        return Model(idf, w, 0.3, 0.0)
    s = scores(part(test), w)
    return Model(idf, w, temperature(s, y[test]), float((s.argmax(1) == y[test]).mean()))


def judge(model: Model, texts: list[str]) -> list[list[tuple[str, float, str]]]:
    """For every text its languages: [(language, confidence, segment text)], the largest first; [] without words."""
    parts, owner, letters = [], [], []
    for k, t in enumerate(texts):
        merged: list[list] = []
        for kd, s in segments(cleaned(t or "", BORDER)):
            n = sum(c.isalpha() for c in s)
            # short parts in the same script go with their neighbour
            if merged and merged[-1][0] == kd and (n < CLAUSE[kd] or merged[-1][2] < CLAUSE[kd]):
                merged[-1][1] += " " + s
                merged[-1][2] += n
            else:
                merged.append([kd, s, n])
        for kd, s, n in merged:
            parts.append(s)
            owner.append(k)
            letters.append((n, kd))
    p = model.probabilities(parts)
    out: list[list[tuple[str, float, str]]] = [[] for _ in texts]
    by: list[list[int]] = [[] for _ in texts]
    for i, k in enumerate(owner):
        by[k].append(i)
    for k, own in enumerate(by):
        if not own:
            continue
        foreign = [i for i in own if letters[i][1] == "foreign" and letters[i][0] >= CLAUSE["foreign"]]
        own = [i for i in own if letters[i][1] != "foreign"]
        if foreign:
            out[k].append((UNKNOWN, 1.0, " ".join(parts[i].strip() for i in foreign)))
        if not own:
            if not foreign:
                out[k] = [(UNKNOWN, 1.0, cleaned(texts[k]).strip())]
            continue
        clause = [i for i in own if letters[i][0] >= CLAUSE[letters[i][1]] and len(parts[i].split()) >= (3 if letters[i][1] in ("narrow", "cyrillic") else 1)]
        if not clause:
            if not foreign:
                whole = model.probabilities([cleaned(texts[k])])[0]
                best = int(whole.argmax())
                out[k] = [(LANGS[best] if whole[best] >= REJECT else UNKNOWN, float(whole[best]), cleaned(texts[k]).strip())]
            continue
        found: dict[int, list] = {}
        for i in clause:
            best = int(p[i].argmax())
            found.setdefault(best, []).append(i)
        total = {x: sum(letters[i][0] * (2 if letters[i][1] in ("wide", "hangul") else 1) for i in v) for x, v in found.items()}
        main = max(total, key=lambda x: (total[x], -x))
        for x in sorted(found, key=lambda x: (-total[x], x)):
            sure = max(float(p[i][x]) for i in found[x])
            if x == main or sure >= DOUBT:
                mean = float(np.average([p[i][x] for i in found[x]], weights=[letters[i][0] for i in found[x]]))
                out[k].append((LANGS[x] if sure >= REJECT else UNKNOWN, mean, " ".join(parts[i].strip() for i in found[x])))
    return out


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """The first n distinct rows in the order of a hash of text and lang. An estimate of how many there are sets a threshold
    on the hash under which twice as many are expected, so only those are shuffled."""
    h = F.xxhash64("text", "lang")
    there = rows.agg(F.approx_count_distinct(h)).first()[0]
    near = rows.where(h < F.lit(int(-(1 << 63) + min(1.0, 2 * n / max(1, there)) * ((1 << 64) - 1)))) if there > 2 * n else rows
    return near.distinct().orderBy(h, "text", "lang").limit(n)


def training_rows(tweets: DataFrame, docs: DataFrame) -> tuple[list[str], list[str]]:
    """At most MAX_TRAIN labelled rows, half of it lines of documents in other languages than Japanese."""
    t = tweets.where(F.col("text").isNotNull()).select("text", label(F.col("lang")).alias("lang")).where(F.col("lang").isin(*LANGS))
    d = docs.where(F.col("text").isNotNull()).select("text", label(F.col("lang")).alias("lang")).where(F.col("lang").isin(*[x for x in LANGS if x != "ja"]))
    # a shorter line is a heading or a name, which tells no language
    d = d.select(F.explode(F.split("text", "\n")).alias("text"), "lang").where((F.length("text") > 30) & ~F.col("text").rlike("[ぁ-ヿ]"))
    rows = first_by_hash(t, MAX_TRAIN // 2).unionByName(first_by_hash(d, MAX_TRAIN // 2)).collect()
    return [cleaned(r[0]) for r in rows], [r[1] for r in rows]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Inverse document frequencies of the n-gram buckets over all texts."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        total, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        for b in batches:
            own = [cleaned(x) for x in b.column(0).to_pylist()]
            offsets, buckets = ngrams(own)
            # a text counts once for each of its n-grams
            key = common.distinct(np.repeat(np.arange(len(own)), np.diff(offsets)) << BITS | buckets)
            total += np.bincount(key & ((1 << BITS) - 1), minlength=1 << BITS)
            rows += len(own)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, -1).astype(np.int32)), pa.array(np.append(total[there], rows))], names=schema.names)

    got = common.spread(texts.where(F.col("text").isNotNull()).select("text")).mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    own = got[got.bucket >= 0]
    df[own.bucket.to_numpy()] = own.n.to_numpy()
    rows = int(got.n[got.bucket < 0].sum())
    return np.log((1 + rows) / (1 + df)) + 1


def fitted(spark, sf_dir: str) -> Model:
    tweets = common.read(spark, sf_dir, "tweets").select("text", "lang")
    docs = common.read(spark, sf_dir, "documents").select("text", "lang")
    return fit(*training_rows(tweets, docs), document_frequencies(tweets))


_JUDGED = T.StructType([T.StructField("status_id", T.LongType()), T.StructField("label", T.StringType()), T.StructField("seg", T.IntegerType()), T.StructField("n_langs", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("segment", T.StringType())])


def judged(spark, sf_dir: str) -> DataFrame:
    """(status_id, label, seg, n_langs, lang, confidence, segment) of every status with words."""
    shared = spark.sparkContext.broadcast(fitted(spark, sf_dir))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            got = judge(shared.value, texts)
            ids, labels = b.column("status_id").to_pylist(), b.column("label").to_pylist()
            rows = [(ids[i], labels[i], k, len(g), *x) for i, g in enumerate(got) for k, x in enumerate(g)]
            cols = list(zip(*rows)) if rows else [[] for _ in _JUDGED]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()))], names=_JUDGED.names)

    t = common.read(spark, sf_dir, "tweets").where(F.col("text").isNotNull()).select("status_id", "text", label(F.col("lang")).alias("label")).distinct()
    return t.mapInArrow(run, _JUDGED)


def p4_languages(spark, sf_dir: str) -> DataFrame:
    """Language and confidence of every status, and of each segment of a mixed one."""
    return judged(spark, sf_dir).select("status_id", "seg", "n_langs", "lang", "confidence", "segment")


def p4_found(spark, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    wrong = F.col("label").isNull() | ((F.col("label") != F.col("lang")) & (~F.col("label").isin(*LANGS) | (F.col("confidence") >= DOUBT)))
    return j.where(((F.col("n_langs") > 1) | wrong) & (F.col("lang") != UNKNOWN)).select("status_id", "lang").distinct()
