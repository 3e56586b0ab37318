"""Problem 9: passages of evaluation items inside documents.

Method: size-partitioned MinHash containment search. Every item is cut into quarters: whatever passage holds half of an
item holds one of its quarters whole. Quarters are partitioned by size, a factor of sqrt(2) apart; for the partition with
upper bound u, documents are looked at through windows of 2u shingles that start every u shingles, so each quarter stands
whole in some window and the Jaccard similarity that a given containment implies is bounded from below (0.24 at 80 %).
With 32 hash functions, bands of one row and three equal minima asked for, half an item is missed with probability under
1 %. Windows in which no shingle is the minimum of any quarter of the partition cannot match and are not sketched.
Candidates are verified by the exact containment of shingles, and the passage is followed across scattered one-character
slips; its share of the item decides.

Shingles have SHINGLE characters for items of SMALL characters and more. Quarters of shorter items hold too few of them for
a sketch to be smaller than the set itself: such items are searched by all of their (shorter) shingles, SIZES by length,
and verified in the same way; items under SIZES' last length by any stretch of half their characters.

Plan: the items (a fixed query set) become flat arrays once, on the driver, in blocks of at most MAX_ITEMS_CHARS characters
(about 60 bytes a character); each block is broadcast and searched in one pass over all documents, in Arrow batches,
without any shuffle of text; only (doc_id, item_id) is made distinct at the end.

Defined results: null and empty texts and items have no passages, nor have items without letters or digits; rows without
an id are left out; equal items are found each under its own id.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, HASHES, SHARE, PARTS = 12, 32, 0.5, 4
#: Items under SMALL characters are searched by all of their shingles: (least length, characters of a shingle).
SMALL = 4 * (SHINGLE + 6)
SIZES = ((24, 6), (12, 3))
#: Equal minima of an item and a document that make a candidate; distinct shared shingles, as a share of the item, that
#: the exact containment asks for before a passage is followed.
LEAST_MATCHES, LEAST_CONTAINMENT = 3, 0.12
MAX_ITEMS_CHARS = 2_000_000
BATCH_CHARS = 1_000_000
_DROP = re.compile(r"[\W_]+")
_MULT = (np.random.default_rng(20240229).integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def plain(text: str) -> str:
    """Letters and digits only, in one width and case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = text.casefold()
        return _DROP.sub("", unicodedata.normalize("NFKC", text))
    return _DROP.sub("", text.lower())


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles that start at each character (the last size - 1 starts are left out)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(c) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        c = (c + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15)
        c ^= c >> np.uint64(29)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + c[j : j + n]
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def _csr(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, value) pairs as sorted distinct keys, offsets and values."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    distinct, first = np.unique(keys, return_index=True)
    return distinct, np.append(first, len(keys)), values


def _expand(which: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys `which`: (index into which, value) of each of their values."""
    size = offsets[which + 1] - offsets[which]
    owner = np.repeat(np.arange(len(which)), size)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return owner, values[offsets[which][owner] + within]


class Postings:
    """Where the shingles of one size stand in the items that are searched by them: flat arrays."""

    def __init__(self, size: int, texts: list[str], which: list[int]):
        self.size, self.which = size, np.array(which, dtype=np.int64)
        own = [shingles(texts[k], size) for k in which]
        self.lengths = np.array([len(texts[k]) for k in which], dtype=np.int64)
        key = np.concatenate([np.zeros(0, np.uint64), *own])
        item = np.repeat(np.arange(len(which)), [len(h) for h in own])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(h)) for h in own]])
        # values: number of the item in `which`, and the place in it
        self.keys, self.offsets, self.values = _csr(key, (item << 32) | place)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h where a shingle of an item stands, its number among the keys)."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[which] == h[at]
        return at[same], which[same]

    def places(self, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For known places: (place in the text, shingle, item, place in the item), one row for each posting."""
        owner, value = _expand(which, self.offsets, self.values)
        return at[owner], which[owner], self.which[value >> 32], value & 0xFFFFFFFF


class Items:
    """The search structure of a block of items: flat arrays, built once and broadcast."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        self.text = [plain(t) for _, t in rows]
        self.size = np.array([len(t) for t in self.text], dtype=np.int64)
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.size.tolist()):
            if n:
                by_size[SHINGLE if n >= SMALL else next((s for least, s in SIZES if n >= least), -(-n // 2))].append(k)
        self.main = Postings(SHINGLE, self.text, by_size.pop(SHINGLE, []))
        self.small = [Postings(s, self.text, own) for s, own in sorted(by_size.items())]
        minima: dict[int, list[list]] = defaultdict(lambda: [[] for _ in range(HASHES)])
        for k in self.main.which.tolist():
            h, n = shingles(self.text[k]), int(self.size[k])
            step = -(-n // PARTS)
            for a in range(0, n, step):
                own = h[a : max(a + step - SHINGLE + 1, a + 1)]
                if len(own):
                    with np.errstate(over="ignore"):
                        low = own[np.argmin(own[None, :] * _MULT[:, None], axis=1)]
                    for f in range(HASHES):
                        minima[self.bound(len(own))][f].append((int(low[f]), k))
        self.parts, self.minima = {}, {}
        for bound, tables in minima.items():
            pairs = [(np.array([x for x, _ in t], dtype=np.uint64), np.array([k for _, k in t], dtype=np.int64)) for t in tables]
            self.parts[bound] = [_csr(*p) for p in pairs]
            self.minima[bound] = common.distinct(np.concatenate([x for x, _ in pairs]))

    @staticmethod
    def bound(n: int) -> int:
        u = 8.0
        while u < n:
            u *= 2**0.5
        return int(np.ceil(u))


def passage(a: str, b: str, i: int, j: int, size: int) -> tuple[int, int]:
    """The part of item a that stands in b as one passage around the equal stretch a[i:i+size] = b[j:j+size]."""

    def run(x: int, y: int, step: int) -> int:
        """How far a goes on from x in b from y, in direction step, across single slips; the last equal place."""
        good, n, m, since = x, len(a), len(b), 8
        while 0 <= x < n and 0 <= y < m:
            if a[x] == b[y]:
                good = x
                since += 1
                x += step
                y += step
                continue
            if since < 3:  # slips are scattered
                break
            for dx, dy in ((step, step), (0, step), (step, 0)):
                p, q, same = x + dx, y + dy, 0
                while same < 4 and 0 <= p < n and 0 <= q < m and a[p] == b[q]:
                    p, q, same = p + step, q + step, same + 1
                if same == 4 or (same and not 0 <= p < n):
                    x, y, since = x + dx, y + dy, 0
                    break
            else:
                break
        return good

    return run(i, j, -1), run(i + size - 1, j + size - 1, 1)


def verify(a: str, text: str, places: list[int], own: list[int], size: int) -> bool:
    """Whether at least SHARE of item a stands in the text as one passage; its shingles stand at own in it, at places here."""
    need = SHARE * len(a)
    done: dict[int, int] = {}  # diagonal -> where the passage on it ends
    for j, i in zip(places, own):
        d = j - i
        if any(done.get(d + s, -1) >= j for s in (0, -1, 1, -2, 2)) or a[i : i + size] != text[j : j + size]:
            continue
        lo, hi = passage(a, text, i, j, size)
        if hi - lo + 1 >= need:
            return True
        done[d] = max(done.get(d, -1), d + hi)
    return False


def candidates(items: Items, h: np.ndarray, doc_of: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Sorted keys doc * items + item of the pairs with enough equal minima.

    h: shingle hashes of a stretch of text; doc_of: the document of each; known: where shingles of items stand.
    """
    none = np.zeros(0, dtype=np.int64)
    n, seen = len(items.ids), []
    with np.errstate(over="ignore"):
        for tag, (bound, tables) in enumerate(items.parts.items()):
            maybe = known[np.isin(h[known], items.minima[bound])]
            if not len(maybe):
                continue
            width = 2 * bound
            last = maybe // bound
            windows = common.distinct(np.concatenate([last, np.maximum(last - 1, 0)]))
            padded = h if len(h) >= width else np.concatenate([h, np.repeat(h[-1:], width - len(h))])
            begin = common.distinct(np.minimum(windows * bound, len(padded) - width))
            step = max(1, 500_000 // width)
            for at in range(0, len(begin), step):
                grid = padded[begin[at : at + step, None] + np.arange(width)]
                rows = np.arange(len(grid))
                for f, (keys, offsets, values) in enumerate(tables):
                    low = np.argmin(grid * _MULT[f], axis=1)
                    value = grid[rows, low]
                    p = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                    hit = np.flatnonzero(keys[p] == value)
                    if len(hit):
                        owner, item = _expand(p[hit], offsets, values)
                        pos = np.minimum(begin[at + hit] + low[hit], len(h) - 1)[owner]
                        seen.append(((doc_of[pos] * n + item) * len(items.parts) + tag) * HASHES + f)
    if not seen:
        return none
    pair, count = np.unique(common.distinct(np.concatenate(seen)) // (HASHES * len(items.parts)), return_counts=True)
    return pair[count >= LEAST_MATCHES]


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])


def _verified(items: Items, post: Postings, rows: tuple, doc_of: np.ndarray, starts: np.ndarray, plains: list[str], least: float) -> list[tuple[int, int]]:
    """(document, item) of the postings that hold, for each document and item together."""
    place, shingle, item, own = rows
    n = len(items.ids)
    pair = doc_of[place] * n + item
    order = np.lexsort((place, pair))
    place, shingle, own, pair = place[order], shingle[order], own[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, int)
    found = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pair)]):
        d, k = divmod(int(pair[a]), n)
        if len(common.distinct(shingle[a:b])) >= least * items.size[k] and verify(items.text[k], plains[d], (place[a:b] - starts[d]).tolist(), own[a:b].tolist(), post.size):
            found.append((d, k))
    return found


def leaks_of(items: Items, ids: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """(doc_id, item_id) for a batch of documents."""
    found: list[tuple[int, int]] = []
    at, n = 0, len(items.ids)
    gap = "\0" * SHINGLE
    while at < len(texts):
        end, size, plains = at, 0, []
        while end < len(texts) and (end == at or size + len(texts[end]) < BATCH_CHARS):
            plains.append(plain(texts[end]))
            size += len(texts[end]) + SHINGLE
            end += 1
        lengths = np.array([len(t) + SHINGLE for t in plains])
        starts = np.cumsum(lengths) - lengths
        whole = gap.join(plains) + gap
        doc_of = np.repeat(np.arange(end - at), lengths)
        if len(items.main.keys):
            h = shingles(whole)
            known, which = items.main.known(h)
            pairs = candidates(items, h, doc_of[: len(h)], known) if len(known) else np.zeros(0, dtype=np.int64)
            if len(pairs):
                # exact containment of the candidates: distinct shingles of the item in the document
                rows = items.main.places(known, which)
                kept = np.isin(doc_of[rows[0]] * n + rows[2], pairs)
                found += [(ids[at + d], items.ids[k]) for d, k in _verified(items, items.main, tuple(x[kept] for x in rows), doc_of, starts, plains, LEAST_CONTAINMENT)]
        for post in items.small:
            known, which = post.known(shingles(whole, post.size))
            if len(known):
                found += [(ids[at + d], items.ids[k]) for d, k in _verified(items, post, post.places(known, which), doc_of, starts, plains, 0.0)]
        at = end
    return found


def leaks(docs: DataFrame, eval_items: DataFrame) -> DataFrame:
    """docs(doc_id, text), eval_items(item_id, text) -> distinct (doc_id, item_id)."""
    spark = docs.sparkSession
    rows = [(r[0], r[1]) for r in eval_items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct().toLocalIterator()]
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in sorted(rows):
        if size + len(r[1]) > MAX_ITEMS_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append(r)
        size += len(r[1])
    kept = common.spread(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text"))
    out = spark.createDataFrame([], _FOUND)
    for block in blocks:
        shared = spark.sparkContext.broadcast(Items(block))

        def search(batches, shared=shared):
            items = shared.value
            for b in batches:
                got = leaks_of(items, b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["doc_id", "item_id"]).astype("int64"), preserve_index=False)

        out = out.unionByName(kept.mapInArrow(search, _FOUND))
    return out.distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents").select("doc_id", "text"), common.read(spark, sf_dir, "eval_items").select("item_id", "text"))


def p9_documents(spark, sf_dir: str) -> DataFrame:
    """Each document concerned with the items it gives away."""
    return p9_found(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.count("*").alias("n_items"))
