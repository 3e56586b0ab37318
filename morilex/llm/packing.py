"""Problem 8: documents into containers of fixed capacity.

Method: shortest-pack-first over the length histogram. Lengths are placed longest first; each goes into the open packing
pattern with the most space left, and the counts of the patterns are updated, so the work depends on the capacity and
not on the number of documents. Then patterns are joined back to documents by the rank of a document among those of its
length. A document longer than the capacity is split into pieces of the full capacity and a rest, each with the place of
its characters in the text, so that it can be cut back from it.

Bounds: a step of the placement either uses up a pattern or ends a length, so there are fewer than 2 * capacity patterns
and, as the distinct lengths of a pattern add up to at most the capacity, at most 2 * capacity * sqrt(2 * capacity) slots
(5 MB at 2,048). Only the histogram (at most `capacity` rows) reaches the driver.

Sizes are tokens of a public tokenizer, whose file is a parameter. Defined results: null and empty texts are left out; a
text without tokens (white space) counts as one token; equal doc_ids are packed as separate rows.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CAPACITY = 2048
TOKENIZER = os.environ.get("MORILEX_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def _tiktoken(path: str):
    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """A function from texts to their numbers of tokens, by the kind of the tokenizer's file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        coding = _tiktoken(path)
        return lambda texts: [len(coding.encode_ordinary(x)) for x in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def locator(path: str):
    """A function from a text to the character each of its tokens begins at."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        return lambda text: [a for a, _ in model.encode(text, return_type="offset_mapping")["offsets"]]
    if path.endswith(".tiktoken"):
        coding = _tiktoken(path)
        return lambda text: coding.decode_with_offsets(coding.encode_ordinary(text))[1]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    return lambda text: [a for a, _ in model.encode(text, add_special_tokens=False).offsets]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(containers, ((length, times), ...)), ...]: packing patterns with their counts, for {length: documents}."""
    open_by_space: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)
    done = []
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        waiting: list[tuple[int, int, dict[int, int]]] = []
        space = max((s for s, v in open_by_space.items() if v), default=0)
        while left:
            while space >= length and not open_by_space.get(space):
                space -= 1
            if space < length:
                # no pattern has room: new containers, filled with as many of this length as fit
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    waiting.append((capacity - each * length, full, {length: each}))
                if rest:
                    waiting.append((capacity - rest * length, 1, {length: rest}))
                break
            n, pattern = open_by_space[space].pop()
            take = min(n, left)
            if take < n:
                open_by_space[space].append((n - take, pattern))
            pattern = dict(pattern)
            pattern[length] = pattern.get(length, 0) + 1
            left -= take
            if space - length >= length:  # it may take this length again, after those with more space
                open_by_space[space - length].append((take, pattern))
            else:
                waiting.append((space - length, take, pattern))
        for s, n, pattern in waiting:
            (open_by_space[s].append((n, pattern)) if s > 0 else done.append((n, pattern)))
    done += [x for v in open_by_space.values() for x in v]
    return [(n, tuple(sorted(p.items(), reverse=True))) for n, p in done]


def slots(patterns) -> pd.DataFrame:
    """Where the ranks of each length go: (length, start rank, times in a container, number of the first container)."""
    rows, base, used = [], 0, defaultdict(int)
    for n, pattern in patterns:
        for length, times in pattern:
            rows.append((length, used[length], times, base))
            used[length] += n * times
        base += n
    return pd.DataFrame(rows, columns=["length", "start", "times", "base"])


_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType())])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> one row for each document or piece, numbered within its task and length."""

    def cut(batches):
        count, locate = counter(tokenizer), None
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            out: list[tuple[int, int, int, int, int, int, int]] = []
            for at in range(0, len(texts), 256):
                for i, text, n in zip(ids[at : at + 256], texts[at : at + 256], count(texts[at : at + 256])):
                    n = max(1, n)
                    ends = [len(text)]
                    if n > capacity:
                        locate = locate or locator(tokenizer)
                        # where each further piece begins, never before the one before it
                        places = np.maximum.accumulate(np.array(locate(text), dtype=np.int64))
                        ends = [*places[capacity:n:capacity].tolist(), len(text)]
                    for k, (a, z) in enumerate(zip([0, *ends], ends)):
                        size = min(capacity, n - k * capacity)
                        out.append((i, k, size, a, z, part, int(seen[size])))
                        seen[size] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=_PIECES.names)

    kept = docs.where(F.col("text").isNotNull() & (F.col("text") != "")).select("doc_id", "text")
    return common.spread(kept).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, piece, n_tokens, start_char, end_char, container), containers from 0."""
    got = common.written(pieces(docs, tokenizer, capacity), "pieces")
    parts = got.groupBy("n_tokens", "part").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in got.groupBy("n_tokens").agg(F.count("*")).collect()}
    where = slots(shortest_pack_first(histogram, capacity))
    by_length = {int(k): (g["start"].to_numpy(), g["times"].to_numpy(), g["base"].to_numpy()) for k, g in where.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(by_length)
    # ranks before each task's documents of a length: one row for each (task, length)
    before = parts.withColumn("before", F.sum("n").over(W.partitionBy("n_tokens").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("n_tokens", "part", F.coalesce("before", F.lit(0)).alias("before"))

    @F.pandas_udf(T.LongType())
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(length), dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(sizes, kind="stable")
        ends = np.flatnonzero(np.diff(sizes[order])) + 1
        for rows in np.split(order, ends) if len(order) else []:
            start, times, base = shared.value[int(sizes[rows[0]])]
            k = np.searchsorted(start, ranks[rows], side="right") - 1
            out[rows] = base[k] + (ranks[rows] - start[k]) // times[k]
        return pd.Series(out)

    ranked = got.join(before, ["n_tokens", "part"]).withColumn("rank", F.col("before") + F.col("seq"))
    return ranked.select("doc_id", "piece", "n_tokens", "start_char", "end_char", container("n_tokens", "rank").alias("container"))


def p8_containers(spark, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_complete(spark, sf_dir: str) -> DataFrame:
    """Every document with the characters of its pieces, and whether all of its containers hold what they may."""
    c = common.written(p8_containers(spark, sf_dir), "containers")
    used = c.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return c.join(used, "container").groupBy("doc_id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("chars"), F.bool_and(F.col("used") <= CAPACITY).alias("fits"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    """How many containers are filled to what tenth."""
    full = p8_containers(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return full.groupBy(F.floor(F.col("used") * 10 / CAPACITY).cast("int").alias("tenths")).agg(F.count("*").alias("containers"), F.min("used").alias("least"), F.max("used").alias("most"))
