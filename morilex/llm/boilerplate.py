"""Problem 7: lines that belong to the site, not to the page.

Method: content-defined chunking with a rolling hash instead of newlines. The normalised text of a document is one stream
in which a line feed is a character like any other. A rolling hash over the last WINDOW characters is taken at every place;
a chunk ends where the hash is smaller than at the `reach` places before and after it, so chunks have at least reach + 1
characters, end where the same characters stand whatever is around them, and run over line ends. A stretch without such a
place is cut every LONGEST characters, counted from its start. Chunks are taken at several scales (REACHES); a line is
looked at at the coarsest scale that puts a whole chunk within the line and its two feeds (its own chunks). Distinct
documents are counted for each (domain, chunk); chunks in at least `least` documents of a domain are excessive. A line all
of whose own chunks are excessive is a candidate, and the exact count of distinct documents for each (domain, line)
confirms it. Confirmed lines are cut.

Scale and own chunks of a line depend on its characters only. A line too short to hold a chunk at any scale is cut whole,
feeds included, as one chunk: without this fallback the method finds the share of cases that the README gives, with it all.

Lines are the same if they differ only in white space, width or compatibility form, or in the digits of numbers.

Plan: one pass in Arrow batches writes the own chunks of each line, once for each line of a document; documents are
counted for each 64-bit (domain, chunk) with map-side sums; only the chunks' counts are joined back. Keys that hold a
large share of all rows (a line of a site that holds a third of the corpus) are spread over many places in that join.

Defined results: null or empty text has no lines; a null domain is no domain and has no cases, nor has a row without
doc_id; a doc_id that occurs in several rows counts once; blank lines are no cases but keep their number.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Characters of the rolling hash, places to both sides among which an end has the least hash (powers of two), longest chunk.
WINDOW, REACHES, LONGEST = 3, (32, 16, 8, 4, 2, 1), 256
LEAST_DOCUMENTS = 5
#: Characters that are handled in one go, a longer text by itself: bounds the arrays in memory.
BATCH_CHARS = 2_000_000
_SPACE = re.compile(r"[^\S\n]+")
_DIGITS = re.compile(r"\d+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> str:
    """Same lines become equal; line feeds stay. Line by line: a mark at the start of a line joins nothing before it."""
    if not unicodedata.is_normalized("NFKC", text):
        text = "\n".join([unicodedata.normalize("NFKC", x) for x in text.split("\n")])
    return _DIGITS.sub("0", _SPACE.sub("", text))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def rolling(c: np.ndarray) -> np.ndarray:
    """The rolling hash of the last WINDOW characters at every place; the first places lack some of them."""
    m = _mix(c.astype(np.uint64))
    h = np.zeros(len(c), dtype=np.uint64)
    for j in range(min(WINDOW, len(c))):
        h[j:] += m[: len(c) - j] * np.uint64(pow(int(_BASE), j, 1 << 64))
    return _mix(h)


def ends(h: np.ndarray) -> dict[int, np.ndarray]:
    """For each scale the places (of their last character) where content ends a chunk: strictly the least hash in reach."""
    out, low, step = {}, h, 1  # low[i]: the least of the `step` hashes from i on
    while step <= max(REACHES):
        n = len(h) - 2 * step
        if n <= 0:
            at = np.zeros(0, dtype=np.int64)
        else:
            here = h[step : step + n]
            at = np.flatnonzero((here < low[:n]) & (here < low[step + 1 : step + 1 + n])) + step
        if step in REACHES:
            out[step] = at[at >= step + WINDOW - 1]
        low = np.minimum(low[: max(0, len(low) - step)], low[step:])
        step *= 2
    return out


def chunks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For normalised texts: (text index, line number from 1, line hash, chunk hash, whole) of the own chunks of all lines.

    whole marks the fallback: a line too short to hold a chunk of its own. Blank lines have none. One vectorised pass; all
    hashes depend on the characters of the line alone.
    """
    none = np.zeros(0, dtype=np.int64)
    joined = "".join(["\n" + t + "\n" for t in texts])
    if not joined:
        return none, none.astype(np.int32), none, none, none.astype(bool)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    with np.errstate(over="ignore"):
        feed = np.flatnonzero(c == 10)
        begin, end = feed[:-1] + 1, feed[1:]  # a line's characters are c[begin:end]
        size = end - begin
        # prefix sums of a polynomial hash: the value of any stretch comes from two of them
        m = _mix(c.astype(np.uint64))
        powers = np.cumprod(np.full(len(c) + 1, _BASE, dtype=np.uint64), dtype=np.uint64)
        inverse = np.cumprod(np.full(len(c) + 1, pow(int(_BASE), -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(m * powers[:-1], dtype=np.uint64)])
        value = lambda a, b: _mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64) * _BASE)

        at_scale = ends(rolling(c))
        has = np.zeros(len(size), dtype=bool)
        own, key = [none], [np.zeros(0, dtype=np.uint64)]
        for reach in REACHES:
            e = at_scale[reach]
            if len(e) < 2:
                continue
            line = np.searchsorted(feed, e[:-1], side="right") - 1  # the line, or the feed before it, in which the chunk before ends
            # all places on which both ends depend lie within the line and its feeds
            inside = (line >= 0) & (line < len(size))
            inside &= (e[:-1] - reach - WINDOW + 1 >= feed[line]) & (e[1:] + reach <= feed[np.minimum(line + 1, len(feed) - 1)])
            inside &= ~has[np.minimum(line, len(size) - 1)]
            a, b, line = e[:-1][inside] + 1, e[1:][inside] + 1, line[inside]
            cuts = -(-(b - a) // LONGEST)
            owner = np.repeat(np.arange(len(a)), cuts)
            at = a[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * LONGEST
            own.append(line[owner])
            key.append(value(at, np.minimum(at + LONGEST, b[owner])))
            has[line] = True
        own, key = np.concatenate(own), np.concatenate(key)
        short = np.flatnonzero(~has & (size > 0))
        lines = value(begin, end)
        which = np.concatenate([own, short])
        key = np.concatenate([key, value(begin[short] - 1, end[short] + 1)])
    whole = np.arange(len(which)) >= len(own)
    # the feed before a text starts it: texts are parted by two feeds
    heads = np.cumsum([len(t) + 2 for t in texts]) - np.array([len(t) + 2 for t in texts])
    text = np.searchsorted(heads, begin[which] - 1, side="right") - 1
    first_line = np.searchsorted(feed, heads)
    order = np.lexsort((whole, which))
    which, text, key, whole = which[order], text[order], key[order], whole[order]
    return text, (which - first_line[text] + 1).astype(np.int32), lines[which].view(np.int64), key.view(np.int64), whole


_CHUNKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("domain_key", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("line_key", T.LongType()), T.StructField("whole", T.BooleanType()), T.StructField("chunks", T.ArrayType(T.LongType()))])


def _pieces(text: str):
    """(lines before, part of the text) of at most about BATCH_CHARS characters each, parted at line feeds."""
    before = 0
    while len(text) > BATCH_CHARS:
        cut = text.find("\n", BATCH_CHARS)
        if cut < 0:
            break
        yield before, text[:cut]
        before += text.count("\n", 0, cut) + 1
        text = text[cut + 1 :]
    yield before, text


def _chunked(batches):
    for b in batches:
        ids, dom = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("domain_key").to_numpy(zero_copy_only=False)
        pieces = [(i, before, part) for i, x in enumerate(b.column("text").to_pylist()) for before, part in _pieces(normalised(x))]
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end][2]) < BATCH_CHARS):
                size += len(pieces[end][2])
                end += 1
            rows, before = np.array([p[0] for p in pieces[at:end]]), np.array([p[1] for p in pieces[at:end]])
            t, no, line, value, whole = chunks([p[2] for p in pieces[at:end]])
            at = end
            if len(t):
                first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (no[1:] != no[:-1])]))
                offsets = np.concatenate([first, [len(t)]]).astype(np.int32)
                row, no = rows[t[first]], (no[first] + before[t[first]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(dom[row]), pa.array(no), pa.array(line[first]), pa.array(whole[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))], names=_CHUNKS.names)


def chunked_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, domain, text) -> one row for each non-blank line: (doc_id, domain_key, line_no, line_key, whole, chunks)."""
    kept = docs.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("domain").alias("domain_key"), "text")
    return common.spread(kept).mapInArrow(_chunked, _CHUNKS)


def site_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, fallback: bool = True) -> DataFrame:
    """(doc_id, line_no, line_key) of every line that stands in at least `least` documents of its domain.

    fallback: whether lines too short to hold a chunk take part.
    """
    lines = chunked_lines(docs)
    if not fallback:
        lines = lines.where("not whole")
    lines = common.written(lines.select("doc_id", "line_no", F.xxhash64("domain_key", "line_key").alias("line_key"), "domain_key", "chunks"), "chunked")
    key = F.xxhash64("domain_key", "chunk").alias("key")
    # documents for each (domain, chunk): a document counts once, in whatever rows and lines it has the chunk
    flat = lines.select("doc_id", "domain_key", F.explode("chunks").alias("chunk")).select("doc_id", key)
    counted = flat.groupBy("key", "doc_id").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    often = common.written(counted.select("key", "n"), "often")
    # a line all of whose chunks are excessive is a candidate
    asked = lines.select("doc_id", "line_no", "line_key", F.size("chunks").alias("n_chunks"), "domain_key", F.explode("chunks").alias("chunk")).select("doc_id", "line_no", "line_key", "n_chunks", key)
    hit = common.join_hot(asked, often, ["key"], "n", "left_semi").groupBy("doc_id", "line_no", "line_key", "n_chunks").agg(F.count("*").alias("hits")).where("hits >= n_chunks")
    candidates = common.written(hit.select("doc_id", "line_no", "line_key"), "line-candidates")
    common.free(lines, often)
    # the exact check: distinct documents of each candidate line
    docs_of = candidates.groupBy("line_key", "doc_id").agg(F.count("*").alias("n")).groupBy("line_key").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    site = common.written(docs_of.select("line_key", "n"), "site-lines")
    return common.join_hot(candidates, site, ["line_key"], "n", "left_semi")


def repeated_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS, fallback: bool = True) -> DataFrame:
    """(doc_id, line_no) of every line that stands in at least `least` documents of its domain."""
    return site_lines(docs, least, fallback).select("doc_id", "line_no").distinct()


def p7_found(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(common.read(spark, sf_dir, "documents").select("doc_id", "domain", "text"))


def p7_site_lines(spark, sf_dir: str) -> DataFrame:
    """The lines of each domain: one spelling of each, and how often and in how many documents it stands."""
    docs = common.read(spark, sf_dir, "documents")
    found = site_lines(docs.select("doc_id", "domain", "text"))
    per = found.groupBy("line_key", "doc_id").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"))
    counted = per.groupBy("line_key").agg(F.sum("n").alias("occurrences"), F.count("*").alias("docs"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    # one occurrence of each line, fetched from its document
    first = counted.select("line_key", "occurrences", "docs", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    fetched = first.join(docs.where("domain is not null and text is not null").select("doc_id", "domain", "text"), "doc_id").withColumn("example", F.try_element_at(F.split("text", "\n", -1), F.col("line_no"))).where("example is not null").select("domain", F.xxhash64("domain").alias("domain_key"), "line_key", "occurrences", "docs", "example")
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("domain_key", T.LongType()), T.StructField("line_key", T.LongType()), T.StructField("occurrences", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("example", T.StringType()), T.StructField("line_form", T.StringType()), T.StructField("form_key", T.LongType())])

    def forms(batches):
        for b in batches:
            texts = [normalised(x) for x in b.column("example").to_pylist()]
            keys = np.zeros(len(texts), dtype=np.int64)
            if texts:
                t, _, line, _, _ = chunks(texts)
                keys[t] = line
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(keys)], names=schema.names)

    # where a doc_id has several rows only the row with this very line counts
    own = fetched.mapInArrow(forms, schema).where(F.xxhash64("domain_key", "form_key") == F.col("line_key"))
    return own.groupBy("domain", "line_form", "occurrences", "docs").agg(F.min("example").alias("example"))


def p7_cleaned(spark, sf_dir: str) -> DataFrame:
    """Every document without the lines of its site."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "document_id", "domain", "text")
    # at most the lines of the document itself
    cut = repeated_lines(docs.select("doc_id", "domain", "text")).groupBy("doc_id").agg(F.collect_list("line_no").alias("cut"))
    kept = "array_except(sequence(1, size(lines)), coalesce(cut, array()))"  # keeps the order, by a hash of the numbers
    body = F.expr(f"case when text is null or cut is null or domain is null then text else array_join(transform({kept}, i -> lines[i - 1]), '\n') end")
    split = docs.withColumn("lines", F.split("text", "\n", -1))
    return split.join(cut, "doc_id", "left").select("doc_id", "document_id", body.alias("text"), F.when(F.col("domain").isNull(), 0).otherwise(F.coalesce(F.size("cut"), F.lit(0))).alias("lines_cut"))
