"""Readers of raw text, analysed text, standard XML and corpora, behind one dispatcher."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import host
from ..operators.storage import row_index

MAX_XML_BYTES = 16 * 1024 * 1024
_SENTENCES = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("sent_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("bnst_idx", T.IntegerType()), T.StructField("midasi", T.StringType()), T.StructField("yomi", T.StringType()), T.StructField("genkei", T.StringType()), T.StructField("hinsi", T.StringType()), T.StructField("bunrui", T.StringType()), T.StructField("katuyou1", T.StringType()), T.StructField("katuyou2", T.StringType()), T.StructField("imis", T.StringType()), T.StructField("fstring", T.StringType()), T.StructField("homograph", T.BooleanType())])


def numbered_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(file, block, line_no, value) of the records of text files, numbered from 1 within their file.

    Files are read in their splits: no task holds more than one. A split's records are numbered by a window over it, and
    what comes before a split is a sum of counts, one small row for each split.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    t = (reader.option("lineSep", separator) if separator else reader).text(path)
    t = t.select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("_id"), "value")
    counts = t.groupBy("file", "block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = t.withColumn("_k", F.row_number().over(W.partitionBy("file", "block").orderBy("_id")))
    return within.join(before, ["file", "block"]).select("file", "block", (F.col("_before") + F.col("_k")).cast("int").alias("line_no"), "value")


def carried(lines: DataFrame, header, name: str) -> DataFrame:
    """Adds `name`: the last header at or above each line of its file; header is null on other lines. Within a split by a
    window over it, into a split by the last header of those before it."""
    own = lines.withColumn("_h", header)
    last = own.where("_h is not null").groupBy("file", "block").agg(F.max_by("_h", "line_no").alias("_last"))
    every = own.select("file", "block").distinct().join(last, ["file", "block"], "left")
    into = every.withColumn("_into", F.last("_last", ignorenulls=True).over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).drop("_last")
    w = W.partitionBy("file", "block").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return own.join(into, ["file", "block"]).withColumn(name, F.coalesce(F.last("_h", ignorenulls=True).over(w), F.col("_into"))).drop("_h", "_into")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, raw): one sentence for each line; compressed files are read as they are."""
    return numbered_lines(spark, path).where(F.trim("value") != "").select("file", F.col("line_no").alias("sent_id"), F.col("value").alias("raw"))


def read_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, sent_id, raw) of files that hold several documents, each headed by `#document<TAB>id`; lines count from it."""
    lines = numbered_lines(spark, path)
    id_ = F.regexp_extract("value", r"^#document\t(.*)$", 1)
    head = F.when(F.col("value").startswith("#document\t"), F.struct(F.trim(id_).alias("doc_id"), F.col("line_no").alias("at")))
    d = carried(lines, head, "head").where(F.col("head").isNotNull() & ~F.col("value").startswith("#document\t") & (F.trim("value") != ""))
    return d.select("head.doc_id", (F.col("line_no") - F.col("head.at")).alias("sent_id"), F.col("value").alias("raw"))


def parse_analysis(text: str, doc: str | None = None, domain: str | None = None, n: int = 0):
    """Rows of analysed text: morpheme lines, `*` phrase heads, `+` lines, `@` homographs, `# S-ID:`, `#document id domain`, EOS.

    doc, domain, n: the document that the text begins in, and how many of its sentences came before.
    """
    sid, pos, bnst = None, -1, -1
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if line.startswith("#document"):
            parts = re.split(r"[\t ]", line)
            doc, domain = (parts[1] if len(parts) > 1 else None), (parts[2] if len(parts) > 2 else None)
            n = 0
        elif line.startswith("#"):
            m = re.search(r"S-ID:(\S+)", line)
            sid = m.group(1) if m else sid
        elif line.startswith("EOS"):  # also a malformed end mark with text after it
            n, pos, bnst, sid = n + 1, -1, -1, None
        elif line.startswith("* "):
            bnst += 1
        elif line.startswith("+ ") or not line.strip():
            continue
        else:
            homograph = line.startswith("@ ")
            f = (line[2:] if homograph else line).split(" ", 11)
            if len(f) < 11:
                continue
            if not homograph:
                pos += 1
            tail = f[11] if len(f) > 11 else ""
            m = re.match(r'("(?:[^"\\]|\\.)*"|NIL)?\s*(.*)', tail)
            none = lambda x: None if x == "*" else x
            yield (doc, domain, sid or str(n), pos, bnst, f[0], f[1], f[2], f[3], none(f[5]), none(f[7]), none(f[9]), None if m.group(1) in (None, "NIL") else m.group(1).strip('"') or None, m.group(2) or None, homograph)


def parse_phrases(text: str, doc: str | None = None, domain: str | None = None, n: int = 0):
    """(doc_id, sent_id, bnst_idx, parent_idx, dpndtype, fstring) of the `*` lines of analysed text."""
    sid, bnst = None, -1
    for line in text.split("\n"):
        if line.startswith("#document"):
            parts = re.split(r"[\t ]", line.rstrip("\r"))
            doc, n = (parts[1] if len(parts) > 1 else None), 0
        elif line.startswith("#"):
            m = re.search(r"S-ID:(\S+)", line)
            sid = m.group(1) if m else sid
        elif line.startswith("EOS"):
            n, bnst, sid = n + 1, -1, None
        elif m := re.match(r"\* (-?\d+)([A-Z]) ?(.*)", line.rstrip("\r")):
            bnst += 1
            yield doc, sid or str(n), bnst, int(m.group(1)), m.group(2), m.group(3)


def _parsed(spark: SparkSession, path: str, glob: str, parse, schema: T.StructType) -> DataFrame:
    """Sentences of analysed files, each parsed by itself: records end where a line begins with EOS, whatever follows there."""
    if glob != "*":
        path = f"{path.rstrip('/')}/{glob}"
    r = numbered_lines(spark, path, "\nEOS")
    line = F.regexp_extract("value", r"(?m)^#document[\t ](.*)$", 1)
    parts = F.split(F.rtrim(line), "[\\t ]")
    head = F.when(F.col("value").rlike(r"(?m)^#document[\t ]"), F.struct(F.element_at(parts, 1).alias("doc"), F.try_element_at(parts, F.lit(2)).alias("domain"), F.col("line_no").alias("at")))
    d = carried(r, head, "head").select("head.doc", "head.domain", (F.col("line_no") - F.coalesce("head.at", F.lit(1))).alias("n"), "value")

    def rows(batches):
        import pandas as pd

        for b in batches:
            got = [x for doc, domain, n, text in zip(b["doc"], b["domain"], b["n"], b["value"]) for x in parse(text, doc, domain, n)]
            yield pd.DataFrame(got, columns=schema.names)

    return d.mapInPandas(rows, schema)


def read_phrases(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Phrases of analysed files with their dependency."""
    schema = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("sent_id", T.StringType()), T.StructField("bnst_idx", T.IntegerType()), T.StructField("parent_idx", T.IntegerType()), T.StructField("dpndtype", T.StringType()), T.StructField("fstring", T.StringType())])
    return _parsed(spark, path, glob, parse_phrases, schema)


def read_analysis(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Morphemes of analysed files, one row each."""
    return _parsed(spark, path, glob, parse_analysis, _SENTENCES)


def read_standard_xml(spark: SparkSession, path: str, root: str = "StandardFormat") -> DataFrame:
    """(url, domain, sent_id, raw, analysis) of Japanese sentences; files beyond 16 MiB are left out."""
    schema = T.StructType([T.StructField("_Url", T.StringType()), T.StructField("Text", T.StructType([T.StructField("S", T.ArrayType(T.StructType([T.StructField("_Id", T.StringType()), T.StructField("_is_Japanese_Sentence", T.StringType()), T.StructField("_is_Normal_Sentence", T.StringType()), T.StructField("RawString", T.StringType()), T.StructField("Annotation", T.StringType())])))]))])
    d = spark.read.format("xml").option("rowTag", root).option("recursiveFileLookup", True).schema(schema).load(path).where(F.col("_metadata.file_size") <= MAX_XML_BYTES)
    s = d.select(F.col("_Url").alias("url"), F.explode("Text.S").alias("s"))
    mark = F.when(F.coalesce("s._is_Japanese_Sentence", F.lit("0")) != "0", F.col("s._is_Japanese_Sentence")).otherwise(F.col("s._is_Normal_Sentence"))
    return s.where(mark == "1").select("url", host(F.col("url")).alias("domain"), F.col("s._Id").alias("sent_id"), F.col("s.RawString").alias("raw"), F.col("s.Annotation").alias("analysis"))


def read_parallel(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Two analysed corpora side by side: morphemes of both joined by sentence and place."""
    a, b = read_analysis(spark, first, "*"), read_analysis(spark, second, "*")
    key = ["sent_id", "pos"]
    pick = lambda d, p: d.where("not homograph").select(*key, *[F.col(c).alias(f"{p}_{c}") for c in ("midasi", "genkei", "hinsi", "katuyou2")])
    return pick(a, "first").join(pick(b, "second"), key, "full_outer")


def read_bitext(spark: SparkSession, path: str, by_paper: bool = False) -> DataFrame:
    """(doc_id, sent_id, raw) of lines `id<TAB>text`; the id is domain-paper-sentence; a paper's lines form one document."""
    t = spark.read.text(path).select(F.split("value", "\t", 2).alias("p")).where(F.size("p") == 2).select(F.element_at("p", 1).alias("id"), F.element_at("p", 2).alias("raw"))
    if not by_paper:
        return t.select(F.col("id").alias("doc_id"), F.lit(1).alias("sent_id"), "raw")
    paper, line = F.regexp_extract("id", r"^(.*)-\d+$", 1), F.regexp_extract("id", r"-(\d+)$", 1).cast("int")
    return t.select(F.when(paper == "", F.col("id")).otherwise(paper).alias("doc_id"), F.coalesce(line, F.lit(1)).alias("sent_id"), "raw")


def read_bitext_xml(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, raw) of the sentences of bitext in XML, each a document of its own, under the id above it."""
    lines = numbered_lines(spark, path)
    id_ = F.coalesce(*[F.nullif(F.regexp_extract("value", p, 1), F.lit("")) for p in (r'docid="([^"]+)"', r'<para_sentence id="([^"]+)"')])
    found = carried(lines, id_, "doc_id").withColumn("raw", F.regexp_extract("value", "<i_sentence>([^<>]+)</i_sentence>", 1))
    return found.where("raw <> ''").select("doc_id", "line_no", "raw")


def read_sorted_bitext(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, line_no, raw) of sorted bitext: a line `# X ID n n` before each sentence; sentences of one id are one document."""
    lines = numbered_lines(spark, path)
    pattern = r"^# [A-Za-z] ([0-9_A-Z.]+) [0-9]+ [0-9]+$"
    found = carried(lines, F.when(F.col("value").rlike(pattern), F.regexp_extract("value", pattern, 1)), "doc_id")
    return found.where(F.col("doc_id").isNotNull() & ~F.col("value").rlike(pattern) & (F.trim("value") != "")).select("doc_id", "line_no", F.col("value").alias("raw"))


def read_instances(spark: SparkSession, path: str, binary: bool = True) -> DataFrame:
    """(name, label, origin, feats) of lines `name<TAB>label<TAB>origin<TAB>fid:value ...`; values count as 1 if binary."""
    t = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 4)
    pairs = F.transform(F.filter(F.split(F.element_at("p", 4), "[ \t]+"), lambda x: x.contains(":")), lambda x: F.struct(F.element_at(F.split(x, ":"), 1).cast("int").alias("fid"), (F.lit(1.0) if binary else F.element_at(F.split(x, ":"), 2).cast("double")).alias("v")))
    return t.select(F.element_at("p", 1).alias("name"), F.element_at("p", 2).alias("label"), F.element_at("p", 3).alias("origin"), pairs.alias("feats"))


def read_variants(spark: SparkSession, path: str, jis_only: bool = False) -> DataFrame:
    """(a, b, kind) of character variants (as code points) from lines `U+XXXX<TAB>property<TAB>U+YYYY ...`, with reversed edges as kind2.

    jis_only: only characters of the Japanese sets, which are those with a property kJis0 or kJis1.
    """
    kinds = {"kTraditionalVariant": "T", "kSimplifiedVariant": "S", "kZVariant": "Z"}
    t = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 3)
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    if jis_only:
        own = t.where(F.element_at("p", 2).isin("kJis0", "kJis1")).select(F.element_at("p", 1).alias("c")).distinct()
        t = t.join(own, F.element_at("p", 1) == F.col("c"), "left_semi")
    edges = t.select(F.element_at("p", 1).alias("a"), F.try_element_at(table, F.element_at("p", 2)).alias("kind"), F.explode(F.regexp_extract_all(F.element_at("p", 3), F.lit(r"U\+[0-9A-F]+"), F.lit(0))).alias("b")).where("kind is not null").select("a", "b", "kind")
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.concat("kind", F.lit("2")).alias("kind"))).distinct()


def running_header(lines: DataFrame, order: list[str], value: str, pattern: str) -> DataFrame:
    """Adds `header`: the last header line above each line, within a file ordered by `order`; header lines are left out."""
    w = W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    h = F.when(F.col(value).rlike(pattern), F.regexp_extract(value, pattern, 1))
    return lines.withColumn("header", F.last(h, ignorenulls=True).over(w)).where(~F.col(value).rlike(pattern))


def shard_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows of files whose name holds a number from start to end."""
    number = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(\d+)", 1).cast("int")
    return df.where(number.between(start, end))


READERS = {"bitext_xml": read_bitext_xml, "bitext_sorted": read_sorted_bitext, "raw": read_raw, "rawdata": read_raw_documents, "analysed": read_analysis, "docdir": read_standard_xml, "bitext": read_bitext}


def read(spark: SparkSession, **options) -> DataFrame:
    """The first source that is named, in the order of READERS."""
    for name, reader in READERS.items():
        if name in options:
            return reader(spark, options[name])
    raise ValueError(f"none of {', '.join(READERS)} is named")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def round_robin(df: DataFrame, keys: list[str], shards: int) -> DataFrame:
    """Adds `shard`: row i of the order goes to i mod shards."""
    return row_index(df, keys, "_i").withColumn("shard", ((F.col("_i") - 1) % shards).cast("int")).drop("_i")


def format_analysis(morphemes: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): the analysis of each sentence as text that `parse_analysis` reads; a sentence ends with EOS."""
    none = lambda c: F.coalesce(F.col(c), F.lit("*"))
    imis = F.coalesce(F.concat(F.lit('"'), F.col("imis"), F.lit('"')), F.lit("NIL"))
    line = F.concat(F.when(F.coalesce("homograph", F.lit(False)), "@ ").otherwise(""), F.concat_ws(" ", "midasi", "yomi", "genkei", "hinsi", F.lit("0"), none("bunrui"), F.lit("0"), none("katuyou1"), F.lit("0"), none("katuyou2"), F.lit("0"), imis, F.coalesce("fstring", F.lit(""))))
    row = F.struct("pos", F.coalesce("homograph", F.lit(False)).alias("h"), F.coalesce("bnst_idx", F.lit(-1)).alias("b"), line.alias("line"))
    g = morphemes.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("m"))  # the words of one sentence
    lines = F.flatten(F.transform("m", lambda x, i: F.when((x["b"] >= 0) & ((i == 0) | (x["b"] != F.element_at("m", F.greatest(i, F.lit(1)))["b"])), F.array(F.lit("* -1D"), x["line"])).otherwise(F.array(x["line"]))))
    return g.select(*by, F.concat(F.lit("# S-ID:"), F.col(by[-1]).cast("string"), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nEOS")).alias("text"))


def undo_changes(morphemes: DataFrame) -> DataFrame:
    """Words as they were before the parser changed their part of speech: what its mark names is put back.

    The mark is <品詞変更:surface-reading-base-class-subclass-type-form>.
    """
    mark = r"<品詞変更:([^>-]*)-([^>-]*)-([^>-]*)-([^>-]*)-([^>-]*)-([^>-]*)-([^>-]*)>"
    changed = F.coalesce(F.col("fstring").rlike(mark), F.lit(False))
    back = {c: F.when(changed, F.nullif(F.regexp_extract("fstring", mark, i), F.lit(""))).otherwise(F.col(c)) for i, c in enumerate(("midasi", "yomi", "genkei", "hinsi", "bunrui", "katuyou1", "katuyou2"), 1) if c in morphemes.columns}
    return morphemes.withColumns(back)


class Pool:
    """Sources of documents that are given out one after the other, the last one added first."""

    def __init__(self):
        self._held: list[DataFrame] = []

    def add(self, documents: DataFrame) -> None:
        self._held.append(documents)

    def is_empty(self) -> bool:
        return not self._held

    def get(self) -> DataFrame | None:
        return self._held.pop() if self._held else None
