"""Problem 1: visually identical text with different characters.

Method. Every value is mapped to look-alike-free characters in SQL (width forms, radicals, compatibility ideographs,
spaces, look-alike letters and dashes; characters without a glyph are dropped), then values are grouped under Spark's
accent-sensitive UNICODE collation, which makes composed and decomposed accents equal and keeps accents, case, width of
meaning and kana apart. In each class the least value by code point of those that occur most often is the canonical
member; it is joined back to every row.

The look-alike table is built by rule: compatibility forms from the character database, letters of other scripts from the
public confusables data that the collation library carries (single letters only, ideographs among themselves left apart,
as a different ideograph is a different word), and the fixed values below.

Plan: exact copies are one row before anything else, so a text that fills a third of all rows is mapped once. Values are
grouped by the binary key of the collation, which a hash aggregate takes; only classes with several texts are joined back,
pairs are formed of distinct texts, and rows come to them last, from the rarer text of a pair to the more frequent one,
hot texts spread over many places.

Defined results: null is left out; a value that is empty after mapping is a class of its own and equals nothing; repeated
rows are members like others; very long texts are mapped whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as _column

from . import common
from .mojibake import repair_udf

#: Marked as not deterministic so that it stays above the join: only members of classes with several texts are judged.
_judged = repair_udf.asNondeterministic()

# Letters of other scripts that look like the second of the pair.
LATIN_LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХ": "ABESIJKMHOPCTYX",
    "аеоѕіјрсух": "aeosijpcyx",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "ον": "ov",
    "ԁԛԝһ": "dqwh",
}
# Kana that look like ideographs or like kana of the other syllabary.
KANA_LOOKALIKES = {"夕二力口工八卜丿へべぺ": "タニカロエハトノヘベペ"}
# Strokes that stand for the long vowel mark, and marks of quotation.
STROKES = {"一―—–─━‐‑‒−﹣﹘﹣－-": "ー" * 15}
MARKS = {"‘’‛′＇ʼ`´": "'" * 8, "“”‟″＂": '"' * 5, "〜～∼": "~~~", "·•∙⋅・･": "・" * 6, "⁄∕": "//", "…": "…"}
#: Combining marks that half-width text writes as characters of their own.
VOICED = {"゛ﾞ": "゙゙", "゜ﾟ": "゚゚"}


#: Where letters of other scripts, letter-like signs, radicals and kana are, whose look-alikes the public data names.
_LETTERS = ((0x370, 0x590), (0x13A0, 0x1400), (0x2100, 0x2190), (0x2E80, 0x2FE0), (0x3041, 0x3100), (0x31C0, 0x31F0), (0xAB70, 0xABC0))


def confusables(spark: SparkSession) -> dict[str, str]:
    """Letters and the single letter each looks like, from the confusables of the session's ICU library."""
    chars = [chr(c) for a, b in _LETTERS for c in range(a, b) if unicodedata.category(chr(c))[0] in "LNS"]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    out = {}
    for c, like in zip(chars, skeletons):
        if len(like) != 1 or like == c or not unicodedata.category(like).startswith("L"):
            continue
        # the public form of the capital I is the small l
        out[c] = "I" if like == "l" and (c.isupper() or c in "ⅠӀ") else like
    return out


@lru_cache(None)
def folding(spark: SparkSession) -> tuple[str, str]:
    """(from, to) for translate(), built by rule from the character database, the confusables and the fixed values above."""
    table = confusables(spark)
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
        c = chr(code)
        if unicodedata.category(c) == "Zs":
            table[c] = " "
            continue
        tag = unicodedata.decomposition(c).split(" ")
        full = unicodedata.normalize("NFKC", c)
        ideograph = "⺀" <= c <= "⿟" or "豈" <= c <= "﫿" or code >= 0x2F800
        if len(full) == 1 and full != c and (tag[0] in ("<wide>", "<narrow>", "<font>") or ideograph):
            table[c] = full
    for group in (VOICED, LATIN_LOOKALIKES, KANA_LOOKALIKES, STROKES, MARKS):
        for a, b in group.items():
            table |= {x: y for x, y in zip(a, b) if x != y}
    for keep in {y for group in (VOICED, LATIN_LOOKALIKES, KANA_LOOKALIKES, STROKES, MARKS) for y in "".join(group.values())}:
        table.pop(keep, None)  # what others are folded to stays
    for _ in range(3):  # a folded form may itself be a look-alike
        table = {a: table.get(b, b) for a, b in table.items()}
    for c in "\t\n\r\x0b\x0c\x85":
        table[c] = " "
    table = {a: b for a, b in table.items() if a != b}
    return "".join(table), "".join(table.values())


#: Characters without a glyph of their own.
INVISIBLE = "[\\x{00}-\\x{08}\\x{0e}-\\x{1f}\\x{7f}\\x{ad}\\x{34f}\\x{61c}\\x{115f}\\x{1160}\\x{17b4}\\x{17b5}\\x{180b}-\\x{180f}\\x{200b}-\\x{200f}\\x{202a}-\\x{202e}\\x{2060}-\\x{206f}\\x{fe00}-\\x{fe0f}\\x{feff}\\x{fff9}-\\x{fffb}\\x{e0001}-\\x{e007f}\\x{e0100}-\\x{e01ef}]"


def folded(spark: SparkSession, c: Column) -> Column:
    """The look-alike mapping, as a JVM expression."""
    a, b = folding(spark)
    c = F.translate(F.regexp_replace(c, INVISIBLE, ""), a, b)
    # a mark written after its kana as a character of its own, also where a space was folded between
    return F.trim(F.regexp_replace(c, " +", " "))


def collation_key(spark: SparkSession, c: Column) -> Column:
    """The binary key of a string under the UNICODE collation: equal where the collation holds strings for equal."""
    jvm = spark._jvm
    collated = F.collate(c, "UNICODE")
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return _column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.CollationKey(utils.expression(collated._jc))))


def keyed_texts(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """One row for each distinct (group, text) that is not empty after mapping: its number of rows and its class's key."""
    spark = df.sparkSession
    counted = df.where(F.col(text).isNotNull()).groupBy(*group, text).agg(F.count("*").alias("n"))
    mapped = counted.withColumn("_folded", folded(spark, F.col(text))).where(F.length("_folded") > 0)
    return common.written(mapped.select(*group, text, "n", collation_key(spark, F.col("_folded")).alias("key")), "look-alikes")


def classes(keyed: DataFrame, group: list[str], text: str) -> DataFrame:
    """(group, key, canonical, n_texts) of the classes with several texts. No group is gathered into one value."""
    best = keyed.groupBy(*group, "key").agg(F.min_by(F.col(text), F.struct(-F.col("n"), F.col(text))).alias("canonical"), F.count("*").alias("n_texts"))
    return common.written(best.where("n_texts > 1"), "look-alike-classes")


def values(spark, sf_dir: str, lines_only: bool = False) -> DataFrame:
    d = common.read(spark, sf_dir, "dictionary").select(F.lit("dictionary").alias("tbl"), F.col("entry_id").alias("id"), F.explode(F.map_keys("midasi")).alias("text"))
    s = common.read(spark, sf_dir, "sentences")
    if lines_only:
        s = s.where("unit = 'line'")
    s = s.select(F.lit("sentences").alias("tbl"), F.col("row_id").alias("id"), F.col("raw").alias("text"))
    return d.unionByName(s)


def canonical_forms(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """df with `canonical`: the consistent form of each row's text; null stays null."""
    keyed = keyed_texts(df, group, text)
    best = common.join_hot(keyed, classes(keyed, group, text), [*group, "key"], "n_texts")
    forms = common.written(best.select(*group, text, "canonical", "n"), "look-alike-forms")
    # texts that are alone in their class, or empty after mapping, keep their own form
    return common.join_hot(df, forms, [*group, text], "n", "left").withColumn("canonical", F.coalesce("canonical", text))


def p1_canonical(spark, sf_dir: str) -> DataFrame:
    """Every headword and sentence with the consistent form of its class, and whether its own form differs from it."""
    v = values(spark, sf_dir).where(F.col("text").isNotNull())
    return canonical_forms(v, ["tbl"], "text").select("tbl", "id", "text", "canonical", (F.col("canonical") != F.col("text")).alias("changed"))


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Pairs of rows that look the same and are not equal; garbled text takes no part."""
    v = values(spark, sf_dir, lines_only=True).where(F.col("text").isNotNull())
    keyed = keyed_texts(v, ["tbl"], "text")
    members = common.join_hot(keyed, classes(keyed, ["tbl"], "text"), ["tbl", "key"], "n_texts").select("tbl", "key", "text", "n")
    clean = common.written(members.withColumn("_state", _judged("text")["state"]).where("_state = 'clean'").drop("_state"), "look-alike-members")
    ids = common.written(common.join_hot(v.distinct(), clean.select("tbl", "text", "n"), ["tbl", "text"], "n"), "look-alike-rows")
    # pairs of distinct texts, the more frequent one first
    side = lambda x: clean.select("tbl", "key", F.col("text").alias(f"text_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), ["tbl", "key"]).where("n_a > n_b or (n_a = n_b and text_a < text_b)").drop("key")
    rare = common.join_hot(ids.select("tbl", F.col("text").alias("text_b"), F.col("id").alias("id_b")), common.written(pairs, "look-alike-pairs"), ["tbl", "text_b"], "n_b")
    both = common.join_hot(ids.select("tbl", F.col("text").alias("text_a"), F.col("id").alias("id_a")), common.written(rare.select("tbl", "text_a", "n_a", "id_b"), "look-alike-rare"), ["tbl", "text_a"], "n_a")
    return both.where("id_a <> id_b").select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
