"""Acquisition as queries over the sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquire
from .registry import query, table

# A small table of suffixes with part of speech and form, written from grammar.
SUFFIXES = [
    *[(p, "普通名詞", p) for p in ("を", "が", "は", "の", "に", "で", "と", "も", "から", "まで", "より", "という")],
    ("る", "子音動詞ラ行", "基本形"), ("らず", "子音動詞ラ行", "未然形"), ("らない", "子音動詞ラ行", "未然形"), ("り", "子音動詞ラ行", "連用形"), ("れ", "子音動詞ラ行", "命令形"), ("った", "子音動詞ラ行", "タ形"), ("って", "子音動詞ラ行", "テ形"),
    ("な", "ナ形容詞", "連体形"), ("だ", "ナ形容詞", "基本形"), ("に", "ナ形容詞", "連用形"),
    ("い", "イ形容詞", "基本形"), ("く", "イ形容詞", "連用形"), ("かった", "イ形容詞", "タ形"),
]
#: An occurrence in a sentence: a katakana word, possibly with ideographs, and the kana that follow it.
_OCCURRENCE = r"([ァ-ヴー]+[一-鿿々]*)([ぁ-ゖ]{0,4})"


def suffixes(spark):
    return spark.createDataFrame(SUFFIXES, "suffix string, pos_s string, katuyou2 string")


def examples(spark, sf):
    s = table(spark, sf, "sentences").where("raw is not null")
    found = s.select("row_id", "raw", F.posexplode(F.regexp_extract_all("raw", F.lit(_OCCURRENCE), F.lit(0))).alias("i", "occurrence"))
    e = found.select(F.xxhash64("row_id", "i").alias("example_id"), F.lit("").alias("front"), F.lit("BOS").alias("front_tag"), F.regexp_extract("occurrence", _OCCURRENCE, 1).alias("word"), F.regexp_extract("occurrence", _OCCURRENCE, 2).alias("rear"))
    # the text goes to each boundary in the kana that follow: the first one, two, three or four
    ends = F.transform(F.sequence(F.lit(0), F.length("rear")), lambda n: F.concat("word", F.substring("rear", F.lit(1), n)))
    return e.select("example_id", "front", "front_tag", "word", F.explode(ends).alias("text"))


@query(r"""with s as (select row_id, unnest(regexp_extract_all(raw, '[ァ-ヴー]+[一-鿿々]*[ぁ-ゖ]{0,4}')) as o from sentences where raw is not null)
select regexp_extract(o, '^([ァ-ヴー]+[一-鿿々]*)', 1) as word, count(*) as n, count(distinct regexp_extract(o, '([ぁ-ゖ]*)$', 1)) as rears from s group by 1 having count(*) >= 2""")
def st14_occurrences(spark, sf):
    """Suspicious words with how often and before how many endings they occur."""
    s = table(spark, sf, "sentences").where("raw is not null").select(F.explode(F.regexp_extract_all("raw", F.lit(_OCCURRENCE), F.lit(0))).alias("o"))
    return s.groupBy(F.regexp_extract("o", _OCCURRENCE, 1).alias("word")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("o", _OCCURRENCE, 2)).alias("rears")).where("n >= 2")


_LIST = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in SUFFIXES)


@query(rf"""with suf(suffix, pos_s, katuyou2) as (values {_LIST}), s as (select row_id, unnest(regexp_extract_all(raw, '[ァ-ヴー]+[一-鿿々]*[ぁ-ゖ]{{1,4}}')) as o from sentences where raw is not null),
w as (select regexp_extract(o, '^([ァ-ヴー]+[一-鿿々]*)', 1) as word, regexp_extract(o, '([ぁ-ゖ]*)$', 1) as rear from s),
m as (select word, rear, suffix, pos_s, katuyou2, max(length(suffix)) over (partition by word, rear) as top from w join suf on starts_with(rear, suffix))
select pos_s, katuyou2, count(*) as n, count(distinct word) as words from m where length(suffix) = top group by 1, 2""")
def st15_longest_suffix(spark, sf):
    """Each ending's longest listed suffix, with its parts of speech."""
    from ..operators.lookup import prefixes

    s = table(spark, sf, "sentences").where("raw is not null").select(F.explode(F.regexp_extract_all("raw", F.lit(_OCCURRENCE.replace("{0,4}", "{1,4}")), F.lit(0))).alias("o"))
    w = s.select(F.regexp_extract("o", _OCCURRENCE, 1).alias("word"), F.regexp_extract("o", _OCCURRENCE, 2).alias("rear")).groupBy("word", "rear").agg(F.count("*").alias("k"))
    hit = w.select("word", "rear", "k", F.explode(prefixes(F.col("rear"), 1, 4)).alias("suffix")).join(F.broadcast(suffixes(spark)), "suffix")
    top = hit.groupBy("word", "rear").agg(F.max(F.length("suffix")).alias("top"))
    best = hit.join(top, ["word", "rear"]).where(F.length("suffix") == F.col("top"))
    return best.groupBy("pos_s", "katuyou2").agg(F.sum("k").alias("n"), F.count_distinct("word").alias("words"))


@query()
def st06_induced_stems(spark, sf):
    """Entries induced from all sentences."""
    return acquire.induce(examples(spark, sf).drop("word"), suffixes(spark))


@query(r"""with s as (select row_id, i, unnest(regexp_extract_all(raw, '[ァ-ヴー]+[一-鿿々]*')) as stem from (select row_id, raw, 0 as i from sentences where raw is not null)), per as (select distinct stem, row_id as example_id from s),
n as (select stem, count(*) as n from per group by 1), pr as (select a.stem as shorter, b.stem as longer, a.n as a, b.n as b from n a join n b on a.stem <> b.stem and starts_with(b.stem, a.stem)),
sh as (select x.shorter, x.longer, count(*) as k from pr x join per p on p.stem = x.shorter join per q on q.stem = x.longer and q.example_id = p.example_id group by 1, 2)
x as (select shorter, longer, a, b, coalesce(k, 0) as both from pr left join sh using (shorter, longer))
select *, case when b / a < 0.01 then true when both = 0 then false when b = both and both / a >= 0.2 then false else both / a < 0.95 and (b - both) / both < 0.05 end as drop from x""".replace("n as (select stem, count(*) as n from per group by 1)", "n as (select stem, count(*) as n from per group by 1)").replace("both", '"both"').replace(" as drop", ' as "drop"').replace("group by 1, 2)\nx as", "group by 1, 2),\nx as"))
def j10_stem_overlap(spark, sf):
    """Prefix-related stems with the examples they share, and whether the longer one is dropped."""
    s = table(spark, sf, "sentences").where("raw is not null").select(F.col("row_id").alias("example_id"), F.explode(F.regexp_extract_all("raw", F.lit("[ァ-ヴー]+[一-鿿々]*"), F.lit(0))).alias("stem")).distinct()
    return acquire.stem_overlap(s).select("shorter", "longer", "a", "b", "both", "drop")
