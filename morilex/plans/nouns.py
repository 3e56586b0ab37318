"""Features and instances of nouns as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import instances
from .registry import TOK, query, table, tokens

_FEATS = f"""{TOK}, w as (select doc_id, domain, token, lag(token) over (partition by doc_id order by pos) as p, lead(token) over (partition by doc_id order by pos) as n from tok),
f as (select doc_id, domain, token as name, 'prev' as ftype, p as fname from w where p is not null and regexp_matches(token, '^[一-鿿々]+$') union all
 select doc_id, domain, token, 'next', n from w where n is not null and regexp_matches(token, '^[一-鿿々]+$'))"""


def features(spark, sf):
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).withColumn("p", F.lag("token").over(w)).withColumn("n", F.lead("token").over(w)).where(F.col("token").rlike("^[一-鿿々]+$"))
    kinds = F.array(F.struct(F.lit("prev").alias("ftype"), F.col("p").alias("fname")), F.struct(F.lit("next").alias("ftype"), F.col("n").alias("fname")))
    return t.select("doc_id", "domain", F.col("token").alias("name"), F.explode(kinds).alias("k")).select("doc_id", "domain", "name", "k.ftype", "k.fname").where("fname is not null")


@query(f"with {_FEATS} select ftype, fname, count(*) as freq from f group by 1, 2 having count(*) >= 5")
def a18_feature_frequency(spark, sf):
    return features(spark, sf).groupBy("ftype", "fname").agg(F.count("*").alias("freq")).where("freq >= 5")


@query(f"with {_FEATS} select ftype, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from f group by 1")
def a31_feature_type_share(spark, sf):
    c = features(spark, sf).groupBy("ftype").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))  # a handful of types


@query(f"""with {_FEATS}, page as (select name, domain, doc_id, count(distinct ftype || '/' || fname) as k, count(*) as n, count_if(ftype = 'next') as c from f group by 1, 2, 3), p as (select name, domain, doc_id, k, n from page where k >= 6 and c >= 2),
rest as (select f.* from f where not exists (select 1 from p where p.name = f.name and p.domain is not distinct from f.domain and p.doc_id = f.doc_id)), dom as (select name, domain, count(distinct ftype || '/' || fname) as k, count(*) as n, count_if(ftype = 'next') as c from rest group by 1, 2)
select 'page' as origin, name, domain, doc_id, k, n from p union all select 'domain', name, domain, null, k, n from dom where k >= 6 and c >= 2""")
def f21_completeness(spark, sf):
    """Instances complete on a page, else on their domain: enough features, and enough of the core type besides. What a page
    emits is not carried up."""
    return instances.by_level(features(spark, sf), least=6, core=2, core_types=("next",))


@query("""select repname, count(distinct document_id) as df, cast(sum(cnt) as bigint) as tf, string_agg(distinct word_class, '?' order by word_class) as classes from ngram_uni where repname is not null and word_class like '%名詞%' group by 1 having count(distinct document_id) >= 5""")
def a21_stop_names(spark, sf):
    """Nouns frequent enough to be stop words for named entities, with the classes they were given."""
    u = table(spark, sf, "ngram_uni").where("repname is not null and word_class like '%名詞%'")
    g = u.groupBy("repname").agg(F.count_distinct("document_id").alias("df"), F.sum("cnt").alias("tf"), F.array_join(F.array_sort(F.collect_set("word_class")), "?").alias("classes"))
    return g.where("df >= 5").select("repname", "df", "tf", "classes")


@query(f"""with {TOK}, w as (select doc_id, token, lag(token) over s as p, lead(token) over s as n from tok window s as (partition by doc_id order by pos))
select p as family, token as title, count(*) as n from w where token in ('さん', 'くん', 'ちゃん', 'さま', 'いわく') and p is not null and regexp_matches(p, '^[一-鿿々ァ-ヴー]+$') group by 1, 2""")
def cf12_person_pattern(spark, sf):
    """Suspected names: a word of ideographs or katakana before a title."""
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).withColumn("p", F.lag("token").over(w)).where(F.col("token").isin("さん", "くん", "ちゃん", "さま", "いわく") & F.col("p").rlike("^[一-鿿々ァ-ヴー]+$"))
    return t.groupBy(F.col("p").alias("family"), F.col("token").alias("title")).agg(F.count("*").alias("n"))


@query(r"""select document_id, regexp_extract(raw, '([一-鿿々ァ-ヴー]+)という([一-鿿々ァ-ヴー]+)', 1) as name, regexp_extract(raw, '([一-鿿々ァ-ヴー]+)という([一-鿿々ァ-ヴー]+)', 2) as kind, count(*) as n
from sentences where raw is not null and regexp_matches(raw, '[一-鿿々ァ-ヴー]+という[一-鿿々ァ-ヴー]+') group by 1, 2, 3""")
def cf11_called_pairs(spark, sf):
    """Pairs 'A, which is called B'."""
    p = r"([一-鿿々ァ-ヴー]+)という([一-鿿々ァ-ヴー]+)"
    s = table(spark, sf, "sentences").where(F.col("raw").rlike(p))
    return s.groupBy("document_id", F.regexp_extract("raw", p, 1).alias("name"), F.regexp_extract("raw", p, 2).alias("kind")).agg(F.count("*").alias("n"))
