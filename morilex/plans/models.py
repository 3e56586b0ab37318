"""Scores, decisions and inspection of models as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import learn
from .evaluate import _VEC
from .registry import query, table, tokens


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.transform("embedding", lambda x, i: F.struct((i + 1).alias("fid"), x.cast("double").alias("v"))).alias("feats"))


def means(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("label").alias("class_id"), (F.col("i") + 1).alias("fid")).agg(F.avg(F.col("v").cast("double")).alias("weight"))


_SCORES = f"{_VEC}, s as (select vec_id as row_id, class_id, round(sum(v * weight), 9) as score from v join c using (fid) group by 1, 2)"


@query(f"""with {_SCORES}, g as (select row_id, class_id, score, class_id % 3 as grp, sum(score) over (partition by row_id, class_id % 3) as mass, max(score) over (partition by row_id, class_id % 3) as top from s),
a as (select row_id, class_id, row_number() over (partition by row_id order by round(top, 6) desc, grp, round(score, 6) desc, class_id) as r from g), b as (select row_id, class_id, row_number() over (partition by row_id order by round(mass, 6) desc, grp, round(score, 6) desc, class_id) as r from g)
select row_id, a.class_id as by_top, b.class_id as by_mass from a join b using (row_id) where a.r = 1 and b.r = 1""")
def ml14_grouped_classes(spark, sf):
    """One class against the rest in groups: the group of the best class, and the group of the largest sum, then the class in it."""
    s = learn.linear_scores(vectors(spark, sf), means(spark, sf)).withColumn("score", F.round("score", 9))
    w = W.partitionBy("row_id", "grp")  # the classes of one row
    g = s.withColumn("grp", F.col("class_id") % 3).withColumns({"mass": F.sum("score").over(w), "top": F.max("score").over(w)})
    pick = lambda c: F.min_by("class_id", F.struct(-F.round(c, 6), F.col("grp"), -F.round("score", 6), F.col("class_id")))
    return g.groupBy("row_id").agg(pick("top").alias("by_top"), pick("mass").alias("by_mass"))


@query("""with f as (select hinsi, coalesce(bunrui, '') as bunrui, unnest(regexp_extract_all(yomi, '.')) as feature from dictionary where yomi is not null), n as (select hinsi, bunrui, count(*) as n from f group by 1, 2), c as (select hinsi, bunrui, feature, count(*) as c from f group by 1, 2, 3)
select hinsi, bunrui, feature, round(greatest(ln(c / n), ln(0.0001)), 6) as log_p from c join n using (hinsi, bunrui)""")
def ml13_two_axes(spark, sf):
    """Naive Bayes over two axes at once: log-probabilities of features for each pair of labels."""
    d = table(spark, sf, "dictionary").where("yomi is not null").select(F.struct("hinsi", F.coalesce("bunrui", F.lit("")).alias("bunrui")).alias("label"), F.explode(F.regexp_extract_all("yomi", F.lit("."), F.lit(0))).alias("feature"))
    _, like = learn.naive_bayes(d, "label", "feature")
    return like.select("label.hinsi", "label.bunrui", "feature", F.round("log_p", 6).alias("log_p"))


#: A small model of what follows a noun: weights of suffixes for common noun, action noun and na-adjective.
WEIGHTS = [("を", 1.0, 1.2, -1.0), ("が", 1.0, 0.4, -0.5), ("は", 0.8, 0.2, 0.0), ("する", -0.5, 3.0, -1.0), ("な", -1.0, -1.0, 3.0), ("に", 0.4, 0.3, 0.9), ("の", 0.9, 0.3, -0.6), ("だ", 0.1, 0.0, 0.8), ("です", 0.1, 0.0, 0.8)]
_WEIGHT_VALUES = ", ".join(f"('{s}', {a}, {b}, {c})" for s, a, b, c in WEIGHTS)


@query(f"""with m(suffix, w0, w1, w2) as (values {_WEIGHT_VALUES}), p as (select w1.midasi as word, w2.midasi as suffix, sum(cnt) as n from ngram_fbi where w1.word_class in ('<普通名詞>', '<サ変名詞>', '<固有名詞>') and w1.midasi is not null and w2.midasi is not null group by 1, 2),
s as (select word, sum(n) as total, sum(n * m.w0) / sum(n) as a, sum(n * m.w1) / sum(n) as b, sum(n * m.w2) / sum(n) as c from p join m using (suffix) group by 1 having sum(n) >= 3)
select word, cast(total as bigint) as total, case when round(a, 6) >= round(b, 6) and round(a, 6) >= round(c, 6) then 'common' when round(b, 6) >= round(c, 6) then 'action' else 'adjective' end as decision from s""")
def ml16_noun_kind(spark, sf):
    """What kind of noun a word is, from the profile of what follows it: relative frequencies weighed, the first maximum wins."""
    m = spark.createDataFrame(WEIGHTS, "suffix string, m0 double, m1 double, m2 double")
    f = table(spark, sf, "ngram_fbi").where(F.col("w1.word_class").isin("<普通名詞>", "<サ変名詞>", "<固有名詞>") & F.col("w1.midasi").isNotNull() & F.col("w2.midasi").isNotNull())
    p = f.groupBy(F.col("w1.midasi").alias("word"), F.col("w2.midasi").alias("suffix")).agg(F.sum("cnt").alias("n"))
    n = F.sum("n")
    s = p.join(F.broadcast(m), "suffix").groupBy("word").agg(n.alias("total"), *[F.round(F.sum(F.col("n") * F.col(f"m{k}")) / n, 6).alias(f"s{k}") for k in range(3)]).where("total >= 3")
    return s.select("word", "total", F.when((F.col("s0") >= F.col("s1")) & (F.col("s0") >= F.col("s2")), "common").when(F.col("s1") >= F.col("s2"), "action").otherwise("adjective").alias("decision"))


@query(f"""with {_VEC}, b as (select fid, avg(weight) as base from c group by 1), d as (select class_id, fid, round(weight - base, 6) as contrast from c join b using (fid)), r as (select *, row_number() over (partition by class_id order by contrast desc, fid) as rank from d) select class_id, rank, fid, contrast from r where rank <= 10""")
def ml19_strongest_features(spark, sf):
    """What sets each class apart: the ten features with the largest weight over the mean of all classes (a report)."""
    m = means(spark, sf)
    d = m.join(m.groupBy("fid").agg(F.avg("weight").alias("base")), "fid").select("class_id", "fid", F.round(F.col("weight") - F.col("base"), 6).alias("contrast"))
    w = W.partitionBy("class_id").orderBy(F.desc("contrast"), "fid")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("class_id", "rank", F.col("fid").cast("long").alias("fid"), "contrast")


@query()
def ml08_binary_learners(spark, sf):
    """Two-class learners, mixed over shards: how many of the rows each of them gets right."""
    e = table(spark, sf, "embeddings").where("label is not null")
    rows = e.select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("label"), F.transform("embedding", lambda x, i: F.struct(i.alias("fid"), x.cast("double").alias("v"))).alias("feats"))
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0
    out = None
    for kind in ("binary_perceptron", "binary_pa", "binary_scw"):
        w = learn.train_mixed(rows, 2, size, kind, epochs=3)
        got = learn.best_class(learn.linear_scores(rows, w)).join(rows.select("row_id", "label"), "row_id")
        one = got.agg(F.lit(kind).alias("learner"), F.count("*").alias("n"), F.round(F.avg((F.col("class_id") == F.col("label")).cast("double")), 3).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def ml12_expectation(spark, sf):
    """Languages of documents whose label is hidden, by Naive Bayes with expectation and maximisation: how many come out right."""
    t = tokens(spark, sf).select("doc_id", chars.language(F.col("lang")).alias("lang"), "token").where("lang is not null")
    hidden = F.col("doc_id") % 2 == 0
    labels = sorted(r[0] for r in t.where(~hidden).select("lang").distinct().collect())  # as many as languages
    d = t.groupBy("doc_id", "lang", "token").agg(F.count("*").alias("n")).select("doc_id", F.when(~hidden, F.col("lang")).alias("label"), F.col("token").alias("feature"), "n")
    _, _, member = learn.naive_bayes_em(d, labels, rounds=2)
    best = member.where("open").groupBy("doc_id").agg(F.max_by("label", F.struct("w", "label")).alias("label"))
    got = best.join(t.select("doc_id", "lang").distinct(), "doc_id")
    return got.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("lang")).alias("right"))
