"""Metrics, divergences and linear scoring as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import learn, metrics
from .registry import LABELLED, TOK, query, table, tokens

_PAIRED = """two as (select doc_id, min(grade) as a, max(grade) as b from reading_labels where grade is not null group by 1 having count(*) = 2)"""


def paired(spark, sf):
    """The two readers' grades of the documents that have two."""
    g = table(spark, sf, "reading_labels").where("grade is not null")
    return g.groupBy("doc_id").agg(F.min("grade").alias("a"), F.max("grade").alias("b"), F.count("*").alias("n")).where("n = 2").drop("n")


@query(f"""with {_PAIRED}, n as (select count(*) as n from two), o as (select count_if(a = b) / count(*) as po from two),
m as (select k, sum(x) as x, sum(y) as y from (select a as k, 1 as x, 0 as y from two union all select b, 0, 1 from two) group by 1), e as (select sum(x * y) / (max(n) * max(n)) as pe from m, n)
select round(po, 6) as observed, round(pe, 6) as expected, round((po - pe) / (1 - pe), 6) as kappa from o, e""")
def m05_kappa(spark, sf):
    return metrics.kappa(paired(spark, sf), "a", "b")


@query(f"""with {_PAIRED} select round(count_if(a >= 3 and b >= 3) / count_if(a >= 3), 6) as "precision", round(count_if(a >= 3 and b >= 3) / count_if(b >= 3), 6) as recall,
round(2.0 * count_if(a >= 3 and b >= 3) / (count_if(a >= 3) + count_if(b >= 3)), 6) as f1, count_if(a >= 3 and b < 3) as false_positives, count_if(a < 3 and b >= 3) as misses from two""", "false_positives misses")
def m06_precision_recall(spark, sf):
    return metrics.precision_recall(paired(spark, sf), F.col("a") >= 3, F.col("b") >= 3)


@query(f"with {_PAIRED} select a, b, count(*) as n from two group by 1, 2")
def m07_confusion(spark, sf):
    return paired(spark, sf).groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""with t as (select source, coalesce(lang, '') as lang, count(*) as n from documents group by 1, 2), m as (select source, max(n) as top, sum(n) as n from t group by 1) select round(sum(top) / sum(n), 6) as accuracy, cast(sum(n) as bigint) as n from m""")
def m08_cluster_accuracy(spark, sf):
    return metrics.cluster_accuracy(table(spark, sf, "documents").select("source", F.coalesce("lang", F.lit("")).alias("lang")), "source", "lang")


@query(f"""with {_PAIRED}, g as (select doc_id, a >= 3 as before, b >= 3 as after from two) select before, after, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from g group by 1, 2""")
def m09_transitions(spark, sf):
    c = paired(spark, sf).groupBy((F.col("a") >= 3).alias("before"), (F.col("b") >= 3).alias("after")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 6))  # at most four rows


@query("""with s as (select user_id, event_type, avg(value) as score from events group by 1, 2), e as (select *, exp(score - max(score) over (partition by user_id)) as x from s) select user_id, event_type, round(x / sum(x) over (partition by user_id), 6) as p from e""")
def m10_softmax(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("score"))
    return s.select("user_id", "event_type", F.round(learn.softmax(F.col("score"), W.partitionBy("user_id")), 6).alias("p"))


@query(f"""with {TOK}, c as (select source, token, count(*) as n from tok group by 1, 2), q as (select source, token, n / sum(n) over (partition by source) as q from c), r as (select token, sum(n) / (select sum(n) from c) as r from c group by 1)
select source, round(sum(q * ln(q / (0.99 * r + 0.01 * q))), 6) as divergence from q join r using (token) group by 1""")
def m04_skew_divergence(spark, sf):
    """Skew divergence of each source's words from those of all."""
    c = tokens(spark, sf).groupBy("source", "token").agg(F.count("*").alias("n"))
    return metrics.skew_divergence(c, "source", "token", "n", 0.99)


@query("""with b as (select w1.midasi as a, w2.midasi as b, sum(cnt) as n from ngram_fbi where w1.midasi is not null and w2.midasi is not null group by 1, 2), u as (select midasi, sum(cnt) as n from ngram_uni where midasi is not null group by 1),
l as (select midasi as w, sum(cnt) as n from ngram_uni where midasi = '|' group by 1), to_b as (select a as w, n from b where b = '|'), from_b as (select b as w, n from b where a = '|')
select b.a, b.b, round(0.99 * (b.n + 0.01) / (coalesce(u.n, 0) + 300) + 0.01 * ((coalesce(t.n, 0) + 0.01) / (coalesce(u.n, 0) + 300)) * ((coalesce(f.n, 0) + 0.01) / (coalesce((select n from l), 0) + 300)), 8) as p
from b left join u on u.midasi = b.a left join to_b t on t.w = b.a left join from_b f on f.w = b.b where b.n >= 3 and b.a <> '|' and b.b <> '|'""")
def m02_interpolated(spark, sf):
    """Probability of the next word, mixed with the way over a phrase boundary."""
    from ..operators import ngrams

    b = table(spark, sf, "ngram_fbi").where("w1.midasi is not null and w2.midasi is not null").groupBy(F.col("w1.midasi").alias("a"), F.col("w2.midasi").alias("b")).agg(F.sum("cnt").alias("n"))
    u = table(spark, sf, "ngram_uni").where("midasi is not null").groupBy(F.col("midasi").alias("a")).agg(F.sum("cnt").alias("c"))
    border = u.where("a = '|'").agg(F.sum("c")).first()[0] or 0
    j = b.where("n >= 3 and a <> '|' and b <> '|'").join(u, "a", "left")
    j = j.join(b.where("b = '|'").select("a", F.col("n").alias("to_border")), "a", "left").join(b.where("a = '|'").select("b", F.col("n").alias("from_border")), "b", "left")
    return j.select("a", "b", F.round(ngrams.likelihood(F.col("n"), F.col("c"), F.col("to_border"), F.col("from_border"), F.lit(border)), 8).alias("p"))


_VEC = """v as (select vec_id, label, unnest(range(1, len(embedding) + 1)) as fid, cast(unnest(embedding) as double) as v from embeddings), c as (select label as class_id, fid, avg(v) as weight from v group by 1, 2)"""


@query(f"""with {_VEC}, s as (select vec_id as row_id, class_id, sum(v * weight) as score from v join c using (fid) group by 1, 2), b as (select row_id, class_id, row_number() over (partition by row_id order by round(score, 9) desc, class_id) as r from s) select row_id, class_id from b where r = 1""")
def ml01_linear_score(spark, sf):
    """Vectors scored against the mean vector of each label; the best class."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", F.posexplode("embedding").alias("i", "v")).select("row_id", "label", (F.col("i") + 1).alias("fid"), F.col("v").cast("double").alias("v"))
    means = e.groupBy(F.col("label").alias("class_id"), "fid").agg(F.avg("v").alias("weight"))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x, i: F.struct((i + 1).alias("fid"), x.cast("double").alias("v"))).alias("feats"))
    return learn.best_class(learn.linear_scores(rows, means))


@query()
def ml11_parameter_mixing(spark, sf):
    """Weights of a perceptron trained in shards and averaged after each epoch, and its accuracy on its own rows."""
    e = table(spark, sf, "embeddings").where("label is not null")
    size = e.select(F.max(F.size("embedding"))).first()[0] or 0
    classes = (e.select(F.max("label")).first()[0] or 0) + 1
    rows = e.select(F.col("vec_id").alias("row_id"), "label", F.transform("embedding", lambda x, i: F.struct(i.alias("fid"), x.cast("double").alias("v"))).alias("feats"))
    w = learn.train_mixed(rows, classes, size, "averaged", epochs=3)
    got = learn.best_class(learn.linear_scores(rows, w)).join(rows.select("row_id", "label"), "row_id")
    return got.groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("class_id") == F.col("label")).cast("double")).alias("accuracy"))


@query(f"""with {TOK}, {LABELLED}, e as (select lang as label, token as feature from named where lang is not null), n as (select label, count(*) as n from e group by 1), c as (select label, feature, count(*) as c from e group by 1, 2)
select label, feature, round(greatest(ln(c / n), ln(0.0001)), 6) as log_p from c join n using (label) where c >= 3""")
def ml12_naive_bayes(spark, sf):
    """Log-probabilities of words for each label of the table, spellings of a label as one."""
    ev = tokens(spark, sf).select(chars.language(F.col("lang")).alias("label"), F.col("token").alias("feature")).where("label is not null")
    _, like = learn.naive_bayes(ev, "label", "feature")
    often = ev.groupBy("label", "feature").agg(F.count("*").alias("c")).where("c >= 3").drop("c")
    return like.join(often, ["label", "feature"]).select("label", "feature", F.round("log_p", 6).alias("log_p"))


@query("""with f as (select vec_id, pmod_shard as shard, label as class_id, fid, v from (select vec_id, label, vec_id % 4 as pmod_shard, unnest(range(1, len(embedding) + 1)) as fid, cast(unnest(embedding) as double) as v from embeddings)), w as (select shard, class_id, fid, avg(v) as weight from f group by 1, 2, 3)
select class_id, fid, round(sum(weight) / 4, 6) as weight from w group by 1, 2""")
def a36_model_average(spark, sf):
    """Per-shard models averaged with equal weight."""
    f = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("shard"), F.col("label").alias("class_id"), F.posexplode("embedding").alias("i", "v"))
    w = f.groupBy("shard", "class_id", (F.col("i") + 1).cast("long").alias("fid")).agg(F.avg(F.col("v").cast("double")).alias("weight"))
    return learn.average(w, 4).select("class_id", "fid", F.round("weight", 6).alias("weight"))


@query()
def ml15_clusters(spark, sf):
    """Documents' vectors clustered by bisecting k-means; size of each cluster and its largest label share."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    model = BisectingKMeans(k=10, seed=7, maxIter=10).fit(e)
    c = model.transform(e).groupBy("prediction", "label").agg(F.count("*").alias("n"))
    return c.groupBy("prediction").agg(F.sum("n").alias("members"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))
