"""Counting, merging, ranking and eviction as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ngrams, storage
from .registry import HEAD, TOK, headwords, query, table, tokens

#: Suffix rows without an analyser: the kana after a word, its part of speech and form by the script before and its end.
_SUF = f"""{TOK}, w as (select doc_id, token, lag(token) over (partition by doc_id order by pos) as head from tok),
suf as (select token as suffix, case when regexp_matches(head, '[一-鿿々]$') then 'kanji' when regexp_matches(head, '[ァ-ヴー]$') then 'katakana' else 'other' end as pos_s, substr(token, length(token), 1) as form
  from w where regexp_matches(token, '^[ぁ-ゖ]+$') and head is not null)"""


def suffix_rows(spark, sf):
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).withColumn("head", F.lag("token").over(w)).where(F.col("token").rlike("^[ぁ-ゖ]+$") & F.col("head").isNotNull())
    pos = F.when(F.col("head").rlike("[一-鿿々]$"), "kanji").when(F.col("head").rlike("[ァ-ヴー]$"), "katakana").otherwise("other")
    return t.select(F.col("token").alias("suffix"), pos.alias("pos_s"), F.right("token", F.lit(1)).alias("form"))


@query(f"with {_SUF} select suffix, pos_s, form, count(*) as cnt from suf group by 1, 2, 3")
def a01_suffix_count(spark, sf):
    return ngrams.suffix_counts(suffix_rows(spark, sf))


@query(f"with {_SUF} select substr(suffix, 1, 4) as suffix, pos_s, form, count(*) as cnt from suf group by 1, 2, 3")
def a03_suffix_truncated(spark, sf):
    return ngrams.truncated(ngrams.suffix_counts(suffix_rows(spark, sf)), 4)


@query(f"""with {_SUF}, c as (select substr(suffix, 1, 4) as suffix, pos_s, form, count(*) as cnt from suf group by 1, 2, 3),
r as (select *, sum(cnt) over (partition by suffix, pos_s) as total, row_number() over (partition by suffix, pos_s order by cnt desc, form) as rn from c)
select suffix, pos_s, form, cnt, cast(total as bigint) as total from r where rn = 1""")
def a04_best_form(spark, sf):
    """Most frequent form of each (suffix, part of speech)."""
    return ngrams.best_form(a03_suffix_truncated(spark, sf))


@query(f"with {_SUF} select pos_s, form, count(*) as cnt, round(count(*) / sum(count(*)) over (partition by pos_s), 6) as share from suf group by 1, 2")
def a05_form_distribution(spark, sf):
    c = suffix_rows(spark, sf).groupBy("pos_s", "form").agg(F.count("*").alias("cnt"))
    return c.withColumn("share", F.round(F.col("cnt") / F.sum("cnt").over(W.partitionBy("pos_s")), 6))


@query(f"""with {TOK}, w as (select token, coalesce(lag(token) over (partition by doc_id order by pos), '$') as prev from tok) select prev, token, count(*) as n from w group by 1, 2 having count(*) >= 2""")
def a09_ngram_counts(spark, sf):
    return ngrams.bigrams(tokens(spark, sf), ["doc_id"], ["pos"], "token").where("n >= 2")


@query(r"""with s as (select row_id, regexp_extract_all(raw, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+') as a from sentences where raw is not null),
p as (select a[1] as token, 'Bb' as kind from s where len(a) > 0 union all select a[len(a)], 'Bf' from s where len(a) > 0) select kind, token, count(*) as n from p group by 1, 2""")
def a10_boundary_counts(spark, sf):
    """How often a word stands at the start and at the end of a sentence."""
    s = table(spark, sf, "sentences").where("raw is not null").select(F.regexp_extract_all("raw", F.lit("[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+"), F.lit(0)).alias("a")).where(F.size("a") > 0)
    ends = s.select(F.explode(F.array(F.struct(F.lit("Bb").alias("kind"), F.element_at("a", 1).alias("token")), F.struct(F.lit("Bf").alias("kind"), F.element_at("a", -1).alias("token")))).alias("x"))
    return ends.groupBy("x.kind", "x.token").agg(F.count("*").alias("n"))


@query("""select midasi, repname, word_class, cast(sum(cnt) as bigint) as cnt, count(distinct shard_id) as shards from ngram_uni where midasi is not null group by 1, 2, 3 having sum(cnt) >= 2""")
def a11_merged_unigrams(spark, sf):
    """Partial language models of all shards merged, with a threshold."""
    u = table(spark, sf, "ngram_uni").where("midasi is not null")
    return u.groupBy("midasi", "repname", "word_class").agg(F.sum("cnt").alias("cnt"), F.count_distinct("shard_id").alias("shards")).where("cnt >= 2")


@query("""select w1.repname as a, w2.word_class as b, cast(sum(cnt) as bigint) as cnt from ngram_fbi where w1.repname is not null and w2.word_class is not null group by 1, 2 having sum(cnt) >= 3""")
def a10_abstract_bigrams(spark, sf):
    """Bigrams of representative name and class of the word that follows."""
    b = table(spark, sf, "ngram_fbi").where("w1.repname is not null and w2.word_class is not null")
    return b.groupBy(F.col("w1.repname").alias("a"), F.col("w2.word_class").alias("b")).agg(F.sum("cnt").alias("cnt")).where("cnt >= 3")


@query("""with e as (select hinsi, key, value from (select hinsi, unnest(map_entries(annotation)) as kv from dictionary), lateral (select kv.key as key, kv.value as value) where key in ('count', 'df'))
select hinsi, key, cast(sum(cast(value as bigint)) as bigint) as total, count(*) as n from e group by 1, 2""")
def a12_map_merge(spark, sf):
    """Numbers held in maps summed by key."""
    e = table(spark, sf, "dictionary").select("hinsi", F.explode("annotation").alias("key", "value")).where("key in ('count', 'df')")
    return e.groupBy("hinsi", "key").agg(F.sum(F.col("value").cast("long")).alias("total"), F.count("*").alias("n"))


@query("""select map_extract(annotation, 'stem')[1] as stem, hinsi, count(*) as entries, cast(sum(cast(map_extract(annotation, 'count')[1] as bigint)) as bigint) as cnt, count(distinct dict_name) as dictionaries
from dictionary where map_extract(annotation, 'stem')[1] is not null group by 1, 2""")
def a13_dictionary_merge(spark, sf):
    """Dictionaries merged by stem and part of speech, annotations summed."""
    d = table(spark, sf, "dictionary")
    stem = F.try_element_at("annotation", F.lit("stem"))
    return d.where(stem.isNotNull()).groupBy(stem.alias("stem"), "hinsi").agg(F.count("*").alias("entries"), F.sum(F.try_element_at("annotation", F.lit("count")).cast("long")).alias("cnt"), F.count_distinct("dict_name").alias("dictionaries"))


@query(f"with {TOK} select token, count(*) as cnt, count(distinct doc_id) as df, count(distinct domain) as domains from tok group by 1")
def a14_count_df_domain(spark, sf):
    """Count, documents and domains of every token: reduced to (token, document) first, so no token is hot."""
    per = tokens(spark, sf).groupBy("token", "doc_id", "domain").agg(F.count("*").alias("n"))
    return per.groupBy("token", "domain").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("d")).groupBy("token").agg(F.sum("n").alias("cnt"), F.sum("d").alias("df"), F.count("domain").alias("domains"))


@query(f"with {TOK}, d as (select token, count(distinct doc_id) as df from tok group by 1) select token, df, round(ln(sum(df) over () / df), 6) as idf from d")
def a17_idf(spark, sf):
    """Log of the sum of all document frequencies over the word's own."""
    d = storage.written(tokens(spark, sf).select("token", "doc_id").distinct().groupBy("token").agg(F.count("*").alias("df")), "df")
    total = d.agg(F.sum("df")).first()[0] or 0
    return d.withColumn("idf", F.round(F.log(F.lit(float(total)) / F.col("df")), 6))


@query(f"""with {HEAD} select head, max_by(hinsi, n) as hinsi, cast(sum(n) as bigint) as votes from (select head, hinsi, count(*) as n from head group by 1, 2) group by 1 having count(distinct n) = count(*)""")
def a23_majority(spark, sf):
    """Part of speech by majority, where no two have as many votes."""
    v = headwords(spark, sf).groupBy("head", "hinsi").agg(F.count("*").alias("n"))
    return v.groupBy("head").agg(F.max_by("hinsi", "n").alias("hinsi"), F.sum("n").alias("votes"), F.count_distinct("n").alias("a"), F.count("*").alias("b")).where("a = b").drop("a", "b")


@query(f"""with {TOK} select lang, count(distinct doc_id) as docs, count(*) as words, count(distinct token) as types from tok group by 1""")
def a28_corpus_monitor(spark, sf):
    return tokens(spark, sf).groupBy("lang").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("words"), F.count_distinct("token").alias("types"))


@query(f"""with {HEAD}, h as (select entry_id, head, hinsi, row_number() over (order by entry_id, head) as rn, count(*) over () as n from head)
select count(*) as total, count_if(regexp_matches(head, '^[ァ-ヴー]+$')) as katakana, count_if(hinsi = '名詞') as nouns, max(case when rn = (n - 1) // 2 + 1 then head end) as middle from h""", "katakana nouns")
def a32_dictionary_stats(spark, sf):
    """Size, shares, and the lower median of the order."""
    h = storage.row_index(headwords(spark, sf).select("entry_id", "head", "hinsi"), ["entry_id", "head"], "rn")
    n = h.count()
    return h.agg(F.count("*").alias("total"), F.count_if(F.col("head").rlike("^[ァ-ヴー]+$")).alias("katakana"), F.count_if(F.col("hinsi") == "名詞").alias("nouns"), F.max(F.when(F.col("rn") == (n - 1) // 2 + 1, F.col("head"))).alias("middle"))


@query("""with r as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as rn from events) select user_id, event_id, rn as seen from r where rn % 50 = 0""")
def a33_every_fiftieth(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("seen")).where("seen % 50 = 0")


@query("""with c as (select user_id, count(*) as n, avg(case when value > 50 then 1.0 else 0.0 end) as hit from events group by 1) select cast(floor(log10(n)) as bigint) as bucket, count(*) as users, round(avg(hit), 6) as accuracy from c group by 1""")
def a34_accuracy_by_frequency(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("hit"))
    return c.groupBy(F.floor(F.log10("n")).alias("bucket")).agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("accuracy"))


@query("""with n as (select source as ftype, lang as fname, count(*) as freq from documents where lang is not null group by 1, 2) select ftype, fname, freq, row_number() over (order by ftype, freq desc, fname) - 1 as fid from n""")
def t03_feature_ids(spark, sf):
    """Dense ids: types ascending, names by frequency descending."""
    n = table(spark, sf, "documents").where("lang is not null").groupBy(F.col("source").alias("ftype"), F.col("lang").alias("fname")).agg(F.count("*").alias("freq"))
    return storage.row_index(n, ["ftype", F.desc("freq"), "fname"], "fid").withColumn("fid", F.col("fid") - 1)


@query("""with l as (select user_id, max(ts) as last from events group by 1), c as (select min(last) as cut from (select last from l order by last desc limit 80)) select user_id, last from l, c where last >= cut""")
def t05_evict_oldest(spark, sf):
    """What is left after the users that were idle longest are evicted; users of the cut value stay together."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    cut = last.orderBy(F.desc("last")).limit(80).agg(F.min("last")).first()[0]
    return last.where(F.col("last") >= F.lit(cut)) if cut is not None else last


@query("select doc_id, domain from documents order by md5('17-' || doc_id), doc_id limit 50")
def t08_sample(spark, sf):
    """Fifty distinct documents in the order of a seeded digest: the same for the same seed, without sorting all."""
    d = table(spark, sf, "documents").select("doc_id", "domain")
    return d.orderBy(F.md5(F.concat_ws("-", F.lit("17"), F.col("doc_id").cast("string"))), "doc_id").limit(50)


@query("""with s as (select midasi, cast(sum(cnt) as bigint) as c, count(distinct document_id) as d from ngram_uni where midasi is not null group by 1),
a as (select midasi, row_number() over (order by c desc, midasi) as r from s), b as (select midasi, row_number() over (order by d desc, midasi) as r from s), x as (select midasi, row_number() over (order by length(midasi) desc, midasi) as r from s)
select a.r as rank, a.midasi as by_count, b.midasi as by_documents, x.midasi as by_length from a join b on a.r = b.r join x on x.r = a.r where a.r <= 100""")
def t12_three_rankings(spark, sf, first: int = 100):
    s = storage.written(table(spark, sf, "ngram_uni").where("midasi is not null").groupBy("midasi").agg(F.sum("cnt").alias("c"), F.count_distinct("document_id").alias("d")), "counts")
    out = None
    for name, key in (("by_count", F.desc("c")), ("by_documents", F.desc("d")), ("by_length", F.desc(F.length("midasi")))):
        top = s.orderBy(key, "midasi").limit(first)  # a report of the first ranks
        one = top.select(F.row_number().over(W.orderBy(key, "midasi")).cast("long").alias("rank"), F.col("midasi").alias(name))
        out = one if out is None else out.join(one, "rank")
    return out


@query("""with c as (select user_id, event_type, count(*) / sum(count(*)) over (partition by user_id) as share from events group by 1, 2) select user_id, string_agg(event_type, '?' order by share desc, event_type) as labels from c where share >= 0.2 group by 1""")
def t15_ranked_shares(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    c = c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("user_id"))).where("share >= 0.2")
    return c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "event_type"))).alias("a")).select("user_id", F.array_join(F.transform("a", lambda x: x["event_type"]), "?").alias("labels"))
