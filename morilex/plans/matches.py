"""More look-ups on words, keys and ids as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lookup, storage
from .filters import STOP
from .registry import HEAD, TOK, headwords, query, table, tokens

#: Tokens of sentences: runs of one script, and every other character.
STOK = r"""stok as (select row_id, document_id, unnest(range(1, len(a) + 1)) as pos, unnest(a) as token
  from (select row_id, document_id, regexp_extract_all(raw, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|\S') as a from sentences where raw is not null))"""
_STOP_VALUES = ", ".join(f"('{w}')" for w in STOP)
#: Classes of nouns: id, label, whether names.
CLASSES = [("普通名詞", 0, "common", False), ("サ変名詞", 1, "action", False), ("人名", 2, "person", True), ("地名", 3, "place", True), ("組織名", 4, "organisation", True), ("固有名詞", 5, "name", True)]
_CLASS_VALUES = ", ".join(f"('{b}', {i}, '{label}', {str(p).lower()})" for b, i, label, p in CLASSES)


def sentence_tokens(spark, sf):
    s = table(spark, sf, "sentences").where("raw is not null")
    return s.select("row_id", "document_id", F.posexplode(F.regexp_extract_all("raw", F.lit(r"[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|\S"), F.lit(0))).alias("i", "token")).withColumn("pos", (F.col("i") + 1).cast("long")).drop("i")


def classes(spark):
    return spark.createDataFrame(CLASSES, "bunrui string, class_id int, label string, proper boolean")


@query(f"""with {HEAD}, w as (select distinct head as w from head where length(head) > 0) select a.w as prefix, count(*) as extensions, max(length(b.w)) as longest from w a join w b on starts_with(b.w, a.w) and a.w <> b.w group by 1""", "longest")
def j05_extensions(spark, sf):
    """All keys that extend each key: how many, and the longest."""
    p = lookup.prefix_pairs(headwords(spark, sf), "head")
    return p.groupBy(F.col("shorter").alias("prefix")).agg(F.count("*").alias("extensions"), F.max(F.length("longer")).cast("long").alias("longest"))


@query(f"""with stop(p) as (values {_STOP_VALUES}) select distinct midasi from ngram_uni where midasi is not null and not exists (select 1 from stop where starts_with(midasi, p))""")
def j07_without_stop_prefixes(spark, sf):
    """Words that start with no stop word: prefixes are exploded, then an anti join."""
    w = table(spark, sf, "ngram_uni").where("midasi is not null").select("midasi").distinct()
    stop = spark.createDataFrame([(x,) for x in STOP], "p string")
    hit = w.where(F.length("midasi") > 0).select("midasi", F.explode(lookup.prefixes(F.col("midasi"), 1, max(map(len, STOP)))).alias("p")).join(F.broadcast(stop), "p").select("midasi").distinct()
    return w.join(hit, "midasi", "left_anti")


@query(rf"""with {STOK}, p as (select distinct token as kata from stok where regexp_matches(token, '^[ァ-ヴー]+$')), h as (select distinct word from (select unnest(regexp_extract_all(text, '[ァ-ヴー]+')) as word from tweets))
select kata, word as inner_word from p join h on contains(kata, word) and kata <> word""")
def j09_pivots_that_contain(spark, sf):
    """Katakana words of sentences with those of statuses that stand within them, of any length."""
    p = sentence_tokens(spark, sf).where(F.col("token").rlike("^[ァ-ヴー]+$")).select(F.col("token").alias("kata")).distinct()
    h = table(spark, sf, "tweets").select(F.explode(F.regexp_extract_all("text", F.lit("[ァ-ヴー]+"), F.lit(0))).alias("word")).distinct()
    return lookup.contained_in(h, "word", p, "kata").select("kata", F.col("word").alias("inner_word"))


@query(f"""with {TOK}, n as (select lang as ftype, token as fname, count(*) as freq from tok where lang is not null group by 1, 2 having count(*) >= 5), ids as (select *, row_number() over (order by ftype, freq desc, fname) - 1 as fid from n)
select t.doc_id, i.fid, count(*) as n from tok t join ids i on i.ftype = t.lang and i.fname = t.token group by 1, 2""")
def j15_feature_ids(spark, sf):
    """Features of documents with their ids; names that have none are left out."""
    t = tokens(spark, sf).where("lang is not null")
    n = t.groupBy("lang", "token").agg(F.count("*").alias("freq")).where("freq >= 5")
    ids = storage.row_index(n, ["lang", F.desc("freq"), "token"], "fid").withColumn("fid", F.col("fid") - 1)
    per = t.groupBy("doc_id", "lang", "token").agg(F.count("*").alias("n"))
    return per.join(ids.select("lang", "token", "fid"), ["lang", "token"]).select("doc_id", "fid", "n")


@query(f"""with {TOK}, s as (select midasi, row_number() over (order by midasi) - 1 as id from (select distinct midasi from ngram_uni where midasi is not null and regexp_matches(midasi, '^[ぁ-ゖ]+$')))
select s.id, t.token, count(*) as n from tok t join s on s.midasi = t.token group by 1, 2""")
def j16_suffix_ids(spark, sf):
    """Exact look-up of kana words in the numbered list of suffixes."""
    listed = table(spark, sf, "ngram_uni").where(F.col("midasi").rlike("^[ぁ-ゖ]+$")).select("midasi").distinct()
    ids = storage.row_index(listed, ["midasi"], "id").select((F.col("id") - 1).alias("id"), F.col("midasi").alias("token"))
    return tokens(spark, sf).groupBy("token").agg(F.count("*").alias("n")).join(ids, "token").select("id", "token", "n")


@query(rf"""with {STOK}, w as (select row_id, pos, token, lag(token) over (partition by row_id order by pos) as front from stok), e as (select row_id, pos, coalesce(front, '') as front, token as kata from w where regexp_matches(token, '^[ァ-ヴー]+$')),
g as (select front, kata from e group by 1, 2 having count(*) >= 3) select e.front, e.kata, e.row_id, e.pos from e join g using (front, kata)""")
def j21_shared_front(spark, sf):
    """Examples of a word that share what stands before it, in groups of three and more; groups stay rows."""
    w = W.partitionBy("row_id").orderBy("pos")
    e = sentence_tokens(spark, sf).withColumn("front", F.coalesce(F.lag("token").over(w), F.lit(""))).where(F.col("token").rlike("^[ァ-ヴー]+$")).select("front", F.col("token").alias("kata"), "row_id", "pos")
    g = storage.written(e.groupBy("front", "kata").agg(F.count("*").alias("n")).where("n >= 3"), "fronts")
    return storage.join_hot(e, g, ["front", "kata"], "n").select("front", "kata", "row_id", "pos")


@query(rf"""with {STOK}, {HEAD}, h as (select distinct head from head where hinsi = '名詞') select row_id, token as noun, max(pos) as place from stok join h on h.head = token group by 1, 2""")
def j23_rightmost_match(spark, sf):
    """A noun of the dictionary and its token in the sentence, the right-most first."""
    h = headwords(spark, sf).where("hinsi = '名詞'").select(F.col("head").alias("token")).distinct()
    t = sentence_tokens(spark, sf).groupBy("row_id", "token").agg(F.max("pos").alias("place"))
    return t.join(h, "token", "left_semi").select("row_id", F.col("token").alias("noun"), "place")


@query(f"""with {HEAD}, c(bunrui, class_id, label, proper) as (values {_CLASS_VALUES}) select head, string_agg(distinct cast(class_id as varchar), '?' order by cast(class_id as varchar)) as ids, bool_and(proper) as proper from head join c using (bunrui) group by 1""")
def proj11_category_ids(spark, sf):
    """Class ids of a headword over all of its homographs, each once, sorted, and whether all are classes of names."""
    h = headwords(spark, sf).join(F.broadcast(classes(spark)), "bunrui")
    return h.groupBy("head").agg(F.array_join(F.array_sort(F.collect_set(F.col("class_id").cast("string"))), "?").alias("ids"), F.bool_and("proper").alias("proper"))


@query(f"""with c(bunrui, class_id, label, proper) as (values {_CLASS_VALUES}) select entry_id, coalesce(class_id, -1) as class_id, label, coalesce(proper, false) as proper from dictionary left join c using (bunrui)""")
def proj12_class_labels(spark, sf):
    return table(spark, sf, "dictionary").join(F.broadcast(classes(spark)), "bunrui", "left").select("entry_id", F.coalesce("class_id", F.lit(-1)).alias("class_id"), "label", F.coalesce("proper", F.lit(False)).alias("proper"))


@query("""with n as (select source as ftype, coalesce(lang, '') as fname, count(*) as freq from documents group by 1, 2), i as (select *, row_number() over (order by ftype, freq desc, fname) - 1 as fid from n)
select doc_id, fid, ftype || ':' || fname as decoded from documents d join i on i.ftype = d.source and i.fname = coalesce(d.lang, '')""")
def proj14_decoded_features(spark, sf):
    """Feature ids back to type and name."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("ftype"), F.coalesce("lang", F.lit("")).alias("fname"))
    n = d.groupBy("ftype", "fname").agg(F.count("*").alias("freq"))
    ids = storage.written(storage.row_index(n, ["ftype", F.desc("freq"), "fname"], "fid").withColumn("fid", F.col("fid") - 1), "features")
    coded = storage.join_hot(d, ids.select("ftype", "fname", "fid", "freq"), ["ftype", "fname"], "freq").select("doc_id", "fid")
    return storage.join_hot(coded, ids.select("fid", "ftype", "fname", "freq"), ["fid"], "freq").select("doc_id", "fid", F.concat_ws(":", "ftype", "fname").alias("decoded"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id || chr(9) || 'user' || (user_id % 3) || chr(9) || '100' || chr(9) || string_agg(event_type || chr(9) || (n * case when event_type in ('error', 'purchase') then 10 else 1 end), chr(9) order by event_type) as line from c group by user_id""")
def proj15_cluster_lines(spark, sf):
    """Instances in the text form of a clustering tool: label with its weight, then features, some of them weighing ten times."""
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    weighted = F.concat_ws("\t", "event_type", (F.col("n") * F.when(F.col("event_type").isin("error", "purchase"), 10).otherwise(1)).cast("string"))
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", weighted.alias("w")))).alias("f"))  # one for each type
    return g.select(F.concat_ws("\t", F.col("user_id").cast("string"), F.concat(F.lit("user"), (F.col("user_id") % 3).cast("string")), F.lit("100"), F.array_join(F.transform("f", lambda x: x["w"]), "\t")).alias("line"))


@query("select row_id, document_id, raw from sentences where raw is not null and trim(raw) <> '' and unit = 'line'")
def proj10_sentence_lines(spark, sf):
    """Sentences only: what is one already; blocks are for the sentence operator."""
    return table(spark, sf, "sentences").where("raw is not null and trim(raw) <> '' and unit = 'line'").select("row_id", "document_id", "raw")
