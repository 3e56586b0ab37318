"""Joins on words as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, lookup, storage
from .registry import HEAD, TOK, headwords, query, table, tokens


@query(f"""with {HEAD}, u as (select head as token, count(*) as cnt from head where dict_name = 'web' group by 1), m as (select * from head where dict_name = 'main') select hinsi, count(*) as matches, count(distinct token) as words, cast(sum(cnt) as bigint) as cnt from u join m on m.head = u.token where hinsi in ('名詞', '動詞') group by 1""")
def j01_dictionary_lookup(spark, sf):
    h = headwords(spark, sf).withColumn("token", F.col("head"))
    u = h.where("dict_name = 'web'").groupBy("token").agg(F.count("*").alias("cnt"))
    hit = lookup.dictionary_lookup(u, h.where("dict_name = 'main'").select("token", "hinsi"), "token", {"hinsi": ["名詞", "動詞"]})
    return hit.groupBy("hinsi").agg(F.count("*").alias("matches"), F.count_distinct("token").alias("words"), F.sum("cnt").alias("cnt"))


@query(f"""with {HEAD}, a as (select head, 'auto' as d from head where dict_name = 'auto' union all select head, 'main' from head where dict_name = 'main') select head, count(*) as entries, count(distinct d) as dictionaries from a group by 1""")
def j02_union_lookup(spark, sf):
    h = headwords(spark, sf)
    both = h.where("dict_name = 'auto'").select("head", "dict_name").unionByName(h.where("dict_name = 'main'").select("head", "dict_name"))
    return both.groupBy("head").agg(F.count("*").alias("entries"), F.count_distinct("dict_name").alias("dictionaries"))


@query(f"""with {HEAD}, w as (select distinct head as w from head where length(head) > 0) select a.w as shorter, b.w as longer from w a join w b on a.w <> b.w and starts_with(b.w, a.w)""")
def j03_prefix_related(spark, sf):
    return lookup.prefix_pairs(headwords(spark, sf), "head")


@query(f"""with {TOK}, w as (select distinct token as word from tok), p as (select distinct midasi as prefix from ngram_uni where length(midasi) between 1 and 4),
h as (select word, prefix from w join p on starts_with(word, prefix)) select word, max_by(prefix, length(prefix)) as prefix from h group by 1""")
def j04_longest_listed(spark, sf):
    """For each distinct token the longest of the listed words of at most four characters that it starts with."""
    listed = table(spark, sf, "ngram_uni").where(F.length("midasi").between(1, 4)).select(F.col("midasi").alias("p"))
    return lookup.longest_prefix(tokens(spark, sf), "token", listed, "p", 4)


@query(f"""with {HEAD}, w as (select distinct head as w from head where length(head) >= 1) select a.w as inner, b.w as outer from w a join w b on a.w <> b.w and contains(b.w, a.w)""".replace(" as inner", ' as "inner"').replace(" as outer", ' as "outer"'))
def j08_contains(spark, sf):
    return lookup.contained_pairs(headwords(spark, sf), "head")


@query(f"""with {HEAD}, s as (select distinct head as stem from head where hinsi = '動詞' and ends_with(head, 'る')), o as (select distinct head from head)
select s.stem, exists (select 1 from o where o.head = substr(s.stem, 1, length(s.stem) - 1)) as bare, exists (select 1 from o where o.head = s.stem || 'い') as with_i from s""")
def j11_conflict_keys(spark, sf):
    """Words whose derived keys exist as well: what conflicts in inflection."""
    h = headwords(spark, sf)
    stems = h.where((F.col("hinsi") == "動詞") & F.col("head").endswith("る")).select(F.col("head").alias("stem")).distinct()
    seen = h.select(F.col("head").alias("k")).distinct().withColumn("there", F.lit(True))
    keyed = stems.withColumn("a", F.expr("substring(stem, 1, length(stem) - 1)")).withColumn("b", F.concat("stem", F.lit("い")))
    keyed = keyed.join(seen.select(F.col("k").alias("a"), F.col("there").alias("bare")), "a", "left").join(seen.select(F.col("k").alias("b"), F.col("there").alias("with_i")), "b", "left")
    return keyed.select("stem", F.coalesce("bare", F.lit(False)).alias("bare"), F.coalesce("with_i", F.lit(False)).alias("with_i"))


@query(f"""with {HEAD}, v as (select distinct head, katuyou1 from head where hinsi = '動詞'),
k as (select head, substr(head, 1, length(head) - 2) || translate(substr(head, length(head) - 1, 1), 'えけせてめれげべ', 'うくすつむるぐぶ') as base from v where length(head) >= 3 and ends_with(head, 'る') and regexp_matches(substr(head, length(head) - 1, 1), '[えけせてめれげべ]'))
select k.head, min(b.head) as base from k join v b on b.head = k.base group by 1 having count(distinct b.head) = 1""")
def j12_potential_verbs(spark, sf):
    """Potential verbs with their base verb, where there is exactly one."""
    v = headwords(spark, sf).where("hinsi = '動詞'").select("head").distinct()
    kana = F.expr("substring(head, length(head) - 1, 1)")
    k = v.where((F.length("head") >= 3) & F.col("head").endswith("る") & kana.rlike("[えけせてめれげべ]")).withColumn("key", F.concat(F.expr("substring(head, 1, length(head) - 2)"), F.translate(kana, "えけせてめれげべ", "うくすつむるぐぶ")))
    hits = k.join(v.select(F.col("head").alias("key"), F.col("head").alias("base")), "key")
    return lookup.unique_candidate(hits, "head", "base")


@query("""with g as (select distinct entry_id, yomi from dictionary where length(yomi) >= 3), q as (select distinct entry_id, substr(yomi, i, 3) as g from (select entry_id, yomi, unnest(range(1, length(yomi) - 1)) as i from g)),
n as (select entry_id, count(*) as n from q group by 1), c as (select a.entry_id as key_a, b.entry_id as key_b, count(*) as c from q a join q b on a.g = b.g and a.entry_id < b.entry_id group by 1, 2)
select key_a, key_b, c / least(x.n, y.n) as overlap from c join n x on x.entry_id = key_a join n y on y.entry_id = key_b where c / least(x.n, y.n) >= 0.6""")
def j14_trigram_overlap(spark, sf):
    """Pairs of readings that share most of the shorter one's trigrams."""
    return lookup.overlap_pairs(table(spark, sf, "dictionary").where("yomi is not null"), "entry_id", "yomi", 3, 0.6)


@query("""with b as (select w1.midasi as a, w2.midasi as b, sum(cnt) as n from ngram_fbi where w1.midasi is not null and w2.midasi is not null group by 1, 2), u as (select midasi, sum(cnt) as n from ngram_uni where midasi is not null group by 1)
select a, b, cast(b.n as bigint) as n_ab, cast(coalesce(u.n, 0) as bigint) as n_a, round((b.n + 0.01) / (coalesce(u.n, 0) + 300), 8) as p from b left join u on u.midasi = a where b.n >= 3""")
def j17_left_default(spark, sf):
    """Smoothed probability of the following word; a missing count is zero."""
    b = table(spark, sf, "ngram_fbi").where("w1.midasi is not null and w2.midasi is not null").groupBy(F.col("w1.midasi").alias("a"), F.col("w2.midasi").alias("b")).agg(F.sum("cnt").alias("n_ab")).where("n_ab >= 3")
    u = table(spark, sf, "ngram_uni").where("midasi is not null").groupBy(F.col("midasi").alias("a")).agg(F.sum("cnt").alias("n_a"))
    j = b.join(u, "a", "left").withColumn("n_a", F.coalesce("n_a", F.lit(0).cast("long")))
    return j.select("a", "b", "n_ab", "n_a", F.round((F.col("n_ab") + 0.01) / (F.col("n_a") + 300), 8).alias("p"))


@query("""with a as (select doc_id, rater, row_number() over (order by doc_id, rater, grade) as rn from reading_labels), b as (select item_id, row_number() over (order by item_id) as rn from eval_items) select rn, a.doc_id, b.item_id from a join b using (rn)""")
def j18_positional_zip(spark, sf):
    """Two ordered lists side by side."""
    a = storage.row_index(table(spark, sf, "reading_labels").select("doc_id", "rater", "grade"), ["doc_id", "rater", "grade"], "rn").select("rn", "doc_id")
    b = storage.row_index(table(spark, sf, "eval_items").select("item_id"), ["item_id"], "rn")
    return a.join(b, "rn").select("rn", "doc_id", "item_id")


@query(f"""with {HEAD}, a as (select distinct head || ':' || hinsi as k from head where dict_name = 'auto'), b as (select distinct head || ':' || hinsi as k from head where dict_name = 'web')
select coalesce(a.k, b.k) as k, case when a.k is null then 'only2' when b.k is null then 'only1' else 'shared' end as side from a full outer join b on a.k = b.k""")
def j19_dictionary_diff(spark, sf):
    h = headwords(spark, sf).withColumn("k", F.concat_ws(":", "head", "hinsi"))
    a, b = (h.where(F.col("dict_name") == x).select("k").distinct() for x in ("auto", "web"))
    j = a.withColumn("in1", F.lit(True)).join(b.withColumn("in2", F.lit(True)), "k", "full_outer")
    return j.select("k", F.when(F.col("in1").isNull(), "only2").when(F.col("in2").isNull(), "only1").otherwise("shared").alias("side"))


@query(r"""with s as (select row_id, replace(raw, ' ', '') as t from sentences where raw is not null),
a as (select row_id, unnest(regexp_extract_all(t, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|.', 0, 's')) as w, generate_subscripts(regexp_extract_all(t, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|.', 0, 's'), 1) as i from s),
b as (select row_id, unnest(regexp_extract_all(t, '[一-鿿々]+[ぁ-ゖ]?|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|.', 0, 's')) as w, generate_subscripts(regexp_extract_all(t, '[一-鿿々]+[ぁ-ゖ]?|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|.', 0, 's'), 1) as i from s),
ea as (select row_id, sum(length(w)) over (partition by row_id order by i) as e from a), eb as (select row_id, sum(length(w)) over (partition by row_id order by i) as e from b)
select row_id, count(*) as cuts, count_if(x and y) as common, count_if(x and not y) as only_first, count_if(y and not x) as only_second
from (select row_id, e, bool_or(s = 1) as x, bool_or(s = 2) as y from (select row_id, e, 1 as s from ea union all select row_id, e, 2 from eb) group by 1, 2) group by 1""", "common only_first only_second")
def j20_segmentation_diff(spark, sf):
    """Two segmentations of the same text compared by the offsets of their cuts."""
    s = table(spark, sf, "sentences").where("raw is not null").select("row_id", F.replace("raw", F.lit(" "), F.lit("")).alias("t"))
    first = "(?s)[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|."
    second = "(?s)[一-鿿々]+[ぁ-ゖ]?|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|."
    s = s.select("row_id", F.regexp_extract_all("t", F.lit(first), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(second), F.lit(0)).alias("b"))
    return align.cut_counts(s, "a", "b").where("cuts > 0")
