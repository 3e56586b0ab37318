"""Inflection, detection, dictionary cleaning and similarity as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, kana, morphology
from ..operators import detect, dictionaries
from .acquire import SUFFIXES, suffixes
from .filters import MALFORMED
from .registry import HEAD, TOK, headwords, query, table, tokens

_FORMS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in morphology.inflections())
_SUFFIX_VALUES = ", ".join(f"('{a}')" for a in sorted({s for s, _, _ in SUFFIXES}))


@query(f"""with {HEAD}, f(k, form, ending) as (values {_FORMS}), v as (select entry_id, head, katuyou1 from head where katuyou1 is not null)
select v.entry_id, v.head, b.form, case when ends_with(v.head, a.ending) then substr(v.head, 1, length(v.head) - length(a.ending)) || b.ending end as surface
from v join f a on a.k = v.katuyou1 and a.form = '基本形' join f b on b.k = v.katuyou1""")
def c02_inflected_forms(spark, sf):
    """Every form of every inflecting headword."""
    v = headwords(spark, sf).where("katuyou1 is not null").select("entry_id", "head", "katuyou1")
    t = F.broadcast(morphology.inflection_table(spark))  # about a hundred rows by construction
    base = t.where("katuyou2 = '基本形'").select("katuyou1", F.col("ending").alias("b"))
    j = v.join(base, "katuyou1").join(t, "katuyou1")
    stem = F.substring("head", F.lit(1), F.length("head") - F.length("b"))
    return j.select("entry_id", "head", F.col("katuyou2").alias("form"), F.when(F.col("head").endswith(F.col("b")), F.concat(stem, "ending")).alias("surface"))


@query(f"""with {HEAD} select entry_id, head, case when hinsi = '動詞' then case when katuyou1 in ('母音動詞', 'サ変動詞', 'ザ変動詞') or starts_with(katuyou1, '子音動詞') then katuyou1 end
 when hinsi = '形容詞' then case when starts_with(katuyou1, 'イ形容詞') then 'イ形容詞' when starts_with(katuyou1, 'ナ') then 'ナ形容詞' end
 when hinsi = '名詞' then case when coalesce(bunrui, '') not in ('数詞', '形式名詞', '副詞的名詞', '時相名詞') then '普通名詞' end when hinsi = '副詞' then '副詞' end as pos_s from head""")
def c06_pos_name(spark, sf):
    return headwords(spark, sf).select("entry_id", "head", chars.pos_name(F.col("hinsi"), F.col("bunrui"), F.col("katuyou1")).alias("pos_s"))


@query("""select regexp_replace(word_class, ':[^>]*>$', '>') as abstract, count(distinct word_class) as classes, cast(sum(cnt) as bigint) as cnt from ngram_uni where word_class is not null group by 1""")
def c08_abstract_classes(spark, sf):
    u = table(spark, sf, "ngram_uni").where("word_class is not null")
    return u.groupBy(morphology.abstract_class(F.col("word_class")).alias("abstract")).agg(F.count_distinct("word_class").alias("classes"), F.sum("cnt").alias("cnt"))


@query(f"""with {HEAD} select entry_id, head, coalesce(map_extract(imis, '代表表記')[1], head || '/' || coalesce(yomi, '')) as repname from head""")
def c24_representative(spark, sf):
    return headwords(spark, sf).select("entry_id", "head", morphology.representative(F.col("imis"), F.col("head"), F.col("yomi")).alias("repname"))


@query(f"""with {HEAD}, s(suffix) as (values {_SUFFIX_VALUES}) select distinct head from head where length(head) <= 5 and head in (select suffix from s)""")
def f13_function_words(spark, sf):
    s = suffixes(spark).select(F.col("suffix").alias("head")).distinct()
    return headwords(spark, sf).where(F.length("head") <= 5).join(F.broadcast(s), "head", "left_semi").select("head").distinct()


@query(f"""with {HEAD} select entry_id, head, length(head) between 1 and 129 and length(coalesce(yomi, 'あ')) between 1 and 129 and regexp_matches(head, '^[{kana.two_byte_class()}]+$') and regexp_matches(coalesce(yomi, 'あ'), '^[{kana.two_byte_class()}]+$')
 and length(array_to_string(list_transform(coalesce(map_entries(imis), []), lambda e: e.key || ':' || coalesce(e.value, '')), ' ')) <= 1024 as sane from head""")
def f14_sane_entries(spark, sf):
    """Entries whose headword, reading and marks have a length that the dictionary takes, in characters that it knows."""
    text = F.array_join(F.transform(F.map_entries("imis"), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit("")))), " ")
    return headwords(spark, sf).select("entry_id", "head", (chars.sane_entry(F.col("head"), F.col("yomi"), text) & kana.euc_convertible_column(F.col("head")) & kana.euc_convertible_column(F.coalesce("yomi", F.lit("あ")))).alias("sane"))


@query("""select repname, count(distinct midasi) as spellings, cast(sum(cnt) as bigint) as cnt from ngram_uni where repname is not null and midasi is not null
group by 1 having count(distinct midasi) > 1 and not bool_and(regexp_matches(midasi, '^[ァ-ヴーA-Za-zＡ-Ｚａ-ｚ]+$')) and not bool_and(regexp_matches(midasi, '^[ぁ-ゖー]+$')) and max(case when regexp_matches(midasi, '^[ぁ-ゖー]+$') then length(midasi) else 0 end) < 8""")
def f18_variant_names(spark, sf):
    """Representative names with spellings to choose from: not one only, not all katakana or letters, not all hiragana."""
    u = table(spark, sf, "ngram_uni").where("repname is not null and midasi is not null")
    hira = F.col("midasi").rlike("^[ぁ-ゖー]+$")
    g = u.groupBy("repname").agg(F.count_distinct("midasi").alias("spellings"), F.sum("cnt").alias("cnt"), F.bool_and(F.col("midasi").rlike("^[ァ-ヴーA-Za-zＡ-Ｚａ-ｚ]+$")).alias("k"), F.bool_and(hira).alias("h"), F.max(F.when(hira, F.length("midasi")).otherwise(0)).alias("longest"))
    return g.where("spellings > 1 and not k and not h and longest < 8").select("repname", "spellings", "cnt")


_STEMS = """st as (select entry_id, dict_name, coalesce(map_extract(annotation, 'stem')[1], list_min(map_keys(midasi))) as stem, hinsi, katuyou1, try_cast(map_extract(annotation, 'count')[1] as bigint) as cnt from dictionary)"""


@query(f"""with {_STEMS}, v as (select distinct stem, katuyou1 as pos_s from st where katuyou1 is not null) select * from v where not (pos_s = '母音動詞' and (exists (select 1 from v r where r.pos_s = '子音動詞ラ行' and r.stem = v.stem) or exists (select 1 from v k where k.pos_s = '子音動詞カ行' and k.stem || 'い' = v.stem)))""")
def f19_without_conflicts(spark, sf):
    """Verb classes that contradict each other: the less likely one goes."""
    v = dictionaries.stems(table(spark, sf, "dictionary")).where("katuyou1 is not null").select("stem", F.col("katuyou1").alias("pos_s")).distinct()
    return dictionaries.without_conflicts(v).select("stem", "pos_s")


@query(f"""with {_STEMS}, s(suffix) as (values {_SUFFIX_VALUES}), f as (select stem, hinsi, sum(coalesce(cnt, 0)) as cnt from st where stem is not null and dict_name <> 'main' group by 1, 2), kn as (select distinct stem, hinsi from st where dict_name = 'main' and stem is not null)
select stem, hinsi, cast(cnt as bigint) as cnt, case when exists (select 1 from kn where kn.stem = f.stem and kn.hinsi = f.hinsi) then 'known' when length(stem) <= 5 and stem in (select suffix from s) then 'function word'
 when {MALFORMED.format(w='stem', p='hinsi')} then 'malformed' else 'registered' end as outcome from f""")
def st07_registration(spark, sf):
    """Found words with the outcome of registering them into the main dictionary."""
    e = dictionaries.stems(table(spark, sf, "dictionary")).where("stem is not null")
    known = e.where("dict_name = 'main'").select("stem", F.col("hinsi").alias("pos_s"))
    found = e.where("dict_name <> 'main'").groupBy("stem", F.col("hinsi").alias("pos_s")).agg(F.sum(F.coalesce(F.try_element_at("annotation", F.lit("count")).cast("long"), F.lit(0).cast("long"))).alias("cnt"))
    got = dictionaries.register(found, known, suffixes(spark))
    return got.select("stem", F.col("pos_s").alias("hinsi"), "cnt", "outcome")


@query("""with p as (select w1.midasi as a, w2.midasi as b, sum(cnt) as n from ngram_fbi where w1.midasi is not null and w2.midasi is not null group by 1, 2), often as (select a, b from p where n >= 5),
d as (select document_id, w1.midasi as a, w2.midasi as b, sum(cnt) as n from ngram_fbi where w1.midasi is not null and w2.midasi is not null group by 1, 2, 3)
select document_id, count(*) as kept, cast(sum(n) as bigint) as n from d where not exists (select 1 from often o where o.a = d.a and o.b = d.b) group by 1""")
def j25_without_common_pairs(spark, sf):
    """Neighbouring words of each document without the pairs that are common in the corpus."""
    f = table(spark, sf, "ngram_fbi").where("w1.midasi is not null and w2.midasi is not null").select("document_id", F.col("w1.midasi").alias("a"), F.col("w2.midasi").alias("b"), "cnt")
    d = f.groupBy("document_id", "a", "b").agg(F.sum("cnt").alias("n"))
    often = d.groupBy("a", "b").agg(F.sum("n").alias("t")).where("t >= 5").select("a", "b")
    return d.join(often, ["a", "b"], "left_anti").groupBy("document_id").agg(F.count("*").alias("kept"), F.sum("n").alias("n"))


@query(f"""with {TOK}, w as (select doc_id, token, lead(token, 1) over s as n1, lead(token, 2) over s as n2 from tok window s as (partition by doc_id order by pos))
select n1 || coalesce(case when regexp_matches(n2, '^[ぁ-ゖ]+$') then n2 end, '') as suffix, count(*) as n from w where regexp_matches(token, '^[一-鿿々]+$') and regexp_matches(n1, '^[ぁ-ゖ]+$') group by 1""")
def c28_suffix_extraction(spark, sf):
    """What follows a word, up to where the kana end."""
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).withColumn("next", F.array_compact(F.array(F.lead("token", 1).over(w), F.lead("token", 2).over(w))))
    t = t.where(F.col("token").rlike("^[一-鿿々]+$")).select(detect.take_while(F.col("next"), "^[^ぁ-ゖ]").alias("suffix"))
    return t.where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("n"))


_NAMED = """b as (select w1.midasi as a, w1.repname as r, w2.midasi as b, sum(cnt) as n from ngram_fbi where w1.midasi is not null and w2.midasi is not null and w1.repname is not null group by 1, 2, 3),
p as (select a, b, sum(n) as n from b group by 1, 2), u as (select midasi as w, sum(cnt) as n from ngram_uni where midasi is not null group by 1), s as (select distinct x.a, y.a as other from (select distinct a, r from b) x join (select distinct a, r from b) y on x.r = y.r and x.a <> y.a)"""


@query(f"""with {_NAMED}, k as (select p.a, p.b, any_value(p.n) as n, sum(coalesce(q.n, 0)) as k, sum(coalesce(u2.n, 0)) as u from p join s on s.a = p.a left join p q on q.a = s.other and q.b = p.b left join u u2 on u2.w = s.other group by 1, 2)
select k.a, k.b, cast(k.n as bigint) as n, round((k.n + 0.01) / (coalesce(u.n, 0) + 300), 8) as p, round((k.k + 0.01) / (k.u + 300), 8) as p_other, ((k.k + 0.01) / (k.u + 300)) / ((k.n + 0.01) / (coalesce(u.n, 0) + 300)) < 0.001 as suspicious from k left join u on u.w = k.a""")
def st02_likelihood_ratio(spark, sf):
    """For each pair whose first word has other spellings: its probability, and that of the other spellings."""
    f = table(spark, sf, "ngram_fbi").where("w1.midasi is not null and w2.midasi is not null and w1.repname is not null").select(F.col("w1.midasi").alias("a"), F.col("w1.repname").alias("r"), F.col("w2.midasi").alias("b"), "cnt")
    pairs = f.groupBy("a", "b").agg(F.sum("cnt").alias("n"))
    uni = table(spark, sf, "ngram_uni").where("midasi is not null").groupBy(F.col("midasi").alias("w")).agg(F.sum("cnt").alias("n"))
    names = f.select("a", "r").distinct()
    spellings = names.join(names.select("r", F.col("a").alias("other")), "r").where("a <> other").select("a", "other").distinct()
    got = detect.suspicious_pairs(pairs, uni, spellings)
    return got.select("a", "b", "n", F.round("p", 8).alias("p"), F.round("p_other", 8).alias("p_other"), "suspicious")


@query(r"""with s as (select row_id, regexp_extract_all(raw, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z0-9]+|\S') as a from sentences where raw is not null),
e as (select row_id, list_prepend({'skip': 0, 'held': false, 'found': []::integer[], 'w': '', 'f': '', 'i': -1}, list_transform(a, lambda w, i: {'skip': 0, 'held': false, 'found': []::integer[], 'w': w, 'f': case when w = 'っ' then 'SKIP' when regexp_matches(w, '^[A-Za-z0-9]+$') then 'SINGLESKIP' when regexp_matches(w, '^[ァ-ヴー]{3,}$') then 'KATAKANA' else '' end, 'i': cast(i - 1 as integer)})) as l from s),
r as (select row_id, list_reduce(l, lambda acc, x: {'skip': case when x.f = 'SKIP' then 2 else greatest(acc.skip - 1, 0) end, 'held': not regexp_matches(x.w, '^[、。，．！？…「」『』（）()：；／]$') and (acc.held or (x.f = 'KATAKANA' and acc.skip = 0)),
 'found': case when not acc.held and x.f = 'KATAKANA' and acc.skip = 0 then list_append(acc.found, x.i) else acc.found end, 'w': x.w, 'f': x.f, 'i': x.i}) as z from e)
select row_id, cast(len(z.found) as integer) as n, array_to_string(z.found, ',') as positions from r where len(z.found) > 0""")
def w03_fold_detection(spark, sf):
    """Positions detected in each sentence by the skipping fold; single katakana words are the candidates."""
    s = table(spark, sf, "sentences").where("raw is not null").select("row_id", F.regexp_extract_all("raw", F.lit("[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z0-9]+|[^\\s]"), F.lit(0)).alias("words"))
    marks = F.transform("words", lambda w: F.when(w == "っ", "SKIP").when(w.rlike("^[A-Za-z0-9]+$"), "SINGLESKIP").when(w.rlike("^[ァ-ヴー]{3,}$"), "KATAKANA"))
    return s.select("row_id", detect.fold_detections(F.col("words"), marks).alias("at")).select("row_id", F.size("at").alias("n"), F.array_join("at", ",").alias("positions")).where("n > 0")


@query("""with c as (select midasi, repname, word_class, sum(cnt) as n from ngram_uni where repname is not null and midasi is not null group by 1, 2, 3), t as (select repname, sum(n) as total from c group by 1)
select repname, midasi, word_class, round(n / total, 6) as share from c join t using (repname) where total > 20""")
def a08_training_rows(spark, sf):
    """Relative-frequency vectors of the names that occur often enough."""
    c = table(spark, sf, "ngram_uni").where("repname is not null and midasi is not null").groupBy("repname", "midasi", "word_class").agg(F.sum("cnt").alias("n"))
    t = c.groupBy("repname").agg(F.sum("n").alias("total")).where("total > 20")
    return c.join(t, "repname").select("repname", "midasi", "word_class", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(f"with {TOK} select doc_id, count(distinct token) as terms, count(*) as n, max(k) as top from (select doc_id, token, count(*) over (partition by doc_id, token) as k from tok where regexp_matches(token, '^[一-鿿々ァ-ヴー]+$')) group by 1")
def a22_document_terms(spark, sf):
    c = tokens(spark, sf).where(F.col("token").rlike("^[一-鿿々ァ-ヴー]+$")).groupBy("doc_id", "token").agg(F.count("*").alias("k"))
    return c.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("k").alias("n"), F.max("k").alias("top"))


@query(f"""with {HEAD} select coalesce(map_extract(imis, '代表表記')[1], head) as repname, count(*) as entries, min(entry_id) as kept from head group by 1""")
def a38_unique_by_name(spark, sf):
    rep = F.coalesce(F.try_element_at("imis", F.lit("代表表記")), F.col("head"))
    return headwords(spark, sf).groupBy(rep.alias("repname")).agg(F.count("*").alias("entries"), F.min("entry_id").alias("kept"))


@query()
def j14_variants_by_distance(spark, sf):
    """Dictionary entries whose readings, of any length and script, are close under the weighted distance."""
    return dictionaries.variants_by_distance(table(spark, sf, "dictionary").select("entry_id", "yomi", "hinsi", "bunrui", "katuyou1"))


@query("""with f as (select repname as item, document_id as feature, cast(sum(cnt) as double) as n from ngram_uni where repname is not null and midasi is not null group by 1, 2), t as (select item from f group by 1 having sum(n) >= 5),
g as (select f.* from f join t using (item)), nn as (select item, sqrt(sum(n * n)) as norm from g group by 1)
select x.item as a, y.item as b, round(sum(x.n * y.n) / (any_value(p.norm) * any_value(q.norm)), 6) as cosine from g x join g y on x.feature = y.feature and x.item < y.item join nn p on p.item = x.item join nn q on q.item = y.item
where split_part(x.item, '/', 2) = split_part(y.item, '/', 2) and split_part(x.item, '/', 2) <> '' group by 1, 2""")
def ml18_distributional_similarity(spark, sf):
    """Cosine of the documents of frequent names that share a reading."""
    f = table(spark, sf, "ngram_uni").where("repname is not null and midasi is not null").groupBy(F.col("repname").alias("item"), F.col("document_id").alias("feature")).agg(F.sum("cnt").cast("double").alias("n"))
    often = f.groupBy("item").agg(F.sum("n").alias("t")).where("t >= 5").select("item")
    f = f.join(often, "item")
    named = often.withColumn("reading", F.split_part("item", F.lit("/"), F.lit(2))).where("reading <> ''")  # a name without a reading shares none
    pairs = named.select(F.col("item").alias("a"), "reading").join(named.select(F.col("item").alias("b"), "reading"), "reading").where("a < b").select("a", "b")
    return dictionaries.similar(f, pairs).where("cosine > 0").select("a", "b", F.round("cosine", 6).alias("cosine"))
