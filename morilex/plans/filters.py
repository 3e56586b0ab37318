"""Filters, predicates and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars
from ..operators import rules
from .registry import HEAD, LABELLED, TOK, headwords, query, table, tokens

#: A rule file in the engine's own words, for tokens without an analyser.
DETECTION = """
; the first rule that matches decides
(([(見出し語長 1)] [(カタカナ)] [(見出し語長 1)]) KATAKANA_BETWEEN)
((* [(カタカナ)^(見出し語 ー)] [(見出し語 する)]) KATAKANA_VERB)
((* [(カタカナ)] ^[(ひらがな)]) KATAKANA_ALONE)
((| [(漢字)] *) KANJI_FIRST)
((* [(一文字漢字)] [(ひらがな)(見出し語長 2)]) KANJI_OKURI)
"""


@query(f"""with {TOK}, w as (select token, lag(token) over s as p, lead(token) over s as n from tok window s as (partition by doc_id order by pos)),
m as (select case
 when p is not null and length(p) = 1 and regexp_matches(token, '^[ァ-ヴー]+$') and n is not null and length(n) = 1 then 'KATAKANA_BETWEEN'
 when regexp_matches(token, '^[ァ-ヴー]+$') and token <> 'ー' and n = 'する' then 'KATAKANA_VERB'
 when regexp_matches(token, '^[ァ-ヴー]+$') and (n is null or not regexp_matches(n, '^[ぁ-ゖー]+$')) then 'KATAKANA_ALONE'
 when p is null and regexp_matches(token, '^[一-鿿々]+$') then 'KANJI_FIRST'
 when regexp_matches(token, '^[一-鿿々]$') and n is not null and regexp_matches(n, '^[ぁ-ゖー]+$') and length(n) = 2 then 'KANJI_OKURI' end as feature, token from w)
select feature, count(*) as n, count(distinct token) as words from m where feature is not null group by 1""")
def f01_rule_match(spark, sf):
    t = tokens(spark, sf).withColumnRenamed("token", "midasi")
    m = rules.match_tokens(t, rules.parse(DETECTION), ["doc_id"], ["pos"], ["midasi"])
    return m.where("feature is not null").groupBy("feature").agg(F.count("*").alias("n"), F.count_distinct("midasi").alias("words"))


NOISE = f"""(regexp_matches(raw, '{chars.OBSOLETE}') or regexp_matches(raw, '{chars.PHRASE}+[ぁ-ゖ]{{15,}}|{chars.PHRASE}{{16,}}') or regexp_matches(raw, '(?:^|[^{chars.BEFORE_SMALL}])[ゃゅょ]')
 or regexp_matches(raw, '(?:^|[^ぁ-ゖ])[ぁぃぅぇぉ]|(?:^|[^ァ-ヴ])[ァィゥェォ]'))"""


@query(f"select row_id, {NOISE} as noisy_line from sentences where raw is not null")
def f04_noise_filter(spark, sf):
    return table(spark, sf, "sentences").where("raw is not null").select("row_id", chars.noisy_line(F.col("raw")).alias("noisy_line"))


STOP = ["する", "なる", "ある", "いる", "の", "を", "に", "が", "は", "と", "で", "も"]


@query(f"""select midasi, cast(sum(cnt) as bigint) as cnt from ngram_uni where midasi is not null and midasi not in ({", ".join(f"'{w}'" for w in STOP)}) group by 1 having sum(cnt) >= 3""")
def f15_stopword_anti(spark, sf):
    stop = spark.createDataFrame([(w,) for w in STOP], "midasi string")
    u = table(spark, sf, "ngram_uni").where("midasi is not null").join(F.broadcast(stop), "midasi", "left_anti")
    return u.groupBy("midasi").agg(F.sum("cnt").alias("cnt")).where("cnt >= 3")


#: A malformed word in SQL: {w} the word, {p} its part of speech.
MALFORMED = f"(regexp_matches({{w}}, '{chars.BAD_FIRST}') or regexp_matches({{w}}, '{chars.BAD_LAST}') or (ends_with({{p}}, '名詞') and length({{w}}) = 1) or ({{p}} in ('普通名詞', '副詞', 'ナ形容詞') and (regexp_matches({{w}}, '^[ぁ-ゖ]ー$') or ends_with({{w}}, 'っ'))))"


@query(f"""with {HEAD} select entry_id, head, {MALFORMED.format(w="head", p="coalesce(bunrui, hinsi)")} as bad, coalesce(bunrui, hinsi) in ('普通名詞', '副詞', 'ナ形容詞') and regexp_matches(head, '^[ァ-ヴー]{{1,2}}$') as unsafe from head""")
def f11_bad_words(spark, sf):
    """Malformed headwords, and those that are not safe enough without more evidence."""
    pos = F.coalesce("bunrui", "hinsi")
    return headwords(spark, sf).select("entry_id", "head", chars.bad_word(F.col("head"), pos).alias("bad"), chars.unsafe_word(F.col("head"), pos).alias("unsafe"))


@query(f"""with {HEAD} select head, count(distinct entry_id) as entries, count(distinct hinsi || '/' || coalesce(bunrui, '') || '/' || coalesce(katuyou1, '')) = 1 as safe from head group by 1""")
def f10_safe_homographs(spark, sf):
    """Headwords whose entries all have the same part of speech."""
    tag = F.concat_ws("/", "hinsi", F.coalesce("bunrui", F.lit("")), F.coalesce("katuyou1", F.lit("")))
    return headwords(spark, sf).groupBy("head").agg(F.count_distinct("entry_id").alias("entries"), (F.count_distinct(tag) == 1).alias("safe"))


@query("select status_id, regexp_matches(text, '[ぁ-ゖァ-ヴ]') as japanese from tweets where text is not null")
def f27_japanese_text(spark, sf):
    return table(spark, sf, "tweets").where("text is not null").select("status_id", chars.japanese_text(F.col("text")).alias("japanese"))


@query(f"""with {TOK}, top as (select token from (select token, count(*) as n from tok group by 1 order by n desc, token limit 99)),
g as (select doc_id, avg(grade) as grade from reading_labels where grade is not null group by 1)
select t.token, count(*) as n, round(avg(g.grade), 6) as grade from tok t join g using (doc_id) where t.token not in (select token from top) group by 1 having count(*) >= 2""")
def f20_train_filter(spark, sf):
    """Words of graded documents without the most frequent ones."""
    t = tokens(spark, sf)
    top = t.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(99).select("token")
    g = table(spark, sf, "reading_labels").where("grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    return t.join(g, "doc_id").join(F.broadcast(top), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"), F.round(F.avg("grade"), 6).alias("grade")).where("n >= 2")


@query(f"""with {TOK}, f as (select lang as ftype, token as fname, count(*) as freq from tok where lang is not null group by 1, 2)
select ftype, count(*) as features, count_if(freq >= 5) as kept, cast(sum(freq) as bigint) as mass, round(100.0 * sum(case when freq < 5 then freq else 0 end) / sum(freq), 6) as lost_percent from f group by 1""", "kept")
def f22_feature_threshold(spark, sf):
    f = tokens(spark, sf).where("lang is not null").groupBy(F.col("lang").alias("ftype"), F.col("token").alias("fname")).agg(F.count("*").alias("freq"))
    return f.groupBy("ftype").agg(F.count("*").alias("features"), F.count_if(F.col("freq") >= 5).alias("kept"), F.sum("freq").alias("mass"), F.round(F.lit(100.0) * F.sum(F.when(F.col("freq") < 5, F.col("freq")).otherwise(0)) / F.sum("freq"), 6).alias("lost_percent"))


@query(f"""with {TOK}, {LABELLED}, c as (select lang, token, count(*) as n from named where lang is not null group by 1, 2), s as (select *, n / sum(n) over (partition by lang) as share from c),
l as (select distinct lang from c), p as (select a.lang, l.lang as other, a.n, x.token is null as lacked from s a join l on l.lang <> a.lang left join c x on x.lang = l.lang and x.token = a.token where a.n >= 2 and a.share > 0.00001)
select lang, other, count(*) as distinctive, cast(sum(n) as bigint) as mass from p where lacked group by 1, 2""")
def f25_distinctive(spark, sf):
    """Words of one language that another lacks, with their mass for each pair of languages of the table.

    Spellings of a label count as one. Words are taken for each language
    as a whole, less those it shares with the other: rows grow with the languages that have a word, not with those that lack it.
    """
    c = tokens(spark, sf).select(chars.language(F.col("lang")).alias("lang"), "token").where("lang is not null").groupBy("lang", "token").agg(F.count("*").alias("n"))
    mass = c.groupBy("lang").agg(F.sum("n").alias("mass"))  # a row for each language
    rated = c.join(F.broadcast(mass), "lang").withColumn("counts", F.expr("n >= 2 and n / mass > 0.00001"))
    have = rated.groupBy("token").agg(F.collect_list(F.struct("lang", "n", "counts")).alias("have"))
    held = have.select(F.explode("have").alias("a"), "have").where("a.counts")
    shared = held.select("a.lang", "a.n", F.explode("have.lang").alias("other")).where("other <> lang").groupBy("lang", "other").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    whole = rated.where("counts").groupBy("lang").agg(F.count("*").alias("k_all"), F.sum("n").alias("m_all"))
    pairs = whole.join(F.broadcast(mass.select(F.col("lang").alias("other"))), F.col("lang") != F.col("other")).join(shared, ["lang", "other"], "left")
    lacked = pairs.select("lang", "other", (F.col("k_all") - F.coalesce("k", F.lit(0))).alias("distinctive"), (F.col("m_all") - F.coalesce("m", F.lit(0))).alias("mass"))
    return lacked.where("distinctive > 0")


@query(f"""with {HEAD} select entry_id, head, case when regexp_matches(head, '^[一-鿿々]+$') then 'kanji' when regexp_matches(head, '^[ぁ-ゖ]+$') then 'hiragana'
 when regexp_matches(head, '^[ァ-ヴー・A-Za-z0-9Ａ-Ｚａ-ｚ０-９]+$') then 'katakana' else 'mixed' end as name_type from head""")
def c11_name_type(spark, sf):
    return headwords(spark, sf).select("entry_id", "head", chars.name_type(F.col("head")).alias("name_type"))


@query(f"""with {HEAD} select entry_id, head, translate(head, '{chars.KATAKANA}', '{chars.HIRAGANA}') as reading, not regexp_matches(translate(head, '{chars.KATAKANA}', '{chars.HIRAGANA}'), '^[ぁ-ゖー]+$') as unsure,
 translate(head, '{chars.FULL.replace(chr(39), chr(39) * 2)}', '{chars.HALF.replace(chr(39), chr(39) * 2)}') || '/' || coalesce(yomi, '') as repname from head""")
def c04_reading(spark, sf):
    """Reading and representative name made from the surface."""
    kana, unsure = chars.reading(F.col("head"))
    return headwords(spark, sf).select("entry_id", "head", kana.alias("reading"), unsure.alias("unsure"), chars.repname(F.col("head"), F.col("yomi")).alias("repname"))


@query("""select status_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[A-Za-z0-9./?=_-]+', '', 'g'), '@[A-Za-z0-9_]+', '', 'g'), '#\\S+', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ 　]+', ' ', 'g')) as plain from tweets where text is not null""")
def c25_text_normalise(spark, sf):
    return table(spark, sf, "tweets").where("text is not null").select("status_id", chars.plain_tweet(F.col("text")).alias("plain"))


@query("""select entry_id, map_extract(imis, '代表表記')[1] as repname, string_split(coalesce(map_extract(imis, '代表表記')[1], ''), '/')[1] as surface, coalesce(cardinality(imis), 0) as keys from dictionary""", "keys")
def r02_map_access(spark, sf):
    rep = F.try_element_at("imis", F.lit("代表表記"))
    return table(spark, sf, "dictionary").select("entry_id", rep.alias("repname"), F.element_at(F.split(F.coalesce(rep, F.lit("")), "/"), 1).alias("surface"), F.coalesce(F.cardinality("imis"), F.lit(-1)).alias("k")).select("entry_id", "repname", "surface", F.when(F.col("k") < 0, 0).otherwise(F.col("k")).cast("long").alias("keys"))


@query(f"""with {HEAD} select entry_id, head, case when katuyou1 like 'ナ%' then regexp_replace(head, 'だ$', '') when bunrui = '普通名詞' then head || 'だ' else head end as converted,
 case when katuyou1 like 'ナ%' then '名詞' when bunrui = '普通名詞' then '形容詞' else hinsi end as new_hinsi from head""")
def c21_convert_noun_adjective(spark, sf):
    """Noun to na-adjective and back, with the headword that changes with it."""
    h = headwords(spark, sf)
    na, noun = F.coalesce(F.col("katuyou1").startswith("ナ"), F.lit(False)), F.coalesce(F.col("bunrui") == "普通名詞", F.lit(False))
    return h.select("entry_id", "head", F.when(na, F.regexp_replace("head", "だ$", "")).when(noun, F.concat("head", F.lit("だ"))).otherwise(F.col("head")).alias("converted"), F.when(na, "名詞").when(noun, "形容詞").otherwise(F.col("hinsi")).alias("new_hinsi"))
