"""Dictionary entries, spellings, maps and records as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chars, morphology
from ..operators import storage
from .registry import HEAD, headwords, query, table

_KIND = {"kanji": 1, "hiragana": 2, "katakana": 4, "mixed": 8}
_KIND_SQL = """case when regexp_matches(midasi, '^[一-鿿々]+$') then 1 when regexp_matches(midasi, '^[ぁ-ゖ]+$') then 2 when regexp_matches(midasi, '^[ァ-ヴー・A-Za-z0-9Ａ-Ｚａ-ｚ０-９]+$') then 4 else 8 end"""
#: Suffixes of compounds, and the endings of basic forms by inflection type, as far as stems of entries need them.
HONORIFICS = ("さん", "くん", "ちゃん")
_BASIC = [(k, e) for k, f, e in morphology.inflections() if f == "基本形"]
_BASIC_VALUES = ", ".join(f"('{k}', '{e}')" for k, e in _BASIC)


@query(f"""with s as (select repname, midasi, {_KIND_SQL} as kind, cast(sum(cnt) as bigint) as n from ngram_uni where repname is not null and midasi is not null group by 1, 2), g as (select repname, bit_or(kind) as kinds, arg_max(midasi, n * 1000000 + length(midasi)) filter (kind = 1) as plain, max(n) filter (kind = 1) as top from s group by 1)
select s.repname, s.midasi as suspicious, s.n, cast(g.kinds as bigint) as kinds from s join g using (repname) where s.kind <> 1 and g.top > s.n""", "kinds")
def c12_suspicious_spellings(spark, sf):
    """Spellings of a name by kind as bits; those without ideographs are suspicious where one with them is more frequent."""
    u = table(spark, sf, "ngram_uni").where("repname is not null and midasi is not null")
    kind = F.coalesce(*[F.when(chars.name_type(F.col("midasi")) == k, F.lit(b)) for k, b in _KIND.items()])
    s = u.groupBy("repname", "midasi").agg(F.sum("cnt").alias("n")).withColumn("kind", kind)
    g = s.groupBy("repname").agg(F.bit_or("kind").cast("long").alias("kinds"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("top"))
    return s.join(g, "repname").where("kind <> 1 and top > n").select("repname", F.col("midasi").alias("suspicious"), "n", "kinds")


@query(f"with {HEAD} select entry_id, head || suffix as compound from head, (values {', '.join(f'({chr(39)}{h}{chr(39)})' for h in HONORIFICS)}) s(suffix) where bunrui = '人名'")
def c19_compounds(spark, sf):
    """All surfaces of compounds of a name and a title: combined within the row."""
    d = table(spark, sf, "dictionary").where("bunrui = '人名'")
    parts = F.array(*[F.lit(h) for h in HONORIFICS])
    return d.select("entry_id", F.explode(F.flatten(F.transform(F.map_keys("midasi"), lambda m: F.transform(parts, lambda s: F.concat(m, s))))).alias("compound"))


@query(f"""with b(k, e) as (values {_BASIC_VALUES}), f as (select map_extract(annotation, 'stem')[1] as stem, hinsi, bunrui, katuyou1, count(*) as n from dictionary where map_extract(annotation, 'stem')[1] is not null group by 1, 2, 3, 4)
select stem, hinsi, coalesce(bunrui, case when hinsi = '名詞' then '普通名詞' end) as bunrui, katuyou1, stem || coalesce(e, '') as midasi, translate(stem || coalesce(e, ''), '{chars.KATAKANA}', '{chars.HIRAGANA}') as yomi, hinsi = '名詞' as watched, n from f left join b on k = katuyou1""")
def c20_entries_of_stems(spark, sf):
    """Found stems as entries with the default attributes of their part of speech; nouns are watched for their kind."""
    d = table(spark, sf, "dictionary").withColumn("stem", F.try_element_at("annotation", F.lit("stem"))).where("stem is not null")
    f = d.groupBy("stem", "hinsi", "bunrui", "katuyou1").agg(F.count("*").alias("n"))
    b = spark.createDataFrame(_BASIC, "katuyou1 string, e string")
    midasi = F.concat("stem", F.coalesce("e", F.lit("")))
    j = f.join(F.broadcast(b), "katuyou1", "left")
    return j.select("stem", "hinsi", F.coalesce("bunrui", F.when(F.col("hinsi") == "名詞", "普通名詞")).alias("bunrui"), "katuyou1", midasi.alias("midasi"), chars.hiragana(midasi).alias("yomi"), (F.col("hinsi") == "名詞").alias("watched"), "n")


@query(f"""with {HEAD} select entry_id, head as midasi, coalesce(yomi, translate(head, '{chars.KATAKANA}', '{chars.HIRAGANA}')) as yomi, head as genkei, hinsi, coalesce(bunrui, '*') as bunrui, coalesce(katuyou1, '*') as katuyou1, case when katuyou1 is null then '*' else '基本形' end as katuyou2, coalesce(map_extract(imis, '代表表記')[1], head || '/' || coalesce(yomi, '')) as repname from head""")
def c22_entry_as_morpheme(spark, sf):
    """Entries as records of an analysis in their basic form."""
    h = headwords(spark, sf)
    return h.select("entry_id", F.col("head").alias("midasi"), F.coalesce("yomi", chars.hiragana(F.col("head"))).alias("yomi"), F.col("head").alias("genkei"), "hinsi", F.coalesce("bunrui", F.lit("*")).alias("bunrui"), F.coalesce("katuyou1", F.lit("*")).alias("katuyou1"), F.when(F.col("katuyou1").isNull(), "*").otherwise("基本形").alias("katuyou2"), morphology.representative(F.col("imis"), F.col("head"), F.col("yomi")).alias("repname"))


@query("""select entry_id, array_to_string(list_sort(list_filter(list_concat(coalesce(map_keys(imis), []), ['既知語帰着']), lambda k: k <> '自動獲得')), ' ') as keys, coalesce(cast(map_extract(annotation, 'count')[1] as bigint), 0) as cnt from dictionary""")
def c23_copied_information(spark, sf):
    """An entry's information copied to another: one mark is left out, one is added."""
    d = table(spark, sf, "dictionary")
    copied = F.map_concat(F.map_filter(F.coalesce("imis", F.create_map().cast("map<string,string>")), lambda k, v: k != "自動獲得"), F.create_map(F.lit("既知語帰着"), F.lit("表記")))
    return d.select("entry_id", F.array_join(F.array_sort(F.map_keys(copied)), " ").alias("keys"), F.coalesce(F.try_element_at("annotation", F.lit("count")).cast("long"), F.lit(0).cast("long")).alias("cnt"))


@query("""with w as (select distinct status_id, screen_name, word from (select status_id, screen_name, unnest(regexp_extract_all(text, '[ァ-ヴー]{3,}')) as word from tweets where text is not null and kind = 'mention'))
select status_id, '@' || screen_name || ' ' || string_agg(word, '、' order by word) as reply from w group by status_id, screen_name""")
def c26_replies(spark, sf):
    """Answers to mentions: the distinct katakana words of a status in one line."""
    t = table(spark, sf, "tweets").where("text is not null and kind = 'mention'").select("status_id", "screen_name", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[ァ-ヴー]{3,}"), F.lit(0)))).alias("w")).where(F.size("w") > 0)
    return t.select("status_id", F.concat(F.lit("@"), F.col("screen_name"), F.lit(" "), F.array_join("w", "、")).alias("reply")).distinct()


@query("""select user_id, slot, max(event_id) as event_id from (select user_id, cast(event_id % 10 as int) as slot, event_id from events where event_type <> 'error') group by 1, 2""")
def r01_list_with_holes(spark, sf):
    """A list of ten places for each user: inserted at a place, some left empty, gone through without the holes."""
    e = table(spark, sf, "events").where("event_type <> 'error'").withColumn("slot", (F.col("event_id") % 10).cast("int"))
    last = e.groupBy("user_id", "slot").agg(F.max("event_id").alias("event_id"))
    m = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "event_id"))).alias("m"))  # at most ten
    holes = m.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.try_element_at("m", i)).alias("a"))
    return holes.select("user_id", F.posexplode("a").alias("slot", "event_id")).where("event_id is not null")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, event_type || ':' || cast(json_extract(props, '$.k') as bigint) as again from events where props is not null", "k")
def r05_json(spark, sf):
    """JSON read into columns, written as JSON and read again."""
    e = table(spark, sf, "events").where("props is not null").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    back = e.withColumn("j", F.to_json(F.struct("event_type", F.col("p.k").alias("k")))).withColumn("b", F.from_json("j", "event_type string, k bigint"))
    return back.select("event_id", F.col("p.k").alias("k"), F.concat_ws(":", "b.event_type", F.col("b.k").cast("string")).alias("again"))


@query("""select repname, cast(sum(case when word_class = '<普通名詞>' then cnt else 0 end) as bigint) as common, cast(sum(case when word_class = '<固有名詞>' then cnt else 0 end) as bigint) as named from ngram_uni where repname is not null group by 1
having sum(case when word_class = '<普通名詞>' then cnt else 0 end) > 0 and sum(case when word_class = '<固有名詞>' then cnt else 0 end) > 0""")
def cf13_common_names(spark, sf):
    """Names that are common nouns as well: often tagged as entities by mistake."""
    n = lambda c: F.sum(F.when(F.col("word_class") == c, F.col("cnt")).otherwise(0))
    return table(spark, sf, "ngram_uni").where("repname is not null").groupBy("repname").agg(n("<普通名詞>").alias("common"), n("<固有名詞>").alias("named")).where("common > 0 and named > 0")


@query("""with d as (select midasi as term, document_id, sum(cnt) as tf from ngram_uni where midasi is not null group by 1, 2), b as (select w1.midasi as term, document_id, sum(cnt) as tf from ngram_fbi where w1.midasi is not null group by 1, 2)
select 'word' as kind, term, cast(sum(tf) as bigint) as tf, count(document_id) as df from d group by 2 union all select 'first', term, cast(sum(tf) as bigint), count(document_id) from b group by 2""")
def a16_two_inputs(spark, sf):
    """Term and document frequency from two kinds of input by one rule."""
    def count(rows, kind):
        per = rows.groupBy("term", "document_id").agg(F.sum("cnt").alias("n"))
        return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("document_id").alias("df")).select(F.lit(kind).alias("kind"), "term", "tf", "df")

    u = table(spark, sf, "ngram_uni").where("midasi is not null").select(F.col("midasi").alias("term"), "document_id", "cnt")
    b = table(spark, sf, "ngram_fbi").where("w1.midasi is not null").select(F.col("w1.midasi").alias("term"), "document_id", "cnt")
    return count(u, "word").unionByName(count(b, "first"))


@query("select domain, doc_id from (select domain, doc_id, row_number() over (partition by domain order by loaded_at desc nulls last, doc_id desc) as r from documents where domain is not null) where r = 1")
def s13_last_in(spark, sf):
    """What a holder that gives the last one first would give next, for each domain."""
    d = table(spark, sf, "documents").where("domain is not null")
    return d.groupBy("domain").agg(F.max_by("doc_id", F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")), F.col("doc_id"))).alias("doc_id"))


@query("select event_type, day, cast(sum(n) over (partition by event_type order by day) as bigint) as so_far from (select event_type, cast(date_trunc('day', ts) as date) as day, count(*) as n from events group by 1, 2)")
def k14_curve(spark, sf):
    """The rows of a curve: how many there have been by the end of each day."""
    from pyspark.sql import Window as W

    n = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return n.withColumn("so_far", F.sum("n").over(W.partitionBy("event_type").orderBy("day"))).drop("n")  # a row for each day


@query(f"""with {HEAD}, a as (select distinct head, 'auto' as d from head where dict_name = 'auto' union select distinct head, 'web' from head where dict_name = 'web') select head, string_agg(d, '+' order by d) as dictionaries, row_number() over (order by head) as line from a group by head""")
def k13_judging_rows(spark, sf):
    """The rows of a report for judges: each headword with where it is from, numbered."""
    h = headwords(spark, sf).where("dict_name in ('auto', 'web')").groupBy("head").agg(F.array_join(F.array_sort(F.collect_set("dict_name")), "+").alias("dictionaries"))
    return storage.row_index(h, ["head"], "line")
