"""What is written and read again - stores, versions, models, instances - and functions on words, as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chars, kana, morphology
from ..operators import acquire, dictionaries, instances, learn, storage
from ..sources import stores
from .evaluate import _VEC
from .models import means
from .registry import HEAD, TOK, headwords, query, table, tokens

_FORMS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in morphology.inflections())
_POS = ("母音動詞", "子音動詞カ行", "子音動詞サ行", "サ変動詞", "イ形容詞", "普通名詞")


def _counts(spark, sf):
    return table(spark, sf, "ngram_uni").where("midasi is not null").groupBy("midasi").agg(F.sum("cnt").alias("cnt"), F.count_distinct("document_id").alias("docs"))


_COUNTS = "select midasi, cast(sum(cnt) as bigint) as cnt, count(distinct document_id) as docs from ngram_uni where midasi is not null group by 1"


@query(f"with {TOK}, c as ({_COUNTS}), t as (select distinct token from tok) select token as midasi, cnt, docs from t join c on c.midasi = t.token")
def s19_store_lookup(spark, sf):
    """Words of documents looked up in a compressed key-value store of counts."""
    path = storage.scratch(spark, "store")
    stores.write_store(_counts(spark, sf), "midasi", path)
    keys = tokens(spark, sf).select(F.col("token").alias("midasi")).distinct()
    return stores.look_up(keys, "midasi", path).select("midasi", "cnt", "docs")


@query(f"with c as ({_COUNTS}) select length(midasi) as size, count(*) as keys, cast(sum(cnt) as bigint) as cnt from c group by 1", "size")
def s20_store_scan(spark, sf):
    """A key-value store opened and read as a whole."""
    path = storage.scratch(spark, "store")
    stores.write_store(_counts(spark, sf), "midasi", path)
    return stores.read_store(spark, path).groupBy(F.length("midasi").cast("long").alias("size")).agg(F.count("*").alias("keys"), F.sum("cnt").alias("cnt"))


@query(f"""with {HEAD} select head as stem, hinsi as pos_s, count(*) as cnt from head where dict_name in ('main', 'auto') group by 1, 2, dict_name""")
def k02_appended_dictionary(spark, sf):
    """A dictionary written, then another appended: readers see the newest complete version."""
    h = headwords(spark, sf).groupBy(F.col("head").alias("stem"), F.col("hinsi").alias("pos_s"), "dict_name").agg(F.count("*").alias("cnt"))
    path = storage.scratch(spark, "dictionary")
    dictionaries.publish(h.where("dict_name = 'main'").drop("dict_name"), path)
    dictionaries.append(h.where("dict_name = 'auto'").drop("dict_name"), path)
    return dictionaries.current(spark, path)


@query(f"""with {HEAD}, v as (select head, min(dict_version) as version from head where dict_name = 'web' group by 1) select version, count(*) as added, cast(sum(count(*)) over (order by version) as bigint) as entries from v group by 1""")
def k07_published_versions(spark, sf):
    """A dictionary published version by version, each with what is new in it; how many entries a reader of each one sees."""
    v = headwords(spark, sf).where("dict_name = 'web'").groupBy("head").agg(F.min("dict_version").alias("version"))
    path, out = storage.scratch(spark, "versions"), None
    for k in sorted(r[0] for r in v.select("version").distinct().collect()):  # a handful of versions
        new = v.where(F.col("version") == k)
        n = dictionaries.append(new, path) if dictionaries.versions(spark, path) else dictionaries.publish(new, path)
        one = spark.read.parquet(f"{path}/version={n}").agg(F.count_if(F.col("version") == k).alias("added"), F.count("*").alias("entries")).select(F.lit(k).cast("int").alias("version"), "added", "entries")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "version int, added long, entries long")


@query("""with c as (select user_id, event_type, count(*) as n from events group by 1, 2), t as (select event_type, row_number() over (order by event_type) as fid from (select distinct event_type from events))
select user_id || chr(9) || 'x' || chr(9) || 'events' || chr(9) || string_agg(fid || ':' || n || '.0', ' ' order by fid) as value from c join t using (event_type) group by user_id""")
def k10_instance_lines(spark, sf):
    """Instances in their text form."""
    e = table(spark, sf, "events")
    ids = storage.row_index(e.select("event_type").distinct(), ["event_type"], "fid")
    c = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(F.broadcast(ids), "event_type")  # a handful of types
    g = c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("fid", F.col("n").cast("double").alias("v")))).alias("feats"))
    return instances.feature_lines(g.withColumns({"label": F.lit("x"), "origin": F.lit("events")}), "user_id", "label", "origin", "feats")


@query(f"with {_VEC} select class_id, cast(fid as int) as fid, round(weight, 6) as weight from c")
def k11_kept_model(spark, sf):
    """A model written and read again."""
    path = storage.scratch(spark, "model")
    learn.save_model(means(spark, sf).select(F.col("class_id").cast("int"), F.col("fid").cast("int"), "weight"), path)
    return learn.load_model(spark, path).select("class_id", "fid", F.round("weight", 6).alias("weight"))


@query(f"""with f(k, form, ending) as (values {_FORMS}), s as (select distinct map_extract(annotation, 'stem')[1] as stem, katuyou1 from dictionary where map_extract(annotation, 'stem')[1] is not null) select stem, katuyou1, stem || coalesce(ending, '') as genkei from s left join f on f.k = katuyou1 and form = '基本形'""")
def c01_dictionary_forms(spark, sf):
    s = table(spark, sf, "dictionary").select(F.try_element_at("annotation", F.lit("stem")).alias("stem"), "katuyou1").where("stem is not null").distinct()
    return morphology.dictionary_form(s, "stem", "katuyou1").select("stem", "katuyou1", "genkei")


@query(f"""with {HEAD}, f(k, form, ending) as (values {_FORMS}), h as (select distinct head, katuyou1 from head), j as (select head, katuyou1, coalesce(ending, '') as e from h left join f on f.k = katuyou1 and form = '基本形')
select head, katuyou1, case when ends_with(head, e) then substr(head, 1, length(head) - length(e)) else head end as stem, case when ends_with(head, e) then e else '' end as ending from j""")
def c03_stems_and_endings(spark, sf):
    """Headwords in their basic form taken apart into stem and ending."""
    h = headwords(spark, sf).select("head", "katuyou1").distinct().withColumn("form", F.lit("基本形"))
    return morphology.stem_and_ending(h, "head", "katuyou1", "form").select("head", "katuyou1", "stem", "ending")


@query(f"""with {HEAD} select distinct head, translate(substr(head, 1, 1), 'がぎぐげござじずぜぞだぢづでどばびぶべぼガギグゲゴザジズゼゾダヂヅデドバビブベボ', 'かきくけこさしすせそたちつてとはひふへほカキクケコサシスセソタチツテトハヒフヘホ') || substr(head, 2) as plain from head""")
def c10_unvoiced(spark, sf):
    """Headwords as second elements of compounds with the voicing of their first kana undone."""
    return headwords(spark, sf).select("head", chars.unvoice(F.col("head"), F.lit("濁音化")).alias("plain")).distinct()


@query(rf"""with {HEAD} select distinct head, regexp_matches(head, '^[{kana.two_byte_class()}]+$') as convertible from head""")
def c13_convertible(spark, sf):
    """Whether the two-byte character set holds a headword."""
    return headwords(spark, sf).select("head", kana.euc_convertible_column(F.col("head")).alias("convertible")).distinct()


_ROMAN = ", ".join(f"('{k}', '{v}')" for k, v in kana.roman_table().items())


@query(f"""with m(k, r) as (values {_ROMAN}), w as (select distinct yomi from dictionary where yomi is not null and not regexp_matches(yomi, '[ー～〜]')), c as (select yomi, unnest(range(1, length(yomi) + 1)) as i from w)
select yomi, string_agg(coalesce(r, substr(yomi, cast(i as int), 1)), '' order by i) as roman from c left join m on k = substr(yomi, cast(i as int), 1) group by 1""")
def c14_romanised(spark, sf):
    """Readings without a long mark in letters; a long mark would repeat the vowel before it."""
    d = table(spark, sf, "dictionary").select("yomi").where(F.col("yomi").isNotNull() & ~F.col("yomi").rlike("[ー～〜]")).distinct()
    return d.where("yomi <> ''").select("yomi", kana.romanize_udf("yomi").alias("roman"))


@query(f"""with {HEAD}, h as (select distinct head from head), e as (select head, substr(head, length(head)) as c, translate(substr(head, length(head)), '{chars.KATAKANA}', '{chars.HIRAGANA}') as hira from h)
select head, pos_s, case pos_s when '母音動詞' then not regexp_matches(c, '[ぁ-ゖァ-ヶー]') or regexp_matches(hira, '[{chars.IE_COLUMN}]') when 'サ変動詞' then regexp_matches(head, '^[一-鿿]$') when 'イ形容詞' then not regexp_matches(c, '[っんッン]') when '子音動詞カ行' then not regexp_matches(c, '[っんッンー]') else true end as allowed
from e, (values {', '.join(f"('{p}')" for p in _POS)}) p(pos_s)""")
def f07_stem_constraints(spark, sf):
    """Whether a headword taken as a stem may belong to each of some parts of speech."""
    h = headwords(spark, sf).select("head").distinct()
    return reduce(DataFrame.unionByName, [h.select("head", F.lit(p).alias("pos_s"), chars.stem_allowed(F.col("head"), p).alias("allowed")) for p in _POS])


@query(f"""with {HEAD}, t as (select distinct head, hinsi, bunrui, katuyou1 from head) select a.head, a.hinsi as h1, a.bunrui as b1, a.katuyou1 as k1, b.hinsi as h2, b.bunrui as b2, b.katuyou1 as k2,
 ((a.hinsi = '名詞' or coalesce(starts_with(a.katuyou1, 'ナ'), false)) and (b.hinsi = '名詞' or coalesce(starts_with(b.katuyou1, 'ナ'), false))) or (coalesce(starts_with(a.katuyou1, 'イ形容詞'), false) and coalesce(starts_with(b.katuyou1, 'イ形容詞'), false))
 or (a.hinsi = b.hinsi and a.bunrui is not distinct from b.bunrui and a.katuyou1 is not distinct from b.katuyou1) as consistent
from t a join t b on a.head = b.head and (a.hinsi, coalesce(a.bunrui, ''), coalesce(a.katuyou1, '')) < (b.hinsi, coalesce(b.bunrui, ''), coalesce(b.katuyou1, ''))""")
def f09_consistent_homographs(spark, sf):
    """Homographs of a headword and whether they agree in part of speech; a headword has a handful of kinds."""
    t = headwords(spark, sf).select("head", "hinsi", "bunrui", "katuyou1").distinct()
    side = lambda n: t.select("head", F.col("hinsi").alias(f"h{n}"), F.col("bunrui").alias(f"b{n}"), F.col("katuyou1").alias(f"k{n}"))
    key = lambda n: F.struct(F.col(f"h{n}"), F.coalesce(f"b{n}", F.lit("")), F.coalesce(f"k{n}", F.lit("")))
    j = side(1).join(side(2), "head").where(key(1) < key(2))
    return j.withColumn("consistent", chars.pos_consistent(*[F.col(f"{c}{n}") for n in (1, 2) for c in "hbk"]))


@query(f"""with {HEAD}, p as (select distinct head as stem, case when hinsi = '動詞' and (katuyou1 in ('母音動詞', 'サ変動詞', 'ザ変動詞') or starts_with(katuyou1, '子音動詞')) then katuyou1 when hinsi = '形容詞' and starts_with(katuyou1, 'イ形容詞') then 'イ形容詞' when hinsi = '形容詞' and starts_with(katuyou1, 'ナ') then 'ナ形容詞'
 when hinsi = '名詞' and coalesce(bunrui, '') not in ('数詞', '形式名詞', '副詞的名詞', '時相名詞') then '普通名詞' when hinsi = '副詞' then '副詞' end as pos_s from head), q as (select * from p where pos_s is not null)
select stem, case when count(*) = 1 then any_value(pos_s) when bool_or(pos_s = '普通名詞') and bool_and(pos_s in ('普通名詞', 'ナ形容詞', '母音動詞', '副詞')) then '普通名詞' end as chosen from q group by 1
having count(*) = 1 or (bool_or(pos_s = '普通名詞') and bool_and(pos_s in ('普通名詞', 'ナ形容詞', '母音動詞', '副詞')))""")
def a27_one_part_of_speech(spark, sf):
    """One part of speech for each word: the only one, or the one that includes all others."""
    p = headwords(spark, sf).select(F.col("head").alias("stem"), chars.pos_name(F.col("hinsi"), F.col("bunrui"), F.col("katuyou1")).alias("pos_s")).where("pos_s is not null").distinct()
    return acquire.reduce_pos(p).select("stem", F.col("pos_s").alias("chosen"))
