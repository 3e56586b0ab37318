"""What follows the registration of a word: used examples go, longer entries are tried again, events are logged."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import acquire, dictionaries, lookup
from .acquire import suffixes
from .lexicon import _STEMS, _SUFFIX_VALUES
from .matches import STOK, sentence_tokens
from .filters import MALFORMED
from .registry import HEAD, headwords, query, table

_KATA = "^[ァ-ヴー]+$"


@query(rf"""with {STOK}, e as (select row_id, pos, token as word from stok where regexp_matches(token, '{_KATA}')), reg as (select word from e group by 1 having count(*) >= 5)
select row_id, pos, word from e where not exists (select 1 from reg where contains(e.word, reg.word))""")
def st08_examples_left(spark, sf):
    """Examples that are left when words with five and more are registered: theirs go, and those of words that contain one."""
    e = sentence_tokens(spark, sf).where(F.col("token").rlike(_KATA)).select("row_id", "pos", F.col("token").alias("word"))
    per = e.groupBy("word").agg(F.count("*").alias("n"))
    registered = per.where("n >= 5").select(F.col("word").alias("short"))
    longer = lookup.contained_in(registered, "short", per, "word").select("word")
    gone = registered.select(F.col("short").alias("word")).unionByName(longer).distinct()
    return e.join(gone, "word", "left_anti").select("row_id", "pos", "word")


@query(f"""with {HEAD}, w as (select distinct head as w from head where length(head) > 0), n as (select distinct head as short from head where dict_name = 'auto' and length(head) >= 2)
select distinct w.w as longer, n.short from w join n on (starts_with(w.w, n.short) and substr(w.w, length(n.short) + 1) in (select w from w)) or (ends_with(w.w, n.short) and substr(w.w, 1, length(w.w) - length(n.short)) in (select w from w)) where w.w <> n.short""")
def st09_longer_entries(spark, sf):
    """Longer entries that a newly acquired word and another entry make up: they are deleted afterwards."""
    w = headwords(spark, sf).select(F.col("head").alias("w")).where(F.length("w") > 0).distinct()
    new = headwords(spark, sf).where((F.col("dict_name") == "auto") & (F.length("head") >= 2)).select("head").distinct()
    halves = acquire.halves(w, "w")
    known = w.withColumnRenamed("w", "k")
    left = halves.join(new.withColumnRenamed("head", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi").select(F.col("w").alias("longer"), F.col("a").alias("short"))
    right = halves.join(new.withColumnRenamed("head", "b"), "b", "left_semi").join(known.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("w").alias("longer"), F.col("b").alias("short"))
    return left.unionByName(right).distinct()


@query(f"""with {_STEMS}, s(suffix) as (values {_SUFFIX_VALUES}), f as (select stem, hinsi, sum(coalesce(cnt, 0)) as cnt from st where stem is not null and dict_name <> 'main' group by 1, 2), kn as (select distinct stem, hinsi from st where dict_name = 'main' and stem is not null),
o as (select stem, hinsi, cnt, case when exists (select 1 from kn where kn.stem = f.stem and kn.hinsi = f.hinsi) then 'known' when length(stem) <= 5 and stem in (select suffix from s) then 'function word'
 when {MALFORMED.format(w='stem', p='hinsi')} then 'malformed' else 'registered' end as outcome from f)
select 'example' as event, stem, hinsi, cast(cnt as bigint) as n from o union all select case when outcome = 'registered' then 'append' else 'reject: ' || outcome end, stem, hinsi, 1 from o union all select 'delete examples', stem, hinsi, cast(cnt as bigint) from o where cnt > 0""")
def st13_event_log(spark, sf):
    """The events of registering found words, as rows: examples seen, the entry appended or why not, examples deleted."""
    e = dictionaries.stems(table(spark, sf, "dictionary")).where("stem is not null")
    known = e.where("dict_name = 'main'").select("stem", F.col("hinsi").alias("pos_s"))
    found = e.where("dict_name <> 'main'").groupBy("stem", F.col("hinsi").alias("pos_s")).agg(F.sum(F.coalesce(F.try_element_at("annotation", F.lit("count")).cast("long"), F.lit(0).cast("long"))).alias("cnt"))
    return dictionaries.event_log(dictionaries.register(found, known, suffixes(spark))).select("event", "stem", F.col("pos_s").alias("hinsi"), "n")


@query(f"""with {HEAD}, k as (select distinct head from head) select head as stem, hinsi, count(*) as n from head where dict_name = 'web' and length(head) >= 2 and not (length(head) = 2 and hinsi = '名詞' and regexp_matches(head, '^[一-鿿々]+$'))
 and not exists (select 1 from range(1, 200) r(i) where i < length(head) and substr(head, 1, cast(i as int)) in (select head from k) and substr(head, cast(i as int) + 1) in (select head from k)) group by 1, 2""")
def st10_not_decomposable(spark, sf):
    """Words of the web dictionary that are not two known words put together; two ideographs are always kept apart."""
    h = headwords(spark, sf)
    web = h.where((F.col("dict_name") == "web") & (F.length("head") >= 2)).groupBy(F.col("head").alias("stem"), "hinsi").agg(F.count("*").alias("n"))
    web = web.where(~((F.length("stem") == 2) & (F.col("hinsi") == "名詞") & F.col("stem").rlike("^[一-鿿々]+$")))
    return web.join(acquire.decomposable(web.select("stem").distinct(), h.select(F.col("head").alias("stem"))), "stem", "left_anti")
