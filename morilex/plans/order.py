"""Orders, shuffles, choices and limits as queries. Random orders are orders of a seeded digest: the same everywhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import instances, storage
from .registry import HEAD, headwords, query, table

_UNI = "select midasi, repname, word_class, document_id, cnt from ngram_uni where midasi is not null"


def words(spark, sf):
    return table(spark, sf, "ngram_uni").where("midasi is not null")


@query("select midasi as suffix, row_number() over (order by midasi) as rank from (select distinct midasi from ngram_uni where regexp_matches(midasi, '^[ぁ-ゖ]+$'))")
def t01_by_code_point(spark, sf):
    """Kana words in the order of their code points, numbered without a window over all rows."""
    s = words(spark, sf).where(F.col("midasi").rlike("^[ぁ-ゖ]+$")).select(F.col("midasi").alias("suffix")).distinct()
    return storage.row_index(s, ["suffix"], "rank")


@query("select repname, df, row_number() over (order by df desc, repname) as rank from (select repname, count(distinct document_id) as df from ngram_uni where repname is not null group by 1)")
def t02_by_document_frequency(spark, sf):
    d = table(spark, sf, "ngram_uni").where("repname is not null").groupBy("repname").agg(F.count_distinct("document_id").alias("df"))
    return storage.row_index(d, [F.desc("df"), "repname"], "rank")


@query("""select w1.midasi as word, arg_min(w2.midasi, length(w2.midasi) * 1000000 + rk) as shortest, min(length(w2.midasi)) as size
from ngram_fbi join (select midasi as m, row_number() over (order by midasi) as rk from (select distinct w2.midasi as midasi from ngram_fbi where w2.midasi is not null)) on m = w2.midasi where w1.midasi is not null group by 1""", "size")
def t04_shortest_rear(spark, sf):
    """The shortest word that follows each word, among equals the first by code point."""
    b = table(spark, sf, "ngram_fbi").where("w1.midasi is not null and w2.midasi is not null").select(F.col("w1.midasi").alias("word"), F.col("w2.midasi").alias("rear"))
    return b.groupBy("word").agg(F.min_by("rear", F.struct(F.length("rear"), F.col("rear"))).alias("shortest"), F.min(F.length("rear")).cast("long").alias("size"))


@query("select doc_id, row_number() over (order by md5('9-' || doc_id), doc_id) as place from documents")
def t09_shuffle(spark, sf):
    """Rows in a random order, by a distributed sort on a seeded digest."""
    return instances.shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 9).select("doc_id", "place")


@query("""with b as (select doc_id, (row_number() over (order by doc_id) - 1) // 200 as block from documents), s as (select doc_id, block, row_number() over (partition by block order by md5('10-' || doc_id), doc_id) as within from b)
select doc_id, block, row_number() over (order by within, md5('10-' || block), block) as place from s""", "block")
def t10_block_shuffle(spark, sf):
    """Blocks of rows shuffled within themselves and interleaved at random: what fits in memory at a time is a block."""
    return instances.block_shuffled(table(spark, sf, "documents").select("doc_id"), "doc_id", 200, 10)


@query(f"with {HEAD} select head, arg_min(hinsi, md5('11-' || head || '-' || hinsi)) as chosen, count(distinct hinsi) as choices from head where hinsi is not null group by 1")
def t11_random_choice(spark, sf):
    """One of the parts of speech of each headword, at random but always the same one."""
    h = headwords(spark, sf).where("hinsi is not null")
    return h.groupBy("head").agg(F.min_by("hinsi", F.md5(F.concat_ws("-", F.lit("11"), "head", "hinsi"))).alias("chosen"), F.count_distinct("hinsi").alias("choices"))


@query("""with v as (select dict_name, dict_version from dictionary group by all order by all limit 5) select dict_name, dict_version, hinsi, count(*) as entries from dictionary join v using (dict_name, dict_version) group by 1, 2, 3""")
def t13_first_dictionaries(spark, sf):
    """The first five dictionaries by name and version merged: the limit is on dictionaries, not on rows."""
    d = table(spark, sf, "dictionary")
    first = d.select("dict_name", "dict_version").distinct().orderBy("dict_name", "dict_version").limit(5)
    return d.join(F.broadcast(first), ["dict_name", "dict_version"], "left_semi").groupBy("dict_name", "dict_version", "hinsi").agg(F.count("*").alias("entries"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 100")
def t14_newest(spark, sf):
    """The hundred newest records; each task keeps a hundred."""
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type")


@query("select epoch, vec_id, row_number() over (partition by epoch order by md5(epoch || '-' || vec_id), vec_id) as place from embeddings, (values (1), (2)) e(epoch)", "epoch")
def t16_epochs(spark, sf):
    """Two passes over the instances, each in its own random order."""
    e = table(spark, sf, "embeddings").select("vec_id")
    first, second = (instances.shuffled(e, "vec_id", k).withColumn("epoch", F.lit(k).cast("long")) for k in (1, 2))
    return first.unionByName(second).select("epoch", "vec_id", "place")


@query(f"select n.midasi, n.cnt, row_number() over (order by n.midasi) - 1 as new_id from (select midasi, cast(sum(cnt) as bigint) as cnt from ({_UNI}) group by 1 having sum(cnt) >= 2) n")
def a37_compacted_vocabulary(spark, sf):
    """Only words that are used keep an id; ids are dense again."""
    used = words(spark, sf).groupBy("midasi").agg(F.sum("cnt").alias("cnt")).where("cnt >= 2")
    return storage.row_index(used, ["midasi"], "new_id").withColumn("new_id", F.col("new_id") - 1)


@query("""select document_id, row_number() over (order by split_part(document_id, '-', 1), cast(split_part(document_id, '-', 2) as int), crawled_at, doc_id) as place, doc_id from documents where document_id is not null""")
def proj17_by_parts_of_id(spark, sf):
    """Documents in the order of the parts of their id."""
    d = table(spark, sf, "documents").where("document_id is not null").select("doc_id", "document_id", "crawled_at", F.split_part("document_id", F.lit("-"), F.lit(1)).alias("a"), F.split_part("document_id", F.lit("-"), F.lit(2)).cast("int").alias("b"))
    return storage.row_index(d, ["a", "b", F.asc_nulls_last("crawled_at"), "doc_id"], "place").select("document_id", "place", "doc_id")
