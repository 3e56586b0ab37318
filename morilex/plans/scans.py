"""Sources, sinks, projections, sequence windows and set operations as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars
from ..operators import storage
from .registry import HEAD, TOK, headwords, query, table, tokens


@query(r"select regexp_extract(url, '^(?:https?://)?([^/]+)', 1) as host, count(*) as pages from documents where url is not null group by 1")
def s04_domain_pages(spark, sf):
    d = table(spark, sf, "documents").where("url is not null")
    return d.groupBy(chars.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query(r"""select doc_id, count(*) as lines, count_if(trim(replace(line, chr(13), '')) <> '') as filled, max(length(line)) as longest
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null) group by doc_id""", "filled")
def s05_lines(spark, sf):
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.trim(F.replace("line", F.lit("\r"), F.lit(""))) != "").alias("filled"), F.max(F.length("line")).cast("long").alias("longest"))


@query("""select row_id, document_id, last_value(noisy ignore nulls) over (partition by document_id order by sent_id, row_id rows between unbounded preceding and current row) as noisy_so_far
from sentences where document_id is not null""")
def s06_running_header(spark, sf):
    """A mark of an earlier line carried to the lines that follow it, within each document."""
    w = W.partitionBy("document_id").orderBy("sent_id", "row_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf, "sentences").where("document_id is not null").select("row_id", "document_id", F.last("noisy", ignorenulls=True).over(w).alias("noisy_so_far"))


@query("""select 'documents' as pool, count(*) as texts, sum(length(text)) as chars from documents where text is not null
union all select 'sentences', count(*), sum(length(raw)) from sentences where raw is not null
union all select 'tweets', count(*), sum(length(text)) from tweets where text is not null""", "chars")
def s12_mixed_sources(spark, sf):
    pools = [table(spark, sf, t).select(F.lit(t).alias("pool"), F.col(c).alias("text")) for t, c in (("documents", "text"), ("sentences", "raw"), ("tweets", "text"))]
    both = pools[0].unionByName(pools[1]).unionByName(pools[2]).where("text is not null")
    return both.groupBy("pool").agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))


@query("select shard_id, count(*) as n_rows, cast(sum(cnt) as bigint) as cnt from ngram_uni where shard_id between 1 and 5 group by 1")
def s18_shard_range(spark, sf):
    return table(spark, sf, "ngram_uni").where("shard_id between 1 and 5").groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.sum("cnt").alias("cnt"))


@query(f"""with {HEAD} select head, count(*) as entries, count(distinct hinsi) as parts, min(entry_id) as first_entry from head group by head""")
def k05_static_dictionary(spark, sf):
    """The look-up table of a dictionary: one row for each headword."""
    return headwords(spark, sf).groupBy("head").agg(F.count("*").alias("entries"), F.count_distinct("hinsi").alias("parts"), F.min("entry_id").alias("first_entry"))


@query("""select (rn - 1) % 10 as shard, count(*) as docs, sum(n_chars) as chars from (select n_chars, row_number() over (order by doc_id) as rn from documents) group by 1""", "chars")
def k15_round_robin_shards(spark, sf):
    """Row i of the order goes to shard i mod 10; the row number needs no single task."""
    d = storage.row_index(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"], "rn")
    return d.groupBy(((F.col("rn") - 1) % 10).alias("shard")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query(f"""with {HEAD}, u as (select head as token, count(*) as cnt from head where dict_name = 'web' group by 1)
select token in (select head from head where dict_name = 'main') as known, count(*) as words, sum(cnt) as cnt from u group by 1""", "cnt")
def k17_route_by_list(spark, sf):
    """Words of the corpus routed by the headword list: a semi and an anti join."""
    all_heads = headwords(spark, sf).select("dict_name", F.col("head").alias("token"))
    u = all_heads.where("dict_name = 'web'").groupBy("token").agg(F.count("*").alias("cnt"))
    h = all_heads.where("dict_name = 'main'").select("token").distinct()
    both = u.join(h, "token", "left_semi").withColumn("known", F.lit(True)).unionByName(u.join(h, "token", "left_anti").withColumn("known", F.lit(False)))
    return both.groupBy("known").agg(F.count("*").alias("words"), F.sum("cnt").alias("cnt"))


@query("""select coalesce(map_contains(imis, '自動獲得'), false) as acquired, dict_name, count(*) as entries from dictionary group by 1, 2""")
def k16_split_acquired(spark, sf):
    d = table(spark, sf, "dictionary")
    return d.groupBy(F.coalesce(F.map_contains_key("imis", F.lit("自動獲得")), F.lit(False)).alias("acquired"), "dict_name").agg(F.count("*").alias("entries"))


@query("""select t.event_type as dropped, count(*) as events, count(distinct e.user_id) as users
from (select distinct event_type from events) t join events e on e.event_type <> t.event_type group by 1""")
def k18_leave_one_type_out(spark, sf):
    """What is left of the data without each type in turn, from one aggregation by type instead of a join of all with all."""
    e = table(spark, sf, "events")
    by = e.groupBy("event_type").agg(F.count("*").alias("n"))
    # a user is lost with a type only if all of the user's events are of it
    per_user = e.groupBy("user_id").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    lone = per_user.where("a = b").groupBy(F.col("a").alias("event_type")).agg(F.count("*").alias("lone"))
    total, users = e.count(), per_user.count()
    return by.join(lone, "event_type", "left").select(F.col("event_type").alias("dropped"), (F.lit(total) - F.col("n")).alias("events"), (F.lit(users) - F.coalesce("lone", F.lit(0))).alias("users"))


@query(f"with {TOK} select doc_id, md5(string_agg(token, '' order by pos)) as joined, count(*) as n from tok group by 1")
def proj06_joined_text(spark, sf):
    """The raw text of an analysis: its surfaces joined in their order."""
    t = tokens(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("a"))
    return t.select("doc_id", F.md5(F.array_join(F.transform("a", lambda x: x["token"]), "")).alias("joined"), F.size("a").cast("long").alias("n"))


@query(r"""with lines as (select doc_id, unnest(range(1, len(a) + 1)) as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null)),
words as (select doc_id, line_no, unnest(range(1, len(b) + 1)) as place, unnest(b) as word from (select doc_id, line_no, regexp_extract_all(line, '""" + chars.TOKEN + r"""') as b from lines))
select line_no, place, count(*) as n, count(distinct word) as words from words group by 1, 2""")
def proj08_position_map(spark, sf):
    """Place of each word as (line, offset in the line), for all lines and places."""
    lines = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("l", "line"))
    words = lines.select((F.col("l") + 1).cast("long").alias("line_no"), F.posexplode(F.regexp_extract_all("line", F.lit(chars.TOKEN), F.lit(0))).alias("p", "word")).withColumn("place", (F.col("p") + 1).cast("long"))
    return words.groupBy("line_no", "place").agg(F.count("*").alias("n"), F.count_distinct("word").alias("words"))


@query(f"""with {TOK}, w as (select token, lag(token) over (partition by doc_id order by pos) as prev, lead(token) over (partition by doc_id order by pos) as next from tok),
f as (select token, 'prev' as ftype, prev as fname from w where prev is not null union all select token, 'next', next from w where next is not null)
select ftype, token, fname, count(*) as n from f group by 1, 2, 3 having count(*) >= 3""")
def proj13_prev_next(spark, sf):
    """Connection features: the word before and the word after, counted."""
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).select("token", F.lag("token").over(w).alias("prev"), F.lead("token").over(w).alias("next"))
    f = t.select("token", F.explode(F.array(F.struct(F.lit("prev").alias("ftype"), F.col("prev").alias("fname")), F.struct(F.lit("next").alias("ftype"), F.col("next").alias("fname")))).alias("f")).select("token", "f.*").where("fname is not null")
    return f.groupBy("ftype", "token", "fname").agg(F.count("*").alias("n")).where("n >= 3")


@query("""select user_id, event_type, count(*) as n, round(count(*) / sum(count(*)) over (partition by user_id), 6) as share from events group by 1, 2""")
def proj16_relative_freq(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("user_id")), 6))


@query(f"""with {TOK}, first as (select token, min(doc_id) as doc_id from tok group by 1), n as (select doc_id, count(*) as n from first group by 1)
select d.doc_id, cast(sum(coalesce(n, 0)) over (order by d.doc_id) as bigint) as distinct_so_far from documents d left join n using (doc_id)""")
def w11_saturation(spark, sf):
    """Distinct words seen up to each document: each word counts where it is first seen, then one distributed sum."""
    new = tokens(spark, sf).groupBy("token").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    d = table(spark, sf, "documents").select("doc_id").join(new, "doc_id", "left")
    return storage.prefix_sum(d, ["doc_id"], F.col("n"), "distinct_so_far").select("doc_id", "distinct_so_far")


@query("""with c as (select event_type, count(*) as n from events group by 1)
select event_type, n, round(sum(n) over (order by n desc, event_type) / sum(n) over (), 6) as share_so_far from c""")
def w12_cumulative_share(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    run = storage.prefix_sum(c, [F.desc("n"), "event_type"], F.col("n"), "run")
    total = table(spark, sf, "events").count()
    return run.select("event_type", "n", F.round(F.col("run") / F.lit(total), 6).alias("share_so_far"))


@query("""with l as (select document_id, row_id, length(raw) as n, sum(length(raw)) over (partition by document_id order by sent_id, row_id) as run from sentences where raw is not null and document_id is not null)
select document_id, count(*) as lines, cast(max(run) as bigint) as chars, count_if(run > 400) as beyond from l group by 1""", "beyond")
def w09_running_length(spark, sf):
    w = W.partitionBy("document_id").orderBy("sent_id", "row_id").rowsBetween(W.unboundedPreceding, 0)
    # rows of equal order count together, as a running total by value does
    s = table(spark, sf, "sentences").where("raw is not null and document_id is not null").withColumn("run", F.sum(F.length("raw")).over(w))
    return s.groupBy("document_id").agg(F.count("*").alias("lines"), F.max("run").alias("chars"), F.count_if(F.col("run") > 400).alias("beyond"))


@query("""select doc_id, i as line_no, line from (select doc_id, i, line, row_number() over (partition by doc_id, line order by i) as r
from (select doc_id, unnest(range(1, len(a) + 1)) as i, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from documents where text is not null))) where r = 1 and trim(line) <> ''""")
def u04_sentence_dedup(spark, sf):
    """Distinct lines within a document, the first of each kept: within the row, without a shuffle."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", "\n", -1).alias("a"))
    # sorted by line and place, the first of equal lines is the one whose neighbour before it differs
    s = d.select("doc_id", F.array_sort(F.transform("a", lambda x, i: F.struct(x.alias("line"), (i + 1).cast("long").alias("line_no")))).alias("s"))
    first = s.select("doc_id", F.explode(F.filter("s", lambda x, i: (i == 0) | (F.get("s", F.greatest(i - 1, F.lit(0)))["line"] != x["line"]))).alias("x"))
    return first.select("doc_id", "x.line_no", "x.line").where(F.trim("line") != "")


@query(f"""with {HEAD}, a as (select distinct head from head where dict_name = 'auto'), w as (select distinct head from head where dict_name = 'web')
select 'both' as side, count(*) as heads from (select * from a intersect select * from w) union all select 'auto', count(*) from (select * from a except select * from w)
union all select 'web', count(*) from (select * from w except select * from a)""")
def u03_set_operations(spark, sf):
    h = headwords(spark, sf)
    a, w = (h.where(F.col("dict_name") == x).select("head").distinct() for x in ("auto", "web"))
    parts = [("both", a.intersect(w)), ("auto", a.subtract(w)), ("web", w.subtract(a))]
    out = None
    for side, df in parts:
        one = df.agg(F.count("*").alias("heads")).select(F.lit(side).alias("side"), "heads")
        out = one if out is None else out.unionByName(one)
    return out


@query("""with a as (select distinct user_id from tweets where kind = 'mention'), b as (select distinct user_id from tweets where kind = 'newFriend')
select 'added' as change, user_id from b where user_id not in (select user_id from a where user_id is not null) and user_id is not null
union all select 'deleted', user_id from a where user_id not in (select user_id from b where user_id is not null) and user_id is not null""")
def u05_membership_changes(spark, sf):
    t = table(spark, sf, "tweets").where("user_id is not null")
    a, b = (t.where(F.col("kind") == k).select("user_id").distinct() for k in ("mention", "newFriend"))
    return b.join(a, "user_id", "left_anti").select(F.lit("added").alias("change"), "user_id").unionByName(a.join(b, "user_id", "left_anti").select(F.lit("deleted").alias("change"), "user_id"))


@query("""select cast(date_trunc('day', ts) as date) as day, strftime(ts, '%Y%m%d') as label, cast(date_trunc('day', ts) as date) + 1 as next_day, count(*) as n from events group by 1, 2, 3""")
def r06_day_labels(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return e.groupBy("day", F.date_format("ts", "yyyyMMdd").alias("label"), F.date_add("day", 1).alias("next_day")).agg(F.count("*").alias("n"))
