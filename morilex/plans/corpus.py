"""Noise, context, profiles and evaluation over the sentences and single-word counts, as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars, kana
from ..operators import context as borders
from ..operators import metrics
from .aggregates import _SUF, suffix_rows
from .filters import NOISE, STOP
from .matches import STOK, sentence_tokens
from .registry import HEAD, headwords, query, table, tokens

_KATA, _KANA = "^[ァ-ヴー]+$", "^[ぁ-ゖ]+$"
_STOPS = ", ".join(f"'{w}'" for w in STOP)
#: Tokens with their neighbours, and whether a token starts a phrase: content after kana, a mark or nothing.
_WIN = rf"""{STOK}, win as (select *, lag(token) over s as p1, lead(token) over s as n1, lead(token, 2) over s as n2, lead(token, 3) over s as n3 from stok window s as (partition by row_id order by pos)),
ph as (select *, sum(case when not regexp_matches(token, '^[ぁ-ゖ]+$') and (p1 is null or not regexp_matches(p1, '^[一-鿿々ァ-ヴーA-Za-z]+$')) then 1 else 0 end) over (partition by row_id order by pos) as phrase from win)"""


def context(spark, sf):
    w = W.partitionBy("row_id").orderBy("pos")
    t = sentence_tokens(spark, sf).withColumns({"p1": F.lag("token").over(w), "n1": F.lead("token").over(w), "n2": F.lead("token", 2).over(w), "n3": F.lead("token", 3).over(w)})
    start = ~F.col("token").rlike(_KANA) & (F.col("p1").isNull() | ~F.col("p1").rlike("^[一-鿿々ァ-ヴーA-Za-z]+$"))
    return t.withColumn("phrase", F.sum(start.cast("int")).over(w))


@query(rf"""with {_WIN} select token, n1, case when n2 is null then 'end' when regexp_matches(n2, '{_KANA}') then 'kana' else 'other' end as second, case when n3 is null then 'end' when regexp_matches(n3, '{_KANA}') then 'kana' else 'other' end as third, count(*) as n
from win where regexp_matches(token, '[一-鿿々ァ-ヴー]$') and starts_with(n1, 'る') group by 1, 2, 3, 4""")
def w02_look_ahead(spark, sf):
    """Words before る with what stands two and three places on: the exception for る-verbs is told by these."""
    kind = lambda c: F.when(F.col(c).isNull(), "end").when(F.col(c).rlike(_KANA), "kana").otherwise("other")
    t = context(spark, sf).where(F.col("token").rlike("[一-鿿々ァ-ヴー]$") & F.col("n1").startswith("る"))
    return t.groupBy("token", "n1", kind("n2").alias("second"), kind("n3").alias("third")).agg(F.count("*").alias("n"))


@query(rf"""with {_WIN} select row_id, phrase, arg_max(token, pos) as target, max(pos) as place from ph where regexp_matches(token, '^[一-鿿々ァ-ヴーA-Za-z]+$') group by 1, 2""")
def w04_last_content_word(spark, sf):
    """Each phrase looked through from its end: the first content word that is met."""
    t = context(spark, sf).where(F.col("token").rlike("^[一-鿿々ァ-ヴーA-Za-z]+$"))
    return t.groupBy("row_id", "phrase").agg(F.max_by("token", "pos").alias("target"), F.max("pos").alias("place"))


@query(rf"""with {_WIN}, p as (select row_id, phrase, string_agg(token, '' order by pos) as surface, min(pos) as first, arg_max(token, pos) as last from ph group by 1, 2),
q as (select *, lead(surface) over (partition by row_id order by phrase) as next from p)
select surface || next as joined, count(*) as n from q where next is not null and regexp_matches(last, '^(?:[ぁ-ゖ]*を|[ぁ-ゖ]*に)$') and regexp_matches(next, '^[一-鿿々]') group by 1""")
def w08_merged_phrases(spark, sf):
    """A phrase that ends in を or に merged with the phrase of ideographs that follows it."""
    t = context(spark, sf)
    p = t.groupBy("row_id", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("surface"), F.max_by("token", "pos").alias("last"))
    q = p.withColumn("next", F.lead("surface").over(W.partitionBy("row_id").orderBy("phrase")))
    q = q.where(F.col("next").isNotNull() & F.col("last").rlike("^(?:[ぁ-ゖ]*を|[ぁ-ゖ]*に)$") & F.col("next").rlike("^[一-鿿々]"))
    return q.groupBy(F.concat("surface", "next").alias("joined")).agg(F.count("*").alias("n"))


@query(r"""select row_id, regexp_matches(raw, '\x{FFFD}|\\x[0-9A-Fa-f]{2}') as corrupt, regexp_matches(raw, '　') as wide_space, regexp_matches(raw, '(?:^|[^ぁ-ゖ])[ぁぃぅぇぉゃゅょっ]') as small_kana, not regexp_matches(raw, '[ぁ-ゖ]') as no_predicate, regexp_matches(raw, '[^、。！？「」（）\s]{16,}') as long_phrase from sentences where raw is not null""")
def f05_suffix_noise(spark, sf):
    """What makes a sentence of no use for counting suffixes, each reason by itself."""
    return table(spark, sf, "sentences").where("raw is not null").select("row_id", *[c.alias(k) for k, c in chars.suffix_noise(F.col("raw")).items()])


@query(rf"""select distinct midasi, not regexp_matches(midasi, '^[{kana.two_byte_class("re2")}]+$') or regexp_matches(midasi, '\\x[0-9A-Fa-f]{{2}}') as corrupt from ngram_uni where midasi is not null""")
def f16_corrupt_words(spark, sf):
    """Words that the two-byte character set does not hold, or that show a byte as an escape."""
    w = table(spark, sf, "ngram_uni").where("midasi is not null").select("midasi").distinct()
    return w.select("midasi", (~kana.euc_convertible_column(F.col("midasi")) | F.col("midasi").rlike(r"\\x[0-9A-Fa-f]{2}")).alias("corrupt"))


@query("""select word_class, midasi, coalesce(regexp_matches(word_class, '^<[ァ-ヴー一-鿿]+(?::[ぁ-ゖァ-ヴー一-鿿0-9]+)?>$') and regexp_matches(cast(cnt as varchar), '^[0-9]+$') and length(midasi) > 0, false) as well_formed, count(*) as n from ngram_uni group by all""")
def f17_line_format(spark, sf):
    """Rows whose class, count and word have the form of the list."""
    ok = F.col("word_class").rlike("^<[ァ-ヴー一-鿿]+(?::[ぁ-ゖァ-ヴー一-鿿0-9]+)?>$") & F.col("cnt").cast("string").rlike("^[0-9]+$") & (F.length("midasi") > 0)
    return table(spark, sf, "ngram_uni").groupBy("word_class", "midasi", F.coalesce(ok, F.lit(False)).alias("well_formed")).agg(F.count("*").alias("n"))


@query(f"""select document_id, count(distinct midasi) as terms, cast(sum(cnt) as bigint) as cnt from ngram_uni where document_id is not null and word_class in ('<普通名詞>', '<固有名詞>', '<サ変名詞>') and midasi is not null and not regexp_matches(midasi, '^[ぁ-ゖァ-ヴ]$') and midasi not in ({_STOPS}) group by 1""")
def f24_cluster_terms(spark, sf):
    """Content words of documents that serve for clustering: no stop words, no single kana."""
    u = table(spark, sf, "ngram_uni").where(F.col("document_id").isNotNull() & F.col("word_class").isin("<普通名詞>", "<固有名詞>", "<サ変名詞>") & F.col("midasi").isNotNull() & ~F.col("midasi").rlike("^[ぁ-ゖァ-ヴ]$") & ~F.col("midasi").isin(*STOP))
    per = u.groupBy("document_id", "midasi").agg(F.sum("cnt").alias("c"))
    return per.groupBy("document_id").agg(F.count("*").alias("terms"), F.sum("c").alias("cnt"))


@query(r"""with t as (select user_id, text, regexp_matches(text, 'https?://') as link from tweets where user_id is not null and text is not null), r as (select user_id, text, count(*) as n, bool_or(link) as link from t group by 1, 2)
select user_id, cast(sum(n) as bigint) as statuses, round(sum(case when link then n else 0 end) / sum(n), 6) as links, round(1 - count(*) / sum(n), 6) as repeated, sum(case when link then n else 0 end) / sum(n) > 0.5 or 1 - count(*) / sum(n) > 0.5 as spam from r group by 1""")
def f26_spam_accounts(spark, sf):
    """Accounts most of whose statuses are links or repeat others of theirs; equal statuses are summed before users are."""
    t = table(spark, sf, "tweets").where("user_id is not null and text is not null")
    r = t.groupBy("user_id", "text").agg(F.count("*").alias("n")).withColumn("linked", F.when(F.col("text").rlike("https?://"), F.col("n")).otherwise(0))
    g = r.groupBy("user_id").agg(F.sum("n").alias("statuses"), (F.sum("linked") / F.sum("n")).alias("l"), (1 - F.count("*") / F.sum("n")).alias("r"))
    return g.select("user_id", "statuses", F.round("l", 6).alias("links"), F.round("r", 6).alias("repeated"), ((F.col("l") > 0.5) | (F.col("r") > 0.5)).alias("spam"))


@query(rf"""with {_WIN} select token as word, count(*) as n, round(avg(case when p1 is null then 1.0 else 0.0 end), 6) as share, avg(case when p1 is null then 1.0 else 0.0 end) > 0.05 as reliable from win where regexp_matches(token, '{_KATA}') group by 1""")
def f28_front_reliability(spark, sf):
    """How often a word stands at the start of a sentence: its front border is reliable if that is often enough."""
    bos = F.avg(F.when(F.col("p1").isNull(), 1.0).otherwise(0.0))
    return context(spark, sf).where(F.col("token").rlike(_KATA)).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"), F.round(bos, 6).alias("share"), (bos > 0.05).alias("reliable"))


@query(rf"""with {_WIN}, f as (select token as word, substr(n1, 1, 2) as form, n2 as predicate from win where regexp_matches(token, '{_KATA}') and regexp_matches(n1, '{_KANA}')),
g as (select word, count(distinct form) as forms, count(distinct case when regexp_matches(predicate, '^[一-鿿々]+$') then predicate end) as predicates, count(*) as n, count_if(regexp_matches(predicate, '^[一-鿿々]+$')) as before_predicate from f group by 1)
select word, forms, predicates, n, forms >= 3 or predicates >= 4 as reliable, predicates > 1 and before_predicate / n > 0.5 as adverb from g""")
def f29_form_reliability(spark, sf):
    """Words with enough different endings, or predicates after them; mostly before predicates they may be adverbs."""
    predicate = F.when(F.col("n2").rlike("^[一-鿿々]+$"), F.col("n2"))
    t = context(spark, sf).where(F.col("token").rlike(_KATA) & F.col("n1").rlike(_KANA))
    g = t.groupBy(F.col("token").alias("word")).agg(F.count_distinct(F.left("n1", F.lit(2))).alias("forms"), F.count_distinct(predicate).alias("predicates"), F.count("*").alias("n"), F.count(predicate).alias("b"))
    return g.select("word", "forms", "predicates", "n", ((F.col("forms") >= 3) | (F.col("predicates") >= 4)).alias("reliable"), ((F.col("predicates") > 1) & (F.col("b") / F.col("n") > 0.5)).alias("adverb"))


@query(rf"""with {STOK} select token as word, count(*) as examples, count(*) >= 3 as enough, count(*) >= 8 as enough_in_safe_mode from stok where regexp_matches(token, '{_KATA}') group by 1""")
def f30_enough_examples(spark, sf):
    t = sentence_tokens(spark, sf).where(F.col("token").rlike(_KATA)).groupBy(F.col("token").alias("word")).agg(F.count("*").alias("examples"))
    return t.select("word", "examples", (F.col("examples") >= 3).alias("enough"), (F.col("examples") >= 8).alias("enough_in_safe_mode"))


@query("select dict_name, dict_version, count(*) as entries, not bool_or(coalesce(cardinality(midasi), 0) > 0) as dummy from dictionary group by 1, 2")
def f31_dummy_dictionaries(spark, sf):
    """Dictionaries that hold nothing but entries without a headword."""
    return table(spark, sf, "dictionary").groupBy("dict_name", "dict_version").agg(F.count("*").alias("entries"), (~F.bool_or(F.coalesce(F.cardinality("midasi"), F.lit(0)) > 0)).alias("dummy"))


@query(f"select row_id from sentences where raw is not null and length(raw) between 10 and 200 and regexp_matches(raw, '[。！？]$') and regexp_matches(raw, '[ぁ-ゖ]') and not {NOISE}")
def f32_evaluation_sentences(spark, sf):
    """Sentences fit for judging: whole, of middling length, without noise."""
    s = table(spark, sf, "sentences").where("raw is not null")
    return s.where(F.length("raw").between(10, 200) & F.col("raw").rlike("[。！？]$") & F.col("raw").rlike("[ぁ-ゖ]") & ~chars.noisy_line(F.col("raw"))).select("row_id")


@query(f"with {_SUF}, v as (select w.head, w.token as suffix from w where regexp_matches(token, '{_KANA}') and head is not null) select case when regexp_matches(head, '[一-鿿々]$') then 'kanji' when regexp_matches(head, '[ァ-ヴー]$') then 'katakana' else 'other' end as pos_s, head as genkei, substr(suffix, 1, 4) as suffix, count(*) as n from v group by 1, 2, 3")
def a06_suffix_vectors(spark, sf):
    """For each word the suffixes that follow it, cut to four characters."""
    return suffix_vectors(spark, sf)


def suffix_vectors(spark, sf):
    w = W.partitionBy("doc_id").orderBy("pos")
    t = tokens(spark, sf).withColumn("head", F.lag("token").over(w)).where(F.col("token").rlike(_KANA) & F.col("head").isNotNull())
    pos = F.when(F.col("head").rlike("[一-鿿々]$"), "kanji").when(F.col("head").rlike("[ァ-ヴー]$"), "katakana").otherwise("other")
    return t.groupBy(pos.alias("pos_s"), F.col("head").alias("genkei"), F.left("token", F.lit(4)).alias("suffix")).agg(F.count("*").alias("n"))


@query(f"with {_SUF} select case when pos_s in ('kanji', 'katakana') then 'group' else pos_s end as pos_s, substr(suffix, 1, 4) as suffix, count(*) as n from suf group by 1, 2")
def a07_merged_vectors(spark, sf):
    """Suffix vectors of a part of speech, the nominal ones merged into one group."""
    s = suffix_rows(spark, sf)
    return s.groupBy(F.when(F.col("pos_s").isin("kanji", "katakana"), "group").otherwise(F.col("pos_s")).alias("pos_s"), F.left("suffix", F.lit(4)).alias("suffix")).agg(F.count("*").alias("n"))


@query(rf"""with {_WIN} select token as word, count(*) as n, count_if(n1 is null) as at_end, count_if(coalesce(regexp_matches(n1, '{_KANA}'), false)) as has_suffix, count_if(coalesce(regexp_matches(n1, '^[一-鿿々ァ-ヴー]+$'), false)) as with_right, count_if(p1 is null or regexp_matches(p1, '^[、。！？「」（）]$')) as left_separated,
 count_if(p1 is null and n1 is null) as single from win where regexp_matches(token, '{_KATA}') group by 1""", "at_end has_suffix with_right left_separated single")
def a15_context_profile(spark, sf):
    """In what contexts a katakana word stands, as conditional sums."""
    t = context(spark, sf).where(F.col("token").rlike(_KATA))
    conds = {"at_end": F.col("n1").isNull(), "has_suffix": F.col("n1").rlike(_KANA), "with_right": F.col("n1").rlike("^[一-鿿々ァ-ヴー]+$"), "left_separated": F.col("p1").isNull() | F.col("p1").rlike("^[、。！？「」（）]$"), "single": F.col("p1").isNull() & F.col("n1").isNull()}
    return t.groupBy(F.col("token").alias("word")).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conds.items()])


@query(rf"""with {_WIN}, {HEAD}, h as (select distinct head from head where map_contains(imis, '自動獲得')), s as (select token as word, substr(n1, 1, 4) as suffix, count(*) as n from win join h on h.head = token where regexp_matches(n1, '{_KANA}') group by 1, 2)
select word, suffix, n, cast(sum(n) over (partition by word) as bigint) as total from s""")
def a29_usage_profile(spark, sf):
    """Suffixes that follow each acquired word, with the word's total."""
    h = headwords(spark, sf).where(F.map_contains_key("imis", F.lit("自動獲得"))).select(F.col("head").alias("token")).distinct()
    s = context(spark, sf).where(F.col("n1").rlike(_KANA)).groupBy("token", F.left("n1", F.lit(4)).alias("suffix")).agg(F.count("*").alias("n")).join(h, "token", "left_semi")
    total = s.groupBy("token").agg(F.sum("n").alias("total"))
    return s.join(total, "token").select(F.col("token").alias("word"), "suffix", "n", "total")


@query(rf"""with {_WIN}, f as (select p1 as family, token as title from win where token in ('さん', 'くん', 'ちゃん', 'さま') and regexp_matches(p1, '^[一-鿿々ァ-ヴー]+$')), a as (select token as family, count(*) as occurrences from stok group by 1)
select f.family, count(*) as examples, count(distinct title) as features, round(count(*) * count(*) / max(a.occurrences), 6) as weighted, round(count(*) / max(a.occurrences), 6) as expectation from f join a using (family) group by 1""")
def a30_family_names(spark, sf):
    """Suspected family names: examples, different titles, and how far their occurrences stand before titles."""
    f = context(spark, sf).where(F.col("token").isin("さん", "くん", "ちゃん", "さま") & F.col("p1").rlike("^[一-鿿々ァ-ヴー]+$")).groupBy(F.col("p1").alias("family")).agg(F.count("*").alias("examples"), F.count_distinct("token").alias("features"))
    a = sentence_tokens(spark, sf).groupBy(F.col("token").alias("family")).agg(F.count("*").alias("k"))
    return f.join(a, "family").select("family", "examples", "features", F.round(F.col("examples") * F.col("examples") / F.col("k"), 6).alias("weighted"), F.round(F.col("examples") / F.col("k"), 6).alias("expectation"))


@query(r"""with t as (select row_id, regexp_replace(raw, '([ァ-ヴー]{3,})', '<U>\1</U>', 'g') as tagged, regexp_extract_all(raw, '[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]+|[A-Za-z]+|\S') as a from sentences where raw is not null and not regexp_matches(raw, '[<>]'))
select row_id, len(regexp_extract_all(tagged, '<U>')) as regions, len(list_filter(a, lambda x: regexp_matches(x, '^[ァ-ヴ][ァ-ヴー]{3,}$'))) as found from t where len(regexp_extract_all(tagged, '<U>')) > 0""")
def m13_region_recall(spark, sf):
    """Tagged regions of each sentence and how many of them a detector of longer katakana words meets."""
    s = table(spark, sf, "sentences").where("raw is not null").where(~F.col("raw").rlike("[<>]"))
    tagged = F.regexp_replace("raw", "([ァ-ヴー]{3,})", "<U>$1</U>")
    hits = F.transform(metrics.matches(F.col("raw"), "(?<![ァ-ヴー])[ァ-ヴ][ァ-ヴー]{3,}(?![ァ-ヴー])"), lambda m: m["start"])
    r = s.select("row_id", metrics.regions(tagged, "U").alias("regions"), hits.alias("hits"))
    found = F.size(F.filter("regions", lambda g: F.exists("hits", lambda h: (h >= g["start"]) & (h < g["end"]))))
    return r.where(F.size("regions") > 0).select("row_id", F.size("regions").cast("long").alias("regions"), found.cast("long").alias("found"))


@query("""select count(*) as judged, count_if(grade not between 1 and 6) as refused, round(avg(case when abs(grade - m) <= 1 then 1.0 else 0.0 end), 6) as accuracy from reading_labels join (select doc_id, avg(grade) as m from reading_labels where grade between 1 and 6 group by 1) using (doc_id) where grade is not null""", "refused")
def m16_judgements(spark, sf):
    """Submitted judgements: how many there are, how many are refused, and how many agree with their document's mean."""
    g = table(spark, sf, "reading_labels").where("grade is not null")
    mean = g.where("grade between 1 and 6").groupBy("doc_id").agg(F.avg("grade").alias("m"))
    return g.join(mean, "doc_id").agg(F.count("*").alias("judged"), F.count_if(~F.col("grade").between(1, 6)).alias("refused"), F.round(F.avg(F.when(F.abs(F.col("grade") - F.col("m")) <= 1, 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query("""with u as (select event_id, (cast('0x' || substr(md5('12-' || event_id), 1, 8) as bigint) + 1) / 4294967297 as a, cast('0x' || substr(md5('12-' || event_id), 9, 8) as bigint) / 4294967296 as b from events)
select event_id, round(5 + 2 * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 5) as draw from u""")
def m12_gaussian_draws(spark, sf):
    """A normal draw (mean 5, deviation 2) for each record, from two uniform numbers of a seeded digest."""
    return table(spark, sf, "events").select("event_id", F.round(metrics.gaussian(F.concat_ws("-", F.lit("12"), F.col("event_id").cast("string")), 5.0, 2.0), 5).alias("draw"))


def _sentences(spark, sf):
    """(row_id, tokens) of the sentences, with phrases; a sentence's own tokens come together."""
    t = context(spark, sf).withColumn("t", F.struct("pos", F.col("token").alias("w"), F.col("phrase").cast("int").alias("phrase")))
    g = t.groupBy("row_id").agg(F.array_sort(F.collect_list("t")).alias("a"))
    return g.select("row_id", F.transform("a", lambda x: F.struct(x["w"].alias("w"), x["phrase"].alias("phrase"), F.lit(None).cast("string").alias("mark"))).alias("tokens"))


def _borders(spark, sf, side):
    s = _sentences(spark, sf).withColumn("i", F.explode(F.filter(F.transform("tokens", lambda t, i: F.when(t["w"].rlike(_KATA), i)), lambda i: i.isNotNull())))
    return s.select("row_id", "i", F.get("tokens", "i")["w"].alias("word"), F.explode(side(F.col("tokens"), F.col("i"))).alias("b")).select("row_id", "i", "word", "b.n", "b.text", "b.tag")


def _border_sql(front: bool) -> str:
    """The borders of one side as a reduction over the tokens of the sentence, from the word on."""
    longest = borders.LONGEST_FRONT if front else borders.LONGEST_REAR
    near = f"t.pos < p.pos and t.phrase >= p.phrase - {borders.PHRASES}" if front else f"t.pos > p.pos and t.phrase <= p.phrase + {borders.PHRASES}"
    text = "x.w || acc.text" if front else "acc.text || x.w"
    edge, inner = ("BOS", "BOB") if front else ("EOS", "EOB")
    stop = f"regexp_matches(x.w, '{borders.SEPARATOR}')" + (" or x.w = 'を'" if front else "")
    last = "" if front else " and x.w <> 'を'"
    at = lambda n, t, tag: f"list_append(list_filter({{out}}, lambda b: b.n <> {n}), {{{{'n': {n}, 'text': {t}, 'tag': {tag}}}}})"
    stopped = at("acc.n", "acc.text", f"'{edge}'").format(out="acc.found")
    taken = at("acc.n + 1", f"({text})", "x.tag").format(out="acc.found")
    side = "prev_phrase" if front else "next_phrase"
    return rf"""with {_WIN}, tk as (select *, lag(phrase) over s as prev_phrase, lead(phrase) over s as next_phrase from ph window s as (partition by row_id order by pos)),
tg as (select *, case when {side} is null then '{edge}' when {side} <> phrase then '{inner}' end as tag from tk), pv as (select * from tg where regexp_matches(token, '{_KATA}')),
sc as (select p.row_id, p.pos, any_value(p.token) as word, any_value(p.tag) as tag, list({{'go': true, 'text': '', 'n': 0, 'found': []::struct(n integer, text varchar, tag varchar)[], 'w': t.token, 'tag': t.tag}} order by t.pos {'desc' if front else 'asc'}) filter (t.pos is not null) as l
 from pv p left join tg t on t.row_id = p.row_id and {near} group by 1, 2),
rd as (select row_id, pos, word, list_reduce(list_prepend({{'go': true, 'text': '', 'n': 0, 'found': case when tag is null then [] else [{{'n': 0, 'text': '', 'tag': tag}}] end::struct(n integer, text varchar, tag varchar)[], 'w': '', 'tag': null::varchar}}, coalesce(l, [])), lambda acc, x: case when not acc.go then acc
 when {stop} then {{'go': false, 'text': acc.text, 'n': acc.n, 'found': {stopped}, 'w': x.w, 'tag': x.tag}}
 else {{'go': length({text}) <= {longest}{last}, 'text': {text}, 'n': acc.n + 1, 'found': case when length({text}) <= {longest} and x.tag is not null then {taken} else acc.found end, 'w': x.w, 'tag': x.tag}} end) as z from sc)
select row_id, cast(pos - 1 as integer) as i, word, b.n as n, b.text as text, b.tag as tag from (select row_id, pos, word, unnest(z.found) as b from rd)"""


@query(_border_sql(True))
def w06_front_borders(spark, sf):
    """Borders before each katakana word: sentence, phrase, separator."""
    return _borders(spark, sf, borders.front_borders)


@query(_border_sql(False))
def w07_rear_borders(spark, sf):
    """Borders after each katakana word."""
    return _borders(spark, sf, borders.rear_borders)


@query(rf"""with {_WIN}, s as (select row_id, count(*) as n from stok group by 1), c as (select p.row_id, p.pos, cast(s.n - p.pos as bigint) as rest from ph p join s using (row_id) where regexp_matches(token, '{_KATA}'))
select rest = 0 as at_end, count(*) as words from c group by 1""")
def st14_words_at_end(spark, sf):
    """How many katakana words end their sentence, so that nothing bounds them from behind."""
    t = sentence_tokens(spark, sf)
    last = t.groupBy("row_id").agg(F.max("pos").alias("last"))
    return t.where(F.col("token").rlike(_KATA)).join(last, "row_id").groupBy((F.col("pos") == F.col("last")).alias("at_end")).agg(F.count("*").alias("words"))
