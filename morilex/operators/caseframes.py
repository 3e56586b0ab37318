"""Predicate-argument pairs from phrases with a dependency tree, in the JVM: one row for each phrase, joined to its head.

bunsetsu(doc_id, sent_id, bnst_idx, parent_idx, dpndtype, fstring), morphemes as in the schema. What a rule needs is read
from the feature strings by regular expressions; trees are followed by equi-joins on (doc_id, sent_id, parent_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


SENT = ["doc_id", "sent_id"]
#: Letters for the voice of a predicate, by the marks of the phrase: passive, causative, possible, receiving, negation.
VOICES = (("P", "態:受動"), ("C", "態:使役"), ("A", "態:受動|使役"), ("K", "態:可能"), ("M", "態:使役&受動"))
CASES = ("ガ", "ヲ", "ニ", "ト", "デ", "カラ", "ヨリ", "ヘ", "マデ", "ノ")


def case_of(fstring: Column) -> Column:
    """Case of a phrase: from its mark 係:…格, else null."""
    return F.nullif(F.regexp_extract(fstring, r"<係:([^>格]+)格>", 1), F.lit(""))


def predicate_kind(fstring: Column) -> Column:
    """Verb, adjective or nominal predicate, or null."""
    return F.nullif(F.regexp_extract(fstring, r"<用言:([^>]+)>", 1), F.lit(""))


def voice(fstring: Column) -> Column:
    """Voice letters of a predicate, and N where it is negated."""
    parts = [F.when(fstring.contains(f"<{mark}>"), letter).otherwise("") for letter, mark in VOICES]
    return F.concat(*parts, F.when(fstring.contains("<否定表現>"), "N").otherwise(""))


def heads(morphemes: DataFrame) -> DataFrame:
    """(doc_id, sent_id, bnst_idx, head): the head of each phrase, content words of one compound joined by +."""
    content = ~F.col("hinsi").isin("助詞", "助動詞", "特殊", "判定詞", "接続詞")
    word = F.coalesce("repname", "genkei")
    g = morphemes.where(content).groupBy(*SENT, "bnst_idx").agg(F.array_sort(F.collect_list(F.struct("pos", word.alias("w"), F.col("hinsi").alias("h")))).alias("ms"))
    return g.select(*SENT, "bnst_idx", F.array_join(F.transform("ms", lambda m: m["w"]), "+").alias("head"), F.element_at("ms", -1)["h"].alias("head_hinsi"))


def generalised(head: Column, fstring: Column) -> Column:
    """Content of an argument: time, amounts and named entities by their kind."""
    counter = F.regexp_extract(fstring, r"<カウンタ:([^>]+)>", 1)
    entity = F.regexp_extract(fstring, r"<NE:([^:>]+)", 1)
    return F.when(fstring.contains("<補文>"), "<補文>").when(fstring.contains("<時間>"), "<時間>").when(fstring.contains("<数量>"), F.concat(F.lit("<数量>"), counter)).when(entity != "", F.concat(F.lit("<NE:"), entity, F.lit(">"))).otherwise(head)


def predicates(bunsetsu: DataFrame, morphemes: DataFrame) -> DataFrame:
    """Phrases that are predicates worth counting: no compound, no address or greeting, no unclear parse."""
    b = bunsetsu.withColumn("kind", predicate_kind(F.col("fstring"))).where("kind is not null")
    b = b.where(~F.col("fstring").rlike("<(?:複合辞|呼掛|ID:[^>]*|非用言格解析)>"))
    return b.join(heads(morphemes), [*SENT, "bnst_idx"]).withColumn("predicate", F.concat("head", F.when(voice(F.col("fstring")) != "", F.concat(F.lit("+"), voice(F.col("fstring")))).otherwise("")))


def arguments(bunsetsu: DataFrame, morphemes: DataFrame) -> DataFrame:
    """(doc_id, sent_id, bnst_idx, predicate, kind, case, argument, adjacent): arguments that depend on a predicate directly.

    Coordinated and appositional dependents are left out; of several phrases with one case the nearest counts.
    """
    p = predicates(bunsetsu, morphemes).select(*SENT, F.col("bnst_idx").alias("p_idx"), "predicate", "kind")
    a = bunsetsu.where(F.coalesce("dpndtype", F.lit("D")) == "D").withColumn("case", case_of(F.col("fstring"))).where(F.col("case").isin(*CASES))
    a = a.join(heads(morphemes), [*SENT, "bnst_idx"]).withColumn("argument", generalised(F.col("head"), F.col("fstring")))
    j = a.select(*SENT, F.col("bnst_idx").alias("a_idx"), F.col("parent_idx").alias("p_idx"), "case", "argument").join(p, [*SENT, "p_idx"])
    near = j.groupBy(*SENT, "p_idx", "predicate", "kind", "case").agg(F.max_by("argument", "a_idx").alias("argument"), F.max("a_idx").alias("a_idx"))
    return near.select(*SENT, F.col("p_idx").alias("bnst_idx"), "predicate", "kind", "case", "argument", (F.col("a_idx") == F.col("p_idx") - 1).alias("adjacent"))


def valid_from(bunsetsu: DataFrame) -> DataFrame:
    """Phrases of each sentence after its last predicate that cannot be trusted: a sentence is read from its end and given up
    there. Not trusted are unclear final predicates, greetings and interjections."""
    bad = bunsetsu.where(F.col("fstring").rlike("<(?:呼掛|感動詞|用言弱化|解析不能)>")).groupBy(*SENT).agg(F.max("bnst_idx").alias("_bad"))
    return bunsetsu.join(bad, SENT, "left").where(F.coalesce("_bad", F.lit(-1)) < F.col("bnst_idx")).drop("_bad")


#: Checks that a case component must pass: what its phrase may not be marked as.
_NO_COMPONENT = "<(?:非用言格解析|ハ|モ|副詞|並キ:[^>]*|括弧始|ID:[^>]*)>"


def compound_particle(fstring: Column) -> Column:
    """Case of a compound particle (について and the like), by the kana of its mark, or null."""
    return F.nullif(F.regexp_extract(fstring, "<複合辞:([ァ-ヴー]+)>", 1), F.lit(""))


def components(bunsetsu: DataFrame, morphemes: DataFrame) -> DataFrame:
    """(doc_id, sent_id, p_idx, a_idx, case, argument, amount, adjacent): case components of predicates after all checks.

    Compound particles count as cases of their own; a component that is not next to its predicate is left out where
    another predicate stands between them.
    """
    p = predicates(valid_from(bunsetsu), morphemes).select(*SENT, F.col("bnst_idx").alias("p_idx"), "predicate", "kind")
    a = bunsetsu.where((F.coalesce("dpndtype", F.lit("D")) == "D") & ~F.col("fstring").rlike(_NO_COMPONENT))
    a = a.withColumn("case", F.coalesce(compound_particle(F.col("fstring")), F.when(case_of(F.col("fstring")).isin(*CASES), case_of(F.col("fstring"))))).where("case is not null and case <> 'ノ'")
    a = a.join(heads(morphemes), [*SENT, "bnst_idx"]).select(*SENT, F.col("bnst_idx").alias("a_idx"), F.col("parent_idx").alias("p_idx"), "case", generalised(F.col("head"), F.col("fstring")).alias("argument"), F.col("fstring").contains("<数量>").alias("amount"))
    j = a.join(p, [*SENT, "p_idx"]).withColumn("adjacent", F.col("a_idx") == F.col("p_idx") - 1)
    crossed = intervening(bunsetsu, "a_idx", "p_idx", "<用言:")(j)
    return crossed.where(F.col("adjacent") | ~F.col("between")).drop("between")


def with_no_case(parts: DataFrame, bunsetsu: DataFrame, morphemes: DataFrame) -> DataFrame:
    """Adds `no`: what stands before a component with の. Where the component is an amount and what stands before it is not,
    the two change places: of 三人の学生 and 学生の三人 it is the students that act."""
    h = heads(morphemes)
    no = bunsetsu.where(case_of(F.col("fstring")) == "ノ").join(h, [*SENT, "bnst_idx"]).select(*SENT, F.col("parent_idx").alias("a_idx"), F.col("bnst_idx").alias("n_idx"), generalised(F.col("head"), F.col("fstring")).alias("no"), F.col("fstring").contains("<数量>").alias("_no_amount"))
    near = no.groupBy(*SENT, "a_idx").agg(F.max_by(F.struct("no", "_no_amount"), "n_idx").alias("n"))
    j = parts.join(near, [*SENT, "a_idx"], "left")
    swap = F.coalesce(F.col("amount") & ~F.col("n._no_amount"), F.lit(False))
    return j.select(*[c for c in parts.columns if c != "argument"], F.when(swap, F.col("n.no")).otherwise(F.col("argument")).alias("argument"), F.when(swap, F.col("argument")).otherwise(F.col("n.no")).alias("no"))


def analysed_cases(bunsetsu: DataFrame) -> DataFrame:
    """(doc_id, sent_id, bnst_idx, predicate, case, kind, argument) read from the parser's own case analysis: kind is C for a
    case that is written, N for one that is not, O for an omitted one; cases without an argument are left out."""
    found = bunsetsu.withColumn("_r", F.regexp_extract("fstring", "<格解析結果:([^>]+)>", 1)).where("_r <> ''")
    # name/reading:kind of predicate:case/kind/argument/...;case/...
    head = F.regexp_extract("_r", "^([^:]+):", 1)
    flat = found.select(*SENT, "bnst_idx", head.alias("predicate"), F.explode(F.split(F.regexp_replace("_r", "^[^:]+:[^:]+:", ""), ";")).alias("c"))
    part = lambda n: F.try_element_at(F.split("c", "/"), F.lit(n))
    return flat.select(*SENT, "bnst_idx", "predicate", part(1).alias("case"), part(2).alias("kind"), F.nullif(part(3), F.lit("-")).alias("argument")).where("argument is not null and kind <> 'U'")


def noun_frames(bunsetsu: DataFrame, morphemes: DataFrame) -> DataFrame:
    """(noun, feature): what a noun does (its case and predicate), and the nouns it stands before with の."""
    args = arguments(bunsetsu, morphemes).where("case <> 'ノ'").select(F.col("argument").alias("noun"), F.concat_ws(":", "case", "predicate").alias("fname"), F.lit("cf").alias("ftype"))
    h = heads(morphemes)
    no = bunsetsu.where(case_of(F.col("fstring")) == "ノ").join(h, [*SENT, "bnst_idx"]).select(*SENT, F.col("head").alias("noun"), F.col("parent_idx").alias("bnst_idx"))
    pairs = no.join(h.select(*SENT, "bnst_idx", F.col("head").alias("other")), [*SENT, "bnst_idx"])
    return args.select("noun", "ftype", "fname").unionByName(pairs.select("noun", F.lit("ncf1").alias("ftype"), F.col("other").alias("fname"))).unionByName(pairs.select(F.col("other").alias("noun"), F.lit("ncf2").alias("ftype"), F.col("noun").alias("fname")))


def intervening(bunsetsu: DataFrame, first: str, last: str, pattern: str) -> DataFrame:
    """Adds `between`: whether a phrase whose features match `pattern` stands between the two places of a row."""
    marks = bunsetsu.where(F.col("fstring").rlike(pattern)).groupBy(*SENT).agg(F.collect_set("bnst_idx").alias("_at"))  # at most the phrases of a sentence
    return lambda rows: rows.join(marks, SENT, "left").withColumn("between", F.coalesce(F.exists("_at", lambda i: (i > F.col(first)) & (i < F.col(last))), F.lit(False))).drop("_at")


