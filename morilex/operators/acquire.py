"""Acquisition of unknown words in batch: from suspicious occurrences to stems with a part of speech.

An example is one occurrence: (example_id, front, front_tag, text), text being the word and what follows it. Listed
suffixes that stand in the text propose stems; stems that enough examples share, that no longer or shorter stem explains
better, and whose part of speech is clear, become entries. Every step is an equi-join or a grouped sum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import chars
from .lookup import prefixes, small
from .storage import written

# Least examples, coverage of stems and parts of speech, lengths, and what a reliable word needs.
LEAST_EXAMPLES, SAFE_EXAMPLES = 3, 8
STEM_COVERAGE, CONTAINED_COVERAGE, OVERLAP = 0.01, 0.20, 0.05
POS_COVERAGE, BOS_SHARE = 0.90, 0.05
LEAST_FORMS, LEAST_PREDICATES, PREDICATE_SHARE = 3, 4, 0.5
LONGEST_SUFFIX, LONGEST_STEM = 4, 16
#: Inflection of an example that ends before a predicate: this and the predicate.
PREDICATE = "用言:"
BARE_STEM = ("母音動詞", "普通名詞", "副詞", "ナ形容詞")
POS_LIST = ("母音動詞", "子音動詞カ行", "子音動詞ガ行", "子音動詞サ行", "子音動詞タ行", "子音動詞バ行", "子音動詞マ行", "子音動詞ラ行", "子音動詞ワ行", "サ変動詞", "ザ変動詞", "イ形容詞", "普通名詞", "副詞", "ナ形容詞")
#: A part of speech that stands for others that also fit.
INCLUDES = {"普通名詞": ("ナ形容詞", "母音動詞", "副詞")}


def suffix_matches(examples: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(example_id, stem, pos_s, katuyou2): at each offset the longest listed suffix that stands there.

    A suffix shorter than LONGEST_SUFFIX must end where the text ends (a rear boundary). A stem includes the front.
    """
    offsets = F.sequence(F.lit(1), F.least(F.length("text") - 1, F.lit(LONGEST_STEM)))
    at = examples.where(F.length("text") >= 2).select("example_id", "front", "text", F.explode(offsets).alias("i"))
    at = at.withColumn("rest", F.expr("substring(text, i + 1, length(text))")).select("example_id", F.concat("front", F.expr("substring(text, 1, i)")).alias("stem"), "i", F.length("rest").alias("left"), F.explode(prefixes(F.col("rest"), 1, LONGEST_SUFFIX)).alias("suffix"))
    hit = at.join(small(suffixes), "suffix").where((F.length("suffix") >= LONGEST_SUFFIX) | (F.length("suffix") == F.col("left")))
    best = hit.withColumn("_top", F.max(F.length("suffix")).over(W.partitionBy("example_id", "i"))).where(F.length("suffix") == F.col("_top"))
    return best.select("example_id", "stem", "pos_s", "katuyou2").distinct()


def allowed(matches: DataFrame) -> DataFrame:
    """Matches whose stem may belong to the part of speech."""
    rule = reduce(lambda acc, p: acc.when(F.col("pos_s") == p, chars.stem_allowed(F.col("stem"), p)), POS_LIST, F.when(F.lit(False), F.lit(False)))
    return matches.where(F.coalesce(rule, F.lit(True)))


def stem_overlap(per_stem: DataFrame) -> DataFrame:
    """(shorter, longer, a, b, both, drop) for stems of which one is a prefix of the other.

    per_stem(stem, example_id). The longer is dropped if it is rare among the shorter's examples, or if the two hardly
    differ and the shorter covers it.
    """
    n = per_stem.groupBy("stem").agg(F.count_distinct("example_id").alias("n"))
    long = per_stem.select(F.col("stem").alias("longer"), "example_id", F.explode(prefixes(F.col("stem"))).alias("shorter")).where("shorter <> longer")
    pairs = long.select("longer", "shorter").distinct().join(n.select(F.col("stem").alias("shorter"), F.col("n").alias("a")), "shorter").join(n.select(F.col("stem").alias("longer"), F.col("n").alias("b")), "longer")
    shared = long.join(per_stem.select(F.col("stem").alias("shorter"), "example_id"), ["shorter", "example_id"]).groupBy("shorter", "longer").agg(F.count_distinct("example_id").alias("both"))
    j = pairs.join(shared, ["shorter", "longer"], "left").withColumn("both", F.coalesce("both", F.lit(0).cast("long")))
    only = F.col("b") - F.col("both")
    drop = F.when(F.col("b") / F.col("a") < STEM_COVERAGE, True).when(F.col("both") == 0, False).when((only == 0) & (F.col("both") / F.col("a") >= CONTAINED_COVERAGE), False).otherwise((F.col("both") / F.col("a") < 1 - OVERLAP) & (only / F.col("both") < OVERLAP))
    return j.withColumn("drop", drop)


def pos_coverage(matches: DataFrame, bare: DataFrame) -> DataFrame:
    """(stem, pos_s, n, total, coverage): share of a stem's examples that a part of speech explains, bare ones included
    where it may stand alone; only what covers more than POS_COVERAGE."""
    predicate = F.col("katuyou2").startswith(PREDICATE)
    per = matches.groupBy("stem", "pos_s").agg(F.count_distinct("example_id").alias("n"), F.count_distinct(F.when(~predicate, F.col("katuyou2"))).alias("forms"), F.count_distinct(F.when(predicate, F.col("katuyou2"))).alias("predicates"), F.count_distinct(F.when(predicate, F.col("example_id"))).alias("before_predicate"))
    both = matches.select("stem", "example_id").unionByName(bare.select("stem", "example_id"))
    total = both.groupBy("stem").agg(F.count_distinct("example_id").alias("total"))
    alone = bare.groupBy("stem").agg(F.count_distinct("example_id").alias("alone"))
    j = per.join(total, "stem").join(alone, "stem", "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    n = F.col("n") + F.when(F.col("pos_s").isin(*BARE_STEM), F.col("alone")).otherwise(0)
    return j.withColumn("coverage", n / F.col("total")).where(F.col("coverage") > POS_COVERAGE)


def reliable() -> Column:
    """Enough different endings (all predicates that follow count as one), or enough different predicates."""
    return (F.col("forms") + F.when(F.col("predicates") > 0, 1).otherwise(0) >= LEAST_FORMS) | (F.col("predicates") >= LEAST_PREDICATES)


def may_be_adverb() -> Column:
    """A common noun that mostly stands right before predicates, and before more than one."""
    return (F.col("pos_s") == "普通名詞") & (F.col("predicates") > 1) & (F.col("before_predicate") / F.col("n") > PREDICATE_SHARE)


def reduce_pos(candidates: DataFrame) -> DataFrame:
    """One part of speech for a stem: the only one, or one that includes all the others; else none."""
    c = candidates.groupBy("stem").agg(F.collect_set("pos_s").alias("all"))  # at most the fifteen parts of speech
    keep = F.when(F.size("all") == 1, F.element_at("all", 1))
    for p, others in INCLUDES.items():
        keep = keep.when(F.array_contains("all", p) & (F.size(F.array_except("all", F.array(F.lit(p), *[F.lit(o) for o in others]))) == 0), F.lit(p))
    return c.withColumn("pos_s", keep).where("pos_s is not null").select("stem", "pos_s")


def induce(examples: DataFrame, suffixes: DataFrame, least: int = LEAST_EXAMPLES, safe: bool = False) -> DataFrame:
    """(stem, pos_s, cnt, adverb): entries that the examples support.

    examples(example_id, front, front_tag, text); front_tag 'BOS' where the front is the start of a sentence or phrase.
    safe: at least SAFE_EXAMPLES of the chosen part of speech are asked for.
    """
    matches = written(allowed(suffix_matches(examples, suffixes)), "suffixed")
    bare = examples.select("example_id", F.concat("front", "text").alias("stem"))
    enough = matches.groupBy("stem").agg(F.count_distinct("example_id").alias("k")).where(F.col("k") >= least).select("stem").where((F.length("stem") > 1) | ~F.col("stem").rlike("^[ぁ-ゖ]$"))
    matches = written(matches.join(enough, "stem", "left_semi"), "stems")
    gone = stem_overlap(matches.select("stem", "example_id").distinct()).where("drop").select(F.col("longer").alias("stem")).distinct()
    matches = matches.join(gone, "stem", "left_anti")
    matches = written(matches, "stems-left")
    covered = written(pos_coverage(matches, bare.join(enough, "stem", "left_semi")), "covered")
    chosen = reduce_pos(covered).join(covered, ["stem", "pos_s"])
    fronts = matches.join(examples.select("example_id", "front_tag"), "example_id").groupBy("stem", "pos_s").agg(F.avg((F.col("front_tag") == "BOS").cast("double")).alias("bos"))
    good = chosen.join(fronts, ["stem", "pos_s"]).where((F.col("bos") > BOS_SHARE) & reliable() & (F.col("total") >= least) & (F.col("n") >= (SAFE_EXAMPLES if safe else 1)))
    # of stems that explain the same examples the shortest stays
    kept = written(good.select("stem", "pos_s", F.col("total").alias("cnt"), may_be_adverb().alias("adverb")), "entries")
    longer = kept.select(F.col("stem").alias("longer"), F.explode(prefixes(F.col("stem"))).alias("stem")).where("stem <> longer").join(kept.select("stem"), "stem", "left_semi").select(F.col("longer").alias("stem")).distinct()
    return kept.join(longer, "stem", "left_anti")


def halves(words: DataFrame, word: str) -> DataFrame:
    """words with (a, b) for each way to cut the word in two."""
    cut = words.where(F.length(word) >= 2).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(word) - 1)))
    return cut.withColumns({"a": F.substring(word, F.lit(1), F.col("_i")), "b": F.substring(word, F.col("_i") + 1, F.length(word))}).drop("_i")


def decomposable(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (stem) that are two known stems put together: both halves of some split are known."""
    k = known.select(F.col("stem").alias("k")).distinct()
    return halves(candidates.select("stem"), "stem").join(k.withColumnRenamed("k", "a"), "a", "left_semi").join(k.withColumnRenamed("k", "b"), "b", "left_semi").select("stem").distinct()


def filter_by_length(entries: DataFrame, seed: DataFrame, longest: int = LONGEST_STEM) -> DataFrame:
    """Entries kept by increasing length unless they decompose into what is kept already; one pass for each length."""
    kept = written(seed.select("stem").distinct(), "kept")
    out = entries.limit(0)
    for n in range(1, longest + 1):
        now = entries.where(F.length("stem") == n)
        now = written(now.join(decomposable(now, kept), "stem", "left_anti"), f"kept-{n}")
        out = out.unionByName(now)
        kept = kept.unionByName(now.select("stem"))
    return out
