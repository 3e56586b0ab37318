"""Inflection, parts of speech and n-gram keys, as JVM expressions over the columns of morphemes and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of consonant verbs: the kana of the columns a, i, u, e, o, and the sound-changed ending before た.
_ROWS = {"カ": ("かきくけこ", "いた"), "ガ": ("がぎぐげご", "いだ"), "サ": ("さしすせそ", "した"), "タ": ("たちつてと", "った"), "バ": ("ばびぶべぼ", "んだ"), "マ": ("まみむめも", "んだ"), "ラ": ("らりるれろ", "った"), "ワ": ("わいうえお", "った")}
_COLUMNS = ("未然形", "基本連用形", "基本形", "命令形", "意志形")


def inflections() -> list[tuple[str, str, str]]:
    """(inflection type, form, ending): by rule for consonant verbs; the regular endings of the other types."""
    out = []
    for row, (kana, ta) in _ROWS.items():
        kind = f"子音動詞{row}行"
        out += [(kind, form, k if form != "意志形" else k + "う") for form, k in zip(_COLUMNS, kana)]
        out += [(kind, "タ形", ta), (kind, "タ系連用テ形", ta[:-1] + ("て" if ta[-1] == "た" else "で")), (kind, "基本条件形", kana[3] + "ば")]
    out += [("母音動詞", f, e) for f, e in (("基本形", "る"), ("未然形", ""), ("基本連用形", ""), ("命令形", "ろ"), ("意志形", "よう"), ("タ形", "た"), ("タ系連用テ形", "て"), ("基本条件形", "れば"))]
    out += [(k, f, e) for k in ("サ変動詞",) for f, e in (("基本形", "する"), ("未然形", "し"), ("基本連用形", "し"), ("命令形", "しろ"), ("意志形", "しよう"), ("タ形", "した"), ("タ系連用テ形", "して"), ("基本条件形", "すれば"))]
    out += [("ザ変動詞", f, e) for f, e in (("基本形", "ずる"), ("未然形", "じ"), ("基本連用形", "じ"), ("命令形", "じろ"), ("タ形", "じた"), ("タ系連用テ形", "じて"))]
    out += [(k, f, e) for k in ("イ形容詞アウオ段", "イ形容詞イ段") for f, e in (("基本形", "い"), ("基本連用形", "く"), ("タ形", "かった"), ("タ系連用テ形", "くて"), ("基本条件形", "ければ"), ("語幹", ""))]
    out += [(k, f, e) for k in ("ナ形容詞", "ナノ形容詞") for f, e in (("基本形", "だ"), ("ダ列基本連体形", "な"), ("ダ列基本連用形", "に"), ("ダ列タ形", "だった"), ("語幹", ""))]
    return out


def inflection_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(inflections(), "katuyou1 string, katuyou2 string, ending string")


def dictionary_form(df: DataFrame, stem: str, kind: str) -> DataFrame:
    """Adds `genkei`: stem and basic ending of its inflection type; what does not inflect stays."""
    t = inflection_table(df.sparkSession).where("katuyou2 = '基本形'").select(F.col("katuyou1").alias("_k"), "ending")
    return df.join(F.broadcast(t), df[kind] == F.col("_k"), "left").withColumn("genkei", F.concat(stem, F.coalesce("ending", F.lit("")))).drop("_k", "ending")


def stem_and_ending(df: DataFrame, surface: str, kind: str, form: str) -> DataFrame:
    """Adds `stem` and `ending` of an inflected surface; without an inflection the surface is the stem."""
    t = inflection_table(df.sparkSession).select(F.col("katuyou1").alias("_k"), F.col("katuyou2").alias("_f"), "ending")
    j = df.join(F.broadcast(t), (df[kind] == F.col("_k")) & (df[form] == F.col("_f")), "left").drop("_k", "_f")
    n = F.length(surface) - F.length(F.coalesce("ending", F.lit("")))
    fits = F.col(surface).endswith(F.coalesce("ending", F.lit("")))
    return j.withColumn("stem", F.when(fits, F.substring(surface, F.lit(1), n)).otherwise(F.col(surface))).withColumn("ending", F.when(fits, F.coalesce("ending", F.lit(""))).otherwise(""))


def change_form(df: DataFrame, surface: str, kind: str, source: str, target: str) -> DataFrame:
    """Adds `changed`: the surface in form `target` instead of form `source` of its inflection type."""
    t = inflection_table(df.sparkSession)
    a = t.where(F.col("katuyou2") == source).select(F.col("katuyou1").alias("_a"), F.col("ending").alias("_from"))
    b = t.where(F.col("katuyou2") == target).select(F.col("katuyou1").alias("_b"), F.col("ending").alias("_to"))
    j = df.join(F.broadcast(a), df[kind] == F.col("_a"), "left").join(F.broadcast(b), df[kind] == F.col("_b"), "left")
    stem = F.substring(surface, F.lit(1), F.length(surface) - F.length("_from"))
    return j.withColumn("changed", F.when(F.col(surface).endswith(F.col("_from")), F.concat(stem, "_to"))).drop("_a", "_b", "_from", "_to")


def ngram_class(hinsi: Column, bunrui: Column, katuyou2: Column) -> Column:
    """Class of a word in the n-gram model: subclass or class, with the inflected form."""
    return F.concat(F.lit("<"), F.when(hinsi == "名詞", F.coalesce(bunrui, hinsi)).otherwise(hinsi), F.coalesce(F.concat(F.lit(":"), katuyou2), F.lit("")), F.lit(">"))


def abstract_class(word_class: Column) -> Column:
    """The class without its inflected form."""
    return F.regexp_replace(word_class, ":[^>]*>$", ">")


def ngram_word(genkei: Column, repname: Column, word_class: Column, content: Column, listed: Column) -> Column:
    """Key of a word: spelling kept only where its representative name has spellings to choose from."""
    return F.when(content & listed, F.concat_ws("-", genkei, repname, word_class)).when(content, F.concat_ws("-", repname, word_class)).otherwise(genkei)


def original_tag(fstring: Column, hinsi: Column) -> Column:
    """Part of speech before a change that the analysis marks."""
    return F.coalesce(F.nullif(F.regexp_extract(fstring, r"<品詞変更:[^>-]+-[^>-]+-[^>-]+-([^>-]+)-", 1), F.lit("")), hinsi)


def representative(imis: Column, midasi: Column, yomi: Column) -> Column:
    """Representative name: the one marked, else spelling and reading."""
    return F.coalesce(F.try_element_at(imis, F.lit("代表表記")), F.concat_ws("/", midasi, F.coalesce(yomi, F.lit(""))))


def feature(fstring: Column, name: str) -> Column:
    """Value of <name:value> in a feature string; '' for <name>; null if it is not there."""
    return F.when(fstring.contains(f"<{name}>"), "").when(fstring.contains(f"<{name}:"), F.regexp_extract(fstring, f"<{name}:([^>]*)>", 1))
