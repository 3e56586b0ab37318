"""Characters, kana, and tests on words."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from morilex.functions import chars, kana


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("s, expected", [("대한", False), ("ｱｸｱﾄﾞﾗｲ", False), ("アクアドライ®", False), ("アクアドライ", True), ("ABCD", False), ("ＡＢ", True), ("颭顇", False), ("монгол", True), ("长白", False), ("", False)])
def test_euc_convertible(s, expected):
    assert kana.euc_convertible(s) is expected


@pytest.mark.parametrize("stem, expected", [("あー", False), ("リー", False), ("げげげ", True), ("あああ", False), ("り患し", False)])
def test_vowel_verb_stems(spark, stem, expected):
    assert one(spark, chars.stem_allowed(F.col("s"), "母音動詞"), s=stem) is expected


@pytest.mark.parametrize("midasi, expected", [("ばしご", "はしご"), ("ごたつ", "こたつ")])
def test_voicing_is_undone_where_marked(spark, midasi, expected):
    assert one(spark, chars.unvoice(F.col("m"), F.col("i")), m=midasi, i="濁音化 D") == expected
    assert one(spark, chars.unvoice(F.col("m"), F.col("i")), m=midasi, i="") == midasi


def test_weighted_distance():
    assert kana.weighted_distance("おかあさん", "おかーさん") == pytest.approx(0.3)
    assert kana.weighted_distance("たかい", "たけー") == pytest.approx(1 - 0.6)
    assert kana.weighted_distance("", "あ") == 1
    assert kana.weighted_distance("やっぱり", "やぱり") == pytest.approx(0.3)


@pytest.mark.parametrize("alphabet", ["かいけー", "ないねー", "こうおー〜", "あえーっつ", "やゃいーっ"])
def test_near_keys_bring_all_near_readings_together(alphabet):
    words = ["".join(p) for n in range(4) for p in product(alphabet, repeat=n)]
    keys = {w: kana.near_keys(w) for w in words}
    near = {(a, b) for a in words for b in words if kana.weighted_distance(a, b) <= kana.NEAR}
    assert len(near) > len(words) and not [x for x in near if keys[x[0]][0] not in keys[x[1]] and keys[x[1]][0] not in keys[x[0]]]


def test_romanize_and_base_verbs():
    assert kana.romanize("こーひー") == "ko.o.hi.i."
    assert kana.romanize("っぽ") == "Q.po."
    assert kana.base_verb("書ける") == ("書く", "子音動詞カ行")
    assert kana.base_verb("見る") is None


def test_romanize_takes_any_character():
    assert kana.romanize("$B$.$+(B") == "$B$.$+(B"  # garbled ぎか
    assert kana.romanize("か.ー") == "ka..ー" and kana.romanize("..") == ".."


def test_kanji_variants_are_all_combinations():
    assert list(kana.kanji_variants("国学", {"国": "國", "学": "學"})) == ["国學", "國学", "國學"]
    assert sum(1 for _ in kana.kanji_variants("国" * 11, {"国": "國圀"})) == 3**11 - 1  # whatever their number
    assert list(kana.kanji_variants("", {})) == []


def test_kanji_variants_as_rows(spark):
    df = spark.createDataFrame([("国" * 9, 1), ("学", 2), (None, 3)], "w string, i int")
    got = kana.explode_variants(df, "w", {"国": "國圀", "学": "學"}, chunk=1000)
    assert got.count() == 3**9 - 1 + 1 and got.where("i = 2").first()["variant"] == "學"


def test_reading_and_repname(spark):
    k, unsure = chars.reading(F.col("s"))
    assert one(spark, k, s="ファボる") == "ふぁぼる" and one(spark, unsure, s="ファボる") is False and one(spark, unsure, s="漢字る") is True
    assert one(spark, chars.repname(F.col("s"), F.col("y")), s="ＡＢ", y="えーびー") == "AB/えーびー"


def test_udfs_keep_nulls(spark):
    df = spark.createDataFrame([(None,), ("か",)], "s string")
    assert [r[0] for r in df.select(kana.romanize_udf("s")).collect()] == [None, "ka."]
