"""Inflection, detection, dictionaries, analysers, case frames."""

import pytest
from pyspark.sql import functions as F

from morilex.functions import kana, morphology
from morilex.operators import caseframes, detect, dictionaries
from morilex.sources import analysers, texts


def test_inflection(spark):
    df = spark.createDataFrame([("ファボ", "子音動詞ラ行"), ("食べ", "母音動詞"), ("本", None)], "stem string, kind string")
    assert {r["stem"]: r["genkei"] for r in morphology.dictionary_form(df, "stem", "kind").collect()} == {"ファボ": "ファボる", "食べ": "食べる", "本": "本"}
    df = spark.createDataFrame([("書いた", "子音動詞カ行", "タ形"), ("泳いで", "子音動詞ガ行", "タ系連用テ形"), ("本", None, None)], "s string, kind string, form string")
    assert {r["s"]: (r["stem"], r["ending"]) for r in morphology.stem_and_ending(df, "s", "kind", "form").collect()} == {"書いた": ("書", "いた"), "泳いで": ("泳", "いで"), "本": ("本", "")}
    df = spark.createDataFrame([("読む", "子音動詞マ行"), ("本", None)], "s string, kind string")
    assert {r["s"]: r["changed"] for r in morphology.change_form(df, "s", "kind", "基本形", "タ形").collect()} == {"読む": "読んだ", "本": None}


def test_fold_skips_and_holds(spark):
    rows = [(["ア", "っ", "イ", "ウ", "エ", "。", "オ"], ["X", None, None, None, "X", None, "X"]), (["っ", "ア", "イ", "ウ"], ["SKIP", "X", "X", "X"]), ([], [])]
    df = spark.createDataFrame(rows, "w array<string>, f array<string>")
    assert [r[0] for r in df.select(detect.fold_detections(F.col("w"), F.col("f"))).collect()] == [[0, 6], [3], []]


def test_take_while_and_boundaries(spark):
    df = spark.createDataFrame([(["に", "つい", "漢", "て"],), ([],)], "w array<string>")
    assert [tuple(r) for r in df.select(detect.take_while(F.col("w"), "^[一-鿿]"), detect.boundaries(F.col("w"), 3)).collect()] == [("につい", [1, 3]), ("", [])]


def test_suspicious_pairs(spark):
    pairs = spark.createDataFrame([("かける", "する", 500), ("懸ける", "する", 0), ("駆ける", "足", 5)], "a string, b string, n long")
    uni = spark.createDataFrame([("かける", 600), ("懸ける", 100_000)], "w string, n long")
    other = spark.createDataFrame([("かける", "懸ける"), ("駆ける", "懸ける")], "a string, other string")
    got = {r["a"]: r["suspicious"] for r in detect.suspicious_pairs(pairs, uni, other).collect()}
    assert got["かける"] is True and got["駆ける"] is True


def test_registration_order_and_conflicts(spark):
    found = spark.createDataFrame([("ふぁぼ", "子音動詞ラ行", 3), ("を", "普通名詞", 9), ("っぽ", "普通名詞", 4), ("既知", "普通名詞", 4), ("アイ", "普通名詞", 4)], "stem string, pos_s string, cnt long")
    known = spark.createDataFrame([("既知", "普通名詞")], "stem string, pos_s string")
    suf = spark.createDataFrame([("を",)], "suffix string")
    assert {r["stem"]: r["outcome"] for r in dictionaries.register(found, known, suf, safe=True).collect()} == {"ふぁぼ": "registered", "を": "function word", "っぽ": "malformed", "既知": "known", "アイ": "unsafe"}
    v = spark.createDataFrame([("切", "子音動詞ラ行"), ("切", "母音動詞"), ("書い", "母音動詞"), ("書", "子音動詞カ行"), ("見", "母音動詞")], "stem string, pos_s string")
    assert {tuple(r) for r in dictionaries.without_conflicts(v).select("stem", "pos_s").collect()} == {("切", "子音動詞ラ行"), ("書", "子音動詞カ行"), ("見", "母音動詞")}


def test_cleaned_and_majority(spark):
    e = spark.createDataFrame([("本当", "普通名詞", 5), ("カタカナ", "普通名詞", 5), ("止め", "普通名詞", 50), ("に", "普通名詞", 50)], "stem string, pos_s string, cnt long")
    got = dictionaries.cleaned(e, spark.createDataFrame([("に",)], "suffix string"), spark.createDataFrame([("止め",)], "stem string"), 4)
    assert {r["stem"] for r in got.collect()} == {"本当"}
    rivals = spark.createDataFrame([("a", "普通名詞", 2.0, 3), ("a", "ナ形容詞", 5.0, 2), ("b", "普通名詞", 9.0, 1), ("b", "副詞", 1.0, 7)], "stem string, pos_s string, score double, cnt long")
    assert {r["stem"]: (r["pos_s"], r["cnt"]) for r in dictionaries.majority(rivals).collect()} == {"a": ("ナ形容詞", 5), "b": ("副詞", 8)}


def test_variants_and_similarity(spark):
    rows = [(1, "おかあさんたち", "名詞", "普通名詞", None), (2, "おかーさんたち", "名詞", "普通名詞", None), (3, "おとうさんたち", "名詞", "普通名詞", None), (4, "おかあさんたち", "動詞", None, "母音動詞")]
    e = spark.createDataFrame(rows, "entry_id long, yomi string, hinsi string, bunrui string, katuyou1 string")
    got = {(r["a"], r["b"]): r["distance"] for r in dictionaries.variants_by_distance(e).collect()}
    assert (1, 2) in got and got[1, 2] == pytest.approx(0.3) and (1, 4) not in got
    f = spark.createDataFrame([("x", "p", 3.0), ("x", "q", 4.0), ("y", "p", 3.0), ("y", "q", 4.0), ("z", "r", 1.0)], "item string, feature string, n double")
    c = {(r["a"], r["b"]): r["cosine"] for r in dictionaries.similar(f, spark.createDataFrame([("x", "y"), ("x", "z")], "a string, b string")).collect()}
    assert c["x", "y"] == pytest.approx(1) and c["x", "z"] == 0


def close_readings(rows, most_distance):
    """variants_by_distance of (entry_id, yomi, hinsi, bunrui, katuyou1), pair by pair; all nouns."""
    hira = lambda s: "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in s)
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    out = {}
    for i, x, *_ in rows:
        for j, y, *_ in rows:
            if i < j and x and y and abs(len(x) - len(y)) <= 2:
                a, b = grams(kana.romanize(hira(x))), grams(kana.romanize(hira(y)))
                d = kana.weighted_distance(hira(x), hira(y))
                if a and b and len(a & b) / min(len(a), len(b)) >= 0.6 and d <= most_distance:
                    out[i, j] = round(d, 6)
    return out


@pytest.mark.parametrize("most_distance", [0.5, 1.0])
def test_variants_are_all_pairs(spark, most_distance):
    stem = ["おかあさんたち", "おかーさんたち", "オカアサンタチ", "おっかあさんたち", "おかさんたち", "おとうさんたち", "せかいのまち", "せけーのまち", "せけのまち", "せかけーのまち", "せけかいのまち", "きょうかいしつ", "きようかいしつ", "きょうけーしつ", "あ", "い", "っー", "", None]
    rows = [(i, y, "名詞", "普通名詞", None) for i, y in enumerate(stem * 2)]
    e = spark.createDataFrame(rows, "entry_id long, yomi string, hinsi string, bunrui string, katuyou1 string")
    got = [tuple(r) for r in dictionaries.variants_by_distance(e, most_distance=most_distance).collect()]
    expected = close_readings(rows, most_distance)
    assert len(got) == len(set(got)) and {(a, b): d for a, b, d in got} == expected and {0.0, 0.3, 0.4} <= set(expected.values())


def test_variants_are_not_sought_by_trigrams(spark, monkeypatch):
    """There are too few trigrams of romanised kana: each brought a large part of all entries together."""
    monkeypatch.setattr(dictionaries, "overlap_pairs", None)
    e = spark.createDataFrame([(1, "くうこう", "名詞", None, None), (2, "くーこう", "名詞", None, None)], "entry_id long, yomi string, hinsi string, bunrui string, katuyou1 string")
    assert dictionaries.variants_by_distance(e, least_overlap=0.0).count() == 0  # no long mark for u after ku
    assert dictionaries.variants_by_distance(e.withColumn("yomi", F.translate("yomi", "く", "こ"))).count() == 1


def test_versions(spark, tmp_path):
    path = str(tmp_path / "dic")
    with pytest.raises(FileNotFoundError):
        dictionaries.current(spark, path)
    one = spark.createDataFrame([("a",)], "stem string")
    assert dictionaries.publish(one, path) == 1 and dictionaries.append(spark.createDataFrame([("b",)], "stem string"), path) == 2
    (tmp_path / "dic" / "version=3").mkdir()  # a write that broke off
    assert {r["stem"] for r in dictionaries.current(spark, path).collect()} == {"a", "b"}


def test_analyser_restarts_and_round_trip(spark):
    class Flaky(analysers.LongestMatch):
        calls = 0

        def analyse(self, text):
            Flaky.calls += 1
            if text == "broken":
                raise RuntimeError
            return super().analyse(text)

    df = spark.createDataFrame([("ファボるを見た",), ("broken",), (None,)], "t string").coalesce(1)
    got = analysers.analyse(df, "t", lambda: analysers.LongestMatch({"ファボる": "動詞", "を": "助詞"})).withColumn("raw", analysers.raw_of("words")).collect()
    assert [w["midasi"] for w in got[0]["words"]][:2] == ["ファボる", "を"] and got[0]["raw"] == "ファボるを見た" and got[2]["words"] is None


def test_case_frames(spark, tmp_path):
    text = "\n".join(["# S-ID:1", "* 1D <係:ノ格>", "母 はは 母 名詞 6 普通名詞 1 * 0 * 0 NIL", "の の の 助詞 9 接続助詞 3 * 0 * 0 NIL", "* 2D <係:ヲ格>", "本 ほん 本 名詞 6 普通名詞 1 * 0 * 0 NIL", "を を を 助詞 9 格助詞 1 * 0 * 0 NIL", "* -1D <用言:動><否定表現>", "読ま よま 読む 動詞 2 * 0 子音動詞マ行 9 未然形 3 NIL", "EOS", ""])
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    m = texts.read_analysis(spark, str(tmp_path)).where("not homograph").withColumn("repname", F.lit(None).cast("string"))
    b = texts.read_phrases(spark, str(tmp_path)).withColumn("doc_id", F.lit("d"))
    m = m.withColumn("doc_id", F.lit("d"))
    assert [(r["predicate"], r["case"], r["argument"], r["adjacent"]) for r in caseframes.arguments(b, m).collect()] == [("読む+N", "ヲ", "本", True)]
    assert {(r["noun"], r["ftype"], r["fname"]) for r in caseframes.noun_frames(b, m).collect()} == {("本", "cf", "ヲ:読む+N"), ("母", "ncf1", "本"), ("本", "ncf2", "母")}
