"""Queries over small tables, against counts in plain Python."""

import math
import re
from collections import Counter, defaultdict

from morilex.functions import chars
from morilex.plans import evaluate, filters, lexicon, scans


def test_position_map_has_every_line_and_place(spark, tmp_path):
    texts = ["\n".join(f"猫 w{'ab'[i % 2]}" for i in range(45)), " ".join(["犬 x"] * 30), None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    n, words = Counter(), defaultdict(set)
    for text in texts:
        for line_no, line in enumerate((text or "").split("\n"), 1):
            for place, word in enumerate(re.findall(chars.TOKEN, line), 1):
                n[line_no, place] += 1
                words[line_no, place].add(word)
    got = {(r["line_no"], r["place"]): (r["n"], r["words"]) for r in scans.proj08_position_map(spark, str(tmp_path)).collect()}
    assert (45, 2) in got and (1, 60) in got
    assert got == {k: (n[k], len(words[k])) for k in n}


def labelled(spark, tmp_path):
    """A folder of documents in five languages, and the words of each language counted."""
    docs = [("ja", "猫 犬 猫 犬 猫"), ("JA", "猫 鳥 鳥"), ("ja-JP", "鳥 cat"), ("jpn", "cat"), ("en", "cat dog cat dog cat"), ("EN", "dog pig pig"), ("ko", "cat pig PC PC PC"), ("pt", "gato gato gato PC"), ("it", "gato cat"), (None, "cat cat"), ("", "pig pig"), ("und", "pig")]
    rows = [(i, "d", "s", lang, text) for i, (lang, text) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, domain string, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counted = defaultdict(Counter)
    for lang, text in docs:
        if lang and lang != "und":
            counted["ja" if lang in ("JA", "ja-JP", "jpn") else lang.lower()].update(text.split())
    return str(tmp_path), counted


def test_distinctive_words_of_every_pair_of_languages(spark, tmp_path):
    sf, counted = labelled(spark, tmp_path)
    expected = {}
    for a, own in counted.items():
        for b in set(counted) - {a}:
            if lacked := [n for w, n in own.items() if n >= 2 and w not in counted[b]]:
                expected[a, b] = (len(lacked), sum(lacked))
    assert ("ja", "ko") in expected and ("it", "ja") not in expected
    assert {(r["lang"], r["other"]): (r["distinctive"], r["mass"]) for r in filters.f25_distinctive(spark, sf).collect()} == expected


def test_naive_bayes_has_every_label(spark, tmp_path):
    sf, counted = labelled(spark, tmp_path)
    expected = {(lang, w): round(math.log(n / own.total()), 6) for lang, own in counted.items() for w, n in own.items() if n >= 3}
    assert {lang for lang, _ in expected} == {"ja", "en", "ko", "pt"}
    assert {(r["label"], r["feature"]): r["log_p"] for r in evaluate.ml12_naive_bayes(spark, sf).collect()} == expected


def test_variants_of_readings_in_any_script_and_length(spark, tmp_path):
    yomi = ["カード", "カド", "かーど", "か", "かー", "みヵづき", "みかづき", "CDやっき", "CDやき", "ã¹ã‚Œ", "ã¹ã‚Œ", "ばいと", "", "", None, None]
    rows = [(i, y, "名詞", "普通名詞", None) for i, y in enumerate(yomi)] + [(100, "カード", "副詞", None, None)]
    spark.createDataFrame(rows, "entry_id long, yomi string, hinsi string, bunrui string, katuyou1 string").write.parquet(str(tmp_path / "dictionary.parquet"))
    got = [tuple(r) for r in lexicon.j14_variants_by_distance(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(0, 1, 0.3), (0, 2, 0.0), (1, 2, 0.3), (3, 4, 0.3), (5, 6, 0.3), (7, 8, 0.3), (9, 10, 0.0)]
