"""Readers, writers and streams."""

import os
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from morilex.plans import streams
from morilex.sources import sexp, texts
from morilex.streaming import stateful

DIC = """
; count: 80046
; stem: 痒
(形容詞 ((見出し語 痒い (かゆい 1.6)) (読み かゆい) (活用型 イ形容詞イ段) (意味情報 "自動獲得:テキスト 印")))
(指示詞 (連体詞形態指示詞 ((見出し語 この) (読み この)) ((見出し語 その) (読み その))))
(連語 ((名詞 (普通名詞 ((見出し語 恵み めぐみ) (読み めぐみ)))) (形容詞 ((見出し語 多い おおい) (読み おおい) (活用型 イ形容詞アウオ段)))))
"""


def test_entries():
    a, b, c, d = sexp.entries(DIC)
    assert a["midasi"] == {"痒い": 1.0, "かゆい": 1.6} and a["annotation"] == {"count": "80046", "stem": "痒"} and a["imis"] == {"自動獲得": "テキスト", "印": None}
    assert (b["bunrui"], c["bunrui"]) == ("連体詞形態指示詞",) * 2 and set(b["midasi"]) == {"この"}
    assert d["midasi"] == {"恵み多い": -1.0, "恵みおおい": -1.0, "めぐみ多い": -1.0, "めぐみおおい": -1.0}


def test_round_trip():
    for e in list(sexp.entries(DIC))[:3]:
        assert next(sexp.entries(sexp.serialize(e))) == e


@pytest.mark.parametrize("text", ["(a", "a)", '(a "b)', "x"])
def test_broken_expressions(text):
    with pytest.raises(sexp.SexpError):
        list(sexp.parse(text))


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.dic").write_text(DIC, encoding="utf-8")
    df = sexp.read_dictionary(spark, str(tmp_path))
    assert df.count() == 4
    out = str(tmp_path / "out")
    sexp.write_dictionary(df.where("hinsi <> '連語'"), out)
    again = sexp.read_dictionary(spark, out, "part-*")
    assert {(r["hinsi"], tuple(sorted(r["midasi"]))) for r in again.collect()} == {(r["hinsi"], tuple(sorted(r["midasi"]))) for r in df.where("hinsi <> '連語'").collect()}


def test_analysed_text(spark, tmp_path):
    text = "#document d1 example.jp\n# S-ID:1-1\n* 1D\n+ 1D\n本 ほん 本 名詞 6 普通名詞 1 * 0 * 0 \"代表表記:本/ほん\" <漢字>\n@ 本 もと 本 名詞 6 普通名詞 1 * 0 * 0 NIL\n* -1D\n読む よむ 読む 動詞 2 * 0 子音動詞マ行 9 基本形 2 NIL <用言>\nEOS\n# S-ID:1-2\n* -1D\nあ あ あ 感動詞 12 * 0 * 0 * 0 NIL\nEOSxx\n"
    (tmp_path / "x.txt").write_text(text, encoding="utf-8")
    rows = texts.read_analysis(spark, str(tmp_path)).orderBy("sent_id", "pos", "homograph").collect()
    assert [(r["doc_id"], r["domain"], r["sent_id"], r["pos"], r["bnst_idx"], r["midasi"], r["homograph"]) for r in rows] == [("d1", "example.jp", "1-1", 0, 0, "本", False), ("d1", "example.jp", "1-1", 0, 0, "本", True), ("d1", "example.jp", "1-1", 1, 1, "読む", False), ("d1", "example.jp", "1-2", 0, 0, "あ", False)]
    assert rows[0]["imis"] == "代表表記:本/ほん" and rows[2]["katuyou1"] == "子音動詞マ行"


def test_raw_documents_and_bitext(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#document\td1\nいち\n\nに\n#document\td2\nさん\n", encoding="utf-8")
    assert sorted((r["doc_id"], r["raw"]) for r in texts.read(spark, rawdata=str(tmp_path)).collect()) == [("d1", "いち"), ("d1", "に"), ("d2", "さん")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_text("p-1-2\tb\np-1-1\ta\nbroken\n", encoding="utf-8")
    assert sorted((r["doc_id"], r["sent_id"], r["raw"]) for r in texts.read_bitext(spark, str(tmp_path / "b"), True).collect()) == [("p-1", 1, "a"), ("p-1", 2, "b")]
    with pytest.raises(ValueError):
        texts.read(spark, unknown="x")


def test_standard_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<StandardFormat Url="http://h.example/p"><Text><S Id="1" is_Japanese_Sentence="1"><RawString>はい</RawString></S><S Id="2" is_Japanese_Sentence="0"><RawString>no</RawString></S><S Id="3" is_Normal_Sentence="1"><RawString>ええ</RawString></S></Text></StandardFormat>', encoding="utf-8")
    got = texts.read_standard_xml(spark, str(tmp_path)).orderBy("sent_id").collect()
    assert [(r["domain"], r["sent_id"], r["raw"]) for r in got] == [("h.example", "1", "はい"), ("h.example", "3", "ええ")]


def test_instances_and_variants(spark, tmp_path):
    (tmp_path / "i.txt").write_text("本\t1?2\tpage\t3:7 9:2\n", encoding="utf-8")
    r = texts.read_instances(spark, str(tmp_path / "i.txt")).first()
    assert [(x["fid"], x["v"]) for x in r["feats"]] == [(3, 1.0), (9, 1.0)]
    (tmp_path / "v.txt").write_text("# x\nU+56FD\tkTraditionalVariant\tU+570B\n", encoding="utf-8")
    assert {tuple(x) for x in texts.read_variants(spark, str(tmp_path / "v.txt")).collect()} == {("U+56FD", "U+570B", "T"), ("U+570B", "U+56FD", "T2")}


def test_stream_is_as_the_batch(spark, tmp_path):
    sf = tmp_path / "sf"
    rows = [(i, i % 3, "ab"[i % 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string")
    df.repartition(5).write.parquet(str(sf / "events.parquet"))
    s = stateful.table_stream(spark, str(sf), "events", files=2)  # several micro-batches
    got = stateful.latest(stateful.run_to_end(stateful.accumulate(s, ["user_id", "event_type"], 3), "t"), ["user_id", "event_type"])
    expected = {(r[0], r[1], r[2]) for r in df.groupBy("user_id", "event_type").count().collect()}
    assert {(r["user_id"], r["event_type"], r["n"]) for r in got.collect()} == expected
    m = stateful.latest(stateful.run_to_end(stateful.monitor(stateful.table_stream(spark, str(sf), "events", files=2), "user_id", "event_type", 4), "m"), ["user_id"])
    assert all(r["total"] == 10 and r["decision"] in "ab" for r in m.collect())
    assert os.path.isdir(sf)


def test_days_of_unordered_files_all_count(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, event_type string"
    days = [datetime(2024, 3, d, 23) for d in (28, 2, 15, 9, 28, 2, 21)]
    for i, day in enumerate(days):  # one file each, the newest day first
        rows = [(i, day, "a"), (i, day, "b"), (i, None, "a")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    s = stateful.table_stream(spark, str(tmp_path), "events", files=2).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    got = stateful.latest(stateful.run_to_end(stateful.windowed_counts(s, "ts", "event_type"), "w"), ["start", "event_type"])
    expected = Counter((d and d.replace(hour=0), k) for day in days for d, k in ((day, "a"), (day, "b"), (None, "a")))
    assert {(r["start"], r["event_type"]): r["n"] for r in got.withColumn("start", F.col("start").cast("timestamp_ntz")).collect()} == expected


def test_streams_read_and_write_behind_uris(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spark, "_morilex_shared", f"file:{tmp_path}/shared", raising=False)
    spark.createDataFrame([(i, i % 2, "a", datetime(2024, 3, 1 + i % 3)) for i in range(12)], "event_id long, user_id long, event_type string, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "sf/events.parquet"))
    for sf in (f"{tmp_path}/sf", f"file:{tmp_path}/sf"):
        assert [r["n"] for r in streams.st04_accumulate(spark, sf).collect()] == [6, 6]
        assert [r["total"] for r in streams.st05_monitor(spark, sf).collect()] == [6, 6]
        assert [r["n"] for r in streams.st01_windowed_counts(spark, sf).collect()] == [4, 4, 4]
    spark.createDataFrame([], "event_id long, user_id long, event_type string").coalesce(1).write.parquet(str(tmp_path / "none/events.parquet"))
    assert streams.st04_accumulate(spark, f"file:{tmp_path}/none").collect() == []
