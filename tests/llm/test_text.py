"""Problems 1, 5, 6, 7 against fixtures and brute force."""

import time
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from morilex.llm import boilerplate, lookalike, mojibake, sentences

DICT = "entry_id long, midasi map<string,double>, yomi string, extra string"
SENT = "row_id long, document_id string, unit string, raw string, canonical string"


def test_lookalikes_are_found_and_words_stay_apart(spark, sf):
    same = ["タロカ", "夕口力", "ﾀﾛｶ", "タ​ロカ", "タロ﻿カ", "タロ︀カ"]
    other = ["ダロカ", "タロガ", "ツ", "シ", "ン", "ソ", "か", "カ゛", "ガ", "", None]
    lines = [*same, *other, "Café", "Café", "Cafe", "a b", "a b", "a b", "タロカ", "Ａ１", "A1", "А1"]
    d = sf(dictionary=([(1, {"へペ": 1.0, "x": 2.0}, None, "e"), (2, {"ヘぺ": 1.0}, "y", "e"), (3, {}, None, None), (4, None, None, None)], DICT), sentences=([(i, None, "line", x, "c") for i, x in enumerate(lines)] + [(100, None, "block", "夕ロカ", "c")], SENT))
    got = {tuple(r) for r in lookalike.p1_found(spark, d).collect()}
    key = {}
    for i, x in enumerate(lines):
        if x:
            key[i] = "T" if x in same else "GA" if x in ("カ゛", "ガ") else "CAFE" if unicodedata.normalize("NFC", x) == "Café" else "AB" if x.replace(" ", " ").replace(" ", " ") == "a b" else "A1" if x in ("Ａ１", "A1", "А1") else x
    expected = {("sentences", i, j) for i in key for j in key if i < j and key[i] == key[j] and lines[i] != lines[j]} | {("dictionary", 1, 2)}
    assert got == expected
    forms = {r["id"]: r["canonical"] for r in lookalike.p1_canonical(spark, d).where("tbl = 'sentences'").collect()}
    assert len({forms[i] for i in range(len(same))}) == 1 and forms[0] == "タロカ"  # the form that occurs most often
    assert forms[lines.index("ダロカ")] == "ダロカ"


def test_many_copies_of_one_sentence(spark, sf):
    """Copies are one text: 10,000 of one sentence and three of its variant give 30,000 pairs, none among the copies."""
    rows = [(i, None, "line", "タロカを読む。" if i >= 3 else "夕ロ力を読む。", "") for i in range(10_003)]
    d = sf(dictionary=([], DICT), sentences=(rows, SENT))
    got = lookalike.p1_found(spark, d)
    assert got.count() == 30_000 and got.where("id_a < 3 and id_b >= 3").count() == 30_000


@pytest.mark.parametrize("a, b", [("αιρυ", "aipu"), ("κ", "к"), ("ΑΒ", "AB"), ("Ԁ", "Ԁ"), ("ɑ", "ɑ"), ("Іван", "Iван"), ("Տ", "S"), ("ℬ", "B"), ("⼝", "口"), ("ロ", "口")])
def test_public_confusables_are_folded(spark, frame, a, b):
    r = frame([(a, b)], "a string, b string").select(lookalike.folded(spark, F.col("a")).alias("a"), lookalike.folded(spark, F.col("b")).alias("b")).first()
    assert r["a"] == r["b"]


@pytest.mark.parametrize("a, b", [("士", "土"), ("日", "曰"), ("未", "末"), ("1", "l"), ("0", "O"), ("З", "3"), ("シ", "ツ"), ("I", "l"), ("m", "rn")])
def test_different_characters_stay_apart(spark, frame, a, b):
    r = frame([(a, b)], "a string, b string").select(lookalike.folded(spark, F.col("a")).alias("a"), lookalike.folded(spark, F.col("b")).alias("b")).first()
    assert r["a"] != r["b"]


def test_garbled_text_takes_no_part_in_lookalikes(spark, sf):
    bad = "表記".encode().decode("cp932", "replace")
    d = sf(dictionary=([], DICT), sentences=([(1, None, "line", bad, ""), (2, None, "line", bad + "​", "")], SENT))
    assert lookalike.p1_found(spark, d).count() == 0


TEXTS = ["かぼちゃと表記の話です。", "モルフォロジーを調べた。", "Das Büchlein für die Straße.", "Сосед купил зонтик."]


@pytest.mark.parametrize("true, wrong", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "koi8_r"), ("euc_jp", "latin-1"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("cp932", "cp1252"), ("euc_jp", "cp932")])
def test_wrong_decodings_are_found(true, wrong):
    for text in TEXTS if true == "utf-8" else TEXTS[:2]:
        try:
            bad = text.encode(true).decode(wrong, "strict" if wrong != "cp1252" else "replace")
        except UnicodeError:
            continue
        if bad != text:
            assert mojibake.repair(bad)[1] != "clean", (bad, true, wrong)


@pytest.mark.parametrize("true, wrong", [("utf-8", "latin-1"), ("euc_jp", "latin-1"), ("utf-8", "koi8_r")])
def test_round_trip_of_what_can_be_restored(true, wrong):
    for text in TEXTS[:2]:
        assert mojibake.repair(text.encode(true).decode(wrong))[0] == text
        part = text[:3] + text[3:8].encode(true).decode(wrong) + text[8:]
        assert mojibake.repair(part)[0] == text
    twice = TEXTS[2].encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair(twice) == (TEXTS[2], "restored")


LONG = "昨日は図書館でとても古い本を借りて、庭でゆっくり読んだ。"
LEGACY = [(LONG, "euc_jp"), (LONG, "cp932"), ("昨天我们在图书馆借了一本很旧的书，我在家里看了很久。", "gbk"), ("昨天我們在圖書館借了一本很舊的書，我在家裡看了很久。", "big5"), ("어제 도서관에서 아주 오래된 책을 빌려서 정원에서 천천히 읽었다.", "euc_kr"), ("вчера мы взяли старую книгу в библиотеке и долго читали", "cp1251"), ("вчера мы взяли старую книгу в библиотеке и долго читали", "koi8_r"), ("เมื่อวานนี้เรายืมหนังสือเก่าจากห้องสมุด", "cp874")]


@pytest.mark.parametrize("text, codec", LEGACY)
def test_legacy_bytes_read_as_latin(text, codec):
    assert mojibake.repair(text.encode(codec).decode("latin-1")) == (text, "restored")


def test_legacy_bytes_that_fit_several_encodings_are_lost():
    bad = "雨毒和".encode("euc_jp").decode("latin-1")
    assert mojibake.repair(bad) == (bad, "lost")
    assert mojibake.repair(bad, "ja") == ("雨毒和", "restored")


@pytest.mark.parametrize("true, wrong", [("koi8_r", "cp1251"), ("cp1251", "koi8_r")])
def test_cyrillic_read_as_other_cyrillic(true, wrong):
    text = "Вчера мы взяли старую книгу в библиотеке"
    assert mojibake.repair(text.encode(true).decode(wrong)) == (text, "restored")
    assert mojibake.repair("ВЧЕРА МЫ ВЗЯЛИ СТАРУЮ КНИГУ") == ("ВЧЕРА МЫ ВЗЯЛИ СТАРУЮ КНИГУ", "clean")


@pytest.mark.parametrize("layers", range(1, 8))
def test_any_number_of_layers(layers):
    bad = TEXTS[2]
    for _ in range(layers):
        bad = bad.encode().decode("latin-1")
    assert mojibake.repair(bad) == (TEXTS[2], "restored")


def test_search_in_batches_misses_nothing():
    rng = np.random.default_rng(6)
    codecs = ["utf-8", "euc_jp", "cp932", "gbk", "big5", "euc_kr", "koi8_r", "cp1251", "cp866", "latin-1", "cp1252", "mac_roman"]
    texts = [*TEXTS, LONG, *[t for t, _ in LEGACY], "a" * 3000, "été à l'œuvre", "路旗徳", "ﾀﾛｶ"]
    for _ in range(600):
        t, a, b = str(rng.choice(texts[:14])), str(rng.choice(codecs)), str(rng.choice(codecs))
        i, j = sorted(rng.integers(0, len(t) + 1, 2))
        texts.append(t[:i] + t[i:j].encode(a, "ignore").decode(b, "replace") + t[j:])
    assert mojibake.repair_all([*texts, None, "", *texts]) == [mojibake.repair(t) for t in [*texts, None, "", *texts]]


def test_time_grows_with_length():
    def took(n):
        text = ("かな漢字" + "ﾀﾛｶ表記".encode().decode("cp932", "replace") + "¤³¤ì¤Ï") * n
        began = time.perf_counter()
        mojibake.repair_all([text])
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 8 * took(4_000) + 0.5


@pytest.mark.parametrize("text", [None, "", "plain", "価格$B級", "正規表現の \\d+ と \\xff", "ΩとΔ £5 ½", "ｱｸｱﾄﾞﾗｲを見た｡", "さて､日記のｵｱﾎｰﾎﾟが軽い｡", "« Où ? » demanda-t-elle…", "„Wo ist das?“, fragte er.", "塔姆莉莉", "글자를 읽었다."] + TEXTS)
def test_clean_text_is_left_alone(text):
    assert mojibake.repair(text) == (text, "clean")


def test_very_long_and_lost_text():
    assert mojibake.repair("あ" * 200_000)[1] == "clean"
    assert mojibake.repair("あ�い") == ("あ�い", "lost")


def test_garbled_fields(spark, sf):
    bad = "かな".encode().decode("latin-1")
    d = sf(dictionary=([(1, {"漢字": 1.0, bad: 1.0}, bad, None), (2, None, None, None)], DICT), sentences=([(5, None, "line", None, ""), (6, None, "block", bad, ""), (6, None, "block", bad, "")], SENT))
    assert {tuple(r) for r in mojibake.p6_found(spark, d).collect()} == {("dictionary", 1, "midasi"), ("dictionary", 1, "yomi"), ("sentences", 6, "raw")}


DOCS = "doc_id long, document_id string, domain string, text string, chunks string"


def test_site_lines_against_brute_force(spark, sf):
    rng = np.random.default_rng(4)
    furniture = ["トップ > 記事 > 一覧", "Copyright (C) 2001 X", "☆", "更新 2007/11/22", "この文書の転載を禁じます。" * 6]
    rows = []
    for i in range(60):
        own = ["".join(rng.choice(list("あいうえおかきくけこ漢字"), 30)) for _ in range(4)]
        lines = [*own]
        for f in furniture:
            if rng.random() < 0.4:
                lines.insert(int(rng.integers(0, len(lines))), f.replace("2001", str(2000 + i % 9)).replace(" ", "　" if i % 2 else " ") + ("\r" if i % 3 == 0 else ""))
        rows.append((i, f"d{i}", "ab"[i % 2] if i % 7 else None, "\n".join(lines), "x"))
    rows += [(100, "e", "a", None, ""), (101, "e", "a", "", ""), (102, "e", "a", "\n\n", ""), (0, "d0", None, rows[0][3], "x")]
    seen, where = defaultdict(set), defaultdict(set)
    for i, _, dom, text, _ in rows:
        for no, line in enumerate((text or "").split("\n"), 1):
            k = boilerplate.normalised(line)
            if k and dom:
                seen[dom, k].add(i)
                where[dom, k].add((i, no))
    expected = {x for k, v in seen.items() if len(v) >= 5 for x in where[k]}
    d = sf(documents=(rows, DOCS))
    assert expected and {tuple(r) for r in boilerplate.p7_found(spark, d).collect()} == expected
    for r in boilerplate.p7_cleaned(spark, d).where("doc_id between 1 and 99").collect():
        text = next(t for i, _, _, t, _ in rows if i == r["doc_id"])
        assert r["text"] == "\n".join(x for n, x in enumerate(text.split("\n"), 1) if (r["doc_id"], n) not in expected)


def test_a_site_line_is_one_row_in_all_its_spellings(spark, sf):
    spellings = ["本日0件目の表示 ABC", "本日12件目の表示ABC", "本日３件目の表示　ＡＢＣ", "本日　４５件目の表示 ABC\r", "本日7件目の表示 ＡＢＣ", "本日８件目の 表示 ABC"]
    rows = [(i, f"d{i}", "a", f"{x}\nown line {'xyzuvw'[i]}", "x") for i, x in enumerate(spellings)]
    rows += [(0, "d0", "a", "another row of the same id\n", "x"), (9, "d9", "b", spellings[0], "x")]
    got = boilerplate.p7_site_lines(spark, sf(documents=(rows, DOCS))).collect()
    assert [(r["domain"], r["line_form"], r["occurrences"], r["docs"]) for r in got if "本日" in r["line_form"]] == [("a", "本日0件目の表示ABC", 6, 6)]
    assert all(r["docs"] >= 5 for r in got)


def test_chunks_do_not_depend_on_neighbours():
    a, b = "x" * 5 + "\n" + "この一行はどこにあっても同じ塊になるはずである。" * 3, "全く別の行\nもう一つ\n" + "この一行はどこにあっても同じ塊になるはずである。" * 3
    t, no, line, key, whole = boilerplate.chunks([a, b])
    first, second = (t == 0) & (no == 2), (t == 1) & (no == 3)
    assert list(key[first]) == list(key[second]) and len(set(line[first]) | set(line[second])) == 1 and not whole[first].any()
    # an end depends on the characters around it alone: the same stretch inside other lines has the same chunks
    assert set(key[first]) & set(boilerplate.chunks(["前の部分" + a.split("\n")[1] + "後の部分"])[3])
    assert len(boilerplate.chunks([""])[0]) == 0 and len(boilerplate.chunks([])[0]) == 0


def test_chunk_bounds_and_blocks_of_long_texts(monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.integers(0x3040, 0x3060, 20_000).astype(np.uint32)
    for reach, e in boilerplate.ends(boilerplate.rolling(c)).items():
        assert len(e) > 20_000 / (4 * reach) and np.diff(e).min() >= reach + 1
    text = "\n".join("".join(rng.choice(list("あいうえお漢字"), 30)) for _ in range(50)) + "\n" + "a" * 1000
    rows = lambda: sorted((int(i), n, k, tuple(c)) for b in boilerplate._chunked([pa.RecordBatch.from_pydict({"doc_id": [7], "domain_key": [1], "text": [text]})]) for i, n, k, c in zip(*(b.column(x).to_pylist() for x in ("doc_id", "line_no", "line_key", "chunks"))))
    whole = rows()
    assert [r[1] for r in whole] == list(range(1, 52)) and len(whole[-1][3]) >= 1
    monkeypatch.setattr(boilerplate, "BATCH_CHARS", 100)
    assert rows() == whole


def test_no_documents(spark, sf):
    d = sf(documents=([], DOCS))
    assert boilerplate.p7_found(spark, d).count() == 0 and boilerplate.p7_cleaned(spark, d).count() == 0


BLOCKS = [
    "No.24「トド！」の24．衣替え版を配った。|今朝（ノデの切符も長い。）なので行かなかった。|市場で「ビゴ隊。」の単語を練習した。|拍手が長い！？",
    "「バギは嬉しい。もう要らない！」と係の人が言った。|帰り道、模型を隠した♪| 25．５時間かかる。|えっと…ワゴは…配った……|はい。",
    "「焼き魚なら図書館にあるよ。」|ギン隊。の話は短い。|3. 宿題は細かい。|詳細は http://a.example/b.c?d=7 を読んだ。|古い。。|暗いね。笑",
    "“句子呢？”编辑问。|厨房离这里88.0公里。|老师说：“梯子在厨房。我就借走了！”|昨天真的读错了吗？",
    "เมื่อวานพ่อครัวลืมค่ะ| ที่ห้องสมุดมี92อันครับ",
    '교실에서 94.2km를 걸었다.| 손님이 "이제 찾았다. 정말이야!"라고 말했다.',
    "Use a short one, e.g. this, when No. 86 fails.| It cost $80.70 (he returned it. Twice!) at the library.| “Is it worn?” asked J. K. Harvane Jr. and left.| 27 people came.",
    "В библиотеке лежал ребус, т. е. тяжёлый ребус.| «Где мой словарь?» — спросил ученик.",
    "Am 6. Mai kam sie.| „Wo ist es?“, fragte sie.",
    "Has he\ngone? | He\nhas.".replace("? |", "?|"),
]


@pytest.mark.parametrize("block", BLOCKS)
def test_sentences(block):
    text = block.replace("|", "")
    at, expected = 0, []
    for part in block.split("|"):
        at += len(part)
        expected.append(len(text[:at].rstrip()))
    assert sentences.split(text) == expected


def test_abbreviations_by_document_then_corpus():
    text = "It was by Xan. Tandrik of the mill. The end."
    assert len(sentences.split(text, {}, {("word", "Xan"): 3})) == 3
    assert len(sentences.split(text, {("abbr", "Xan"): 2}, {("word", "Xan"): 3})) == 2
    assert len(sentences.split(text, {("abbr", "Xan"): 2, ("small", "tandrik"): 1}, {})) == 3


def test_ordinals_by_evidence_then_the_list():
    text = "Er kam zu uns, und zwar noch 6. Brumal sagte er. Dann ging er."
    assert len(sentences.split(text)) == 3
    assert len(sentences.split(text, {}, {("ordinal", "brumal"): 3, ("start", "brumal"): 1})) == 2
    assert len(sentences.split("Am 6. Mai kam sie.", {}, {("start", "mai"): 3})) == 2  # evidence goes before the list
    assert ("ordinal", "mai") in sentences.evidence("Sie kam am 6. Mai und blieb.") and ("start", "dann") in sentences.evidence("Sie kam. Dann ging sie.")


def test_abbreviations_of_any_length():
    text = "Die Verwaltungsabteilungsltg. Tandrik schrieb. Ende."
    assert ("Verwaltungsabteilungsltg", "Tandrik") in sentences.sites(text)
    assert len(sentences.split(text, {}, {("abbr", "Verwaltungsabteilungsltg"): 4})) == 2


@pytest.mark.parametrize("unit", ["「あ。」と言った（笑）。次は「い。」だ。", 'Dr. Tan came (he left. No). "So e.g. this." ', "（", "「「あ。", "A. B. C. ", " \n", "\"a.", "เมื่อวาน พ่อ "])
def test_time_of_long_texts_grows_with_length(unit):
    def took(n):
        text = unit * (n // len(unit))
        began = time.perf_counter()
        sentences.split(text)
        sentences.evidence(text)
        sentences.sites(text)
        return time.perf_counter() - began

    took(50_000)
    assert took(800_000) < 8 * took(200_000) + 0.5


def test_ten_megabytes():
    text = "He met Dr. Tan in the garden. " * 350_000
    began = time.perf_counter()
    assert len(sentences.split(text)) == 350_000 and time.perf_counter() - began < 60


def test_evidence_keeps_to_the_words_that_are_asked_for():
    text = "He saw Dr. Tan again. The tan dog."
    assert set(sentences.evidence(text, lambda w: (w == "Dr", w.lower() == "tan"))) == {x for x in sentences.evidence(text) if x[1] == "Dr" or x[1] == "tan" and x[0] in ("small", "name", "start")}


@pytest.mark.parametrize("text, ends", [(None, []), ("", []), (" \n", []), ("。", [1]), ("あ", [1]), ("（あ。", [3]), ("a" * 50_000, [50_000])])
def test_odd_blocks(text, ends):
    assert sentences.split(text) == ends


def test_sentence_query(spark, sf):
    d = sf(sentences=([(1, "d", "block", "Dr. Tan came. He left.", ""), (2, None, "block", None, ""), (3, "d", "line", "He saw Dr. Tan again.", ""), (1, "d", "block", "Dr. Tan came. He left.", "")], SENT))
    assert sorted(tuple(r) for r in sentences.p5_found(spark, d).collect()) == [(1, 13), (1, 22)]


def test_evidence_of_the_corpus_reaches_figures(spark, sf):
    """An abbreviation that only ever stands before figures is known from the corpus."""
    rows = [(1, "d", "block", "It weighs approx. 5.5 boxes. He left.", "")] + [(i, "e", "line", f"She saw approx. {i} boats here.", "") for i in range(2, 6)]
    assert sorted(r["end_char"] for r in sentences.p5_found(spark, sf(sentences=(rows, SENT))).collect()) == [28, 37]
