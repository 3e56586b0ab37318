"""The engine as a whole, borders against brute force, stores, options, case frames."""

import re

import pytest
from pyspark.sql import functions as F

from morilex import options, pipeline
from morilex.operators import acquire, caseframes, context, dictionaries, instances, learn, lookup, metrics, storage
from morilex.sources import stores, texts

SUFFIXES = [("る", "子音動詞ラ行", "基本形"), ("るな", "子音動詞ラ行", "基本形"), ("らずにね", "子音動詞ラ行", "未然形"), ("らず", "子音動詞ラ行", "未然形"), ("れ", "子音動詞ラ行", "命令形")]
WORDS = {"それ": "名詞", "を": "助詞", "次": "名詞", "と": "助詞", "言った": "動詞", "。": "特殊", "、": "特殊", "「": "特殊", "」": "特殊", "るな": "助詞", "らずにね": "助詞", "れ": "助詞"}
SAMPLE = ["それをファボるな。", "次、ファボらずにね。", "「ファボれ」と言った。"]


@pytest.fixture
def engine(spark, tmp_path):
    suffixes = spark.createDataFrame(SUFFIXES, "suffix string, pos_s string, katuyou2 string")
    return pipeline.Engine(spark, suffixes, WORDS, options.load(dictionary=f"file:{tmp_path}/dictionary"))


def test_three_sentences_give_one_entry(spark, engine):
    heard = []
    engine.listen(heard.append)
    log = engine.acquire(spark.createDataFrame(list(enumerate(SAMPLE)), "row_id long, raw string"))
    assert [tuple(r) for r in engine.known().collect()] == [("ファボ", "子音動詞ラ行", 3)]
    assert {(r["event"], r["stem"]) for r in log.collect()} == {("example", "ファボ"), ("append", "ファボ"), ("delete examples", "ファボ")} and len(heard) == 1
    again = engine.acquire(spark.createDataFrame(list(enumerate(SAMPLE)), "row_id long, raw string"))
    assert {r["event"] for r in again.collect()} == {"example", "reject: known", "delete examples"}
    assert len(dictionaries.versions(spark, engine.options.dictionary)) == 1


def test_safe_mode_asks_for_more_examples(spark, engine):
    rows = spark.createDataFrame([(i, SAMPLE[i % 3]) for i in range(6)], "row_id long, raw string")
    examples = engine.examples(rows)
    assert acquire.induce(examples, engine.suffixes).count() == 1 and acquire.induce(examples, engine.suffixes, safe=True).count() == 0
    more = engine.examples(spark.createDataFrame([(i, SAMPLE[i % 3]) for i in range(9)], "row_id long, raw string"))
    assert acquire.induce(more, engine.suffixes, safe=True).count() == 1


def test_stream_of_files(spark, engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("\n".join(SAMPLE), encoding="utf-8")
    engine.run_stream(str(folder), str(tmp_path / "ckpt"))
    assert engine.known().count() == 1


def test_no_sentences(spark, engine):
    assert engine.acquire(spark.createDataFrame([(1, None), (2, "")], "row_id long, raw string")).count() == 0


TOKENS = "array<struct<w:string,phrase:int,mark:string>>"


def fronts(tokens, p):
    """Borders before a token, by the description."""
    out, text, n = {}, "", 0
    scope = [i for i in range(p) if tokens[i][1] >= tokens[p][1] - 2]
    if p == 0:
        out[0] = ("", "BOS")
    elif tokens[p - 1][1] != tokens[p][1]:
        out[0] = ("", "BOB")
    for i in reversed(scope):
        w, ph, mark = tokens[i]
        if re.match(context.SEPARATOR, w) or w == "を":
            out[n] = (text, "BOS")
            break
        if mark == "prefix":
            out.setdefault(n, (text, "PRE"))
        elif mark and mark.startswith("NE:"):
            out.setdefault(n, (text, "END"))
        text, n = w + text, n + 1
        if len(text) > 8:
            break
        if i == 0 or tokens[i - 1][1] != ph:
            out[n] = (text, "BOS" if i == 0 else "BOB")
    return [(k, *out[k]) for k in sorted(out)]


def rears(tokens, p):
    out, text, n, last = {}, "", 0, len(tokens) - 1
    if p == last:
        out[0] = ("", "EOS")
    elif tokens[p + 1][1] != tokens[p][1]:
        out[0] = ("", "EOB")
    for i in range(p + 1, len(tokens)):
        w, ph, mark = tokens[i]
        if ph > tokens[p][1] + 2:
            break
        if re.match(context.SEPARATOR, w):
            out[n] = (text, "EOS")
            break
        if mark and mark.startswith("用言:"):
            out[n] = (text, mark)
        elif mark and mark.startswith("NE:"):
            out.setdefault(n, (text, mark))
        elif mark == "prefix":
            out.setdefault(n, (text, "EOB"))
        text, n = text + w, n + 1
        if len(text) > 16:
            break
        if i == last or tokens[i + 1][1] != ph:
            out[n] = (text, "EOS" if i == last else "EOB")
        if w == "を":
            break
    return [(k, *out[k]) for k in sorted(out)]


def test_borders_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = []
    for _ in range(150):
        tokens, phrase = [], 0
        for _ in range(r.randint(1, 12)):
            tokens.append((r.choice(["の", "本", "ファボ", "を", "、", "とても長い語", "る", "」"]), phrase, r.choice([None, None, None, "prefix", "NE:人", "用言:読む"])))
            phrase += r.random() < 0.4
        rows.append((tokens, r.randrange(len(tokens))))
    df = spark.createDataFrame(rows, f"tokens {TOKENS}, p int")
    for got, (tokens, p) in zip(df.select(context.front_borders(F.col("tokens"), F.col("p")).alias("f"), context.rear_borders(F.col("tokens"), F.col("p")).alias("r")).collect(), rows):
        assert [tuple(x) for x in got["f"]] == fronts(tokens, p), (tokens, p)
        assert [tuple(x) for x in got["r"]] == rears(tokens, p), (tokens, p)


def test_merging_and_deliveries(spark, tmp_path):
    a = spark.createDataFrame([("x", "普通名詞", 3), ("y", "副詞", 9)], "stem string, pos_s string, cnt long")
    b = spark.createDataFrame([("x", "普通名詞", 4), ("x", "副詞", 1), ("y", "普通名詞", 2)], "stem string, pos_s string, cnt long")
    assert {tuple(r) for r in pipeline.merge_dictionaries([a, b]).collect()} == {("x", "普通名詞", 8), ("y", "副詞", 11)}
    assert pipeline.merge_dictionaries([a, b], limit=1).count() == 2
    for name in ("20100102", "20100101", "20100103"):
        (tmp_path / name).mkdir()
    for name in ("20100101.done", "20100102.done", "20100104.done"):
        (tmp_path / name).write_text("")
    assert [p.rpartition("/")[2] for p in pipeline.ready_folders(spark, str(tmp_path))] == ["20100101", "20100102"]


def test_other_dictionaries_cut_differently(spark):
    df = spark.createDataFrame([(1, "東京都に住む"), (2, None), (3, "に")], "row_id long, raw string")
    got = pipeline.segmentation_changes(df, {"東京": "名詞", "都": "名詞"}, {"東": "名詞", "京都": "名詞"}).collect()
    assert [tuple(r) for r in got] == [(1, 0, 3, "東京 都", "東 京都")]


def test_options(tmp_path):
    p = tmp_path / "prefs"
    p.write_text("# settings\nleast_examples: 5  # more\nsafe: yes\n")
    assert options.load(str(p), least_examples=7) == options.Options(least_examples=7, safe=True)
    with pytest.raises(ValueError):
        options.load(nothing=1)
    with pytest.raises(ValueError):
        options.parse("no colon")
    assert options.plugin("morilex.sources.analysers:LongestMatch").__name__ == "LongestMatch"


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(500)] + [(None, 7)], "k string, v int")
    stores.write_store(rows, "k", str(tmp_path / "s"), parts=8)
    keys = spark.createDataFrame([("k7", "x"), ("k8", "y"), ("none", "z")], "k string, extra string")
    got = stores.look_up(keys, "k", str(tmp_path / "s"), parts=8)
    assert sorted((r["k"], r["extra"], r["v"]) for r in got.collect()) == [("k7", "x", 7), ("k8", "y", 8)]
    assert stores.read_store(spark, str(tmp_path / "s")).count() == 501
    text = '(文法ファイル dic)\n(辞書ファイル\n\tdic\n\tauto\n)\n'
    assert stores.add_dictionary(text, "new") == '(文法ファイル dic)\n(辞書ファイル\n\tdic\n\tauto\n\tnew\n)\n'
    with pytest.raises(ValueError):
        stores.add_dictionary("(x)", "new")


ANALYSED = """#document d1 site.test
# S-ID:s1
* 1D <係:ガ格>
彼 かれ 彼 名詞 6 普通名詞 1 * 0 * 0 NIL
が が が 助詞 9 格助詞 1 * 0 * 0 NIL
* -1D <用言:動><態:受動>
読む よむ 読む 動詞 2 * 0 子音動詞マ行 9 基本形 2 "代表表記:読む/よむ" <品詞変更:読む-よむ-読む-未定義語-その他-*-*>
EOS junk after
# S-ID:s2
* -1D <用言:動>
走る はしる 走る 動詞 2 * 0 子音動詞ラ行 10 基本形 2 NIL
EOS
#document d2 other.test
* -1D
猫 ねこ 猫 名詞 6 普通名詞 1 * 0 * 0 NIL
EOS
"""


def test_analysed_files_are_read_by_sentence_and_written_back(spark, tmp_path):
    (tmp_path / "a.knp").write_text(ANALYSED, encoding="utf-8")
    m = texts.read_analysis(spark, str(tmp_path), "*.knp")
    assert sorted((r["doc_id"], r["domain"], r["sent_id"], r["midasi"]) for r in m.collect()) == [("d1", "site.test", "s1", "が"), ("d1", "site.test", "s1", "彼"), ("d1", "site.test", "s1", "読む"), ("d1", "site.test", "s2", "走る"), ("d2", "other.test", "0", "猫")]
    assert sorted((r["doc_id"], r["sent_id"], r["bnst_idx"], r["parent_idx"]) for r in texts.read_phrases(spark, str(tmp_path), "*.knp").collect()) == [("d1", "s1", 0, 1), ("d1", "s1", 1, -1), ("d1", "s2", 0, -1), ("d2", "0", 0, -1)]
    again = [row for t in texts.format_analysis(m, ["doc_id", "sent_id"]).collect() for row in texts.parse_analysis(t["text"], t["doc_id"])]
    keep = lambda r: (r[0], r[2], r[3], r[4], *r[5:15])
    assert sorted(map(repr, map(keep, again))) == sorted(map(repr, (keep((*r,)) for r in m.collect())))
    back = texts.undo_changes(m.where("midasi = '読む'")).first()
    assert (back["hinsi"], back["bunrui"], back["katuyou1"], back["midasi"]) == ("未定義語", "その他", "*", "読む")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    body = [f"line {i}" if i % 5 else "" for i in range(1, 2001)]
    (tmp_path / "a.txt").write_text("\n".join(body) + "\n", encoding="utf-8")
    docs = [f"#document\tdoc{i // 40}" if i % 40 == 0 else f"text {i}" for i in range(400)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("\n".join(docs) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = texts.read_raw(spark, str(tmp_path / "a.txt"))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 1
        assert sorted((r["sent_id"], r["raw"]) for r in got.collect()) == [(i, x) for i, x in enumerate(body, 1) if x]
        rows = texts.read_raw_documents(spark, str(tmp_path / "d")).collect()
        assert sorted((r["doc_id"], r["sent_id"], r["raw"]) for r in rows) == sorted((f"doc{i // 40}", i % 40, x) for i, x in enumerate(docs) if i % 40)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def frames(spark, phrases, words):
    b = spark.createDataFrame([("d", s, i, p, t, f) for s, i, p, t, f in phrases], "doc_id string, sent_id string, bnst_idx int, parent_idx int, dpndtype string, fstring string")
    m = spark.createDataFrame([("d", s, i, n, w, w, h) for n, (s, i, w, h) in enumerate(words)], "doc_id string, sent_id string, bnst_idx int, pos int, genkei string, repname string, hinsi string")
    return b, m


def test_case_components(spark):
    phrases = [("s", 0, 1, "D", "<係:ノ格>"), ("s", 1, 3, "D", "<係:ガ格><数量><カウンタ:人>"), ("s", 2, 3, "D", "<係:ヲ格>"), ("s", 3, -1, "D", "<用言:動>"), ("t", 0, 1, "D", "<係:ガ格>"), ("t", 1, 2, "D", "<用言:動><呼掛>"), ("t", 2, -1, "D", "<用言:動>"), ("u", 0, 2, "D", "<係:ガ格>"), ("u", 1, 2, "D", "<用言:動>"), ("u", 2, -1, "D", "<用言:動>"), ("v", 0, 1, "D", "<複合辞:ニツク>"), ("v", 1, -1, "D", "<用言:動>")]
    words = [("s", 0, "学生", "名詞"), ("s", 1, "三人", "名詞"), ("s", 2, "本", "名詞"), ("s", 3, "読む", "動詞"), ("t", 0, "猫", "名詞"), ("t", 1, "来い", "動詞"), ("t", 2, "走る", "動詞"), ("u", 0, "犬", "名詞"), ("u", 1, "見る", "動詞"), ("u", 2, "逃げる", "動詞"), ("v", 0, "夢", "名詞"), ("v", 1, "話す", "動詞")]
    b, m = frames(spark, phrases, words)
    parts = caseframes.components(b, m)
    got = {(r["sent_id"], r["predicate"], r["case"], r["argument"], r["adjacent"]) for r in parts.collect()}
    assert got == {("s", "読む", "ガ", "<数量>人", False), ("s", "読む", "ヲ", "本", True), ("v", "話す", "ニツク", "夢", True)}
    no = {(r["sent_id"], r["case"], r["argument"], r["no"]) for r in caseframes.with_no_case(parts, b, m).collect()}
    assert ("s", "ガ", "学生", "<数量>人") in no and ("s", "ヲ", "本", None) in no


def test_the_parsers_own_cases(spark):
    b, _ = frames(spark, [("s", 0, -1, "D", "<格解析結果:食べる/たべる:ガ/N/彼/0/0/1>"), ("s", 1, -1, "D", "<格解析結果:読む:動1:ガ/C/彼/0/0/1;ヲ/U/-/-/-/-;ニ/O/家/1/0/1>"), ("s", 2, -1, "D", "")], [("s", 0, "x", "名詞")])
    got = {(r["bnst_idx"], r["predicate"], r["case"], r["kind"], r["argument"]) for r in caseframes.analysed_cases(b).where("bnst_idx = 1").collect()}
    assert got == {(1, "読む", "ガ", "C", "彼"), (1, "読む", "ニ", "O", "家")}


def test_joins_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(storage, "HOT_KEYS", 4)
    monkeypatch.setattr(storage, "SALTS", 3)
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(200)] + [(None, -1)], "k string, i int")
    keyed = storage.written(spark.createDataFrame([("hot", 100, "a"), ("hot", 100, "b"), *[(f"k{i}", 1, "c") for i in range(0, 200, 4)]], "k string, n long, x string"), "keyed")
    for how in ("inner", "left"):
        want = rows.join(keyed.drop("n"), "k", how)
        assert sorted(map(str, storage.join_hot(rows, keyed, ["k"], "n", how).collect())) == sorted(map(str, want.collect()))
    assert storage.join_hot(rows, keyed, ["k"], "n", "left_semi").count() == rows.join(keyed, "k", "left_semi").count()
    storage.free(keyed)
    assert not storage.is_dir(spark, keyed._morilex_path)


def test_words_of_one_character_are_contained(spark):
    inner = spark.createDataFrame([("ア",), ("アイ",), ("ウエ",), ("",), (None,)], "a string")
    outer = spark.createDataFrame([("アイウ",), ("ア",), ("ウ",)], "b string")
    assert {tuple(r) for r in lookup.contained_in(inner, "a", outer, "b").collect()} == {("ア", "アイウ"), ("アイ", "アイウ")}


def test_places_of_matches_and_regions(spark):
    df = spark.createDataFrame([("アアとアアア", "x<U>ab</U>c<U></U>")], "t string, g string")
    r = df.select(metrics.matches(F.col("t"), "ア+").alias("m"), metrics.regions(F.col("g"), "U").alias("g")).first()
    assert [tuple(x) for x in r["m"]] == [(0, 2), (3, 6)] and [tuple(x) for x in r["g"]] == [(1, 3), (4, 4)]


def test_gaussian_draws(spark):
    r = spark.range(20_000).select(metrics.gaussian(F.col("id").cast("string"), 5.0, 2.0).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(r[0] - 5) < 0.05 and abs(r[1] - 2) < 0.05


def test_instances_in_passes_and_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(i, "l", "page", [(3, 2.0), (5, 1.0)]) for i in range(50)], "name long, label string, origin string, feats array<struct<fid:int,v:double>>")
    one = instances.InstanceList(rows, "name", 4)
    first = [r["name"] for r in one.shuffled().orderBy("place").collect()]
    one.reset()
    second = [r["name"] for r in one.shuffled().orderBy("place").collect()]
    assert sorted(first) == sorted(second) == list(range(50)) and first != second
    one.append(rows.limit(1))
    assert one.rows.count() == 51
    instances.feature_lines(rows, "name", "label", "origin", "feats").write.text(str(tmp_path / "i"))
    back = texts.read_instances(spark, str(tmp_path / "i"), binary=False).where("name = '7'").first()
    assert (back["label"], [(x["fid"], x["v"]) for x in back["feats"]]) == ("l", [(3, 2.0), (5, 1.0)])


def test_models_are_kept(spark, tmp_path):
    w = spark.createDataFrame([(0, 1, 0.5)], "class_id int, fid int, weight double")
    learn.save_model(w, str(tmp_path / "m"))
    assert [tuple(r) for r in learn.load_model(spark, str(tmp_path / "m")).collect()] == [(0, 1, 0.5)]


def test_pool(spark):
    p = texts.Pool()
    p.add(spark.range(1))
    p.add(spark.range(2))
    assert p.get().count() == 2 and p.get().count() == 1 and p.is_empty() and p.get() is None


def test_bitext_and_variants(spark, tmp_path):
    (tmp_path / "b.xml").write_text('<doc docid="p1">\n<i_sentence>一文目。</i_sentence>\n<para_sentence id="p2">\n<i_sentence>二文目。</i_sentence>\n', encoding="utf-8")
    assert [(r["doc_id"], r["raw"]) for r in texts.read(spark, bitext_xml=str(tmp_path / "b.xml")).orderBy("line_no").collect()] == [("p1", "一文目。"), ("p2", "二文目。")]
    (tmp_path / "s.txt").write_text("# A 1_X 1 2\nfirst\n# A 1_X 2 2\nsecond\n# B 2.Y 1 1\nthird\n", encoding="utf-8")
    assert [(r["doc_id"], r["raw"]) for r in texts.read_sorted_bitext(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()] == [("1_X", "first"), ("1_X", "second"), ("2.Y", "third")]
    (tmp_path / "u.txt").write_text("U+56FD\tkTraditionalVariant\tU+570B\nU+56FD\tkJis0\t2581\nU+4E2A\tkTraditionalVariant\tU+500B\n", encoding="utf-8")
    assert {r["a"] for r in texts.read_variants(spark, str(tmp_path / "u.txt"), jis_only=True).collect()} == {"U+56FD", "U+570B"}


def test_labels_by_expectation(spark):
    rows = [(i, ("x" if i < 5 else "y") if i % 5 < 2 else None, f, 2) for i in range(10) for f in (("a", "b") if i < 5 else ("c", "d"))]
    for hard in (False, True):
        _, _, member = learn.naive_bayes_em(spark.createDataFrame(rows, "doc_id int, label string, feature string, n int"), ["x", "y"], rounds=3, hard=hard)
        best = {r["doc_id"]: r["label"] for r in member.where("w > 0.9").collect()}
        assert best == {i: "x" if i < 5 else "y" for i in range(10)}
