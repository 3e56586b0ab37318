"""Operators against small brute-force versions."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from morilex.operators import acquire, align, instances, learn, lookup, metrics, ngrams, rules, storage

WORDS = ["あ", "あい", "あいう", "いう", "うあい", "かき", "かきく", "きくけ", "かきくけ", "ん", ""]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(w,) for w in [*WORDS, "あい", None]], "w string")


def test_prefix_pairs(words):
    got = {(r[0], r[1]) for r in lookup.prefix_pairs(words, "w").collect()}
    assert got == {(a, b) for a, b in product(WORDS, WORDS) if a and a != b and b.startswith(a)}


def test_contained_pairs(words):
    got = {(r[0], r[1]) for r in lookup.contained_pairs(words, "w").collect()}
    assert got == {(a, b) for a, b in product(WORDS, WORDS) if a and a != b and a in b}


def test_overlap_pairs(spark):
    texts = {1: "あいうえお", 2: "あいうえか", 3: "あいうえ", 4: "かきくけこさ", 5: "きくけこ", 6: "あい", 7: "あいうえお"}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    gram = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    expected = {(a, b) for a in texts for b in texts if a < b and gram(texts[a]) and gram(texts[b]) and len(gram(texts[a]) & gram(texts[b])) >= 0.6 * min(len(gram(texts[a])), len(gram(texts[b])))}
    assert {(r[0], r[1]) for r in lookup.overlap_pairs(df, "k", "t").collect()} == expected


def test_longest_prefix(spark, words):
    listed = spark.createDataFrame([("あ",), ("あいう",), ("か",)], "p string")
    assert {(r[0], r[1]) for r in lookup.longest_prefix(words, "w", listed, "p", 4).collect()} == {("あ", "あ"), ("あい", "あ"), ("あいう", "あいう"), ("かき", "か"), ("かきく", "か"), ("かきくけ", "か")}


def test_row_index_and_prefix_sum(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(8)
    rows = {r["id"]: (r["n"], r["s"]) for r in storage.row_index(storage.prefix_sum(df, ["id"], F.col("v"), "s"), ["id"], "n").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert rows[i] == (i + 1, total)
    assert storage.row_index(df.limit(0), ["id"]).count() == 0


def test_rules_every_atom(spark):
    r = rules.parse("""
    ; comment
    ((| [(カタカナ)] *) START)       # a missing neighbour
    (([(見出し語 あ)] [^(ひらがな)(見出し語長 1)] ^[(品詞 名詞)]) NEG)
    ((* [(一文字漢字)] |) LAST)
    ((* [(素性 括弧)] *) FEATURE)
    """)
    assert [x.name for x in r] == ["START", "NEG", "LAST", "FEATURE"]
    rows = [(1, 0, "アイ", "名詞", None), (1, 1, "あ", "助詞", None), (1, 2, "X", "記号", None), (1, 3, "木", "名詞", None), (2, 0, "「", "特殊", "<括弧>")]
    df = spark.createDataFrame(rows, "s int, pos int, midasi string, hinsi string, fstring string")
    got = {(x["s"], x["pos"]): x["feature"] for x in rules.match_tokens(df, r, ["s"], ["pos"], ["midasi", "hinsi", "fstring"]).collect()}
    assert got == {(1, 0): "START", (1, 1): None, (1, 2): None, (1, 3): "LAST", (2, 0): "FEATURE"}


@pytest.mark.parametrize("text", ["((* *) X)", "((* * [(よくわからない 1)]) X)", "((* * [) X)", "(* * * X"])
def test_bad_rules_are_refused(spark, text):
    with pytest.raises(rules.RuleError):
        df = spark.createDataFrame([(1, 0, "a")], "s int, pos int, midasi string")
        rules.match_tokens(df, rules.parse(text), ["s"], ["pos"], ["midasi"]).collect()


def test_alignment_regions():
    assert align.regions(["ab", "c", "d"], ["a", "bc", "d"]) == [(0, 3, ["ab", "c"], ["a", "bc"])]
    assert align.regions(["ab"], ["ab"]) == []


def test_best_form_ties_go_to_the_least(spark):
    df = spark.createDataFrame([("る", "v", "b"), ("る", "v", "a"), ("る", "n", "c")], "suffix string, pos_s string, form string")
    got = {(r["pos_s"], r["form"], r["total"]) for r in ngrams.best_form(ngrams.suffix_counts(df)).collect()}
    assert got == {("v", "a", 2), ("n", "c", 1)}


def test_induction_acquires_the_fixture(spark):
    """Three sentences with one new verb, each with another ending."""
    ex = [(1, "", "BOS", "ファボる"), (2, "", "BOS", "ファボらず"), (3, "", "BOS", "ファボれ"), (4, "", "BOS", "ホゲを")]
    suf = [("る", "子音動詞ラ行", "基本形"), ("らず", "子音動詞ラ行", "未然形"), ("れ", "子音動詞ラ行", "命令形"), ("を", "普通名詞", "を")]
    got = acquire.induce(spark.createDataFrame(ex, "example_id long, front string, front_tag string, text string"), spark.createDataFrame(suf, "suffix string, pos_s string, katuyou2 string"))
    assert [tuple(r) for r in got.collect()] == [("ファボ", "子音動詞ラ行", 3, False)]


def test_decomposable_and_kept_by_length(spark):
    e = spark.createDataFrame([("ふぁぼ", "v"), ("ふぁぼったー", "n"), ("ったー", "n"), ("別", "n")], "stem string, pos_s string")
    got = acquire.filter_by_length(e, spark.createDataFrame([], "stem string"), 8)
    assert {r["stem"] for r in got.collect()} == {"ふぁぼ", "ったー", "別"}


def test_instances_carry_up(spark):
    rows = [(1, "d", "x", "prev", f"f{i}") for i in range(3)] + [(2, "d", "x", "prev", "g1"), (3, "d", "x", "next", "g2"), (3, "d", "x", "next", "g3"), (4, "e", "y", "prev", "h")]
    got = instances.by_level(spark.createDataFrame(rows, "doc_id long, domain string, name string, ftype string, fname string"), least=3)
    assert {(r["origin"], r["name"], r["doc_id"], r["k"]) for r in got.collect()} == {("page", "x", 1, 3), ("domain", "x", None, 3)}


def test_two_class_learners_separate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    y = (x @ np.array([2.0, -1.0, 0.5, 0.0, 0.0]) > 0).astype(int)
    for kind in ("binary_perceptron", "binary_pa", "binary_scw"):
        m = learn.LEARNERS[kind](2, 5)
        for _ in range(3):
            for a, b in zip(x, y):
                m.step(int(b), np.arange(5), a)
        assert np.mean((m.result() @ x.T).argmax(0) == y) > 0.95 and not m.result()[0].any()
    with pytest.raises(ValueError):
        learn.BinaryPerceptron(3, 5)


@pytest.mark.parametrize("kind", sorted(k for k in learn.LEARNERS if not k.startswith("binary")))
def test_learners_separate(kind):
    rng = np.random.default_rng(3)
    m = learn.LEARNERS[kind](3, 6)
    rows = [(k, np.array([2 * k, 2 * k + 1]), rng.random(2) + 0.5) for k in range(3) for _ in range(30)]
    for _ in range(5):
        for i in rng.permutation(len(rows)):
            m.step(*rows[i])
    w = m.result()
    assert np.mean([int((w[:, f] @ v).argmax()) == y for y, f, v in rows]) == 1


def test_parameter_mixing(spark):
    rows = [(i, i % 2, [(i % 2, 1.0), (2, 0.5)]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, label int, feats array<struct<fid:int,v:double>>")
    w = learn.train_mixed(df, 2, 3, "pa", 4, 2)
    got = learn.best_class(learn.linear_scores(df, w))
    assert all(r["class_id"] == r["row_id"] % 2 for r in got.collect())


def test_kappa_and_mcnemar(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "a int, b int")
    r = metrics.kappa(df, "a", "b").first()
    assert (r["observed"], r["expected"], r["kappa"]) == (0.75, 0.5, 0.5)
    assert metrics.mcnemar(0, 0) == (0.0, 1.0) and metrics.mcnemar(10, 0)[1] < 0.01


def test_quantile():
    assert learn.quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
