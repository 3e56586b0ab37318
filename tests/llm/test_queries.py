"""Every query over empty tables, over rows of nulls, and over tables with more columns that have clashing names."""

import pytest

from morilex.llm import queries

WORD = "struct<midasi:string,repname:string,word_class:string>"
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, document_id string, domain string, url string, doc_rank int, crawled_at timestamp, loaded_at timestamp",
    "sentences": "row_id long, document_id string, sent_id int, unit string, raw string, noisy boolean, loaded_at timestamp",
    "dictionary": "entry_id long, dict_name string, dict_version int, hinsi string, bunrui string, katuyou1 string, yomi string, midasi map<string,double>, imis map<string,string>, annotation map<string,string>, loaded_at timestamp",
    "tweets": "status_id long, user_id long, screen_name string, kind string, text string, lang string, created_at timestamp, loaded_at timestamp",
    "ngram_uni": "shard_id int, document_id string, midasi string, repname string, word_class string, cnt long, loaded_at timestamp",
    "ngram_fbi": f"shard_id int, document_id string, w1 {WORD}, w2 {WORD}, cnt long, loaded_at timestamp",
    "eval_items": "item_id long, task string, text string",
    "reading_labels": "doc_id long, rater string, grade int",
}
#: Names that the operators use for columns of their own.
CLASHES = "key string, n long, _n long, container string, canonical string, level string, bucket string, sign string, seen string, k string, _h string, part string"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name in ("empty", "clashes"):  # the latter has rows of nulls
        d = tmp_path_factory.mktemp(name)
        for t, schema in TABLES.items():
            width = len(spark.createDataFrame([], schema).columns)
            rows = [] if name == "empty" else [(None,) * width] * 2
            df = spark.createDataFrame(rows, schema)
            if name == "clashes":
                df = df.crossJoin(spark.createDataFrame([(None,) * 12], CLASHES))
            df.write.parquet(str(d / f"{t}.parquet"))
        out[name] = str(d)
    return out


@pytest.mark.parametrize("query", sorted(queries.WHERE))
@pytest.mark.parametrize("kind", ["empty", "clashes"])
def test_nothing_gives_nothing(spark, folders, kind, query):
    rows = queries.queries()[query](spark, folders[kind]).collect()
    # rows of nulls hold no case; what is given back row by row keeps them
    assert not rows or query == "p7_cleaned" and kind != "empty" and all(r["text"] is None and r["lines_cut"] == 0 for r in rows)
