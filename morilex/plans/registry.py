"""Where queries and their SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tokens of documents in SQL: runs of one script.
TOK = f"""tok as (select doc_id, domain, source, lang, unnest(range(1, len(a) + 1)) as pos, unnest(a) as token
  from (select *, regexp_extract_all(text, '{chars.TOKEN}') as a from documents where text is not null))"""
#: Tokens with the language that their document's label names, in whatever spelling.
LABELLED = """labels as (select lang as raw, split_part(replace(lower(trim(lang)), '_', '-'), '-', 1) as base from (select distinct lang from documents where lang is not null)),
codes(code, lang) as (values %s), named as (select doc_id, token, coalesce(codes.lang, nullif_code(base)) as lang from tok join labels on tok.lang = labels.raw left join codes on codes.code = base)""" % ", ".join(f"('{a}', '{b}')" for a, b in chars.LANGUAGES.items())
LABELLED = LABELLED.replace("nullif_code(base)", "case when base not in (%s) then base end" % ", ".join(f"'{x}'" for x in chars.NO_LANGUAGE))
#: Headwords of the dictionary in SQL.
HEAD = "head as (select *, unnest(map_keys(midasi)) as head from dictionary)"


def query(sql: str | None = None, whole: str = ""):
    """Registers a query with its SQL; `whole` names columns whose SQL sums are to be 64-bit whole numbers."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            casts = ", ".join(f"cast({c} as bigint) as {c}" for c in whole.split())
            SQL[f.__name__] = f"select * replace ({casts}) from ({sql.strip()})" if casts else sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select("doc_id", "domain", "source", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(chars.TOKEN), F.lit(0))).alias("i", "token")).withColumn("pos", (F.col("i") + 1).cast("long")).drop("i")


def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dictionary").select("*", F.explode(F.map_keys("midasi")).alias("head"))
