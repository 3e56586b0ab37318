"""Where an unknown word may begin and end: borders before and after it, as folds over the tokens of its sentence.

tokens: array<struct<w:string, phrase:int, mark:string>>; mark is null, 'prefix', an entity's tag ('NE:...') or a predicate
('用言:...'). Places are counted in tokens from the word; a border has the text up to it and a tag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "^[、。，．！？…「」『』（）()：；／｜【】\\[\\]\\s]$"
# Phrases and characters that are looked through.
PHRASES, LONGEST_FRONT, LONGEST_REAR = 2, 8, 16
_OUT = "array<struct<n:int,text:string,tag:string>>"


def _border(out: Column, n: Column, text: Column, tag: Column, override: bool) -> Column:
    """out with a border at n; an older one there is replaced only with override."""
    new = F.struct(n.cast("int").alias("n"), text.alias("text"), tag.cast("string").alias("tag"))
    if override:
        return F.array_append(F.filter(out, lambda b: b["n"] != n), new)
    return F.when(F.exists(out, lambda b: b["n"] == n), out).otherwise(F.array_append(out, new))


def front_borders(tokens: Column, pivot: Column) -> Column:
    """Borders before token number `pivot` (from 0), from right to left.

    BOS at the start of the sentence, after a separator and after を; BOB at the start of a phrase; PRE after a prefix; END
    after an entity.
    """
    phrase = F.element_at(tokens, pivot + 1)["phrase"]
    scope = F.reverse(F.filter(F.slice(tokens, F.lit(1), pivot), lambda t: t["phrase"] >= phrase - PHRASES))
    first = F.when(pivot == 0, F.lit("BOS")).when(F.element_at(tokens, F.greatest(pivot, F.lit(1)))["phrase"] != phrase, F.lit("BOB"))
    none = F.array().cast(_OUT)
    start = F.struct(F.lit(True).alias("go"), F.lit("").alias("text"), F.lit(0).alias("n"), F.when(first.isNotNull(), F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("text"), first.alias("tag"))).cast(_OUT)).otherwise(none).alias("out"))

    def step(acc, t):
        stop = t["w"].rlike(SEPARATOR) | (t["w"] == "を")
        out = F.when(stop, _border(acc["out"], acc["n"], acc["text"], F.lit("BOS"), True)).when(F.coalesce(t["mark"] == "prefix", F.lit(False)), _border(acc["out"], acc["n"], acc["text"], F.lit("PRE"), False)).when(F.coalesce(t["mark"].startswith("NE:"), F.lit(False)), _border(acc["out"], acc["n"], acc["text"], F.lit("END"), False)).otherwise(acc["out"])
        text, n = F.concat(t["w"], acc["text"]), acc["n"] + 1
        fits = F.length(text) <= LONGEST_FRONT
        place = pivot - n  # the number of this token
        at_start = F.when(place == 0, F.lit("BOS")).when(F.element_at(tokens, F.greatest(place, F.lit(1)))["phrase"] != t["phrase"], F.lit("BOB"))
        taken = F.when(fits & at_start.isNotNull(), _border(out, n, text, at_start, True)).otherwise(out)
        done = F.struct((~stop & fits).alias("go"), F.when(stop, acc["text"]).otherwise(text).alias("text"), F.when(stop, acc["n"]).otherwise(n).alias("n"), F.when(stop, out).otherwise(taken).alias("out"))
        return F.when(acc["go"], done).otherwise(acc)

    return F.array_sort(F.aggregate(scope, start, step, lambda acc: acc["out"]))


def rear_borders(tokens: Column, pivot: Column) -> Column:
    """Borders after token number `pivot` (from 0), from left to right.

    EOS at the end of the sentence and before a separator; EOB at the end of a phrase and before a prefix; an entity's tag
    or a predicate before one; を ends the search after it.
    """
    phrase = F.element_at(tokens, pivot + 1)["phrase"]
    scope = F.filter(F.slice(tokens, pivot + 2, F.size(tokens)), lambda t: t["phrase"] <= phrase + PHRASES)
    size = F.size(tokens)
    first = F.when(pivot == size - 1, F.lit("EOS")).when(F.element_at(tokens, F.least(pivot + 2, size))["phrase"] != phrase, F.lit("EOB"))
    start = F.struct(F.lit(True).alias("go"), F.lit("").alias("text"), F.lit(0).alias("n"), F.when(first.isNotNull(), F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("text"), first.alias("tag"))).cast(_OUT)).otherwise(F.array().cast(_OUT)).alias("out"))

    def step(acc, t):
        stop = t["w"].rlike(SEPARATOR)
        mark = F.coalesce(t["mark"], F.lit(""))
        out = F.when(stop, _border(acc["out"], acc["n"], acc["text"], F.lit("EOS"), True)).when(mark.startswith("用言:"), _border(acc["out"], acc["n"], acc["text"], mark, True)).when(mark.startswith("NE:"), _border(acc["out"], acc["n"], acc["text"], mark, False)).when(mark == "prefix", _border(acc["out"], acc["n"], acc["text"], F.lit("EOB"), False)).otherwise(acc["out"])
        text, n = F.concat(acc["text"], t["w"]), acc["n"] + 1
        fits = F.length(text) <= LONGEST_REAR
        place = pivot + n
        at_end = F.when(place == size - 1, F.lit("EOS")).when(F.element_at(tokens, F.least(place + 2, size))["phrase"] != t["phrase"], F.lit("EOB"))
        taken = F.when(fits & at_end.isNotNull(), _border(out, n, text, at_end, True)).otherwise(out)
        done = F.struct((~stop & fits & (t["w"] != "を")).alias("go"), F.when(stop, acc["text"]).otherwise(text).alias("text"), F.when(stop, acc["n"]).otherwise(n).alias("n"), F.when(stop, out).otherwise(taken).alias("out"))
        return F.when(acc["go"], done).otherwise(acc)

    return F.array_sort(F.aggregate(scope, start, step, lambda acc: acc["out"]))


def examples(sentences, tokens: str, unknown):
    """(example_id, pivot, front, front_tag, text) of the unknown words of sentences: for each the nearest border before it,
    and the word with what follows up to each border after it.

    sentences: row_id and an array of tokens; unknown: whether a token is one that is looked for.
    """
    at = sentences.select("row_id", F.col(tokens).alias("tokens"), F.explode(F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), unknown(t).alias("is"), t["w"].alias("w"))), lambda x: x["is"])).alias("x"))
    found = at.select(F.xxhash64("row_id", "x.i").alias("example_id"), F.col("x.w").alias("pivot"), F.get(front_borders(F.col("tokens"), F.col("x.i")), F.lit(0)).alias("front"), rear_borders(F.col("tokens"), F.col("x.i")).alias("rears"))
    return found.where("front is not null").select("example_id", "pivot", F.col("front.text").alias("front"), F.col("front.tag").alias("front_tag"), F.explode("rears").alias("r")).select("example_id", "pivot", "front", "front_tag", F.concat("pivot", "r.text").alias("text"))
