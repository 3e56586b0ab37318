"""Functions on kana that need a table or a dynamic programme; Arrow-batched where they meet Spark."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
_SMALL = {"ぁぃぅぇぉ": "aiueo"}


@lru_cache(None)
def roman_table() -> dict[str, str]:
    """Kana -> letters with a closing dot, by row and column."""
    table = {kana: f"{row}{v}." for row, kanas in _ROWS.items() for kana, v in zip(kanas, "aiueo")}
    table |= {kana: f"{v}{v}." for kanas, vs in _SMALL.items() for kana, v in zip(kanas, vs)}
    table |= dict(zip("やゆよわゐゑを", ("ya.", "yu.", "yo.", "wa.", "wi.", "we.", "wo.")))
    return table | dict(zip("ゃゅょゎっんヵゔ", ("Ya.", "Yu.", "Yo.", "Wa.", "Q.", "N.", "Ka.", "vu.")))


def romanize(hira: str) -> str:
    """Letters of a kana string; a long mark repeats the vowel before it; other characters stay."""
    out, vowel = [], ""
    for c in hira:
        if c in "ー～〜":
            out.append(f"{vowel}." if vowel else c)
            continue
        r = roman_table().get(c)
        vowel = r[-2] if r and r[-2] in "aiueo" else ""
        out.append(r or c)
    return "".join(out)


# What it costs to write one character for another.
REPLACED = [
    ("ー", "〜", 0.2), ("ー", "～", 0.2), ("〜", "～", 0.2),
    ("あ", "ぁ", 0.3), ("い", "ぃ", 0.3), ("う", "ぅ", 0.3), ("え", "ぇ", 0.3), ("お", "ぉ", 0.3), ("わ", "ゎ", 0.3), ("か", "ヵ", 0.3),
    ("つ", "っ", 0.5), ("や", "ゃ", 0.3), ("ゆ", "ゅ", 0.3), ("よ", "ょ", 0.3),
]
# The vowel that a long mark may stand for after a kana.
PROLONGED = {
    "か": "あ", "ば": "あ", "ま": "あ", "ゃ": "あ",
    "い": "い", "き": "い", "し": "い", "ち": "い", "に": "い", "ひ": "い", "じ": "い",
    "け": "い", "せ": "い", "て": "い", "へ": "い", "め": "い", "れ": "い", "げ": "い", "ぜ": "い", "で": "い", "べ": "い", "ぺ": "い",
    "お": "う", "こ": "う", "そ": "う", "と": "う", "の": "う", "ほ": "う", "も": "う", "よ": "う", "ろ": "う", "ご": "う", "ぞ": "う", "ど": "う", "ぼ": "う", "ぽ": "う", "ょ": "う",
    "え": "え", "ね": "え",
}
PROLONGED_COST = 0.3
# Two kana that are also written as one with a long mark, and what that costs.
MERGED = {
    "あい": ("え", -0.6), "あえ": ("え", -0.6), "かい": ("け", -0.6), "かえ": ("け", -0.6), "がい": ("げ", -0.6), "がえ": ("げ", -0.6),
    "さい": ("せ", -0.6), "さえ": ("せ", -0.6), "ざい": ("ぜ", -0.6), "ざえ": ("ぜ", -0.6), "たい": ("て", -0.6), "たえ": ("て", -0.6), "だい": ("で", -0.6), "だえ": ("で", -0.6),
    "ない": ("ね", -0.6), "なえ": ("ね", -0.6), "はい": ("へ", -0.1), "はえ": ("へ", -0.1), "ばい": ("べ", -0.6), "ばえ": ("べ", -0.6), "ぱい": ("ぺ", -0.6), "ぱえ": ("ぺ", -0.6),
    "まい": ("め", -0.6), "まえ": ("め", -0.6), "やい": ("や", -0.6), "やえ": ("や", -0.6), "らい": ("れ", -0.6), "らえ": ("れ", -0.6),
}
# Characters that are cheap to leave out or put in; marks of length.
CHEAP = {"ー": 0.3, "〜": 0.3, "～": 0.3, "っ": 0.3}
LONG_MARKS = "ー～〜"


@lru_cache(None)
def _pair_costs() -> dict[str, float]:
    """Cost of a pair of characters, in either order."""
    return {a + b: c for x, y, c in REPLACED for a, b in ((x, y), (y, x))}


def _substitution(a: str, b: str, before_a: str, before_b: str) -> float:
    """Cost of one character for another, each with the one before it: the least of what the tables allow, 1 otherwise."""
    costs = [1.0, _pair_costs().get(a + b, 1.0)]
    for kana, before, mark, before_mark in ((a, before_a, b, before_b), (b, before_b, a, before_a)):
        if mark in LONG_MARKS:
            if before == before_mark and PROLONGED.get(before) == kana:
                costs.append(PROLONGED_COST)
            merged, cost = MERGED.get(before + kana, ("", 1.0))
            if merged and before != before_mark and merged == before_mark:
                costs.append(cost)
    return min(costs)


@lru_cache(None)
def vowel_kana(vowels: str) -> str:
    """Kana of the regular rows whose vowel is one of these."""
    return "".join(k for row in _ROWS.values() for k, v in zip(row, "aiueo") if v in vowels)


def weighted_distance(s: str, t: str) -> float:
    """Edit distance of two readings where spelling variants are cheap. Not a metric: a contraction has negative cost."""
    above = [float(j) for j in range(len(t) + 1)]
    for i, a in enumerate(s, 1):
        row = [float(i)]
        for j, b in enumerate(t, 1):
            swap = 0.0 if a == b else _substitution(a, b, s[i - 2 : i - 1] if i > 1 else "", t[j - 2 : j - 1] if j > 1 else "")
            row.append(min(above[j] + CHEAP.get(a, 1.0), row[j - 1] + CHEAP.get(b, 1.0), above[j - 1] + swap))
        above = row
    return above[-1]


#: The distance up to which readings are found by near_keys().
NEAR = 0.5


@lru_cache(None)
def _skeleton() -> dict[int, str]:
    """For str.translate: characters that are cheap to exchange become one, those that are cheap to leave out go."""
    fold = {y: x for x, y, _ in REPLACED if x not in CHEAP and y not in CHEAP}
    gone = {c for x, y, _ in REPLACED if x in CHEAP or y in CHEAP for c in (x, y)} | set(CHEAP)
    return str.maketrans(fold | dict.fromkeys(gone, ""))


def near_keys(s: str) -> list[str]:
    """Keys of a reading, its skeleton first: of two readings at a distance of at most NEAR, one has the other's skeleton
    among its keys. Within NEAR there is room for cheap characters, all lost in the skeleton, and besides for one kana
    written as a long mark or one contraction: that costs 0.4 with the kana exchanged, left out or put in before it."""
    keys = [s]
    for i in range(1, len(s)):
        if PROLONGED.get(s[i - 1]) == s[i]:
            keys.append(s[:i] + s[i + 1 :])
        merged, cost = MERGED.get(s[i - 1 : i + 1], ("", 1.0))
        if merged and 1 + cost <= NEAR:
            keys += [s[: i - 1] + merged + s[i + 1 :], s[:i] + merged + s[i + 1 :]]
            if s[i - 2 : i - 1] == merged:
                keys.append(s[: i - 1] + s[i + 1 :])
    return list(dict.fromkeys(k.translate(_skeleton()) for k in keys))


def euc_convertible(s: str) -> bool:
    """Whether the two-byte character set holds the whole text: no ASCII, half-width kana or three-byte characters."""
    try:
        data = s.encode("euc_jp")
    except UnicodeEncodeError:
        return False
    return bool(data) and len(data) == 2 * len(s) and all(b >= 0xA1 for b in data)


@lru_cache(None)
def two_byte_class(syntax: str = "java") -> str:
    """The characters of the two-byte set as the inside of a character class, by rule from the installed codec."""
    codes = sorted(c for c in range(0xA1, 0x10000) if not 0xD800 <= c < 0xE000 and euc_convertible(chr(c)))
    out, at = [], 0
    while at < len(codes):
        end = at
        while end + 1 < len(codes) and codes[end + 1] == codes[end] + 1:
            end += 1
        out.append(f"\\x{{{codes[at]:X}}}" if end == at else f"\\x{{{codes[at]:X}}}-\\x{{{codes[end]:X}}}")
        at = end + 1
    return "".join(out)


def euc_convertible_column(c: Column) -> Column:
    """euc_convertible() as a JVM expression: nothing is left when the set's characters are taken away."""
    everything = "".join(chr(x) for x in range(0xA1, 0x10000) if not 0xD800 <= x < 0xE000 and euc_convertible(chr(x)))
    return (F.length(c) > 0) & (F.length(F.translate(c, everything, "")) == 0)


def base_verb(potential: str) -> tuple[str, str] | None:
    """Base verb and its inflection type for a potential verb in dictionary form, or None."""
    # E-column kana before る, the u-column kana of the base verb, its row.
    rows = {"え": ("う", "ワ"), "け": ("く", "カ"), "せ": ("す", "サ"), "て": ("つ", "タ"), "め": ("む", "マ"), "れ": ("る", "ラ"), "げ": ("ぐ", "ガ"), "べ": ("ぶ", "バ")}
    if len(potential) < 3 or potential[-1] != "る" or potential[-2] not in rows:
        return None
    u, row = rows[potential[-2]]
    return potential[:-2] + u, f"子音動詞{row}行"


def kanji_variants(midasi: str, variants: dict[str, str]) -> Iterator[str]:
    """All spellings with characters exchanged for their variants, the word itself left out, one after the other: their
    number is the product of the choices, so they are never held together."""
    choices = [[c, *(x for x in variants.get(c, "") if x != c)] for c in midasi]
    spellings = product(*choices)
    next(spellings)  # the word itself
    return ("".join(p) for p in spellings)


def explode_variants(df: DataFrame, word: str, variants: dict[str, str], chunk: int = 10_000) -> DataFrame:
    """df with `variant`: a row for each spelling of the word, in batches of at most `chunk` rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("variant", T.StringType())])

    def rows(batches):
        for b in batches:
            for r in b.to_dict("records"):
                spellings = kanji_variants(r[word], variants) if r[word] else iter(())
                while part := list(islice(spellings, chunk)):
                    yield pd.DataFrame([{**r, "variant": v} for v in part], columns=schema.names)

    return df.mapInPandas(rows, schema)


romanize_udf = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else romanize(x)), T.StringType())
distance_udf = F.pandas_udf(lambda s, t: pd.Series([None if a is None or b is None else weighted_distance(a, b) for a, b in zip(s, t)], dtype="float64"), T.DoubleType())
near_keys_udf = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else near_keys(x)), T.ArrayType(T.StringType()))
euc_udf = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else euc_convertible(x)), T.BooleanType())
