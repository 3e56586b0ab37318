"""Analysers as plug-ins: one long-lived analyser for each task, fed in Arrow batches; restarted when it fails."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([T.StructField("midasi", T.StringType()), T.StructField("hinsi", T.StringType()), T.StructField("start", T.IntegerType())])


class Analyser(Protocol):
    def analyse(self, text: str) -> list[tuple[str, str, int]] | None:
        """(surface, part of speech, offset) of each word, or None if it fails."""


class LongestMatch:
    """Longest words of a dictionary first; what no word covers falls into runs of one script."""

    def __init__(self, words: dict[str, str]):
        self.words, self.longest = words, max(map(len, words), default=0)

    def analyse(self, text: str) -> list[tuple[str, str, int]]:
        out, at = [], 0
        while at < len(text):
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if text[at : at + n] in self.words:
                    out.append((text[at : at + n], self.words[text[at : at + n]], at))
                    at += n
                    break
            else:
                m = re.compile(r"[一-鿿々]+|[ァ-ヴー]+|[ぁ-ゖ]|[A-Za-z]+|\s+|.", re.S).match(text, at)
                if not m.group().isspace():
                    out.append((m.group(), "未定義語", at))
                at = m.end()
        return out


REGISTRY: dict[str, Callable[[], Analyser]] = {}


def register(name: str, factory: Callable[[], Analyser]) -> None:
    REGISTRY[name] = factory


def analyse(df: DataFrame, text: str, factory: Callable[[], Analyser], restart_every: int = 10_000) -> DataFrame:
    """Adds `words`: an array of words, null where the analyser fails twice. The analyser is made anew after
    `restart_every` texts and after a failure."""
    schema = T.StructType([*df.schema.fields, T.StructField("words", T.ArrayType(WORD))])

    def run(batches: Iterator) -> Iterator:
        tool, used = factory(), 0
        for b in batches:
            got = []
            for x in b[text]:
                words = None
                if x is not None:
                    for _ in range(2):
                        if used >= restart_every:
                            tool, used = factory(), 0
                        used += 1
                        try:
                            words = tool.analyse(x)
                        except Exception:
                            words = None
                        if words is not None:
                            break
                        used = restart_every
                got.append(None if words is None else [{"midasi": m, "hinsi": h, "start": s} for m, h, s in words])
            yield b.assign(words=got)

    return df.mapInPandas(run, schema)


def first_of(*columns: str):
    """The first analysis that is there."""
    return F.coalesce(*columns)


def raw_of(words: str):
    """The text of an analysis."""
    return F.array_join(F.transform(words, lambda w: w["midasi"]), "")
