"""Three-position rules over token sequences: a small rule language, parsed on the driver, compiled to one CASE.

A rule is ((previous self next) NAME). A position is *, which anything matches; |, which only a missing neighbour
matches; or [atoms], all of which must hold; ^ before an atom or a position negates it. Atoms are (attribute value) or
(class). A missing neighbour matches a position only if it is negated. Rules are tried in order; the first match names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LEX = re.compile(r"\s*([()\[\]^*|]|[^\s()\[\]^*|]+)")
CLASSES = {"ひらがな": "^[ぁ-ゖー]+$", "カタカナ": "^[ァ-ヴー]+$", "漢字": "^[一-鿿々]+$", "一文字漢字": "^[一-鿿々]$"}
COLUMNS = {"見出し語": "midasi", "原形": "genkei", "品詞": "hinsi", "品詞細分類": "bunrui", "活用型": "katuyou1", "活用形": "katuyou2"}


@dataclass(frozen=True)
class Position:
    kind: str  # 'any', 'none' or 'atoms'
    negated: bool = False
    atoms: tuple[tuple[bool, str, str | None], ...] = ()


@dataclass(frozen=True)
class Rule:
    positions: tuple[Position, Position, Position]
    name: str


class RuleError(ValueError):
    pass


def parse(text: str) -> list[Rule]:
    """Rules of a rule file; ; and # start comments."""
    source = "\n".join(re.split(r"[;#]", line, maxsplit=1)[0] for line in text.splitlines())
    toks, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        if not m:
            raise RuleError(f"unreadable at {source[at:at + 20]!r}")
        toks.append(m.group(1))
        at = m.end()
    i = 0

    def take(want: str | None = None) -> str:
        nonlocal i
        if i >= len(toks):
            raise RuleError("the rule breaks off")
        t = toks[i]
        if want is not None and t != want:
            raise RuleError(f"{want!r} expected, {t!r} found")
        i += 1
        return t

    def position() -> Position:
        nonlocal i
        t = take()
        if t == "*":
            return Position("any")
        if t == "|":
            return Position("none")
        negated = t == "^"
        if negated:
            t = take()
        if t != "[":
            raise RuleError(f"a position expected, {t!r} found")
        inner = i < len(toks) and toks[i] == "^" and not negated and toks[i + 1 : i + 2] == ["["]
        if inner:
            raise RuleError("positions do not nest")
        atoms = []
        while toks[i : i + 1] != ["]"]:
            neg = toks[i : i + 1] == ["^"]
            if neg:
                take("^")
            take("(")
            name = take()
            value = None if toks[i : i + 1] == [")"] else take()
            take(")")
            atoms.append((neg, name, value))
        take("]")
        return Position("atoms", negated, tuple(atoms))

    rules = []
    while i < len(toks):
        take("(")
        take("(")
        three = (position(), position(), position())
        take(")")
        name = take()
        take(")")
        rules.append(Rule(three, name))
    return rules


def _atom(name: str, value: str | None, at) -> Column:
    if name == "見出し語長":
        return F.length(at("midasi")) == int(value)
    if name in CLASSES and value is None:
        return at("midasi").rlike(CLASSES[name])
    if name == "未定義語":
        return at("hinsi") == "未定義語"
    if name == "素性":
        return F.coalesce(at("fstring"), F.lit("")).contains(f"<{value}>")
    if name in COLUMNS and value is not None:
        return at(COLUMNS[name]) == value
    raise RuleError(f"unknown atom {name!r}")


def _matches(p: Position, at, there: Column) -> Column:
    if p.kind == "any":
        return F.lit(True)
    if p.kind == "none":
        return ~there
    ok = F.lit(True)
    for neg, name, value in p.atoms:
        one = F.coalesce(_atom(name, value, at), F.lit(False))
        ok = ok & (~one if neg else one)
    return (~there | ~ok) if p.negated else (there & ok)


def first_match(rules: list[Rule], at_prev, at_self, at_next, has_prev: Column, has_next: Column) -> Column:
    """The name of the first rule that matches, else null: an ordered CASE, evaluated in the JVM."""
    out = None
    for r in rules:
        a, b, c = r.positions
        hit = _matches(a, at_prev, has_prev) & _matches(b, at_self, F.lit(True)) & _matches(c, at_next, has_next)
        out = F.when(hit, r.name) if out is None else out.when(hit, r.name)
    return F.lit(None).cast("string") if out is None else out


def match_tokens(df: DataFrame, rules: list[Rule], by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds `feature` to tokens; neighbours by one window over each sequence."""
    w = W.partitionBy(*by).orderBy(*order)
    wide = df.withColumns({f"_p_{c}": F.lag(c).over(w) for c in columns} | {f"_n_{c}": F.lead(c).over(w) for c in columns} | {"_has_p": F.lag(F.lit(True)).over(w), "_has_n": F.lead(F.lit(True)).over(w)})
    null = F.lit(None).cast("string")
    side = lambda mark: lambda c: F.col(f"{mark}{c}") if c in columns else null
    here = lambda c: F.col(c) if c in columns else null
    return wide.withColumn("feature", first_match(rules, side("_p_"), here, side("_n_"), F.coalesce("_has_p", F.lit(False)), F.coalesce("_has_n", F.lit(False)))).drop(*[c for c in wide.columns if c.startswith(("_p_", "_n_", "_has_"))])
