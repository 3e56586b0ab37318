"""S-expressions of dictionary files: reading, entries, and writing them back. Nothing in a file is ever executed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import ENTRY

_TOKEN = re.compile(r'\s*(?:;([^\n]*)|([()])|"((?:[^"\\]|\\.)*)"|([^\s()";]+))')
#: Stands for a semantic mark without a value.
NO_VALUE = None


class SexpError(ValueError):
    pass


class Text(str):
    """A quoted string, to be told from a symbol."""


def parse(text: str) -> Iterator[tuple[list, list[str]]]:
    """(expression, comments before it) of every top-level expression: nested lists of symbols, numbers and Text."""
    at, stack, comments = 0, [], []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip():
                raise SexpError(f"unreadable at {text[at:at + 20]!r}")
            break
        at = m.end()
        comment, paren, string, symbol = m.groups()
        if comment is not None:
            if not stack:
                comments.append(comment.strip())
        elif paren == "(":
            stack.append([])
        elif paren == ")":
            if not stack:
                raise SexpError("a closing bracket without an opening one")
            done = stack.pop()
            if stack:
                stack[-1].append(done)
            else:
                yield done, comments
                comments = []
        else:
            if not stack:
                raise SexpError("a symbol outside brackets")
            if string is not None:
                stack[-1].append(Text(re.sub(r"\\(.)", r"\1", string)))
            else:
                stack[-1].append(float(symbol) if re.fullmatch(r"-?\d+(?:\.\d+)?", symbol) else symbol)
    if stack:
        raise SexpError("a bracket is not closed")


def _imis(text: str) -> dict[str, str | None]:
    out: dict[str, str | None] = {}
    for part in text.split():
        key, colon, value = part.partition(":")
        out[key] = value if colon else NO_VALUE
    return out


def _spellings(forms: list) -> dict[str, float]:
    out: dict[str, float] = {}
    for f in forms:
        if isinstance(f, list):
            out[str(f[0])] = float(f[1])
        else:
            out[str(f)] = 1.0
    return out


def _fields(rest: list) -> dict:
    e: dict = {"katuyou1": None, "yomi": None, "midasi": {}, "imis": None}
    for item in rest:
        head, *values = item
        if head == "見出し語":
            e["midasi"] = _spellings(values)
        elif head == "読み":
            e["yomi"] = str(values[0])
        elif head == "活用型":
            e["katuyou1"] = str(values[0])
        elif head == "意味情報":
            e["imis"] = _imis(str(values[0]))
    return e


def entries(text: str) -> Iterator[dict]:
    """Entries of a dictionary file. An entry head with a subclass may hold several entries; a compound (連語) becomes one
    entry whose spellings are all combinations of its parts', with cost -1 unless the expression gives one."""
    for expr, comments in parse(text):
        annotation = {}
        for c in comments:
            key, colon, value = c.partition(":")
            if colon:
                annotation[key.strip()] = value.strip()
        annotation = annotation or None
        if expr[0] == "連語":
            *body, last = expr[1:]
            cost = last if isinstance(last, float) else -1.0
            parts = [e for p in (body if isinstance(last, float) else [*body, last]) for e in _one(q for q in ([p] if p and not isinstance(p[0], list) else p))]
            midasi, yomi = {"": 1.0}, ""
            for p in parts:
                midasi = {a + b: cost for a in midasi for b in p["midasi"]}
                yomi += p["yomi"] or ""
            yield {"hinsi": "連語", "bunrui": None, "katuyou1": parts[-1]["katuyou1"] if parts else None, "yomi": yomi, "midasi": midasi, "imis": None, "annotation": annotation}
            continue
        for e in _one([expr]):
            yield e | {"annotation": annotation}


def _one(exprs) -> Iterator[dict]:
    for expr in exprs:
        hinsi, *rest = expr
        groups = [(None, [r for r in rest])] if rest and isinstance(rest[0], list) and isinstance(rest[0][0], list) else None
        if groups is None:
            groups = []
            for r in rest:
                if r and isinstance(r[0], list):
                    groups.append((None, [r]))
                else:
                    groups.append((str(r[0]), [x for x in r[1:]]))
        for bunrui, own in groups:
            for spec in own:
                yield {"hinsi": str(hinsi), "bunrui": bunrui, **_fields(spec)}


def serialize(e: dict) -> str:
    """One entry as an expression, annotations as comments before it."""
    def quoted(s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    forms = " ".join(m if c == 1 else f"({m} {c:g})" for m, c in e["midasi"].items())
    parts = [f"(見出し語 {forms})"]
    if e.get("yomi"):
        parts.append(f"(読み {e['yomi']})")
    if e.get("katuyou1"):
        parts.append(f"(活用型 {e['katuyou1']})")
    if e.get("imis"):
        parts.append(f"(意味情報 {quoted(' '.join(k if v is None else f'{k}:{v}' for k, v in e['imis'].items()))})")
    body = f"({' '.join(parts)})"
    comments = "".join(f"; {k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}\n" for k, v in (e.get("annotation") or {}).items())
    return f"{comments}({e['hinsi']} ({e['bunrui']} {body}))" if e.get("bunrui") else f"{comments}({e['hinsi']} {body})"


def read_dictionary(spark: SparkSession, path: str, glob: str = "*.dic") -> DataFrame:
    """Entries of all dictionary files under a path; a file is one record, as an entry may run over lines."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    schema = T.StructType([*ENTRY.fields])

    def rows(batches):
        import pandas as pd

        for b in batches:
            got = [e for text in b["value"] for e in entries(text)]
            yield pd.DataFrame(got, columns=schema.names) if got else pd.DataFrame(columns=schema.names)

    return files.mapInPandas(rows, schema)


def write_dictionary(df: DataFrame, path: str) -> None:
    """Entries as expressions, one file for each partition; an empty dictionary writes an empty folder."""
    def lines(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"value": [serialize({k: (dict(v) if isinstance(v, (list, dict)) or hasattr(v, "items") else v) for k, v in r._asdict().items() if k != "Index"}) for r in b.itertuples()]})

    cols = [c for c in ENTRY.names if c in df.columns]
    df.select(*cols).mapInPandas(lines, T.StructType([T.StructField("value", T.StringType())])).write.mode("overwrite").option("compression", "none").text(path)


