"""Options of an engine: defaults, a file of `name: value` lines, and what the caller sets, in this order."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """least_examples: examples that a word needs; safe: stricter rules; files_per_batch: files that a stream takes at once."""

    least_examples: int = 3
    safe: bool = False
    files_per_batch: int = 50
    dictionary: str = ""
    analyser: str = ""


def parse(text: str) -> dict[str, str]:
    """`name: value` lines; # starts a comment. Nothing in a file is ever executed."""
    out = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if line:
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no colon in {line!r}")
            out[name.strip()] = value.strip()
    return out


def load(path: str | None = None, **given) -> Options:
    """The defaults, over them the file's options, over them the given ones; unknown names are refused."""
    kinds = {f.name: f.type for f in fields(Options)}
    values = {}
    if path:
        with open(path, encoding="utf-8") as f:
            values = parse(f.read())
    unknown = set(values) | set(given)
    unknown -= set(kinds)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    cast = {"int": int, "bool": lambda x: str(x).lower() in ("1", "true", "yes"), "str": str}
    return replace(Options(), **{k: cast[kinds[k]](v) for k, v in (values | given).items()})


def plugin(name: str) -> Callable:
    """What `module:attribute` names."""
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"{name!r} is not of the form module:attribute")
    return getattr(importlib.import_module(module), attribute)
