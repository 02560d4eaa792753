"""Labels of generated tool calls against the expected ones: 0 agrees, 1 does not.  Arrow-batched, as Python's JSON rules decide."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

# What counts as code in an answer that should be text.
CODE = ("import ", "def ", "class ", "```python")
TICKS = "```"
_MISSING = object()


def find_json(text: str):
    """The value between the first { and the last }, else of the whole text; _MISSING if neither parses."""
    text = text.strip()
    a, b = text.find("{"), text.rfind("}")
    for part in ([text[a : b + 1]] if a != -1 and b != -1 else []) + [text]:
        try:
            value = json.loads(part)
        except ValueError:
            continue
        return _MISSING if value is None else value
    return _MISSING


def _arguments(call: dict):
    args = call.get("arguments", {})
    if isinstance(args, str):
        try:
            return json.loads(args)
        except ValueError:
            return args
    return args


def _number(x):
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def _alike(a, b) -> bool:
    if str(a) == str(b):
        return True
    x, y = _number(a), _number(b)
    return x is not None and y is not None and x == y


def _leaks(truth: str, generated: str) -> bool:
    return TICKS in generated or (any(k in generated for k in CODE) and not any(k in truth for k in CODE))


def structured(truth: str, generated: str, strict: bool = False) -> int | None:
    """Rules in order; ``strict`` wants equal arguments and gives None where a value is no object."""
    want, got = find_json(truth), find_json(generated)
    if want is _MISSING and got is _MISSING:
        return int(_leaks(truth, generated))
    if want is _MISSING or got is _MISSING:
        return 0 if want is _MISSING and truth.strip().startswith("{") else 1
    if not (isinstance(want, dict) and isinstance(got, dict)):
        return None if strict else 1
    if "parameters" in got or want.get("name") != got.get("name"):
        return 1
    a, b = _arguments(want), _arguments(got)
    if a == b:
        return 0
    if strict:
        return int(str(a) != str(b))
    both = isinstance(a, dict) and isinstance(b, dict)
    return int(not (both and all(k in b and _alike(b[k], v) for k, v in a.items())))


# The forms of a call in a reasoning-and-acting answer.
ACTION = re.compile(r"Action:\s*(\w+)\s*Action Input:\s*(\{.*?\})", re.DOTALL)
CALL = re.compile(r"(\w+)\((.*?)\)")
PAIR = re.compile(r"(\w+)\s*=\s*(['\"]?)(.*?)\2(?:,|$)")


def call_of(text: str) -> tuple[str, dict] | None:
    if m := ACTION.search(text):
        try:
            return m[1], json.loads(m[2])
        except ValueError:
            pass
    if m := CALL.search(text):
        return m[1], {p[1]: p[3] for p in PAIR.finditer(m[2])}
    return None


def react(truth: str, generated: str) -> int:
    want, got = call_of(truth), call_of(generated)
    if not want or not got or want[0].lower() != got[0].lower():
        return 1
    plain = lambda v: str(v).lower().strip().replace(" ", "")
    return int(not all(k in got[1] and plain(v) == plain(got[1][k]) for k, v in want[1].items()))


def _both(rule):
    @F.pandas_udf("int")
    def label(truth: pd.Series, generated: pd.Series) -> pd.Series:
        return pd.Series([rule(a or "", b or "") for a, b in zip(truth, generated, strict=True)], dtype="Int32")

    return label


def json_label(strict: bool = False):
    return _both(lambda a, b: structured(a, b, strict))


def react_label():
    return _both(react)
