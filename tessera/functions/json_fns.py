"""JSON functions that no built-in expresses, as Arrow-batched UDFs over JSON text."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_MISSING = object()


def load(text):
    if text is None:
        return _MISSING
    try:
        return json.loads(text)
    except ValueError:
        return _MISSING


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def member(value, key: str):
    """Object member by text, array element by a text of digits."""
    if isinstance(value, dict):
        return value.get(key, _MISSING)
    if isinstance(value, list) and re.fullmatch(r"\d+", key) and int(key) < len(value):
        return value[int(key)]
    return _MISSING


def contains(a, b) -> bool:
    """Recursive containment: objects by member, arrays by element, a scalar in an array."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains(x, y) for x in a) for y in b)
    if isinstance(a, list) and not isinstance(b, dict):
        return any(contains(x, b) for x in a if not isinstance(x, (list, dict)))
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b


@lru_cache(maxsize=256)
def parse_path(text: str) -> tuple:
    """Steps of a path: a key, an index, or None for all; ``strict`` and ``lax`` are ignored."""
    rest = re.sub(r"^\s*(?:strict|lax)\s+", "", text.strip())
    if not rest.startswith("$"):
        raise ValueError(f"unsupported path {text!r}")
    rest, steps = rest[1:], []
    while rest:
        if m := re.match(r"\.\*|\[\*\]", rest):
            steps.append((m[0] == ".*", None))
        elif m := re.match(r'\.([A-Za-z_][A-Za-z0-9_]*)|\.?"([^"]*)"|\["([^"]*)"\]', rest):
            steps.append((True, next(g for g in m.groups() if g is not None)))
        elif m := re.match(r"\[(\d+)\]", rest):
            steps.append((False, int(m[1])))
        else:
            raise ValueError(f"unsupported path {text!r}")
        rest = rest[m.end() :]
    return tuple(steps)


def walk(value, steps: tuple) -> list:
    found = [value]
    for of_object, key in steps:
        new = []
        for x in found:
            if of_object and isinstance(x, dict):
                new += list(x.values()) if key is None else [x[key]] if key in x else []
            elif not of_object and isinstance(x, list):
                new += x if key is None else [x[key]] if key < len(x) else []
        found = new
    return found


def _each(fn):
    return lambda a, b: pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def _get(text: str, key: str):
    value = member(load(text), key)
    return None if value is _MISSING else dump(value)


def _get_str(text: str, key: str):
    value = member(load(text), key)
    return None if value is _MISSING else value if isinstance(value, str) else dump(value)


def _contains(a: str, b: str):
    x, y = load(a), load(b)
    return None if x is _MISSING or y is _MISSING else contains(x, y)


def _first(text: str, path: str):
    steps, value = parse_path(path), load(text)
    found = [] if value is _MISSING else walk(value, steps)
    return dump(found[0]) if found else None


def _all(text: str, path: str):
    steps, value = parse_path(path), load(text)
    return None if value is _MISSING else dump(walk(value, steps))


def elements(text: str, path: str) -> list:
    value = load(text)
    for key in path.split("."):
        value = member(value, key) if value is not _MISSING else value
    if value is _MISSING or value is None:
        return []
    return [x if isinstance(x, str) else dump(x) for x in (value if isinstance(value, list) else [value])]


def _format(mask: str, args) -> str:
    rest = list(args if args is not None else [])

    def piece(m):
        if m[0] == "%%":
            return "%"
        return (rest.pop(0) or "") if rest else ""

    return re.sub("%[sIL%]", piece, mask)


def register(spark: SparkSession) -> None:
    def arrays(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None or y is None else elements(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    for name, kind, fn in (
        ("json_get_udf", "string", _each(_get)),
        ("json_get_str_udf", "string", _each(_get_str)),
        ("json_contains_udf", "boolean", _each(_contains)),
        ("jsonb_path_first_udf", "string", _each(_first)),
        ("jsonb_path_array_udf", "string", _each(_all)),
        ("json_array_udf", "array<string>", arrays),
        ("format_udf", "string", _each(_format)),
    ):
        spark.udf.register(name, _pandas(fn, kind))


def _pandas(fn, kind: str):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return fn(a, b)

    return F.pandas_udf(run, kind)
