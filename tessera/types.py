"""Type names of the dialect and what they are in Spark."""

from __future__ import annotations

import re

#: Spelling -> (name in the dialect, Spark type).
_NAMES = {
    "BOOLEAN": ("BOOLEAN", "boolean"),
    "INTEGER": ("INTEGER", "bigint"),
    "FLOAT": ("FLOAT", "double"),
    "DECIMAL": ("DECIMAL", "decimal(38,18)"),
    "TEXT": ("TEXT", "string"),
    "BYTEA": ("BYTEA", "binary"),
    "DATE": ("DATE", "date"),
    "TIME": ("TIME", "string"),
    "TIMESTAMP": ("TIMESTAMP", "timestamp_ntz"),
    "INTERVAL": ("INTERVAL", "string"),
    "UUID": ("UUID", "string"),
    "INET": ("INET", "string"),
    "POINT": ("POINT", "string"),
    "JSON": ("JSON", "string"),
    "JSONB": ("JSONB", "string"),
    "INT8": ("INT8", "int"),
    "INT16": ("INT16", "int"),
    "INT32": ("INT32", "int"),
    "UINT8": ("UINT8", "int"),
    "UINT16": ("UINT16", "int"),
    "UINT32": ("UINT32", "bigint"),
    "UINT64": ("UINT64", "decimal(20,0)"),
    "INT128": ("INT128", "decimal(38,0)"),
    "UINT128": ("UINT128", "decimal(38,0)"),
}
_ALIASES = {
    "BOOLEAN": "BOOL",
    "INTEGER": "INT INT2 INT4 INT64 BIGINT SMALLINT TINYINT MEDIUMINT HUGEINT SERIAL BIGSERIAL",
    "FLOAT": "DOUBLE REAL FLOAT4 FLOAT8 FLOAT32 FLOAT64",
    "DECIMAL": "NUMERIC DEC",
    "TEXT": "VARCHAR CHAR STRING CHARACTER NVARCHAR CLOB BPCHAR",
    "BYTEA": "BLOB BINARY VARBINARY BYTES",
    "TIMESTAMP": "DATETIME TIMESTAMPTZ",
}
for _to, _from in _ALIASES.items():
    for _name in _from.split():
        _NAMES[_name] = _NAMES[_to]
UNSUPPORTED = ("BIT", "STRUCT", "ENUM")


def normalize(spelling: str) -> tuple[str, str]:
    """(name, Spark type); lengths and precisions are ignored; LIST and MAP hold strings unless said otherwise."""
    text = re.sub(r"\s+PRECISION$", "", spelling.strip().upper())
    if m := re.fullmatch(r"(?:LIST|ARRAY)(?:<(.*)>)?|(.*)\[\]", text):
        inner = m[1] or m[2]
        return "LIST", f"array<{normalize(inner)[1] if inner else 'string'}>"
    if m := re.fullmatch(r"MAP(?:<\s*TEXT\s*,\s*(.*)>)?", text):
        return "MAP", f"map<string,{normalize(m[1])[1] if m[1] else 'string'}>"
    name = re.sub(r"\s*\(.*\)$", "", text)
    if name in UNSUPPORTED or name not in _NAMES:
        raise ValueError(f"unsupported type {spelling!r}")
    return _NAMES[name]


def parameter(text: str):
    """A query-string operand: null, booleans, integers, floats, else text."""
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    for kind in (int, float):
        try:
            if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)", text):
                return kind(text)
        except ValueError:
            pass
    return text
