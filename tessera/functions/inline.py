"""Functions of the dialect as Spark expressions: everything here stays inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Callable


def _literal(text: str) -> str | None:
    return text[1:-1].replace("''", "'") if re.fullmatch(r"'(?:[^']|'')*'", text) else None


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def json_path(key: str) -> str | None:
    """The path of a literal key or index, as a Spark literal; None if it isn't one that a path can say."""
    if re.fullmatch(r"\d+", key):
        return f"'$[{key}]'"
    text = _literal(key)
    if text is None or re.search(r"['\"\\\]\[*]", text):
        return None
    return f'"$[\'{text}\']"'


def json_get(args: list[str]) -> str:
    if (path := json_path(args[1])) is None:
        return f"json_get_udf({args[0]}, cast({args[1]} as string))"
    return f"to_json(try_variant_get(try_parse_json({args[0]}), {path}, 'variant'))"


def json_get_str(args: list[str]) -> str:
    """JSON null is the text null, as everywhere in the dialect."""
    if (path := json_path(args[1])) is None:
        return f"json_get_str_udf({args[0]}, cast({args[1]} as string))"
    return f"(CASE WHEN is_variant_null(try_variant_get(try_parse_json({args[0]}), {path}, 'variant')) THEN 'null' ELSE get_json_object({args[0]}, {path}) END)"


def _gcd(a: str, b: str) -> str:
    return f"aggregate(sequence(1, 93), named_struct('x', abs(cast({a} as bigint)), 'y', abs(cast({b} as bigint))), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"


def _lcm(a: str, b: str) -> str:
    return f"if({a} = 0 or {b} = 0, 0, abs(cast({a} as bigint)) div {_gcd(a, b)} * abs(cast({b} as bigint)))"


def _to_char(args: list[str]) -> str | None:
    mask = _literal(args[1])
    if mask is None or re.search("[YMHSymd]", mask):
        return None if mask is None else f"date_format({args[0]}, {_quote(java_pattern(mask))})"
    decimals = len(re.findall("[90]", re.split("[.D]", mask, maxsplit=1)[1])) if re.search("[.D]", mask) else 0
    body = f"format_number(abs(cast({args[0]} as double)), {decimals})"
    if not re.search("[,G]", mask):
        body = f"replace({body}, ',', '')"
    return f"concat(if({args[0]} < 0, '-', ''), {body})"


#: strftime letters and those of Java.
_LETTERS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "I": "hh", "p": "a", "j": "DDD", "f": "SSSSSS", "%": "%"}


def java_pattern(mask: str) -> str:
    return re.sub("%(.)", lambda m: _LETTERS.get(m[1], m[1]), mask).replace("%F", "yyyy-MM-dd").replace("%T", "HH:mm:ss")


def _format(args: list[str]) -> str | None:
    """%s %I %L take the next argument as text, %% is a percent sign, other %x stay."""
    mask = _literal(args[0])
    if mask is None:
        return f"format_udf({args[0]}, array({', '.join(f'cast({a} as string)' for a in args[1:])}))"
    rest, parts = args[1:], []
    for piece in re.findall(r"%[sIL%]|[^%]+|%", mask):
        if piece in ("%s", "%I", "%L"):
            parts.append(f"coalesce(cast({rest.pop(0)} as string), '')" if rest else "''")
        else:
            parts.append(_quote("%" if piece == "%%" else piece))
    return f"concat({', '.join(parts)})" if parts else "''"


def _renamed(name: str) -> Callable[[list[str]], str]:
    return lambda args: f"{name}({', '.join(args)})"


def _date(fn: str):
    def make(args: list[str]) -> str | None:
        if len(args) < 2 or (mask := _literal(args[1])) is None:
            return None
        return f"{fn}({args[0]}, {_quote(java_pattern(mask))})"

    return make


CALLS: dict[str, Callable[[list[str]], str | None]] = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else None,
    "hex": lambda a: f"lower(hex({a[0]}))",
    "to_hex": lambda a: f"lower(hex({a[0]}))",
    "trunc": lambda a: f"cast(if({a[0]} < 0, ceil({a[0]}), floor({a[0]})) as double)" if len(a) == 1 else None,
    "ceil": lambda a: f"cast(ceil({a[0]}) as double)",
    "floor": lambda a: f"cast(floor({a[0]}) as double)",
    "mod": lambda a: f"if(({a[1]}) = 0, null, cast({a[0]} as double) % cast({a[1]} as double))",
    "div": lambda a: f"if(({a[1]}) = 0, null, cast(cast(cast({a[0]} as double) / cast({a[1]} as double) as bigint) as double))",
    "gcd": lambda a: _gcd(*a),
    "lcm": lambda a: _lcm(*a),
    "find_idx": lambda a: f"instr({a[0]}, {a[1]})",
    "strpos": lambda a: f"instr({a[0]}, {a[1]})",
    "stdev": _renamed("stddev_samp"),
    "variance": _renamed("var_samp"),
    "approx_distinct": _renamed("approx_count_distinct"),
    "approx_percentile": _renamed("percentile_approx"),
    "approx_quantile": _renamed("percentile_approx"),
    "approx_median": lambda a: f"percentile_approx({a[0]}, 0.5)",
    "generate_uuid": _renamed("uuid"),
    "add_month": _renamed("add_months"),
    "array_prepend": lambda a: f"array_prepend({a[1]}, {a[0]})",
    "array_slice": lambda a: f"slice({a[0]}, {a[1]}, ({a[2]}) - ({a[1]}) + 1)",
    "array_sort": _renamed("sort_array"),
    "to_number": lambda a: f"try_cast(regexp_replace({a[0]}, '[^0-9.+-]', '') as double)",
    "to_char": _to_char,
    "format": _format,
    "to_date": _date("to_date"),
    "to_timestamp": _date("to_timestamp_ntz"),
    "json_get": json_get,
    "json_get_str": json_get_str,
    "json_contains": lambda a: f"json_contains_udf({a[0]}, {a[1]})",
    "jsonb_path_query": lambda a: f"jsonb_path_first_udf({a[0]}, {a[1]})",
    "jsonb_path_query_first": lambda a: f"jsonb_path_first_udf({a[0]}, {a[1]})",
    "jsonb_path_query_array": lambda a: f"jsonb_path_array_udf({a[0]}, {a[1]})",
    "json_array": lambda a: f"json_array_udf({a[0]}, {a[1]})",
    "hll_build": lambda a: f"hll_sketch_agg(cast({a[0]} as string), 14)",
    "hll_merge": lambda a: f"hll_union_agg({a[0]})",
    "hll_count": lambda a: f"hll_sketch_estimate({a[0]})",
    "series": lambda a: f"range(1, ({a[0]}) + 1)",
}


def call(name: str, args: list[str]) -> str:
    return CALLS[name](args)
