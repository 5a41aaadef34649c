"""Canonical JSON: keys sorted by code point, no white space, one spelling for every number.

Whole numbers of 64 bits are plain; every other number is the shortest text that reads back as the same
double, with a fraction or an exponent (1.0, 0.00001, 1e-7, 1e16). Of repeated keys the last one holds.
"""

from __future__ import annotations

import json
from decimal import Decimal

#: Deeper nesting is refused, as are numbers beyond doubles and lone surrogates.
MAX_DEPTH = 127
_ESCAPE = json.encoder.encode_basestring


def _integer(text: str) -> int | float:
    if len(text) > 18:
        if len(text) > 20 or not -(2**63) <= int(text) < 2**64:
            return _finite(text)
    if text == "-0":
        return -0.0
    return int(text)


def _finite(text: str) -> float:
    v = float(text)
    if v in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return v


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer, parse_float=_finite)


def parse(text: str) -> object:
    """The value of a JSON text, ValueError where it is none."""
    try:
        value = _decoder.decode(text)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    if "\\u" in text:
        _check_surrogates(value)
    if text.count("[") + text.count("{") > MAX_DEPTH and _depth(value) > MAX_DEPTH:
        raise ValueError("nested too deeply")
    return value


def _check_surrogates(value: object) -> None:
    if type(value) is str:
        try:
            value.encode()
        except UnicodeEncodeError:
            raise ValueError("lone surrogate") from None
    elif type(value) is list:
        for v in value:
            _check_surrogates(v)
    elif type(value) is dict:
        for k, v in value.items():
            _check_surrogates(k)
            _check_surrogates(v)


def _depth(value: object) -> int:
    level, stack = 0, [value]
    while stack:
        level += 1
        stack = [x for v in stack for x in (v.values() if type(v) is dict else v if type(v) is list else ())]
    return level


def number(v: float) -> str:
    sign, digits, exponent = Decimal(repr(v)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    exponent += len(digits) - len(text) if text != "0" else -exponent
    minus = "-" if sign else ""
    if text == "0":
        return minus + "0.0"
    point = len(text) + exponent
    if exponent >= 0 and point <= 16:
        return f"{minus}{text}{'0' * exponent}.0"
    if 0 < point <= 16:
        return f"{minus}{text[:point]}.{text[point:]}"
    if -5 < point <= 0:
        return f"{minus}0.{'0' * -point}{text}"
    tail = f".{text[1:]}" if len(text) > 1 else ""
    return f"{minus}{text[0]}{tail}e{point - 1}"


def _write(value: object) -> str:
    if type(value) is str:
        return _ESCAPE(value)
    if value is None or type(value) is bool:
        return json.dumps(value)
    if type(value) is int:
        return str(value) if -(2**63) <= value < 2**64 else number(float(value))
    if type(value) is float:
        return number(value)
    if type(value) is list:
        return f"[{','.join(map(_write, value))}]"
    return "{" + ",".join(f"{_ESCAPE(k)}:{_write(value[k])}" for k in sorted(value)) + "}"


_fast = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def canonical(value: object) -> str:
    if type(value) is str:
        return _ESCAPE(value)
    return _write(value) if _has_odd(value) else _fast(value)


def _has_odd(value: object) -> bool:
    if type(value) is dict:
        return any(map(_has_odd, value.values()))
    if type(value) is list:
        return any(map(_has_odd, value))
    return type(value) is float and "e" in repr(value)
