"""Strict decoding of captured payloads: one parse per payload, shared by every Arrow stage."""

from __future__ import annotations

import json
import re

#: Keys of an object block whose first string is the block's text, in order (fixed values).
BLOCK_TEXT_KEYS = ("text", "input_text", "output_text", "content")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Digits from which an integer is read as a float: the interpreter's own limit for int().
DIGITS = 4000
#: Levels decoded at once where a text is nested too deeply for the decoder.
LEVELS = 200
_MARK = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def _integer(text: str) -> int | float:
    return int(text) if len(text) < DIGITS else float(text)


_decode = json.JSONDecoder(parse_constant=_no_constant, parse_int=_integer).decode


def _decode_deep(text: str) -> object:
    """The value of a text of any depth. What lies deeper than LEVELS is checked a piece at a time and becomes 0."""
    open_: list[list[str]] = [[]]
    last = depth = 0
    for m in _MARK.finditer(text):
        c = m.group()
        if c in "[{":
            if depth and depth % LEVELS == 0:
                open_[-1].append(text[last : m.start()])
                open_.append([])
                last = m.start()
            depth += 1
        elif c in "]}":
            depth -= 1
            if depth > 0 and depth % LEVELS == 0 and len(open_) > 1:
                _decode("".join([*open_.pop(), text[last : m.end()]]))
                open_[-1].append("0")
                last = m.end()
    if len(open_) > 1:
        raise ValueError("brackets left open")
    return _decode("".join([*open_[0], text[last:]]))


def loads(text: str) -> object:
    """The value of a JSON text, ValueError for anything else (also NaN).

    Integers of any length and any depth are JSON; a value deeper than LEVELS is only told to be one.
    """
    try:
        return _decode(text)
    except RecursionError:
        return _decode_deep(text)


def sound(text: str | None) -> dict | None:
    """The payload if it is an object whose messages is an array of objects only, else None."""
    if text is None:
        return None
    try:
        value = loads(text)
    except ValueError:
        return None
    if type(value) is not dict:
        return None
    messages = value.get("messages")
    if type(messages) is not list:
        return None
    for m in messages:
        if type(m) is not dict:
            return None
    return value


def block_string(block: object) -> str | None:
    if type(block) is str:
        return block
    if type(block) is dict:
        for key in BLOCK_TEXT_KEYS:
            if type(v := block.get(key)) is str:
                return v
    return None


def content_strings(content: object) -> list[str]:
    """A string content by itself, else the strings of its blocks in order."""
    if type(content) is str:
        return [content]
    if type(content) is list:
        return [s for s in map(block_string, content) if s is not None]
    return []


def utf8(text: str) -> bytes:
    """JSON can hold lone surrogates, which UTF-8 cannot."""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace")


def clean(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return utf8(text).decode()
