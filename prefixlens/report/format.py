"""Text forms of values in the reports."""

from __future__ import annotations

import re


def human_bytes(n: int) -> str:
    return f"{n / 1048576:.1f} MB" if n >= 1048576 else f"{n / 1024:.0f} KB" if n >= 1024 else f"{n} B"


def short_id(text: str, n: int = 12) -> str:
    return text if len(text) <= n else text[:n] + "…"


def percent(ratio: float | None) -> str:
    return "-" if ratio is None else f"{ratio * 100:.1f} %"


def flatten(text: str, limit: int | None = None) -> str:
    flat = " ".join(text.replace("\\n", " ").split())
    return flat if limit is None or len(flat) <= limit else flat[:limit] + "…"


def session_label(key: str, prefix: str = "", limit: int = 32) -> str:
    rest = key[len(prefix) :] if prefix and len(key) > len(prefix) else key
    return rest if len(rest) <= limit else f"{rest[:8]}…{rest[-12:]}"


def common_prefix(keys: list[str]) -> str:
    if len(keys) < 2:
        return ""
    a, b = min(keys), max(keys)
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


# GitHub-flavoured Markdown

_SPECIAL = re.compile(r"([\\`*_{}\[\]()<>#+\-.!|~&])")


def inline(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", flatten(text))


def _fence(text: str, least: int) -> str:
    longest = max((len(m) for m in re.findall(r"`+", text)), default=0)
    return "`" * max(least, longest + 1)


def code(text: str) -> str:
    text = flatten(text)
    f = _fence(text, 1)
    pad = " " if not text or text[0] == "`" or text[-1] == "`" else ""
    return f"{f}{pad}{text}{pad}{f}"


def table_code(text: str) -> str:
    return code(text).replace("|", "\\|")


def fenced(text: str) -> str:
    f = _fence(text, 3)
    return f"{f}\n{text}\n{f}"


def anchor(heading: str) -> str:
    """The fragment a heading is reached under: lower case, words joined by hyphens."""
    return re.sub(r"\s", "-", re.sub(r"[^\w\s-]", "", heading.strip().lower()))


def named(template: str, **values: object) -> str:
    """Fill {name} places; {{ and }} are braces. Every place needs a value and every value a place."""
    used: set[str] = set()
    out, at = [], 0
    while at < len(template):
        c = template[at]
        if template[at : at + 2] in ("{{", "}}"):
            out.append(c)
            at += 2
        elif c == "{":
            end = template.find("}", at)
            name = template[at + 1 : end] if end > 0 else ""
            if not name.isidentifier():
                raise ValueError(f"bad place at {at} in {template!r}")
            if name not in values:
                raise ValueError(f"no value for {name}")
            used.add(name)
            out.append(str(values[name]))
            at = end + 1
        elif c == "}":
            raise ValueError(f"stray brace at {at} in {template!r}")
        else:
            out.append(c)
            at += 1
    if unused := values.keys() - used:
        raise ValueError(f"no place for {', '.join(sorted(unused))}")
    return "".join(out)
