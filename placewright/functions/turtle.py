"""Statements of Turtle text."""

from __future__ import annotations

import re
from collections.abc import Iterator

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<uri><[^>]*>)|(?P<text>\"\"\"(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<mark>@[A-Za-z][A-Za-z0-9-]*|\^\^)|(?P<end>[.;,](?=\s|$|\#))|(?P<name>[^\s;,<>"']+?(?=[;,]|\.(?:\s|$)|\s|$))""",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    body = text[3:-3] if text.startswith('"""') else text[1:-1]
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def statements(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) as plain strings: URIs in full, literals without language and type."""
    prefixes: dict[str, str] = {}
    base, at, row, skip = "", 0, [], False

    def full(kind: str, value: str) -> str:
        if kind == "uri":
            inner = value[1:-1]
            return inner if ":" in inner or not base else base + inner
        if kind == "text":
            return _plain(value)
        if value == "a" and len(row) == 1:
            return TYPE
        head, colon, rest = value.partition(":")
        return prefixes[head] + rest if colon and head in prefixes else value

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"no statement at {text[at : at + 40]!r}")
        at, kind, value = m.end(), m.lastgroup, m[0]
        if kind == "space":
            continue
        if kind == "mark" and value.lower() in ("@prefix", "@base") and not row or kind == "name" and value.lower() in ("prefix", "base") and not row:
            found = re.compile(r"\s*([^\s:]*:)?\s*<([^>]*)>\s*\.?").match(text, at)
            if found is None:
                raise ValueError(f"no prefix at {text[at : at + 40]!r}")
            at = found.end()
            if found[1] is None:
                base = found[2]
            else:
                prefixes[found[1][:-1]] = found[2]
        elif kind == "mark":
            skip = value == "^^"  # the type of a literal follows
        elif kind == "end":
            if len(row) == 3:
                yield tuple(row)
            row = [] if value == "." else row[:1] if value == ";" else row[:2]
        elif skip:
            skip = False
        else:
            row.append(full(kind, value))
            if len(row) > 3:
                raise ValueError(f"four terms in a statement at {text[max(0, at - 40) : at]!r}")
    if len(row) == 3:
        yield tuple(row)
