"""Functions of text spans that need state: they run as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SEPARATORS, address_pattern

#: Labels that a parser's answer may not set, and what it becomes if it names the whole address.
RESERVED, WHOLE_LABEL, WHOLE_AS = ("fullConversation", "model-fullAddress", "error"), "fullAddress", "model-fullAddress"


def best_window(key: str, query: str, ignore_case: bool = True) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``key`` nearest to ``query``; end inclusive. Ties: the longest, then the one that ends first.

    Of stretches with one end, the one that starts first counts. With an empty side the stretch is (0, 0).
    """
    if not key or not query:
        return len(query) if not key else 0, 0, 0
    if ignore_case:
        key, query = key.lower(), query.lower()
    row = [(0, j) for j in range(len(key) + 1)]  # cost and start of the best alignment that ends before j
    for i, q in enumerate(query, 1):
        new = [(i, 0)]
        for j, k in enumerate(key, 1):
            new.append(min((row[j - 1][0] + (q != k), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    cost, _, end, start = min((c, s - j, j, s) for j, (c, s) in enumerate(row))
    return cost, start, end - 1


def occurrences(text: str, part: str) -> list[int]:
    """Starts of the non-overlapping occurrences."""
    out, at = [], text.find(part) if part else -1
    while at >= 0:
        out.append(at)
        at = text.find(part, at + len(part))
    return out


def _stretch(text: str, a: str, a_start: int, b: str, b_start: int) -> str | None:
    """From the first part to the end of the one that starts later, if they overlap or only separators lie between."""
    (first, head), (last, tail) = sorted([(a_start, a), (b_start, b)], key=lambda x: x[0]) if a_start != b_start else [(b_start, b), (a_start, a)]
    return text[first : last + len(tail)] if not text[first + len(head) : last].strip(SEPARATORS) else None


def _between(text: str, a: str, b: str) -> str | None:
    """The stretch of ``text`` that holds ``a`` and ``b``, for their first occurrences that can be joined."""
    found = (_stretch(text, a, x, b, y) for x in occurrences(text, a) for y in occurrences(text, b))
    return next((s for s in found if s is not None), None)


def _label(label: str) -> str | None:
    """The label under which a part counts; none if it is a reserved one."""
    if label.startswith("___") or label in RESERVED:
        return None
    return WHOLE_AS if label == WHOLE_LABEL else label


def merged_parts(text: str, parts: Iterable[tuple[str, str]], drop_separators: bool = False) -> dict[str, str]:
    """One value for each label: equal and contained parts merge, adjacent parts become one stretch, others are joined by ``___``."""
    out: dict[str, str] = {}
    for label, part in parts:
        if not part or (label := _label(label)) is None:
            continue
        known = out.get(label)
        if known is None or known in part:
            out[label] = part
        elif part not in known:
            whole = _between(text, known, part)
            if whole is None and drop_separators and not known.strip(SEPARATORS):
                whole = part
            elif whole is None and drop_separators and not part.strip(SEPARATORS):
                whole = known
            out[label] = f"{known}___{part}" if whole is None else whole
    return out


def strictly_merged_parts(text: str, parts: Iterable[tuple[str, str, int]]) -> dict[str, str]:
    """As ``merged_parts`` for parts of known start: parts merge only if they touch, overlap or have separators between, otherwise the first stays."""
    out: dict[str, tuple[str, int]] = {}
    for label, part, start in parts:
        if not part or (label := _label(label)) is None:
            continue
        if label not in out:
            out[label] = part, start
        elif (whole := _stretch(text, *out[label], part, start)) is not None:
            out[label] = whole, min(start, out[label][1])
    return {label: part for label, (part, _) in out.items()}


def found_spans(text: str, parts: Iterable[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, label) of each part, without white space around it, at its first place that no earlier part uses; by start."""
    used: list[tuple[int, int, str]] = []
    for label, part in parts:
        part = (part or "").strip()
        at = text.find(part) if part else -1
        while at >= 0:
            if all(at + len(part) <= a or at >= b for a, b, _ in used):
                used.append((at, at + len(part), label))
                break
            at = text.find(part, at + 1)
    return sorted(used, key=lambda x: x[0])


_TOKEN = re.compile(r"[^\W_]+|\s+|[^\w\s]|_")


def labelled_pattern(text: str, spans: Iterable[tuple[int, int, str]], part_labels: dict[str, str] | None = None) -> str | None:
    """A structural pattern: labelled spans as their label, what lies between as NUM, WORD and signs; nothing without spans.

    A span without white space but with hyphens has its label for the first part, and for the others what ``part_labels`` gives, or WORD.
    """
    out, at = [], 0

    def gap(stretch: str) -> None:
        for token in _TOKEN.findall(stretch):
            out.append(" " if token.isspace() else "NUM" if token.isnumeric() else "WORD" if token[0].isalnum() else token)

    found = sorted(spans, key=lambda x: x[0])
    if not found:
        return None
    for start, end, label in found:
        gap(text[at:start])
        part = text[start:end]
        if "-" in part and not re.search(r"\s", part):
            rest = part.split("-")[1:]
            label = "-".join([label, *("" if not p else (part_labels or {}).get(p, "WORD") for p in rest)])
        out.append(label)
        at = end
    gap(text[at:])
    return re.sub(" {2,}", " ", "".join(out)).strip()


_PART = "array<struct<label:string,part:string>>"


def partial_distance(key: Column, query: Column) -> Column:
    @F.pandas_udf("distance int, start int, end int")
    def of(keys: pd.Series, queries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(k or "", q or "") for k, q in zip(keys, queries, strict=True)], columns=["distance", "start", "end"])

    return of(key, query)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity; not symmetric."""

    @F.pandas_udf("double")
    def of(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(xs, ys, strict=True)])

    return of(a, b)


def merged(text: Column, parts: Column, drop_separators: bool = False) -> Column:
    @F.pandas_udf("map<string,string>")
    def of(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([merged_parts(t or "", [(p["label"], p["part"]) for p in ([] if ps is None else ps)], drop_separators) for t, ps in zip(texts, lists, strict=True)])

    return of(text, parts.cast(_PART))


def spans(text: Column, parts: Column) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int,label:string>>")
    def of(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b, "label": c} for a, b, c in found_spans(t or "", [(p["label"], p["part"]) for p in ([] if ps is None else ps)])] for t, ps in zip(texts, lists, strict=True)])

    return of(text, parts.cast(_PART))


def strictly_merged(text: Column, parts: Column) -> Column:
    """``parts``: array of structs (label, part, start)."""

    @F.pandas_udf("map<string,string>")
    def of(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([strictly_merged_parts(t or "", [(p["label"], p["part"], p["start"]) for p in ([] if ps is None else ps)]) for t, ps in zip(texts, lists, strict=True)])

    return of(text, parts.cast("array<struct<label:string,part:string,start:int>>"))


def span_pattern(text: Column, spans: Column, part_labels: Column | None = None) -> Column:
    """The pattern of a text by labelled spans (array of structs start, end, label); by its words alone where there are none."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, lists: pd.Series, maps: pd.Series) -> pd.Series:
        rows = zip(texts, lists, maps, strict=True)
        return pd.Series([None if t is None else labelled_pattern(t, [(s["start"], s["end"], s["label"]) for s in ([] if ss is None else ss)], dict(m or {})) for t, ss, m in rows])

    extra = F.lit(None).cast("map<string,string>") if part_labels is None else part_labels
    return F.coalesce(of(text, spans.cast("array<struct<start:int,end:int,label:string>>"), extra), address_pattern(text))
