"""The boundary to address parsers: texts go to a parser in batches, maps from label to part come back; stored answers are replayed.

A parser is anything with ``parse_addresses(list of strings)`` that gives a list of as many dictionaries. Models themselves are not part
of this engine: a parser is handed in by a function that makes one in each Python worker.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.text import json_block, parsed_object, parsed_pairs, quoted_pairs, renamed, without_thinking

#: Labels of some parsers, as the fields that they stand for.
SERVICE_LABELS = {"house_number": "HouseNumber", "road": "StreetName", "city": "City", "state": "State", "country": "Country", "postcode": "PostalCode"}
SEQUENCE_LABELS = {"StreetNumber": "HouseNumber", "StreetName": "StreetName", "Municipality": "City", "Province": "Country", "PostalCode": "PostalCode"}
TOKEN_LABELS = {"Country": "Country", "CountryCode": "Country", "Province": "State", "Municipality": "City", "StreetName": "StreetName", "StreetNumber": "HouseNumber"}
#: Texts that a parser gets at once.
BATCH = 32


def parsed(rows: DataFrame, key: str, text: str, make_parser: Callable[[], object], batch: int = BATCH) -> DataFrame:
    """(key, text, prediction: map of strings, error, seconds): each text by a parser of its worker; null texts are empty ones.

    Parts that are null or empty are left out. A batch that fails is tried again text by text, so that only the texts at fault have an error.
    ``seconds`` is each text's share of its batch's time.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()

        def answers(texts: list[str]) -> list[dict]:
            found = parser.parse_addresses(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            return [{k: str(v) for k, v in (a or {}).items() if v is not None and v != ""} for a in found]

        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = [t or "" for t in part[text]]
                began = time.monotonic()
                try:
                    got = [(a, None) for a in answers(texts)]
                except Exception:  # noqa: BLE001 - whatever a parser raises belongs to its rows
                    got = []
                    for t in texts:
                        try:
                            got.append((answers([t])[0], None))
                        except Exception as e:  # noqa: BLE001
                            got.append(({}, f"{type(e).__name__}: {e}"))
                share = (time.monotonic() - began) / len(texts)
                yield pd.DataFrame({key: part[key].to_numpy(), text: part[text].to_numpy(), "prediction": [g[0] for g in got], "error": [g[1] for g in got], "seconds": share})

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{text}` string, prediction map<string,string>, error string, seconds double")


def fields_of(text: Column, parts: Column, labels: dict[str, str] | None = None) -> Column:
    """A map from field to part of a parser's parts (array of structs label, part): labels renamed, parts of one field merged."""
    named = F.transform(parts, lambda p: F.struct(renamed(p["label"], labels or {}).alias("label"), p["part"].alias("part")))
    return spans.merged(text, named)


def kept_fields(prediction: Column, fields: list[str]) -> Column:
    """A map without other fields and without empty values."""
    return F.map_filter(prediction, lambda k, v: k.isin(*fields) & (F.coalesce(v, F.lit("")) != ""))


class RegexParser:
    """``City`` or ``City / Country`` by a pattern; what has another form goes to another parser, if there is one."""

    def __init__(self, fallback: object | None = None):
        import regex

        self.pattern = regex.compile(r"(?P<City>\w+)(\s*/\s*(?P<Country>\w+))?")
        self.fallback = fallback

    def parse_addresses(self, texts: list[str]) -> list[dict]:
        found = [self.pattern.fullmatch(t) for t in texts]
        out = [{} if m is None else m.groupdict() for m in found]
        if self.fallback is not None and (open_ones := [i for i, m in enumerate(found) if m is None]):
            for i, answer in zip(open_ones, self.fallback.parse_addresses([texts[i] for i in open_ones]), strict=True):
                out[i] = answer
        return out


class ServiceParser:
    """Parts by a parsing service: a JSON list of texts is posted, lists of [part, label] come back. A service that is down is asked again."""

    def __init__(self, url: str, labels: dict[str, str] | None = None, tries: int = 5, wait: float = 1.0, post: Callable[[str, bytes], bytes] | None = None):
        self.url, self.labels, self.tries, self.wait = url, SERVICE_LABELS if labels is None else labels, tries, wait
        self.post = post or self._post

    @staticmethod
    def _post(url: str, body: bytes) -> bytes:
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.read()

    def parse_addresses(self, texts: list[str]) -> list[dict]:
        body = json.dumps(texts).encode()
        for left in reversed(range(self.tries)):
            try:
                found = json.loads(self.post(self.url, body))
                break
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait)
        return [spans.merged_parts(t, [(self.labels.get(label, label), part) for part, label in parts]) for t, parts in zip(texts, found, strict=True)]


# stored answers


def last_message(conversation: Column) -> Column:
    """The content of the last message of a conversation (JSON list of role and content); of plain text, all of it."""
    messages = F.from_json(conversation, "array<struct<role:string,content:string>>")
    return F.coalesce(F.get(messages, F.size(messages) - 1)["content"], conversation)


def after_marker(text: Column, marker: str) -> Column:
    """What follows the last ``marker``; all of the text without one."""
    return F.element_at(F.split(text, "\\Q" + marker + "\\E"), -1)


def answer_parts(reply: Column, as_pairs: bool = False) -> Column:
    """Parts (array of structs label, part) of a model's reply: a JSON object, or a list of [part, label], or lines that look like either."""
    text = without_thinking(reply)
    if as_pairs:
        loose = F.transform(quoted_pairs(text, ","), lambda p: F.struct(p["key"].alias("part"), p["value"].alias("label")))
        strict = parsed_pairs(text)
        found = F.when(F.from_json(json_block(text), "array<array<string>>").isNotNull(), strict).otherwise(F.filter(loose, lambda p: p["label"] != "Other"))
        return F.transform(found, lambda p: F.struct(p["label"].alias("label"), p["part"].alias("part")))
    strict = F.from_json(json_block(text), "map<string,string>")
    from_object = F.transform(F.map_entries(strict), lambda e: F.struct(e["key"].alias("label"), e["value"].alias("part")))
    loose = F.transform(quoted_pairs(text), lambda p: F.struct(p["key"].alias("label"), p["value"].alias("part")))
    return F.when(strict.isNotNull(), from_object).otherwise(loose)


def replayed(stored: DataFrame, text: str, conversation: str, as_pairs: bool = False, marker: str | None = None) -> DataFrame:
    """``stored`` with ``prediction`` parsed anew from stored conversations: the model is not asked again."""
    reply = last_message(F.col(conversation)) if marker is None else after_marker(F.col(conversation), marker)
    parts = F.coalesce(answer_parts(reply, as_pairs), F.array().cast("array<struct<label:string,part:string>>"))
    return stored.withColumn("prediction", spans.merged(F.col(text), parts))


__all__ = ["RegexParser", "ServiceParser", "after_marker", "answer_parts", "fields_of", "kept_fields", "last_message", "parsed", "parsed_object", "replayed"]
