"""Prompts from sections, and orders of sections by number, as Catalyst expressions."""

from __future__ import annotations

import re
from math import factorial

from pyspark.sql import Column
from pyspark.sql import functions as F


def permutation(number: Column, items: list[str]) -> Column:
    """The ``number``-th order of ``items``, counted from 0 as sorted by position; null outside 0 .. n! - 1."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array(*map(F.lit, items)).alias("left"), number.cast("long").alias("code"))

    def take(state: Column, weight: Column) -> Column:
        at, left = F.floor(state["code"] / weight).cast("int"), state["left"]
        return F.struct(
            F.concat(state["done"], F.slice(left, at + 1, 1)).alias("done"),
            F.concat(F.slice(left, 1, at), F.slice(left, at + 2, len(items))).alias("left"),
            (state["code"] % weight).alias("code"),
        )

    weights = F.array(*[F.lit(factorial(n)).cast("long") for n in range(len(items) - 1, -1, -1)])
    ordered = F.aggregate(weights, start, take, lambda s: s["done"])
    return F.when((number >= 0) & (number < factorial(len(items))), ordered)


def permutation_of_code(code: Column, items: Column) -> Column:
    """The order of ``items`` (array of strings) by a code that says, for each place, which of the items left comes next, counted from 0.

    Null if the code is shorter or longer than the items, or names one that is not there.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), items.alias("left"), F.lit(True).alias("fits"))

    def take(state: Column, at: Column) -> Column:
        left = state["left"]
        fits = state["fits"] & (at >= 0) & (at < F.size(left))
        return F.struct(
            F.when(fits, F.concat(state["done"], F.slice(left, at + 1, F.lit(1)))).otherwise(state["done"]).alias("done"),
            F.when(fits, F.concat(F.slice(left, F.lit(1), at), F.slice(left, at + 2, F.greatest(F.size(left) - at - 1, F.lit(0))))).otherwise(left).alias("left"),
            fits.alias("fits"),
        )

    return F.aggregate(code, start, take, lambda s: F.when(s["fits"] & (F.size(s["left"]) == 0), s["done"]))


def partial_permutation(included: Column, code: Column, items: Column) -> Column:
    """The items that ``included`` (array of booleans) marks, in the order of ``code``; as they are where at most one is left."""
    some = F.transform(F.filter(F.arrays_zip(items.alias("item"), included.alias("take")), lambda x: x["take"]), lambda x: x["item"])
    return F.when(F.size(some) <= 1, some).otherwise(permutation_of_code(code, some))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``%(name)s`` replaced by columns, and ``%%`` by a per cent sign; a name without a column is an error."""
    parts = re.split(r"%\((\w+)\)s", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x.replace("%%", "%")) for i, x in enumerate(parts)])


def json_string(x: Column) -> Column:
    quoted = F.to_json(F.array(x))
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)


def labels_json(labels: Column, as_pairs: bool = False) -> Column:
    """A map as a JSON object, or as a list of [part, label], with a space behind each comma and colon, within a fence."""
    one = (lambda e: F.concat(F.lit("["), json_string(e["value"]), F.lit(", "), json_string(e["key"]), F.lit("]"))) if as_pairs else (lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
    inner = F.array_join(F.transform(F.map_entries(labels), one), ", ")
    return F.concat(F.lit("```json["), inner, F.lit("]```")) if as_pairs else F.concat(F.lit("```json{"), inner, F.lit("}```"))


#: What comes before examples, and the form of each.
EXAMPLES_PREFIX, EXAMPLE = "Consider the following examples:\n", "Address: %(address)s\n%(example)s\n"


def few_shot_prompt(template: str, address: Column, examples: Column, prefix: str = EXAMPLES_PREFIX, form: str = EXAMPLE, as_pairs: bool = False) -> Column:
    """A prompt by a template of ``examples`` and ``address``; examples: array of structs (address, labels: map). The prefix comes only with examples."""
    shown = F.array_join(F.transform(examples, lambda e: filled(form, {"address": e["address"], "example": labels_json(e["labels"], as_pairs)})), "")
    return filled(template, {"address": address, "examples": F.when(F.size(examples) > 0, F.concat(F.lit(prefix), shown)).otherwise("")})


def item_list(items: Column) -> Column:
    """``- item`` lines of an array of strings."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def prompt(sections: dict[str, Column], order: list[str], markdown: bool = False) -> Column:
    """Named sections in the given order, with headings if ``markdown``; null and empty sections are left out.

    Every name in ``order`` must be a section, once.
    """
    if len(set(order)) < len(order) or set(order) - set(sections):
        raise ValueError(f"order must name sections once each: {order}")
    head = lambda name: F.lit(f"## {name}\n" if markdown else f"{name}: ")
    return F.concat_ws("\n\n" if markdown else "\n", *[F.when(F.coalesce(sections[n], F.lit("")) != "", F.concat(head(n), sections[n])) for n in order])
