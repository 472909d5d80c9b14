"""Text functions as Catalyst expressions: cleaning, distances, patterns, parsing of structured answers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Precomposed Latin, Greek and Cyrillic letters whose decomposition is one letter and marks, and those letters."""
    pairs = {}
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        whole = chr(code)
        base = [c for c in unicodedata.normalize("NFD", whole) if not unicodedata.category(c).startswith("M")]
        if len(base) == 1 and base[0] != whole:
            pairs[whole] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{M}", "")


def clean_key(x: Column) -> Column:
    """Lower case, without accents and without anything but ASCII letters, digits, underscores and white space."""
    return F.regexp_replace(F.lower(strip_accents(x)), r"[^\w\s]", "")


def byte_distance(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes."""
    as_bytes = lambda c: F.decode(F.encode(c, "utf-8"), "iso-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b))


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Case-insensitive edit distance over code points; with ``most``, any greater distance is ``most`` + 1.

    If one side is empty, the distance is the other's length, however great.
    """
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    if most is None:
        return F.levenshtein(a, b)
    found = F.levenshtein(a, b, most)
    either = F.greatest(F.char_length(a), F.char_length(b))
    return F.when((a == "") | (b == ""), either).when(found < 0, F.lit(most + 1)).otherwise(found)


def abbreviation_pattern(x: Column) -> Column:
    """A LIKE pattern for names that ``x`` may abbreviate: N.Y. and NY give ``n% y%``; null if ``x`` is none, or has no letter.

    One to four capitals of any alphabet, with dots or without, are initials; any other text with a dot is cut at its dots.
    """
    bare = F.replace(x, F.lit("."), F.lit(""))
    initials = bare.rlike(r"^\p{Lu}{1,4}$")
    spelled = F.array_join(F.transform(F.filter(F.split(F.lower(bare), ""), lambda c: c != ""), lambda c: F.concat(c, F.lit("%"))), " ")
    pieces = F.split(F.lower(x), r"\.")
    pieces = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    dotted = F.array_join(F.transform(pieces, lambda p: F.concat(p, F.lit("%"))), " ")
    return F.when(initials, spelled).when(x.contains(".") & x.rlike(r"\p{L}"), dotted)


def city_and_country(x: Column) -> tuple[Column, Column]:
    """The two parts of ``City / Country``; nulls where the text has another form."""
    pattern = r"(?U)^(\w+)(\s*/\s*(\w+))?$"
    part = lambda k: F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))
    return part(1), part(3)


#: Whole words that mark parts of an address, by the token they become.
DISTRICT_WORDS = ("kr.", "krs.", "kreis", "landkreis")
GOVERNMENT_WORDS = ("reg.", "bez.", "regierungsbezirk")
PREPOSITIONS = ("i.", "b.", "bei", "a.", "an", "am", "v.", "im", "in", "o.", "ob", "n.", "nr.", "nähe")
STREET_WORDS = ("straße", "strasse", "gasse", "weg", "allee", "platz", "ring", "damm", "chaussee", "steig", "stieg", "pfad", "trift", "promenade", "avenue", "av.", "str.")
#: Words with a dot, numbers with a letter, other signs, white space; combining marks count as signs, underscores as nothing.
ADDRESS_TOKEN = r"([\p{L}\p{Nl}\p{No}]+\.?|\p{Nd}+[a-zA-Z]?|[^\p{L}\p{N}_\s\p{Z}]|[\s\p{Z}]+)"


def address_pattern(x: Column) -> Column:
    """The sequence of token classes of an address: DIST, REGBEZ, PREP, STREET, NUM, WORD, ASCII signs as they are, other signs as WORD."""
    tokens = F.regexp_extract_all(x, F.lit(ADDRESS_TOKEN), F.lit(1))

    def kind(token: Column) -> Column:
        lower = F.lower(token)
        return (
            F.when(token.rlike(r"^[\s\p{Z}]+$"), F.lit(" "))
            .when(token.rlike(r"^[\p{Nd}²³¹]"), F.lit("NUM"))
            .when(lower.isin(*DISTRICT_WORDS), F.lit("DIST"))
            .when(lower.isin(*GOVERNMENT_WORDS), F.lit("REGBEZ"))
            .when(lower.isin(*PREPOSITIONS), F.lit("PREP"))
            .when(lower.isin(*STREET_WORDS), F.lit("STREET"))
            .when(token.rlike(r"^[\p{L}\x{80}-\x{10FFFF}]"), F.lit("WORD"))
            .otherwise(token)
        )

    return F.trim(F.regexp_replace(F.array_join(F.transform(tokens, kind), ""), " {2,}", " "))


def json_block(x: Column) -> Column:
    """What follows the first backtick fence, of three or one, up to the next, without its ``json`` mark; all of the text if none is there."""
    parts = F.split(x, "```|`")
    inner = F.when(F.size(parts) >= 2, F.element_at(parts, 2)).otherwise(x)
    return F.when(inner.startswith("json"), F.regexp_replace(F.substring(inner, 5, 1 << 30), r"^\s+|\s+$", "")).otherwise(inner)


def quoted_pairs(x: Column, separator: str = ":") -> Column:
    """(key, value) structs of ``"key": "value"`` lines: one for each line, as both quoted parts reach as far as they can."""
    pattern = F.lit(rf'"(.*)"\s*{separator}\s*"(.*)"')
    return F.arrays_zip(F.regexp_extract_all(x, pattern, F.lit(1)).alias("key"), F.regexp_extract_all(x, pattern, F.lit(2)).alias("value"))


def parsed_object(x: Column) -> Column:
    """A JSON object as a map of strings; where the JSON is broken, what ``quoted_pairs`` finds."""
    block = json_block(x)
    found = quoted_pairs(block)
    fallback = F.map_from_arrays(found["key"], found["value"])
    return F.coalesce(F.from_json(block, "map<string,string>"), F.when(F.size(found) > 0, fallback))


def parsed_pairs(x: Column, drop: str = "Other") -> Column:
    """A JSON list of [part, type] pairs as structs, without those of type ``drop``."""
    rows = F.from_json(json_block(x), "array<array<string>>")
    found = F.transform(F.filter(rows, lambda r: F.size(r) == 2), lambda r: F.struct(r[0].alias("part"), r[1].alias("label")))
    return F.filter(found, lambda r: r["label"] != drop)


def without_thinking(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))


def duration(seconds: Column) -> Column:
    """``x years, y months, d days, h:mm:ss`` by months of 30 days and years of 12 months; leading zero units are left out.

    Seconds are rounded, halves to even. Units are singular for 1. For durations from 0.
    """
    s = F.rint(seconds.cast("double")).cast("long")
    days, rest = F.floor(s / 86400), s % 86400
    years, months, days = F.floor(days / 360), F.floor(days % 360 / 30), days % 30
    clock = F.format_string("%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60)
    unit = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise("")))
    return F.concat_ws(", ", unit(years, "year"), unit(months, "month"), unit(days, "day"), clock)


def spaced_words(x: Column) -> Column:
    """UpperCamelCase as words; the empty match behind the last word leaves a space there."""
    return F.array_join(F.regexp_extract_all(x, F.lit(r"([A-Z\p{Nd}]*[a-z\p{Nd}]*)"), F.lit(1)), " ")


def spaced_signs(x: Column) -> Column:
    """A space before and after each character that is no letter and no digit."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}])", " $1 ")


def word_tokens(x: Column) -> Column:
    """Runs of word characters, and each other character for itself."""
    return F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_])"), F.lit(1))


def begins_no_word(x: Column, start: Column, end: Column) -> Column:
    """Whether no run of word characters or of others begins within [start, end), or at ``start``: then it is a piece of a word."""
    runs = F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"), F.lit(1))
    none = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))
    step = lambda acc, r: F.struct((acc["at"] + F.char_length(r)).alias("at"), (acc["hit"] | ((acc["at"] >= start) & (acc["at"] < F.greatest(end, start + 1)))).alias("hit"))
    return ~F.aggregate(runs, none, step, lambda acc: acc["hit"])


#: Characters that may lie between two parts of one value.
SEPARATORS = ",. -()/\\ \t"


def without_separators(x: Column, separators: str = SEPARATORS) -> Column:
    """Without separators at the start, and at the end without those but the dot."""
    return F.rtrim(F.ltrim(x, F.lit(separators)), F.lit(separators.replace(".", "")))


def plain_label(tag: Column) -> Column:
    """A tag without its begin or inside mark."""
    return F.regexp_replace(tag, "^[BI]-", "")


def renamed(value: Column, names: dict[str, str]) -> Column:
    """``value`` by a small constant map; others, and nulls, stay as they are."""
    if not names:
        return value
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(known, value), value)


def resolved_label(tag: Column, tags: dict[str, str] | None = None, labels: dict[str, str] | None = None) -> Column:
    """A model's tag as a label: numbered tags by ``tags``, without begin or inside mark, renamed by ``labels``."""
    return renamed(plain_label(renamed(tag, tags or {})), labels or {})


def without_shots(config: Column) -> Column:
    """A configuration's name without its parts that tell the number of examples (``-5shot``)."""
    return F.array_join(F.filter(F.split(config, "-"), lambda p: ~p.endswith("shot")), "-")


def shots(config: Column) -> Column:
    """The number of examples in a configuration's name; null if it has none."""
    return F.regexp_extract(config, r"(?:^|-)(\d+)shot(?:-|$)", 1).try_cast("int")


def config_name(model: Column, strategy: Column, examples: Column, encoder: Column, pool: Column, rules: Column, fallback: Column, prompt: str = "prompt2") -> Column:
    """A configuration's name from its parts; strategies: embedding, pattern, any other is hybrid."""
    number = lambda c: c.cast("string")
    kind = (
        F.when(strategy == "embedding", F.concat(F.lit("emb-"), encoder, F.lit("-"), number(examples), F.lit("shot")))
        .when(strategy == "pattern", F.concat(F.lit("pat-ner-"), number(examples), F.lit("shot")))
        .otherwise(F.concat(F.lit("hybrid-ner-emb-"), encoder, F.lit("-"), number(examples), F.lit("shot-pool"), number(pool)))
    )
    low = F.when(fallback > 0, F.concat(F.lit("fb"), F.replace(F.format_string("%.2f", fallback.cast("double")), F.lit("."), F.lit(""))))
    return F.concat_ws("_", model, F.lit(prompt), kind, F.when(rules, "rules"), low)


def visible_spaces(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("␣"))


def replaced_once(x: Column, old: Column, new: Column) -> Column:
    """``x`` with the first whole-word occurrence of ``old`` replaced; null if there is none. Letters and digits make words."""
    at = F.regexp_instr(x, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), old, F.lit(r"\E(?![\p{L}\p{N}])")))
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), at - 1), new, F.substring(x, at + F.char_length(old), F.char_length(x))))
