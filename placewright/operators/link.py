"""Linking of free-text names to a gazetteer: one batched plan of cascading tiers instead of a statement for each name.

Exact matches are an equi-join on the clean key. What stays unresolved is matched within an edit distance by equi-joins that lose no
match: short names share a string that deletions leave of both, longer ones a segment of the name at about its place. Abbreviations
meet names that begin with the same initials. The best tier of a query decides; within it names are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import abbreviation_pattern, byte_distance, clean_key, strip_accents
from ..sources.shared import stored

#: Clean queries up to this length are matched by deletions, longer ones by segments.
SHORT = 10


def prepared_names(names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``clean``; names that clean to nothing cannot be linked."""
    return names.withColumn("clean", clean_key(F.col(name))).where(F.trim("clean") != "")


def deletions(x: Column, most: int) -> Column:
    """``x`` and all strings that come of deleting up to ``most`` of its characters, each once.

    Strings within ``most`` edits share one: what a best alignment keeps of both.
    """
    every = level = F.array(x)
    for _ in range(most):
        shorter = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(v), F.lit(1))), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.char_length(v))))
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        every = F.array_union(every, level)
    return every


def _segment(length: Column, parts: int, i: Column) -> tuple[Column, Column]:
    """(start from 0, size) of the ``i``-th of ``parts`` nearly equal segments of a string; the last ones are a character longer."""
    size, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    return size * i + F.greatest(longer + i - parts, F.lit(0)), size + F.when(i >= F.lit(parts) - longer, 1).otherwise(0)


def segments(x: Column, threshold: int) -> Column:
    """(length of ``x``, number, text) of ``threshold`` + 1 segments of ``x``: edits that few leave one of them whole."""

    def cut(i: Column) -> Column:
        start, size = _segment(F.char_length(x), threshold + 1, i)
        return F.struct(F.char_length(x).alias("l"), i.alias("i"), F.substring(x, start + 1, size).alias("s"))

    return F.transform(F.sequence(F.lit(0), F.lit(threshold)), cut)


def segment_keys(x: Column, threshold: int) -> Column:
    """The segments that a name within ``threshold`` edits of ``x`` may share with it, for each length and place that such a name may have.

    A segment that is shared at a shift costs as many edits before it, and behind it the shift's difference to that of the lengths.
    """
    half = lambda c: F.floor(c / 2).cast("int")

    def of_length(longer: Column) -> Column:  # how much longer ``x`` is than the name
        length = F.char_length(x) - longer

        def of_segment(i: Column) -> Column:
            start, size = _segment(length, threshold + 1, i)
            shifts = F.sequence(-half(F.lit(threshold) - longer), half(F.lit(threshold) + longer))
            some = F.filter(shifts, lambda s: (length > threshold) & (start + s >= 0) & (start + s + size <= F.char_length(x)))
            return F.transform(some, lambda s: F.struct(length.alias("l"), i.alias("i"), F.substring(x, start + s + 1, size).alias("s")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(threshold)), of_segment))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-threshold), F.lit(threshold)), of_length)))


def fuzzy_pairs(queries: DataFrame, names: DataFrame, threshold: int) -> DataFrame:
    """(query_id, name_id) with clean keys within ``threshold`` edits. queries: query_id, clean; names: name_id, clean.

    A pair that shares a key is verified where it meets, so that only matches are shuffled again. Distinct clean keys meet, once each;
    keys of many names are split by adaptive execution, as no row of a join needs another.
    """
    q = queries.select(F.col("clean").alias("q")).distinct()
    n = names.select(F.col("clean").alias("n")).distinct()
    close = (F.abs(F.char_length("q") - F.char_length("n")) <= threshold) & (F.levenshtein("q", "n", threshold) >= 0)
    short = max(SHORT, 2 * threshold)  # names that match longer queries have a character for each segment
    by_deletion = (
        q.where(F.char_length("q") <= short)
        .select("q", F.explode(deletions(F.col("q"), threshold)).alias("k"))
        .join(n.where(F.char_length("n") <= short + threshold).select("n", F.explode(deletions(F.col("n"), threshold)).alias("k")), "k")
        .where(close)
        .select("q", "n")
    )
    by_segment = (
        q.where(F.char_length("q") > short)
        .select("q", F.explode(segment_keys(F.col("q"), threshold)).alias("k"))
        .join(n.where(F.char_length("n") > short - threshold).select("n", F.explode(segments(F.col("n"), threshold)).alias("k")), "k")
        .where(close)
        .select("q", "n")
    )
    pairs = by_deletion.union(by_segment).distinct()
    asked, known = queries.select("query_id", F.col("clean").alias("q")), names.select("name_id", F.col("clean").alias("n"))
    return pairs.join(asked, "q").join(known, "n").select("query_id", "name_id")


def _initials(names: Column) -> Column:
    """The keys under which a clean name is found: its first letter, its first two, and its first with that of each later word."""
    words = F.split(names, " ")
    first = F.substring(names, 1, 1)
    later = F.transform(F.filter(F.slice(words, 2, F.size(words)), lambda w: w != ""), lambda w: F.concat(first, F.lit(" "), F.substring(w, 1, 1)))
    return F.array_distinct(F.concat(F.array(first, F.substring(names, 1, 2)), later))


def abbreviation_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name_id) where the clean name fits the abbreviation pattern of the query's text.

    A pattern of two words and more asks for names with those two initials, one of a longer word for its first two letters.
    """
    q = queries.select("query_id", abbreviation_pattern(strip_accents(F.col("text"))).alias("p")).where("p is not null")
    pieces = F.split("p", "% ?")
    plain = lambda c: c.rlike(r"^[^\W_]")
    key = (
        F.when((F.size(pieces) > 2) & plain(pieces[0]) & plain(pieces[1]), F.concat(F.substring(pieces[0], 1, 1), F.lit(" "), F.substring(pieces[1], 1, 1)))
        .when((F.char_length(pieces[0]) > 1) & ~F.substring(pieces[0], 1, 2).rlike("[%_]"), F.substring(pieces[0], 1, 2))
        .otherwise(F.substring("p", 1, 1))
    )
    n = names.select("name_id", F.col("clean").alias("n"), F.explode(_initials(F.col("clean"))).alias("k"))
    return q.withColumn("k", key).join(n, "k").where("n like p").select("query_id", "name_id").distinct()


def _matches(asked: DataFrame, names: DataFrame, threshold: int, reduced_tier: bool) -> DataFrame:
    """(query_id, name_id, exact, abbreviated) with the tier of each pair's kind; ``asked``: query_id, text, hint, clean."""
    known = prepared_names(names)
    exact = asked.join(known.select("name_id", "clean"), "clean").select("query_id", "name_id").withColumn("exact", F.lit(True)).withColumn("abbreviated", F.lit(False))
    pairs = exact
    if threshold > 0:
        open_queries = asked.join(exact.select("query_id").distinct(), "query_id", "left_anti")
        near = fuzzy_pairs(open_queries, known, threshold).withColumn("abbreviated", F.lit(False))
        short = abbreviation_pairs(open_queries, known).withColumn("abbreviated", F.lit(True))
        near = near.union(short).groupBy("query_id", "name_id").agg(F.max("abbreviated").alias("abbreviated")).withColumn("exact", F.lit(False))
        pairs = exact.unionByName(near)
    full = pairs.join(asked.select("query_id", "text", "hint", F.col("clean").alias("clean_query")), "query_id").join(known, "name_id")
    inside = F.col("hint").contains(F.col("country")) if asked.schema["hint"].dataType.simpleString() == "string" else F.array_contains("hint", F.col("country"))
    hinted = F.coalesce(inside, F.lit(False))
    reduced = F.coalesce("reduced", F.lit(False)) & F.lit(reduced_tier)
    return full.withColumn("tier", F.when(F.col("exact"), F.when(hinted, 1).otherwise(2)).when(hinted, 4).when(reduced, 5).otherwise(6))


def link(
    queries: DataFrame, names: DataFrame, threshold: int = 3, topk: int = 1, byte_raw_distance: bool = True, reduced_tier: bool = True, any_type: DataFrame | None = None
) -> DataFrame:
    """Matches of each query by rank, ties included.

    queries: query_id, text, and optionally hint (an array of country codes, or a text that holds them); names: name_id, entity_id, name,
    and optionally country, reduced, preferred (booleans). Distinct texts and hints are searched once. Queries that are blank or clean to nothing
    match nothing. Tiers: 1 exact in a hinted country, 2 exact, 4 near in a hinted country, 5 near among reduced names (unless
    ``reduced_tier`` is off, as for countries), 6 near anywhere, 7 anything among ``any_type``, names of all types, for queries without a
    match so far. Threshold 0 asks for equal clean keys. Of matches that are equally near, preferred names come first.
    """
    if "hint" not in queries.columns:
        queries = queries.withColumn("hint", F.lit(None).cast("array<string>"))

    def whole(table: DataFrame) -> DataFrame:
        for column, kind in (("country", "string"), ("reduced", "boolean"), ("preferred", "boolean")):
            if column not in table.columns:
                table = table.withColumn(column, F.lit(None).cast(kind))
        return table.select("name_id", "entity_id", "name", "country", "reduced", "preferred")

    asked = queries.where(F.trim("text") != "").select("text", "hint").distinct()
    asked = asked.withColumn("query_id", F.struct("text", "hint")).withColumn("clean", clean_key(F.col("text"))).where(F.trim("clean") != "")
    asked = stored(asked, "link-queries")  # met by every tier
    full = stored(_matches(asked, whole(names), threshold, reduced_tier), "link-matches")
    if any_type is not None:
        rest = asked.join(full.select("query_id").distinct(), "query_id", "left_anti")
        full = full.unionByName(_matches(rest, whole(any_type), threshold, False).withColumn("tier", F.lit(7)))
    raw = byte_distance(F.col("name"), F.col("text")) if byte_raw_distance else F.levenshtein("name", "text")
    scored = full.withColumn("raw_distance", raw.cast("long")).withColumn("clean_distance", F.levenshtein("clean", "clean_query").cast("long"))
    kind = F.when(F.col("raw_distance") == 0, 0).when(F.col("clean_distance") == 0, 1).when(F.col("abbreviated"), 2).otherwise(3)
    best = scored.withColumn("kind", kind).withColumn("_t", F.min("tier").over(Window.partitionBy("query_id"))).where("tier = _t")
    order = [F.col("kind"), F.col("raw_distance"), F.col("clean_distance"), F.when(F.col("preferred"), 0).otherwise(1)]
    one = best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "entity_id").orderBy(*order, "name"))).where("_n = 1")
    ranked = one.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(*order)).cast("long")).where(F.col("rank") <= topk)
    found = ranked.select(F.col("text").alias("_text"), F.col("hint").alias("_hint"), "entity_id", "name_id", "name", "country", "tier", "kind", "raw_distance", "clean_distance", "abbreviated", "rank")
    return queries.join(found, F.col("text").eqNullSafe(F.col("_text")) & F.col("hint").eqNullSafe(F.col("_hint"))).drop("_text", "_hint")


def status(matches: DataFrame, queries: DataFrame, threshold: int = 3) -> DataFrame:
    """One status for each query from its matches at rank 1, with the corrected and the final name and how the match differs.

    queries: query_id, text (the part that a parser found, or null), and optionally raw: what the part was taken from. Nothing to take
    from is NO_ADDRESS, no part found in it UNRESOLVED, a part that links to nothing REGEX_NO_MATCH. Without ``raw``, a null text is
    NO_ADDRESS.
    """
    best = matches.where("rank = 1").groupBy("query_id").agg(
        F.countDistinct("entity_id").alias("n"), F.first("name").alias("found"), F.first("country").alias("found_country"), F.min("clean_distance").alias("d"), F.max("abbreviated").alias("abbreviated")
    )
    raw = F.col("raw") if "raw" in queries.columns else F.col("text")
    one = F.col("n") == 1
    wrong = (F.col("d") > threshold) & ~F.col("abbreviated")
    same = F.col("text") == F.col("found")
    named = (
        F.when(one & wrong, "POST_PROCESSING_ERROR").when(one & same, "EXACT_MATCH").when(one & (F.col("d") == 0), "EXACT_MATCH_CORRECTED")
        .when(one & F.col("abbreviated"), "ABBREVIATION_MATCH_CORRECTED").when(one, F.format_string("FUZZY_%d_CORRECTED", F.col("d")))
        .when(F.col("n") > 1, "AMBIGUOUS").when(F.coalesce(F.trim(raw), F.lit("")) == "", "NO_ADDRESS").when(F.col("text").isNull(), "UNRESOLVED").otherwise("REGEX_NO_MATCH")
    )
    right = one & ~wrong
    return queries.join(best, "query_id", "left").select(
        *queries.columns, named.alias("status"), F.when(right & ~same, F.col("found")).alias("corrected"), F.when(right, F.col("found")).alias("final"),
        F.when(one, F.col("d")).alias("edit_distance"), F.when(one, F.col("abbreviated")).alias("is_abbreviation"), F.when(one, F.col("found_country")).alias("matched_country"),
    )
