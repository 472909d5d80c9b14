"""Functions without SQL against brute force; sources, streaming and small cases."""

import gzip
import json
import random
import re
import zipfile
from difflib import SequenceMatcher
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placewright.functions import prompts, spans, text, turtle
from placewright.operators import candidates, inspect, link, parse, retrieve
from placewright.sources import readers
from placewright.streaming import incremental


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abC", max_size=9), st.text("abc", max_size=5))
def test_best_window_is_the_least_of_all_windows(key, query):
    cost, start, end = spans.best_window(key, query)
    if not key or not query:
        assert (cost, start, end) == (len(query) if not key else 0, 0, 0)
        return
    windows = [(distance(key[i:j].lower(), query.lower()), i, j) for j in range(len(key) + 1) for i in range(j + 1)]
    by_end = [min(w for w in windows if w[2] == j) for j in range(len(key) + 1)]  # of one end, the first start
    want = min(by_end, key=lambda w: (w[0], w[1] - w[2], w[2]))
    assert (cost, start, end + 1) == want


@pytest.mark.parametrize(
    ("key", "query", "ignore_case", "want"),
    [
        ("Fort Washington Avenue", "Washington Avenue", True, (0, 5, 21)), ("Fort Washington Avenue", "Washington Ave", True, (0, 5, 18)), ("Fort Washington Avenue", "Washington Ave.", True, (1, 5, 19)),
        ("Fort Washington Avenue, New York", "washington Street", True, (5, 5, 20)), ("Fort Washington Avenue, New York", "washington Street", False, (6, 5, 20)),
    ],
)
def test_best_windows_of_streets(key, query, ignore_case, want):
    assert spans.best_window(key, query, ignore_case) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab ,", max_size=15), st.lists(st.tuples(st.sampled_from("xy"), st.text("ab", max_size=3)), max_size=5))
def test_found_spans_hold_their_parts_and_do_not_overlap(whole, parts):
    found = spans.found_spans(whole, parts)
    assert all((label, whole[a:b]) in parts for a, b, label in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_merging_parts():
    assert spans.merged_parts("Am Ring, 5", [("s", "Ring"), ("s", "Am"), ("n", "5")]) == {"s": "Am Ring", "n": "5"}
    assert spans.merged_parts("a x b", [("s", "a"), ("s", "b")]) == {"s": "a___b"}
    assert spans.merged_parts("a (b)", [("s", "a"), ("s", "b")]) == {"s": "a (b"}
    assert spans.merged_parts("abcd", [("s", "abc"), ("s", "bcd")]) == {"s": "abcd"}
    assert spans.merged_parts("x", [("error", "x"), ("___s", "x"), ("fullAddress", "x"), ("t", None), ("u", "")]) == {"model-fullAddress": "x"}
    assert spans.merged_parts("a-x", [("s", "- "), ("s", "a")], drop_separators=True) == {"s": "a"}
    assert spans.merged_parts("a-x", [("s", "a"), ("s", "- ")], drop_separators=True) == {"s": "a"}
    assert spans.strictly_merged_parts("a, b c", [("s", "c", 5), ("s", "b", 3), ("s", "a", 0), ("t", "b c", 3), ("t", "b", 3)]) == {"s": "a, b c", "t": "b c"}
    assert spans.strictly_merged_parts("a x b", [("s", "a", 0), ("s", "b", 4)]) == {"s": "a"}


def test_sequence_ratio_of_nulls_and_empty(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(spans.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 0.0, 1.0]


@pytest.mark.parametrize(
    ("address", "pattern"), [("Hauptstr. 5, Köln", "WORD NUM, WORD"), ("Kreis Stolp", "DIST WORD"), ("Reg. Bez. Köln", "REGBEZ REGBEZ WORD"), ("Str. 5", "STREET NUM"), ("Karl-Marx-Straße 21/3, Berlin", "WORD-WORD-STREET NUM/NUM, WORD"), ("a_b – n. Ulm", "WORDWORD WORD PREP WORD"), ("Frankfurt a/M", "WORD WORD/WORD"), ("bei  Ulm 3b", "PREP WORD NUM"), ("", ""), (None, None)]
)
def test_address_pattern(spark, address, pattern):
    df = spark.createDataFrame([(address,)], "x string")
    assert df.select(text.address_pattern(F.col("x"))).first()[0] == pattern


def test_all_permutations_in_order_and_nothing_outside(spark):
    got = spark.range(-1, 25).orderBy("id").select(prompts.permutation(F.col("id"), list("abcd"))).collect()
    assert [r[0] for r in got] == [None, *map(list, permutations("abcd")), None]


def test_prompt_leaves_out_empty_sections_and_checks_its_order(spark):
    df = spark.createDataFrame([("r", None, ["x", "y"])], "role string, task string, hints array<string>")
    sections = {"Role": F.col("role"), "Task": F.col("task"), "Hints": prompts.item_list(F.col("hints"))}
    assert df.select(prompts.prompt(sections, ["Hints", "Task", "Role"])).first()[0] == "Hints: - x\n- y\nRole: r"
    assert df.select(prompts.prompt(sections, ["Role"], markdown=True)).first()[0] == "## Role\nr"
    for wrong in (["Role", "Role"], ["None"]):
        with pytest.raises(ValueError):
            prompts.prompt(sections, wrong)


@pytest.mark.parametrize("n", [0, 1, 6, 7, 50, 1001])
def test_folds_differ_by_one_row_at_most_and_larger_ones_come_first(spark, n):
    ids = spark.range(n).select(F.when(F.col("id") > 3, F.col("id") % 40).alias("k"), F.col("id").alias("extra"))
    got = inspect.equal_folds(ids, "k", 7)
    assert got.columns == ["k", "extra", "fold_idx"]
    sizes = {r[0]: r[1] for r in got.groupBy("fold_idx").count().collect()}
    assert [sizes.get(i, 0) for i in range(7)] == [n // 7 + (i < n % 7) for i in range(7)]


def test_level_relation(spark):
    df = spark.createDataFrame([("City", "Country"), ("State", "Region"), ("State", "State"), ("Country", "District"), ("x", "x"), (None, "City")], "a string, b string")
    assert [r[0] for r in df.select(candidates.level_relation(F.col("a"), F.col("b"))).collect()] == ["below", None, "same", "above", None, None]


def test_errors_and_equality_of_nulls(spark):
    df = spark.createDataFrame([(None, None), ("a", "A"), (None, "a")], "p string, t string")
    assert inspect.errors(df, "p", "t").count() == 2
    assert [r[0] for r in df.select(inspect.same_ignoring_case(F.col("p"), F.col("t"))).collect()] == [True, True, False]


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('# head\n 1\t"a#b\n\n  # more\n2\tc\n')
    assert [tuple(r) for r in readers.tsv_without_comments(spark, str(tmp_path / "t.tsv"), "i string, s string").collect()] == [(" 1", '"a#b'), ("2", "c")]
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write('1\t"x\n')
    assert [tuple(r) for r in readers.tsv(spark, str(tmp_path / "g.tsv.gz"), "i int, s string").collect()] == [(1, '"x')]
    (tmp_path / "c.csv").write_text('a,b\n007,"x, ""y"""\n,NA\n')
    assert [tuple(r) for r in readers.labelled_csv(spark, str(tmp_path / "c.csv"), ["a", "b"]).collect()] == [("007", 'x, "y"'), (None, "NA")]
    (tmp_path / "p.json").write_text(json.dumps([{"City": "Ulm"}, {}, {"Street": "Weg", "No": "1"}]))
    assert [r.prediction for r in readers.predictions(spark, str(tmp_path / "p.json")).orderBy("row").collect()] == [{"City": "Ulm"}, {}, {"Street": "Weg", "No": "1"}]
    (tmp_path / "n.nt").write_text('<u:1> <x/type> <T> .\n<u:1> <x/sameAs> <https://g.example/42/a.html> .\n<u:1> <x/name> "Ulm"@de .\n# none\n')
    graph = readers.triples(spark, str(tmp_path / "n.nt"))
    assert [tuple(r) for r in readers.linked_names(graph, "T", "https://g.example/", ["x/name"]).collect()] == [("u:1", 42, "Ulm", "x/name")]


def test_cached_tables_are_made_once(spark, tmp_path):
    made = []
    for _ in range(2):
        assert readers.cached(lambda: made.append(1) or spark.range(3), spark, str(tmp_path / "t")).count() == 3
    assert made == [1]


def test_new_files_are_corrected_as_they_come_and_statistics_add_up(spark, tmp_path):
    fields = ["ApplicantBirthPlace", "ApplicantCurrentAddress", "VictimBirthPlace", "VictimDeathPlace", "VictimCurrentAddress"]
    schema = ", ".join(f"{f} string" for f in ["filename", *fields])
    names = spark.createDataFrame([(1, 1, "Ulm", "DE", "City"), (2, 2, "Germany", "DE", "Country")], "name_id long, entity_id long, name string, country string, kind string")
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for k in range(2):
        (source / f"1{k}.jsonl").write_text(json.dumps({"filename": f"f{k}", "ApplicantBirthPlace": "Ulm / Germany"}) + "\n")
        query = incremental.normalise_files(spark, str(source), schema, names, str(out), str(tmp_path / "checkpoint"))
        assert query.awaitTermination(120)
    got = {(r.field, r.city_status): r.cnt for r in incremental.statistics(spark, str(out)).collect()}
    assert got[("abp", "EXACT_MATCH")] == 2
    assert sum(got.values()) == 10


# linking


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_near_names_are_all_found(spark, threshold):
    rng = random.Random(threshold)
    word = lambda n: "".join(rng.choice("abc d") for _ in range(n)).strip() or "a"
    names = {word(rng.randint(1, 26)) for _ in range(150)}
    near = set()
    for n in list(names):
        x = list(n)
        for _ in range(rng.randint(0, threshold + 1)):
            at = rng.randrange(len(x) + 1)
            x[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        near.add("".join(x).strip() or "b")
    q = spark.createDataFrame([(f"q{x}", x) for x in near], "query_id string, clean string")
    n = spark.createDataFrame([(f"n{x}", x) for x in names], "name_id string, clean string")
    got = {tuple(r) for r in link.fuzzy_pairs(q, n, threshold).collect()}
    assert got == {(f"q{a}", f"n{b}") for a in near for b in names if distance(a, b) <= threshold}
    assert link.fuzzy_pairs(q, n, threshold).count() == len(got)


def test_abbreviations_find_all_names_that_fit(spark):
    names = ["new york", "north yemen", "nanyang", "st louis", "stolp", "saint  louis", "frankfurt am main", "main frankfurt", "übersee"]
    asked = ["N.Y.", "NY", "St. Louis", "St.", "Frankf. a.M.", "F.M.", "ÖBB", ".", "ABCDE", "x", None, "N."]
    q = spark.createDataFrame([(str(x), x) for x in asked], "query_id string, text string")
    n = spark.createDataFrame([(x, x) for x in names], "name_id string, clean string")
    patterns = {r[0]: r[1] for r in q.select("query_id", text.abbreviation_pattern(text.strip_accents(F.col("text")))).collect()}
    assert patterns["N.Y."] == patterns["NY"] == "n% y%" and patterns["St. Louis"] == "st%  louis%" and patterns["ÖBB"] == "o% b% b%"
    assert patterns["."] is patterns["ABCDE"] is patterns["x"] is None
    fits = lambda p, x: p is not None and re.fullmatch(re.escape(p).replace("%", ".*"), x)
    assert {tuple(r) for r in link.abbreviation_pairs(q, n).collect()} == {(a, x) for a, p in patterns.items() for x in names if fits(p, x)}


def test_links_prefer_and_fall_back(spark):
    names = spark.createDataFrame([(1, 10, "Ulm", False), (2, 20, "Ulm", True), (3, 30, "Köln", False)], "name_id int, entity_id int, name string, preferred boolean")
    every = spark.createDataFrame([(4, 40, "Rhein")], "name_id int, entity_id int, name string")
    asked = spark.createDataFrame([(1, "Ulm"), (2, "Koln"), (3, "Rhain"), (4, " "), (5, None), (6, "nichts davon")], "query_id int, text string")
    found = {(r.query_id, r.entity_id): (r["rank"], r.tier) for r in link.link(asked, names, threshold=1, topk=2, any_type=every).collect()}
    assert found == {(1, 20): (1, 2), (1, 10): (2, 2), (2, 30): (1, 2), (3, 40): (1, 7)}
    places = names.withColumn("country", F.when(F.col("entity_id") == 10, "DE").otherwise("AT"))
    for hint in (F.array(F.lit("FR"), F.lit("DE")), F.lit("FR,DE")):
        found = link.link(asked.withColumn("hint", hint), places, threshold=1, topk=2)
        assert {(r.query_id, r.entity_id): r.tier for r in found.collect()} == {(1, 10): 1, (2, 30): 2}
    exact = link.link(asked, names, threshold=0, topk=1)
    assert sorted(r.query_id for r in exact.collect()) == [1, 2]


# parsers and stored answers


def odd_parser():
    class Odd:  # within a function, so that workers get it by value
        """Answers with the length, and fails on some texts."""

        def parse_addresses(self, texts):
            if "bad" in texts:
                raise ValueError("bad text")
            return [{"n": len(t), "none": None, "empty": ""} for t in texts]

    return Odd


def test_parsers_get_batches_and_errors_stay_with_their_rows(spark):
    Odd = odd_parser()
    rows = spark.createDataFrame([(i, "bad" if i == 40 else "x" * (i % 5)) for i in range(90)] + [(90, None)], "id int, text string").coalesce(1)
    got = {r.id: r for r in parse.parsed(rows, "id", "text", Odd).collect()}
    assert len(got) == 91 and got[40].error == "ValueError: bad text" and got[40].prediction == {}
    assert all(got[i].prediction == {"n": str(i % 5)} and got[i].error is None for i in range(90) if i != 40) and got[90].prediction == {"n": "0"}
    assert parse.parsed(rows.where("false"), "id", "text", Odd).count() == 0
    regexes = parse.RegexParser(fallback=Odd())
    assert regexes.parse_addresses(["Köln / Polen", "a b", "Ulm"]) == [{"City": "Köln", "Country": "Polen"}, {"n": 3, "none": None, "empty": ""}, {"City": "Ulm", "Country": None}]


def test_services_are_asked_again_and_labels_renamed():
    calls = []

    def post(url, body):
        calls.append(json.loads(body))
        if len(calls) < 3:
            raise ConnectionError
        return json.dumps([[["Ulm", "city"], ["5", "house_number"], ["x", "odd"]]]).encode()

    service = parse.ServiceParser("http://none", wait=0, post=post)
    assert service.parse_addresses(["Ulm 5 x"]) == [{"City": "Ulm", "HouseNumber": "5", "odd": "x"}] and len(calls) == 3
    with pytest.raises(ConnectionError):
        parse.ServiceParser("http://none", wait=0, tries=2, post=lambda *_: (_ for _ in ()).throw(ConnectionError())).parse_addresses(["a"])


@pytest.mark.parametrize(
    ("answer", "pairs", "want"),
    [
        ('`{"City": "Ulm"}` or so', False, {"City": "Ulm"}), ('```json {"City": "Ulm", "No": ""}```', False, {"City": "Ulm"}), ('"City": "Ulm", "No": "5"', False, {'City": "Ulm", "No': "5"}),
        ("<think>{}</think>nothing", False, {}), ('[["Ulm", "City"], ["x", "Other"]]', True, {"City": "Ulm"}), ('"Ulm", "City"\n"y", "Other"', True, {"City": "Ulm"}), (None, False, {}),
    ],
)
def test_stored_answers_are_read_again(spark, answer, pairs, want):
    df = spark.createDataFrame([("Ulm 5 x", answer)], "a string, c string")
    assert parse.replayed(df, "a", "c", as_pairs=pairs).first()["prediction"] == want


# patterns and examples


def test_patterns_of_labelled_spans(spark):
    rows = [("Berlin-Marienfelde, Teichstr. 9", [(0, 18, "City"), (20, 29, "StreetName")]), ("Ulm", []), (None, None), ("Am Ring 5 a", [(3, 7, "StreetName")])]
    df = spark.createDataFrame(rows, "x string, s array<struct<start:int,end:int,label:string>>")
    got = [r[0] for r in df.select(spans.span_pattern(F.col("x"), F.col("s"), F.create_map(F.lit("Marienfelde"), F.lit("Neighborhood")))).collect()]
    assert got == ["City-Neighborhood, StreetName NUM", "WORD", None, "WORD StreetName NUM WORD"]


def test_pattern_hits_are_those_of_comparing_all(spark):
    rng = random.Random(2)
    patterns = [" ".join(rng.choice(["WORD", "NUM", "STREET", "City"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    q = spark.createDataFrame([(i, p) for i, p in enumerate(patterns[:12])], "query_id int, pattern string")
    e = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "example_id int, pattern string")
    got = {(r.query_id, r["rank"]): (r.example_id, round(r.score, 9)) for r in retrieve.pattern_hits(q, e, 4).collect()}
    for i, p in enumerate(patterns[:12]):
        best = sorted((-SequenceMatcher(None, p, x).ratio(), k) for k, x in enumerate(patterns))[:4]
        assert [got[i, r + 1] for r in range(4)] == [(k, round(-s, 9)) for s, k in best]


def test_examples_fall_back_and_zero_shots_are_none(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 7, 0.99, 1), (1, 8, 0.9, 2), (2, 7, 0.5, 1)], "query_id int, example_id int, score double, rank int")
    examples = spark.createDataFrame([(7, "Ulm 5", {"City": "Ulm"}), (8, "Am Ring", {})], "example_id int, address string, labels map<string,string>")
    shots = retrieve.few_shot(q, hits, examples, threshold=0.95)
    got = {r.query_id: [(s.address, s.included) for s in r.shots] for r in shots.collect()}
    assert got == {1: [("Ulm 5", True), ("Am Ring", False)], 2: [("Ulm 5", False)], 3: []}
    fixed = retrieve.fixed_shots([("Bonn", {"City": "Bonn", "State": "", "No": "1"}), ("x", {})], ["City", "State"], 1)
    full = {r.query_id: [(s.address, s.labels) for s in r.shots] for r in retrieve.with_fallback(shots, fixed).collect()}
    assert full[1][0] == ("Ulm 5", {"City": "Ulm"}) and full[2] == full[3] == [("Bonn", {"City": "Bonn"})]


# sources


def test_dumps_of_a_gazetteer(spark, tmp_path):
    rows = ["1\tUlm\tUlm\t\t48.4\t9.9\tP\tPPL\tDE\t\t01\t\t\t\t120000\t\t478\tEurope/Berlin\t2020-01-02", "2\t\"odd\tOdd\t\t1\t2\tA\tADM1\tDE\t\t01\t\t\t\t5\t\t\t\t2020-01-02"]
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("all.txt", "\n".join([*rows, "# no\tplace"]))
        z.writestr("readme.txt", "nothing")
    out = readers.zip_member(spark, str(tmp_path / "all.zip"), "all.txt", str(tmp_path / "all"), keep=~F.col("value").startswith("#"))
    (tmp_path / "five.txt").write_text("1\tX5\n")
    got = {r.geonameId: r for r in readers.places(spark, out, str(tmp_path / "five.txt")).collect()}
    assert set(got) == {1, 2} and got[1].admin5_code == "X5" and got[2].admin5_code is None and got[2].name == '"odd' and got[1].population == 120000
    (tmp_path / "names.txt").write_text("5\t1\tde\tUlm\t1\t\t\t1\n")
    name = readers.alternate_names(spark, str(tmp_path / "names.txt")).first()
    assert (name.alternateName, name.isPreferredName, name.isShortName, name.isHistoric) == ("Ulm", True, None, True)
    (tmp_path / "tree.txt").write_text("1\t2\tADM\n1\t3\t\n")
    assert [tuple(r) for r in readers.hierarchy(spark, str(tmp_path / "tree.txt")).orderBy("childId").collect()] == [(1, 2, "ADM"), (1, 3, None)]
    (tmp_path / "c.txt").write_text("#ISO\n" + "\t".join(["DE", "DEU", "276", "GM", "Germany", "Berlin", "357021", "82927922", "EU", ".de", "EUR", "Euro", "49", "#####", "^x$", "de", "2921044", "CH,PL", ""]) + "\n")
    country = readers.countries(spark, str(tmp_path / "c.txt")).first()
    assert (country.ISO, country.Postal_Code_Format, country.neighbours) == ("DE", "#####", "CH,PL")


def test_turtle(spark, tmp_path):
    text_of = '''@prefix g: <https://g.example/> . # names
    @base <https://b.example/> .
    PREFIX o: <https://o.example/>
    g:1 a o:Place ; o:name "Ulm"@de, "U\\"lm \\u00e4" ; o:same <https://geo.example/5/> .
    <x> o:size "4"^^<https://t.example/int> ; o:level 5 . g:2 o:note """two
    lines""" .
    '''
    (tmp_path / "a.ttl").write_text(text_of)
    got = {tuple(r) for r in readers.turtle(spark, str(tmp_path / "a.ttl")).collect()}
    g, o = "https://g.example/", "https://o.example/"
    assert got == {
        (g + "1", turtle.TYPE, o + "Place"), (g + "1", o + "name", "Ulm"), (g + "1", o + "name", 'U"lm ä'), (g + "1", o + "same", "https://geo.example/5/"),
        ("https://b.example/x", o + "size", "4"), ("https://b.example/x", o + "level", "5"), (g + "2", o + "note", "two\n    lines"),
    }
    names = readers.linked_names(readers.turtle(spark, str(tmp_path / "a.ttl")).replace(o + "same", "https://w.example/sameAs"), o + "Place", "https://geo.example/", [o + "name"])
    assert sorted(r.name for r in names.collect()) == ['U"lm ä', "Ulm"]


def test_configurations_are_stored_apart_and_tables_rebuilt_in_order(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "config_name string, row int")
    readers.store_by_config(rows, path)
    readers.store_by_config(rows.where("config_name = 'b'").withColumn("row", F.lit(9)), path)
    assert sorted(tuple(r) for r in readers.by_config(spark, path).select("config_name", "row").collect()) == [("a", 1), ("b", 9)]
    assert readers.by_config(spark, path, ["a"]).count() == 1
    made = []
    maker = lambda n: lambda: made.append(n) or spark.range(1)
    makers = {n: maker(n) for n in ("places_t", "names_t", "links_t")}
    order = readers.rebuilt(spark, makers, ["names_t"], {"names_t": ["places_t"], "links_t": ["names_t"]}, [["names_t", "links_t"]])
    assert order == made == ["names_t", "links_t"]
    with pytest.raises(ValueError):
        readers.rebuilt(spark, makers, ["none"], {})
    for n in made:
        spark.sql(f"DROP TABLE {n}")
