"""The queries themselves on odd tables: very long texts, nulls, repeated rows, no labels, nothing at all."""

import random
import zlib

import pytest
import tiktoken

from placewright.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["the", "river", "of", "Ülm", "key=abc", "x1", "token:abcdef123", "a-b", "!", "0f" * 13, "said"] + ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    long_text = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(7000))
    assert len(long_text) > 500_000
    rows = [(1, long_text), (2, None), (3, ""), (None, "no id"), (4, long_text), (5, "same"), (5, "same"), (6, "z" * 20_000), (7, " \n\t "), (8, "é" * 3000 + " " + "=" * 3000)]
    path = tmp_path_factory.mktemp("odd")
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for folder, docs in ((path / "some", table), (path / "none", table.where("false"))):
        docs.coalesce(2).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    return str(path), rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_bear_odd_tables(spark, odd, name):
    path, rows = odd
    assert registry.QUERIES[name](spark, f"{path}/none").count() == 0
    out = registry.QUERIES[name](spark, f"{path}/some")
    if name.startswith("op6"):
        assert out.count() == 0
        return
    got = out.where("piece = 0") if "piece" in out.columns else out
    assert got.count() == len(rows)
    if "score" in out.columns:
        assert out.where("score = 0.5").count() == len(rows)
    if name.startswith("op2"):
        assert {(r.doc_id, r.n_removed) for r in out.where("doc_id in (1, 4, 5)").collect()} == {(1, len(rows[0][1].encode())), (4, len(rows[0][1].encode())), (5, 0)}
    if name.startswith("op8"):
        same = {r.doc_id: r.component_id for r in out.collect() if r.doc_id is not None}
        assert same[1] == same[4] == 1 and same[2] == same[3] == same[7] == 2 and same[5] == 5
    if name.startswith("op4"):
        sizes = {r.doc_id: (r["size"], r.text_crc32) for r in out.collect()}
        assert sizes[1] == (len(rows[0][1].encode()) + 8, zlib.crc32(rows[0][1].encode())) and sizes[2] == (8, 0)
    if name.startswith("op5"):
        import public_tokenizers

        from placewright.llm import bpe

        truth = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(public_tokenizers.path(bpe.RANKS)).ranks, special_tokens={})
        count = {r.doc_id: r.n_tokens for r in out.collect()}
        assert all(count[i] == len(truth.encode_ordinary(t or "")) for i, t in rows if i is not None)
    if name.startswith("op9"):
        assert out.where("base_failed").count() == len(rows) - 2 and out.where("base_failed and kept").count() == 0


def test_ties_keep_the_smallest_id(spark):
    from placewright.llm import simhash

    docs = spark.createDataFrame([(i, "one and the same text of some words") for i in (9, 4, 7, 4)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(docs).collect()] == [4]
    assert {r.component_id for r in simhash.with_components(docs).collect()} == {4}
