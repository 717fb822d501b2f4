"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import datetime as dt

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankweave.llm import alignment, byte_bpe, mixing, queries
from rankweave.llm.chat_format import chat_windows
from rankweave.llm.decontaminate import contamination
from rankweave.llm.line_dedup import without_shared_lines
from rankweave.llm.minhash_dedup import near_duplicates
from rankweave.llm.quality_classifier import good_documents, quality_scores
from rankweave.llm.quality_rules import quality_by_rules
from rankweave.llm.secret_scan import secrets
from rankweave.llm.substring_dedup import without_repeats
from rankweave.llm.url_filter import filtered_urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("words", "keys", "label", "group", "gone", "anchor", "window", "seed", "rank", "size", "count", "key", "path", "good", "quality", "kept", "spans", "item_id", "component_id")


def messy(spark):
    long = "very long text without an end " * 8000 + "\n" + "x" * 100_000
    rows = [(1, "some words\nof a text", "en", "a", 20), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t\n ", "en", None, 5), (5, long, "en", "b", len(long)), (6, long, "en", "b", len(long)), (7, "😀é ü\x00\x0b", "fr", "c", 4), (7, "😀é ü\x00\x0b", "fr", "c", 4), (None, "no id at all, but text", "en", "a", 22), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(1).alias(c) for c in CLASHES))


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1), (5, 0), (5, 1), (2, None), (None, 1), (77, 1)]
    return spark.createDataFrame(rows, "doc_id long, good int")


def items(spark, empty=False):
    rows = [] if empty else [(1, "very long text without an end very long text without an end"), (1, "of a"), (2, None), (3, ""), (None, "no id")]
    return spark.createDataFrame(rows, "item_id long, text string")


OPERATORS = {
    "quality_by_rules": (lambda s, d, e: quality_by_rules(d), 10), "contamination": (lambda s, d, e: contamination(d, items(s, e)), 8), "secrets": (lambda s, d, e: secrets(d), None),
    "quality_scores": (lambda s, d, e: quality_scores(d, labels(s, e)), 10), "without_shared_lines": (lambda s, d, e: without_shared_lines(d), 10), "without_repeats": (lambda s, d, e: without_repeats(d), 10),
    "near_duplicates": (lambda s, d, e: near_duplicates(d), 10), "encode": (lambda s, d, e: byte_bpe.encode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), 10),
    "good_documents": (lambda s, d, e: good_documents(d, labels(s, e)), None), "round trip": (lambda s, d, e: queries.tokens_with_digests(d), 10),
    "mixed": (lambda s, d, e: mixing.mixed(d), 10), "align": (lambda s, d, e: alignment.align(d, alignment.aligner(s, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")), public_tokenizers.PATTERN)), 10),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_documents(spark, name):
    run, rows = OPERATORS[name]
    got = run(spark, messy(spark), False).collect()
    assert rows is None or len(got) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name][0](spark, spark.createDataFrame([], SCHEMA), True).collect() == []


def test_defined_results(spark):
    d = messy(spark)
    near = near_duplicates(d).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in near if r.doc_id in (2, 5, 6, None)} == {(2, 2, True), (5, 5, True), (6, 5, False), (None, None, True)}
    cut = {r.doc_id: r for r in without_repeats(d).collect()}
    assert cut[5].n_removed == 0 and cut[6].n_removed == cut[6].n_words and cut[6].kept_text == ""
    kept = {r.doc_id: r.kept_text for r in without_shared_lines(d).collect()}
    assert kept[2] is None and kept[6] == "" and kept[7].startswith("😀")
    hit = {r.doc_id: r for r in contamination(d, items(spark)).collect()}
    assert hit[1].item_ids == ["1"] and hit[5].contaminated and not hit[2].contaminated
    assert all(r.base_failed and not r.kept for r in quality_by_rules(d).collect() if r.doc_id in (2, 3, 4))


def test_chat_of_messy_turns(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "user", "x"), (None, 1, "assistant", "y"), (2, 0, "system", "only"), (3, 0, "user", "long " * 50_000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in ("window", "place", "start", "end", "loss")))
    got = chat_windows(t).collect()
    assert sum(r.n_turns - r.n_repeated for r in got) == 6
    assert chat_windows(t.limit(0)).collect() == []


def test_urls_of_messy_pages(spark):
    c = spark.createDataFrame([(1, None, dt.date(2024, 1, 1)), (1, None, dt.date(2024, 1, 1)), (None, "http://a.b/" + "c/" * 3000, None), (2, "::::", dt.date(2024, 1, 1))], "page_id long, url string, fetched date").withColumn("pattern", F.lit(1)).withColumn("day", F.lit(1))
    e = spark.createDataFrame([], "pattern string, action string, dated date")
    assert [r.blocked for r in filtered_urls(c, e).collect()] == [False] * 3
    assert filtered_urls(c.limit(0), e).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_on_messy_and_empty_tables(spark, sf, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = messy(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, docs, sf)
    assert k == 4 or out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.limit(0), sf).collect() == []
