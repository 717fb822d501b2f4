"""Findings of round 3."""

import math

import pytest
from pyspark.sql import functions as F

from rankweave.functions.slices import ROWS, map_rows
from rankweave.functions.vectors import hashed_vectors
from rankweave.operators import chunk as C
from rankweave.operators import extract as X
from rankweave.operators.sets import lacking_at_most


@pytest.mark.parametrize("dims", [1, 7, 64, 20_000])
def test_hashed_vectors_count_words_once(spark, dims):
    """Same vectors as the counts of plain Python, and a plan whose expressions don't grow with dims."""
    texts = ["a b B c3", "", None, "x " * 700 + "y", "é ü", "one two three two"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = hashed_vectors(df, "text", dims)
    assert f"0, {dims - 1}" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: list(r.vec) for r in out.collect()}
    words = df.select("id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).select("id", F.xxhash64("w").alias("x")).collect()
    for k in range(len(texts)):
        want = [0.0] * dims
        for r in words:
            if r.id == k:
                want[r.x % dims] += -1.0 if (r.x >> 20) % 2 else 1.0
        norm = math.sqrt(sum(v * v for v in want))
        assert got[k] == [v / norm if norm else v for v in want]


@pytest.mark.parametrize(
    ("lines", "is_record"),
    [(["caféheat it", "b", "c" * 130], True), (["we waſh it", "b", "c" * 130], True), (["ingredientsé", "b", "c"], True), (["ingredientsx", "b", "c"], False), (["a b the recipe", "directions", ":"], True), (["reheat", "b", "c" * 130], False)],
)
def test_record_pages_as_in_sql(spark, lines, is_record):
    """Word borders, dots and case are those of the SQL's engine."""
    duckdb = pytest.importorskip("duckdb")
    joined = " ".join(lines)
    one = lambda pattern: duckdb.execute("SELECT regexp_matches(?, ?)", [joined, pattern]).fetchone()[0]
    assert (one(X.INGREDIENT_HEADER) or one(X.METHOD_HEADER) or (one(X.VERB) and len(joined) > 120)) == is_record
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    assert df.select(X.is_record_page(F.col("lines")).alias("r")).first().r == is_record


def test_pantries_hold_their_first_sets_only(spark):
    """What leaves the join follows pantries and limit, not pantries times sets."""
    edges = spark.range(300).select(F.col("id").cast("string").alias("key"), F.explode(F.array(*map(F.lit, "ab"))).alias("item"))
    own = spark.createDataFrame([(p, i) for p in ("p", "q", "r") for i in "ab"] + [("s", "z")], "pantry_id string, item string")
    rows = lacking_at_most(own, edges, 3, 5).collect()
    assert len(rows) == 20
    first = sorted(str(k) for k in range(300))[:5]
    assert sorted((r.pantry_id, r.key, r.n_needed, r.n_missing) for r in rows) == sorted((p, k, 2, 2 if p == "s" else 0) for p in "pqrs" for k in first)


def test_rows_are_objects_by_slices(spark):
    """A worker turns at most ROWS rows of a batch into objects at once."""
    n = map_rows(spark.range(1000, numPartitions=1), lambda rows: iter([(len(list(rows)),)]), "n long").collect()
    assert sum(r.n for r in n) == 1000 and max(r.n for r in n) <= ROWS


def test_centroid_groups_go_on_over_batches(spark):
    units = [("s", f"d{d}", k, k, k + 1, [] if k == 3 else [math.cos(k * d), math.sin(k * d)] if d else [1.0, 0.0]) for d in range(4) for k in range(9)]
    df = spark.createDataFrame([u[:5] + (u[5] or [0.0, 0.0],) for u in units], "source string, doc_id string, chunk_no int, start long, end long, vec array<double>")
    plan = C.group_centroid(df)
    assert "FlatMapGroups" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no data frame for each document
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = {(r.doc_id, r.chunk_no): r.group_no for r in C.group_centroid(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for d in range(4):
        group, total = 0, None
        for k in range(9):
            v = units[d * 9 + k][5] or [0.0, 0.0]
            if total is not None:
                norm = math.hypot(*total)
                if ((v[0] * total[0] + v[1] * total[1]) / norm if norm else 0.0) < 0.5:
                    group, total = group + 1, None
            total = list(v) if total is None else [total[0] + v[0], total[1] + v[1]]
            assert got[f"d{d}", k] == group


def test_pages_give_the_parts_asked_for(spark):
    """Links are not resolved where only text is asked for; what is there is as from the whole pass."""
    html = '<title>t</title><a href="/b">b</a><p>x</p><script type="application/ld+json">{"@type": "Recipe"}</script>'
    df = spark.createDataFrame([(1, "http://h/a", html), (2, None, None)], "page_id long, url string, html string")
    whole, text, links, nodes = (X.page_parts(df, *of).orderBy("page_id").collect() for of in ((), (("text",),), (("links",),), (("nodes",),)))
    assert [(r.title, r.lines) for r in text] == [(r.title, r.lines) for r in whole] and text[0].lines == ["b", "x"]
    assert [r.links for r in links] == [r.links for r in whole] and len(links[0].links) == 1
    assert [r.nodes for r in nodes] == [r.nodes for r in whole] and len(nodes[0].nodes) == 1
    assert not any(r.links or r.nodes for r in text) and not any(r.lines or r.nodes for r in links)
