"""Findings of round 3 about growth: what is made and shuffled follows the input."""

import pytest
from pyspark.sql import functions as F

from rankweave.operators import evaluate as E
from rankweave.operators import graph as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("mode", ["any", "all"])
def test_records_are_judged_where_they_lie(spark, mode, monkeypatch):
    """The questions are sent to the records, not the records dealt by item; both ways give the same."""
    uses = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "y"), ("c", "z"), ("d", "x")], "key string, item string")
    recipes = spark.createDataFrame([("a", "k", True), ("b", "l", True), ("c", "k", True), ("d", "k", False), ("e", None, True)], "key string, course string, is_recipe boolean")
    known = spark.createDataFrame([("x", "f"), ("y", "g"), ("z", "h"), ("z", None)], "item string, category string")
    q = spark.createDataFrame(
        [("1", None, ["x", "y", "x"], None, None), ("2", "k", ["x", "no"], ["z"], ["none"]), ("3", None, None, None, ["h"]), ("4", "k", None, ["x"], None), ("5", None, ["no"], None, None), ("6", None, ["y", "x"], [None, "z"], None)],
        "query_id string, course string, include array<string>, exclude array<string>, exclude_categories array<string>",
    )
    want = {("1", "a"), ("2", "a"), ("3", "a"), ("3", "e"), ("4", "c"), ("6", "a")} | ({("1", "b"), ("1", "c")} if mode == "any" else set())
    got = G.filter_recipes(q, recipes, uses, known, mode)
    assert "strategy=broadcast" in plan(got) and "LeftAnti" not in plan(got)
    monkeypatch.setattr(G, "BROADCAST_ENTRIES", 0)
    for out in (got, G.filter_recipes(q, recipes, uses, known, mode)):
        rows = [(r.query_id, r.key) for r in out.collect()]
        assert sorted(rows) == sorted(want)


def test_judged_for_all_questions_of_a_course(spark):
    """What questions share is not repeated for each; scores are those of pairs."""
    q = spark.createDataFrame([(f"q{k}", f"c{k % 2}") for k in range(6)], "query_id string, course string")
    pair = lambda f: spark.createDataFrame([(f"q{k}", f"r{n}") for k in range(6) for n in range(12) if f(k, n)], "query_id string, key string")
    returned, expected = pair(lambda k, n: k != 3 and n % (k + 2) == 0), pair(lambda k, n: k not in (2, 4) and n % 4 == 0)
    shared = spark.createDataFrame([(f"c{n % 2}", f"r{n}") for n in range(12)] * 2, "course string, key string")
    want = E.set_scores(q, returned, expected, q.join(shared, "course").select("query_id", "key"))
    got = E.set_scores(q, returned, expected, shared)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.query_id: r.n_judged for r in got.collect()} == {f"q{k}": 6 for k in range(6)}


def test_set_scores_shuffle_pairs_once(spark):
    q = spark.createDataFrame([("x",), ("y",), ("z",)], "query_id string")
    r = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b"), ("y", "c")], "query_id string, key string")
    e = spark.createDataFrame([("x", "a"), ("z", "d"), ("z", "d")], "query_id string, key string")
    j = spark.createDataFrame([("x", "b"), ("x", "e")], "query_id string, key string")
    out = E.set_scores(q, r, e, j)
    assert {(x.query_id, x.n_returned, x.n_expected, x.n_judged, x.precision, x.recall) for x in out.collect()} == {("x", 2, 1, 2, 0.5, 1.0), ("y", 1, 0, 0, 1.0, 1.0), ("z", 0, 1, 0, 0.0, 0.0)}
    assert plan(out).count("Aggregate [query_id") <= 4
    can = E.answerable(q, r, e)
    assert {(x.query_id, x.answerable) for x in can.collect()} == {("x", True), ("y", None), ("z", False)}
    assert "LeftSemi" not in plan(can)


def test_names_are_made_of_distinct_lines_only(spark):
    """No rule for names is left in the plan over all lines, and what is banned isn't made into items for each answer."""
    from rankweave.operators import vocab as V

    lines = spark.createDataFrame([(k, x) for k, x in enumerate(["2 cups rice", "2 cups rice", "1 tbsp ghee", "x", None, "2 cups nothing"])], "query_id long, line string")
    v = spark.createDataFrame([("ghee", "butter", None), ("nothing", None, None), ("rice", "rice", ["rice", "grain"])], "name string, canonical string, split array<string>")
    out = V.resolve(lines, "line", v, named=True)
    assert "regexp_replace" not in plan(out)
    want = [(0, "grain"), (0, "rice"), (1, "grain"), (1, "rice"), (2, "butter")]
    assert sorted((r.query_id, r.item) for r in out.collect()) == want and all(r.item == r.item_name for r in out.collect())
    a = spark.range(4).withColumnRenamed("id", "query_id")
    have = spark.createDataFrame([(0, "rice"), (1, "brown rice"), (2, "oil")], "query_id long, item string")
    got = {r.query_id: (r.grounded, r.invented) for r in E.no_invented(a, out.select("query_id", "item"), have).collect()}
    assert got == {0: (0.5, ["grain"]), 1: (0.5, ["grain"]), 2: (0.0, ["butter"]), 3: (1.0, [])}
    limits = a.select("query_id", F.array(F.lit("rice")).alias("exclude"), F.array(F.lit("fat")).alias("exclude_categories"))
    families = spark.createDataFrame([("butter", "fat"), ("butter", "milk"), ("grain", "none")], "item string, category string")
    kept = E.constraint_respected_answers(a, out, limits, families)
    assert {r.query_id: r.respected for r in kept.collect()} == {0: 0.5, 1: 0.5, 2: 0.0, 3: 1.0}
    assert "explode(exclude" not in plan(kept)
