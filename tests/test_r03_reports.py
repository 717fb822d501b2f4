"""Findings of round 3 about the memory of reports: texts are read as they lie, and a report ranks once."""

from rankweave.operators import retrieve as R
from rankweave.operators.automaton import contained


def test_few_atoms_go_to_the_texts(spark, monkeypatch):
    """The atoms of one automaton need no packs of texts: one pass of Arrow, with texts as objects one at a time."""
    from rankweave.operators import automaton

    texts = spark.createDataFrame([(1, "salt and rice"), (2, None), (3, ""), (4, "rice" * 50_000 + "\u00e9"), (5, "r")], "id int, text string")
    atoms = spark.createDataFrame([("rice",), ("\u00e9",), ("",), (None,), ("salt and",), ("rice",)], "atom string")
    out = contained(texts, "id", atoms)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = [(1, ""), (1, "rice"), (1, "salt and"), (3, ""), (4, ""), (4, "rice"), (4, "\u00e9"), (5, "")]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert contained(texts, "id", atoms.limit(0)).collect() == []
    monkeypatch.setattr(automaton, "BATCH_CHARS", 12)  # packs and batches
    assert sorted(map(tuple, contained(texts, "id", atoms).collect())) == sorted(want)


def test_a_report_ranks_once(spark, sf, monkeypatch):
    """Metrics, diversity and constraints are of one saved ranking; before, each made an index of its own."""
    from rankweave.plans import evaluation

    plain, built = R.bm25_index, []
    monkeypatch.setattr(R, "bm25_index", lambda *a: built.append(1) or plain(*a))
    rows = {r.family: r.n for r in evaluation.e19_ranking_report(spark, sf).collect()}
    assert len(built) == 1 and rows["(all)"] == rows["even"] + rows["odd"]
    built.clear()
    evaluation.e19_ranking_breaches(spark, sf)
    assert len(built) == 1
