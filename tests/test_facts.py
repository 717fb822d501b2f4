"""Pinned facts on small frames."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rankweave.functions.vectors import dot, encode, l2_normalise
from rankweave.operators import chunk as C
from rankweave.operators import context as A
from rankweave.operators import evaluate as E
from rankweave.operators import extract as X
from rankweave.operators import graph as G
from rankweave.operators import question as Q
from rankweave.operators import retrieve as R
from rankweave.operators import vocab as V
from rankweave.plans import evaluation as PE
from rankweave.plans import text as PT
from rankweave.sources import runs as S


def test_names_of_raw_lines(spark):
    cases = {
        "2 tbsp gram flour": "gram flour", "100 grams paneer": "paneer", "2 cloves garlic": "garlic", "4 cloves of garlic": "garlic", "1 inch fresh ginger, chopped": "fresh ginger", "1/2 tsp turmeric powder": "turmeric powder",
        "2 tbsp ghee, melted": "ghee", "1 cup green gram (soaked)": "green gram", "a": None, "one two three four five six seven eight": None,
    }
    got = {r.line: r.name for r in V.normalise_lines(spark.createDataFrame([(c,) for c in cases], "line string"), "line").collect()}
    assert got == cases


def vocabulary(spark):
    families = spark.createDataFrame([("ghee", "dairy", ["clarified butter"]), ("ginger", "none", ["fresh ginger"]), ("cashew", "nut", None)], "canonical string, category string, aliases array<string>")
    splits = spark.createDataFrame([("ginger garlic paste", ["fresh ginger", "garlic"])], "name string, parts array<string>")
    rejects = spark.createDataFrame([("water",), ("ghee",)], "name string")
    lines = spark.createDataFrame([("2 tbsp ghee",), ("1 onion",), ("water",)], "line string")
    return V.build_vocabulary(V.name_frequencies(lines, "line"), V.build_dictionary(families, splits, rejects))


def test_resolving_lines(spark):
    lines = spark.createDataFrame([("2 tbsp clarified butter",), ("1 tsp ginger garlic paste",), ("water",), ("3 mangoes",)], "line string")
    got = sorted((r.line, r.item) for r in V.resolve(lines, "line", vocabulary(spark)).collect())
    assert got == [("1 tsp ginger garlic paste", "garlic"), ("1 tsp ginger garlic paste", "ginger"), ("2 tbsp clarified butter", "ghee"), ("3 mangoes", "mangoes")]
    names = spark.createDataFrame([("ghee",), ("cashew",), ("besan",)], "item string")
    assert {r.item: r.category for r in V.category_of(names, vocabulary(spark)).collect()} == {"ghee": "dairy", "cashew": "nut", "besan": "none"}


def test_structured_pages(spark):
    node = {"@graph": [{"@type": ["Thing", "RECIPE"], "name": "Soup", "recipeIngredient": ["1 onion", "salt"], "recipeInstructions": [{"@type": "HowToStep", "text": "Boil."}, "Serve.  Eat."], "recipeYield": 2}]}
    html = f'<html><head><title>T</title><script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">{{bad</script></head><body><nav><a href="/a#x">nav</a></nav><h1>Big</h1><p>two  words</p></body></html>'
    page = spark.createDataFrame([(1, "http://h.com/b", html)], "page_id long, url string, html string")
    r = X.records_from_pages(page).collect()
    assert [(x.title, x.ingredient_lines, x.step_lines, x.servings_hint) for x in r] == [("Soup", ["1 onion", "salt"], ["Boil.", "Serve.", "Eat."], "2")]
    text = X.html_text(page).first()
    assert text.title == "Big" and text.lines == ["Big", "two words"]
    assert [(x.href, x.text) for x in X.extract_links(page).collect()] == [("http://h.com/a", "nav")]


def test_sections_of_a_page(spark):
    lines = ["Lemon rice", "Serves 4", "Ingredients", "1 cup rice", "Cook time: 5", "Method", "Boil the rice.", "Serve with " + "much " * 20 + "lemon."]
    got = X.split_sections(spark.createDataFrame([("r", 7, lines), ("r", 3, ["x"])], "run string, page_no int, lines array<string>")).collect()
    assert [(r.record_id, r.ingredient_lines, r.step_lines, r.servings_hint, r.time_hint, r.detected_by) for r in got] == [("r_0001", ["1 cup rice"], ["Boil the rice.", lines[-1]], "Serves 4", "Cook time: 5", "headings")]


def test_link_scores(spark):
    cases = {"http://h/recipes/lemon-rice": 10, "http://h/recipes/rice": 6, "http://h/recipes": 2, "http://h/recipe": 1, "http://h/category/x-y": 2, "http://h/south-indian-recipes": 2, "http://h/list?page=2": 1, "http://h/about/us": 0, "http://h/2015/03/dish-name": 7, "http://h/": 0, "http://h/short": 0}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.s for r in df.select("url", X.link_score(F.col("url"), F.lit("")).alias("s")).collect()} == cases


def test_terms_and_public_urls(spark):
    df = spark.createDataFrame([("Deep-fry, then stir.",)], "t string")
    assert df.select(X.extract_terms(F.col("t"), X.ACTIONS).alias("a")).first().a == ["deep fry", "stir"]
    urls = spark.createDataFrame([("http://10.0.0.1/x",), ("http://example.com/",), ("ftp://example.com",), ("http://inner/",)], "url string")
    hosts = spark.createDataFrame([("inner", "127.0.0.1"), ("example.com", "93.184.216.34")], "host string, ip string")
    unknown = X.filter_public_urls(spark.createDataFrame([("http://inner-unknown/",)], "url string"), hosts).first()
    assert (unknown.ok, unknown.reason) == (False, "unresolved")
    assert {r.url: r.ok for r in X.filter_public_urls(urls, hosts).collect()} == {"http://10.0.0.1/x": False, "http://example.com/": True, "ftp://example.com": False, "http://inner/": False}


def test_chunks_reproduce_their_texts():
    text = ("One sentence here. Another; and more, of it.\n\nA new paragraph that goes on " + "and on " * 60 + "\nend. ") * 3
    for size, overlap in ((80, 20), (200, 0), (30, 10)):
        got = C.recursive_bounds(text, size, overlap)
        assert all(0 < b - a <= size and text[a:b].strip() == text[a:b] for a, b in got)
        assert set("".join(text.split())) == set("".join("".join(text[a:b].split()) for a, b in got))
        covered = set().union(*(range(a, b) for a, b in got))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    assert C.sentence_bounds("Hi. A sentence that is long enough to stand alone here. Ok.", 40) == [(0, 3), (4, 59)]
    assert C.record_bounds("aaaa\nbbbb\ncc", 6) == [(0, 4), (4, 9), (9, 12)]


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2), (2, 3, 3)], "k int, start int, end int")
    assert sorted(map(tuple, C.merge_intervals(df, ["k"]).collect())) == [(1, 0, 7), (1, 9, 10)]


def test_ranking_metrics(spark):
    q = spark.createDataFrame([("many",), ("early",), ("late",), ("unknown",)], "query_id string")
    rels = [("many", f"r{i}") for i in range(21)] + [("early", "a"), ("early", "b"), ("late", "a"), ("late", "b")]
    ranked = [("many", f"r{i}", i + 1) for i in range(5)] + [("early", x, i + 1) for i, x in enumerate("abxyz")] + [("late", x, i + 1) for i, x in enumerate("xyzab")]
    m = {r.query_id: r for r in E.ranking_metrics(q, spark.createDataFrame(ranked, "query_id string, record_id string, rank int"), spark.createDataFrame(rels, "query_id string, record_id string")).collect()}
    assert m["many"].recall == 1.0 and m["early"].ap == 1.0 > m["late"].ap and m["unknown"].hit is None
    hits = spark.createDataFrame([("q", i, i, ["r"]) for i in range(1, 5)], "query_id string, passage_id int, rank int, doc_ids array<string>")
    assert E.diversity_at_k(hits, 4).first().diversity == 0.25


def test_set_scores(spark):
    kinds = "query_id string, key string"
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "query_id string")
    returned = spark.createDataFrame([("a", f"k{i}") for i in range(100)], kinds)
    expected = spark.createDataFrame([("a", f"k{i}") for i in range(3)] + [("b", "z")], kinds)
    judged = spark.createDataFrame([("a", f"k{i}") for i in range(4)], kinds)
    got = {r.query_id: (r.precision, r.recall, r.f1) for r in E.set_scores(q, returned, expected, judged).collect()}
    assert got["a"][:2] == (0.75, 1.0) and got["b"] == (0, 0, 0) and got["c"] == (1, 1, 1)


def test_answers(spark):
    v = vocabulary(spark)
    a = spark.createDataFrame([("x", "- 2 tbsp ghee\n- 1 onion\nSTEPS:\n1. add cashew nuts"), ("y", "Fry until the onions soften.")], "query_id string, text string")
    claimed = E.answer_items(a, v)
    assert {(r.query_id, r.item) for r in claimed.collect()} == {("x", "ghee"), ("x", "onion")}
    got = {r.query_id: (r.grounded, r.invented) for r in E.no_invented(a, claimed, E.context_items(spark.createDataFrame([("x", "- chopped onions\n")], "query_id string, text string"), v)).collect()}
    assert got == {"x": (0.5, ["ghee"]), "y": (1.0, [])}
    can = spark.createDataFrame([("x", None), ("y", True)], "query_id string, answerable boolean")
    refused = spark.createDataFrame([("x", True), ("y", True)], "query_id string, refused boolean")
    assert {r.query_id: r.abstention for r in E.abstention(refused, can).collect()} == {"x": None, "y": 0.0}


def test_graph_questions(spark):
    recipes = spark.createDataFrame([("r1", "soup", True), ("r2", "main", True), ("r3", "soup", False)], "key string, course string, is_recipe boolean")
    uses = spark.createDataFrame([("r1", "onion"), ("r1", "ghee"), ("r2", "onion"), ("r3", "onion")], "key string, item string")
    items = spark.createDataFrame([("onion", "none"), ("ghee", "dairy")], "item string, category string")
    kinds = "query_id string, course string, include array<string>, exclude array<string>, exclude_categories array<string>"
    q = spark.createDataFrame([("none", "", [], [], []), ("soup", "soup", [], [], []), ("free", "", ["onion"], [], ["dairy"]), ("lost", "", ["mango"], [], []), ("odd", "", [], ["mango"], [])], kinds)
    got = {}
    for r in G.filter_recipes(q, recipes, uses, items).collect():
        got.setdefault(r.query_id, set()).add(r.key)
    assert got == {"none": {"r1", "r2"}, "soup": {"r1"}, "free": {"r2"}, "odd": {"r1", "r2"}}
    with pytest.raises(ValueError):
        G.assert_unique(uses, ["key"])


def test_constraints(spark):
    replies = ['ok {"include": ["Rice", "egg"], "exclude": ["dairy", "Onion ", "ghee"], "exclude_categories": ["nut", "stone"], "substitute_for": "ghee", "course": "soup"}', "no idea", "{broken"]
    got = Q.constraint_flags(Q.parse_constraints(spark.createDataFrame([(r,) for r in replies], "reply string"))).collect()
    assert (got[0].include, got[0].exclude, got[0].exclude_categories, got[0].course) == (["rice"], ["onion"], ["nut", "dairy"], "soup")
    assert [r.source for r in got] == ["model", "unparsed", "unparsed"] and [r.empty for r in got] == [False, True, True]


def test_follow_ups(spark):
    names = spark.createDataFrame([("coconut",), ("lemon juice",)], "canonical string")
    cases = {"Which recipes use coconut?": False, "and the second one?": True, "what about without dairy?": True, "Can I make a soup with lemon juice for six people?": False, "How long does it take to cook?": False, "ok thanks": True}
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, question string")
    assert {r.question: r.follow_up for r in Q.is_follow_up(Q.has_subject(df, names, ["i"])).collect()} == cases


def test_contexts(spark):
    hits = spark.createDataFrame([("q", i, i, f"t{i}") for i in range(1, 6)], "query_id string, passage_id int, rank int, text string")
    q = spark.createDataFrame([("q", "why?"), ("r", "how?")], "query_id string, question string")
    assert A.contexts_reordered(hits, q).first().passages == [1, 3, 5, 4, 2]
    replies = spark.createDataFrame([("q", "NOT_IN_CONTEXT", "m", 1.0)], "query_id string, reply string, model string, elapsed_s double")
    assert {r.query_id: r.refused for r in A.finalise_answers(q, replies, A.contexts_stuffed(hits, q)).collect()} == {"q": True, "r": True}


def test_composition(spark):
    assert R.Pipeline("rrf", True, True, True).label == "rrf+mmr+rerank+graph"
    p = encode(spark.createDataFrame([(i, t) for i, t in enumerate(["red fish soup", "blue fish", "red rice", "green salad"])], "passage_id int, text string"), "text")
    q = encode(spark.createDataFrame([("a", "red fish"), ("b", "red fish")], "query_id string, text string"), "text")
    held = spark.createDataFrame([("b",)], "query_id string")
    ok = spark.createDataFrame([("b", 2)], "query_id string, passage_id int")
    for at in ("pre", "post"):
        got = R.compose(R.Pipeline("rrf", use_gate=True, k=3), q, p, held, ok, at).collect()
        assert [r.passage_id for r in got if r.query_id == "b"] == [2] and next(r.passage_id for r in got if r.query_id == "a" and r.rank == 1) == 0
    v = spark.createDataFrame([([3.0, 4.0],)], "v array<double>")
    assert v.select(dot(l2_normalise(F.col("v")), F.col("v")).alias("x")).first().x == 5.0


def test_run_files(spark, tmp_path):
    run = {"run_id": "1", "source_type": "pdf", "origin": "book", "n_recipes": 5, "recipes": [{"recipe_id": "r_0001", "title": "Soup", "ingredient_lines": ["1 onion"], "step_lines": ["Boil."]}]}
    (tmp_path / "pdf-1.json").write_text(json.dumps(run))
    (tmp_path / "bad.json").write_text("{nope")
    r = S.read_runs(spark, str(tmp_path)).collect()
    assert [(x.source, x.record_id, x.source_type, x.origin) for x in r] == [("pdf-1", "r_0001", "pdf", "book")]
    assert [(x.file, x.n_records) for x in S.list_runs(S.read_run_files(spark, str(tmp_path))).collect()] == [("pdf-1.json", 1)]
    (tmp_path / "q.txt").write_text("# no\n\nhow?\n")
    assert [(x.query_id, x.question) for x in S.read_questions(spark, str(tmp_path / "q.txt")).collect()] == [("u_0003", "how?")]


def test_cover_by_chunks_of_all_documents(spark, tmp_path):
    """Documents that do not start like a benchmark text hold its words too; ties go by passage_id."""
    text = "alpha bravo charlie delta foxtrot golf hotel india juliet kilo"
    docs = [(1, "s", "juliet kilo hotel"), (2, "s", "alpha bravo charlie delta"), (3, "t", "delta charlie bravo hotel foxtrot"), (4, "t", "india juliet"), (5, "t", "nothing of it")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text), (8, "zulu yankee")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = {w for w in text.split() if len(w) > 3}
    sets, got, k = [words & set(t.split()) for _, _, t in docs], set(), 0
    while len(got) < 0.9 * len(words) and any(x - got for x in sets):
        got |= max(sets, key=lambda x: len(x - got))
        k += 1
    assert {r.record_id: r.k for r in PE.e03_k_at_target(spark, str(tmp_path)).collect()} == {7: k, 8: 0} and k == 4


def test_digest_of_a_source_without_its_text(spark, tmp_path):
    """No row has all texts of a source."""
    docs = [(2, "s", "é two", "en"), (1, "s", "one", "en"), (3, "t", "three", "de"), (10, "s", "ten", "en")]
    spark.createDataFrame(docs, "doc_id long, source string, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = PT.x14_render_records(spark, str(tmp_path))
    text = lambda i: next(f"{t}\n{lang}\nMethod:\n1. {t}" for k, _, t, lang in docs if k == i)
    digest = lambda *ids: hashlib.md5("\1".join(map(text, ids)).encode()).hexdigest()
    assert {r.source: r.digest for r in out.collect()} == {"s": digest(1, 2, 10), "t": digest(3)}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_ties_of_rounded_scores_before_the_cut(spark):
    """Scores that differ only past the ninth place are ties, and the smallest ids of all tied are kept."""
    p = spark.createDataFrame([(i, "saffron" + " plain" * (400 - i)) for i in range(300)] + [(1000 + i, "other words") for i in range(400)], "passage_id long, text string")
    q = spark.createDataFrame([(1, "saffron")], "query_id long, text string")
    hits = R.bm25_topk(q, p, 3, b=1e-13).collect()
    assert sorted((r.rank, r.passage_id) for r in hits) == [(1, 0), (2, 1), (3, 2)]
