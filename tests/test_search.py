"""Ranking over blocks, set joins, the automaton and global numbers against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.functions.numbering import numbered
from rankweave.operators import blocks as B
from rankweave.operators import evaluate as E
from rankweave.operators import graph as G
from rankweave.operators import retrieve as R
from rankweave.operators.automaton import contained
from rankweave.operators.sets import containing_all

WORDS = ["the", "of", "and", "salt", "rice", "beans", "oil", "x1", "leek", "curry", "soup"]


def corpus(seed, n=70):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    texts = {f"p{k:03}": " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 30))) for k in range(n)}
    texts |= {"copy1": texts["p001"], "copy0": texts["p001"], "none": None, "empty": "", "odd": "Ünï. RICE! 7"}
    asked = {f"q{k}": " ".join(rng.choices(WORDS + ["unseen"], k=rng.randint(1, 6))) for k in range(9)} | {"q9": None, "q10": "unseen only"}
    return texts, asked


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def plain_bm25(texts, asked, k1=1.5, b=0.75):
    bags = {p: Counter(words(t)) for p, t in texts.items()}
    n, mean = len(texts), sum(map(Counter.total, bags.values())) / len(texts)
    df = Counter(w for bag in bags.values() for w in bag)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: 0.25 * sum(raw.values()) / len(raw) if r < 0 else r for w, r in raw.items()}
    for q, text in asked.items():
        for p, bag in bags.items():
            met = [w for w in words(text) if w in bag]
            if met:
                yield q, p, sum(idf[w] * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * bag.total() / mean)) for w in met)


def grams(text):
    w = [x for x in re.findall(r"\w\w+", (text or "").lower(), re.ASCII)]
    return Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def plain_tfidf(texts, asked):
    bags = {p: grams(t) for p, t in texts.items()}
    df = Counter(w for bag in bags.values() for w in bag)
    weigh = lambda bag: {w: (1 + math.log(c)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in bag.items() if w in df}
    vectors = {p: weigh(bag) for p, bag in bags.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for q, text in asked.items():
        v = weigh(grams(text))
        for p, other in vectors.items():
            if met := v.keys() & other.keys():
                yield q, p, sum(v[w] * other[w] for w in met) / norm(v) / norm(other)


def best(scored, k, ok=lambda q, p: True):
    out = {}
    for q, p, s in scored:
        if ok(q, p):
            out.setdefault(q, []).append((-round(s, 9), p))
    return {(q, p, r): -s for q, hits in out.items() for r, (s, p) in enumerate(sorted(hits)[:k], 1)}


def same(got, expected):
    got = {(r.query_id, r.passage_id, r["rank"]): r.score for r in got.collect()}
    assert got.keys() == expected.keys()
    assert all(got[x] == pytest.approx(expected[x], abs=1e-8) for x in got)


@pytest.fixture(params=[1, 2])
def asked(request, spark, monkeypatch):
    """Small blocks, so that many meet and some are skipped."""
    monkeypatch.setattr(B, "PASSAGE_BLOCK", 7)
    monkeypatch.setattr(B, "QUERY_BLOCK", 4)
    texts, asked = corpus(request.param)
    p = spark.createDataFrame([(k, t, hash(k) % 3 if k > "p02" else None) for k, t in sorted(texts.items())], "passage_id string, text string, label int").repartition(3)
    return texts, asked, spark.createDataFrame(list(asked.items()), "query_id string, text string"), p, {r.passage_id: r.label for r in p.collect()}


@pytest.mark.parametrize(("ranker", "plain", "index"), [(R.bm25_topk, plain_bm25, R.bm25_index), (R.tfidf_topk, plain_tfidf, R.tfidf_index)])
def test_word_rankings(spark, asked, ranker, plain, index):
    texts, questions, q, p, labels = asked
    scored = list(plain(texts, questions))
    same(ranker(q, p, 3), best(scored, 3))
    built = index(p)
    same(ranker(q, p, None, index=built), best(scored, None))
    only_1 = q.withColumn("permits", F.when(F.col("query_id") != "q1", F.array(F.lit(2).cast("long"))))
    same(ranker(only_1, p, 4, index=built), best(scored, 4, lambda q, p: q == "q1" or labels[p] in (1, None)))
    pairs = [(q, p) for k, q in enumerate(questions) for p in texts if (len(p) + k + ord(p[-1])) % 3 == 0 and q != "q2"]
    allowed = spark.createDataFrame(pairs + pairs[:5], "query_id string, passage_id string")
    same(ranker(q, p, 4, index=built, allowed=allowed), best(scored, 4, lambda q, p: (q, p) in set(pairs)))


def test_blocks_are_skipped_only_without_a_loss(spark, asked):
    """A question's greatest possible score in a block bounds every score there."""
    texts, questions, q, p, _ = asked
    index = R.bm25_index(p)
    for row in index.blocks.collect():
        at = 0
        for top, count in zip(row.tops, row.counts, strict=True):
            assert top == max(row.impacts[at : at + count])
            at += count
        assert at == len(row.docs)


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(B, "PASSAGE_BLOCK", 5)
    monkeypatch.setattr(B, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    vecs, asks = rng.integers(-3, 4, (60, 6)).astype(float), rng.integers(-3, 4, (8, 6)).astype(float)
    vecs[40:45] = vecs[3]
    p = spark.createDataFrame([(k, v.tolist(), k % 70) for k, v in enumerate(vecs)], "passage_id long, vec array<double>, label int").repartition(3)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asks)], "query_id long, vec array<double>")
    scored = [(k, n, float(a @ v)) for k, a in enumerate(asks) for n, v in enumerate(vecs)]
    same(R.dense_topk(q, p, 7), best(scored, 7))
    same(R.dense_topk(q, p, None), best(scored, None))
    high = q.withColumn("permits", F.when(F.col("query_id") > 2, F.array(F.lit(5).cast("long"), F.lit(1).cast("long"))))
    same(R.dense_topk(high, p, 7), best(scored, 7, lambda k, n: k <= 2 or n in (0, 2, 64)))
    pairs = [(k, n) for k in range(0, 8, 2) for n in range(k, 60, 3)]
    allowed = spark.createDataFrame(pairs, "query_id long, passage_id long")
    same(R.dense_topk(q, p, 4, allowed=allowed), best(scored, 4, lambda k, n: (k, n) in pairs))
    assert R.dense_topk(q.limit(0), p, 3).collect() == [] and R.dense_topk(q, p.limit(0), 3).collect() == []


def test_rankings_of_nothing(spark):
    p = spark.createDataFrame([(1, None), (2, "")], "passage_id long, text string")
    q = spark.createDataFrame([(1, "a bc"), (2, None)], "query_id long, text string")
    for ranker in (R.bm25_topk, R.tfidf_topk):
        assert ranker(q, p, 3).collect() == [] and ranker(q, p.limit(0), 3).collect() == [] and ranker(q.limit(0), p, 3).collect() == []


def test_gate_by_keys(spark):
    hits = spark.createDataFrame([(q, p, 1.0 - p / 10, p) for q in (1, 2) for p in (1, 2, 3)], "query_id long, passage_id long, score double, rank int")
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "passage_id long, key string")
    held = spark.createDataFrame([(2,)], "query_id long")
    permitted = spark.createDataFrame([(2, "b"), (2, "c")], "query_id long, key string")
    got = sorted(tuple(r) for r in R.gate(hits, held, permitted, 2, keys).select("query_id", "passage_id", "rank").collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 3, 2)]


def test_post_gate_keeps_all_hits(spark):
    """A permitted passage at the end of the whole ranking is found."""
    texts = [(k, "rice " * (200 - k)) for k in range(150)]
    p = spark.createDataFrame(texts, "passage_id long, text string")
    q = spark.createDataFrame([(1, "rice"), (2, "rice")], "query_id long, text string")
    held, permitted = q.where("query_id = 1").select("query_id"), spark.createDataFrame([(1, 149), (1, 140)], "query_id long, passage_id long")
    for at in ("post", "pre"):
        got = R.compose(R.Pipeline("bm25", use_gate=True, k=2, pool=5), q, p, held, permitted, gate_at=at)
        assert {r.passage_id for r in got.where("query_id = 1").collect()} == {149, 140} and got.where("query_id = 2").count() == 2


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pantry_gap(spark, seed):
    rng = random.Random(seed)
    items = [f"i{k}" for k in range(14)]
    records = {f"r{k:02}": set(rng.sample(items, rng.randint(1, 8))) for k in range(60)}
    pantries = {f"c{k}": set(rng.sample(items, rng.randint(1, 9))) for k in range(6)} | {"odd": {"elsewhere"}}
    uses = spark.createDataFrame([(k, i) for k, s in records.items() for i in s] * 2, "key string, item string")
    known = spark.createDataFrame([(k, len(s) >= 2) for k, s in records.items()], "key string, is_recipe boolean")
    own = spark.createDataFrame([(c, i) for c, s in pantries.items() for i in s], "pantry_id string, item string")
    for most, limit in ((3, 5), (1, 4), (0, 20)):
        expected = []
        for c, has in pantries.items():
            lacking = sorted((len(s - has), -len(s), k) for k, s in records.items() if len(s) >= 2 and len(s - has) <= most)
            expected += [(c, k, -n, m, place, tuple(sorted(records[k] - has))) for place, (m, n, k) in enumerate(lacking[:limit], 1)]
        got = [(r.pantry_id, r.key, r.n_needed, r.n_missing, r.place, tuple(r.missing)) for r in G.pantry_gap(own, known, uses, most, limit).collect()]
        assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("mode", ["any", "all"])
def test_filter_recipes(spark, mode):
    rng = random.Random(7)
    items = [f"i{k}" for k in range(9)]
    family = {i: ("meat", "fish", "none")[k % 3] for k, i in enumerate(items)}
    records = {f"r{k:02}": (rng.choice(["main", "soup"]), set(rng.sample(items, rng.randint(1, 6)))) for k in range(50)}
    asked = [(f"q{k}", rng.choice([None, "", "main"]), rng.sample([*items, "unknown"], rng.randint(0, 3)), rng.sample([*items, "unknown"], rng.randint(0, 2)), rng.choice([[], ["fish"], ["none", ""]])) for k in range(40)]
    q = spark.createDataFrame(asked, "query_id string, course string, include array<string>, exclude array<string>, exclude_categories array<string>")
    recipes = spark.createDataFrame([(k, c, len(s) >= 2) for k, (c, s) in records.items()], "key string, course string, is_recipe boolean")
    uses = spark.createDataFrame([(k, i) for k, (_, s) in records.items() for i in s] * 2, "key string, item string")
    known = spark.createDataFrame(list(family.items()), "item string, category string")
    expected = set()
    for name, course, include, exclude, families in asked:
        want = [i for i in include if i in family]
        for key, (of, s) in records.items():
            has = (any if mode == "any" else all)(i in s for i in want) if want else not include
            bad = any(i in exclude or (family[i] in families and family[i] != "none") for i in s)
            if len(s) >= 2 and (not course or course == of) and has and not bad:
                expected.add((name, key))
    got = G.filter_recipes(q, recipes, uses, known, mode).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_containing_all_of_nothing(spark):
    wanted = spark.createDataFrame([], "query_id long, item string")
    edges = spark.createDataFrame([("a", "x")], "key string, item string")
    assert containing_all(wanted, edges).collect() == []


def test_automaton(spark, monkeypatch):
    from rankweave.operators import automaton

    monkeypatch.setattr(automaton, "BATCH_CHARS", 60)  # several batches
    monkeypatch.setattr(automaton, "PACK_CHARS", 50)
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("ab é\n", k=rng.randint(0, 60)))) for k in range(40)] + [(90, None), (91, ""), (92, "x" * 70_000 + "end"), (92, "ab")]
    atoms = ["", "a", "ab", "aba", "é b", "\n", "end", "xxend", "never", None, "b\n", "ab"]
    got = contained(spark.createDataFrame(texts, "id long, text string"), "id", spark.createDataFrame([(a,) for a in atoms], "atom string")).collect()
    expected = [(k, a) for k, t in texts if t is not None for a in {*atoms} - {None} if a in t]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_relevance_needs_the_whole_item(spark):
    item = "A long item whose first sixty characters are common to two texts, and its end is not."
    docs = spark.createDataFrame([(1, item[:70]), (2, "before " + item + " after")], "passage_id long, text string")
    got = E.containing(docs, "passage_id", spark.createDataFrame([(7, item)], "record_id long, atom string")).collect()
    assert [(r.passage_id, r.record_id) for r in got] == [(2, 7)]


def test_numbers_in_any_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["o:1", "o:2", "o:13", None, "z"]), k, rng.choice([None, 1, 2, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, k long, size long").repartition(5)
    got = numbered(df, F.col("key").asc_nulls_last(), "k", number="n", total="before", of="size").collect()
    before = 0
    for n, row in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1]))):
        [one] = [r for r in got if r.k == row[1]]
        assert (one.n, one.before) == (n, before)
        before += row[2] or 0
    assert numbered(df.limit(0), "k").collect() == []


@pytest.mark.parametrize("normalise", [False, True])
def test_mmr(spark, normalise):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(30, 4))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    base = {q: sorted(((float(s), p) for p, s in enumerate(rng.normal(size=30))), reverse=True) for q in (1, 2)}
    hits = spark.createDataFrame([(q, p, s, r) for q, rows in base.items() for r, (s, p) in enumerate(rows, 1)], "query_id long, passage_id long, score double, rank int")
    passages = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "passage_id long, vec array<double>")
    expected = {}
    for q, rows in base.items():
        pool = rows[:12]
        low, high = min(s for s, _ in pool), max(s for s, _ in pool)
        worth = {p: (s - low) / (high - low) if normalise else s for s, p in pool}
        chosen = []
        while len(chosen) < 6:
            gain = lambda p: 0.6 * worth[p] - 0.4 * max((float(vecs[p] @ vecs[c]) for c in chosen), default=0)  # noqa: B023, E731
            chosen.append(max((p for p in worth if p not in chosen), key=gain))
        expected |= {(q, p, r): dict((p, s) for s, p in rows)[p] for r, p in enumerate(chosen, 1)}
    same(R.mmr(hits, passages, 6, pool=12, normalise=normalise), expected)
