"""Findings of round 3 about rankings by words: what is saved and shuffled follows the input, packed."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rankweave.operators import blocks as B
from rankweave.operators import retrieve as R


def odd_texts(seed, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choices("ab9_ Z.é\u0000ñ\n字", k=rng.randint(0, 25))) for _ in range(n)] + ["", "ab", "cd", "é", "a", "x" * 3000]


def test_words_are_runs_of_bytes():
    """Words found in the bytes of many texts are those of the regular expressions; none goes over the end of a text."""
    texts = [t.lower() for t in odd_texts(1)]
    for low in (0, 7):
        given = pa.array(texts).slice(low)
        for more, least, pattern in ((b"", 1, "[a-z0-9]+"), (b"_", 2, "[a-z0-9_][a-z0-9_]+")):
            words, of = B._runs(given, more, least)
            assert list(zip(of.tolist(), words.to_pylist(), strict=True)) == [(k, w) for k, t in enumerate(texts[low:]) for w in re.findall(pattern, t)]


def test_hashes_of_grams():
    """Equal n-grams have equal hashes, others have others, in whatever text they are."""
    texts = [t.lower() for t in odd_texts(2)] + ["one two one two three", "two three one"]
    found, of = B._grams(pa.array(texts), 3)
    got = {k: Counter(found[of == k].tolist()) for k in range(len(texts))}
    names, want = {}, {}
    for k, t in enumerate(texts):
        w = re.findall("[a-z0-9_][a-z0-9_]+", t)
        want[k] = Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    for k in want:
        assert sorted(got[k].values()) == sorted(want[k].values())
    for n in (1, 2, 3):
        one, _ = B._grams(pa.array(["one two three"]), n)
        names |= dict(zip(["one", "two", "three", "one two", "two three", "one two three"], one.tolist(), strict=False))
    assert len(set(names.values())) == 6 and got[len(texts) - 2][names["one two"]] == 2 and got[len(texts) - 1][names["two three"]] == 1


def test_frequencies_of_packed_blocks(spark, monkeypatch):
    """Each term of a block meets its frequency in its range of hashes; what is shuffled are ranges of blocks, not terms."""
    monkeypatch.setattr(B, "RANGE_TERMS", 40)
    monkeypatch.setattr(B, "PASSAGE_BLOCK", 9)
    texts = odd_texts(3, 90)
    p = spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string").withColumn("label", F.lit(None).cast("int")).repartition(3)
    raw = R.saved(B.gram_blocks(p, 2).withColumn("block", F.monotonically_increasing_id()))
    total = raw.agg(F.sum(F.length("terms") / 8).cast("long")).first()[0]
    df = Counter(g for t in texts for g in set(B._grams(pa.array([t.lower()]), 2)[0].tolist()))
    out = B.block_frequencies(raw, total)
    rows = {r.block: r.dfs for r in out.collect()}
    assert max(len(x) for x in rows.values()) > 1 and "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in raw.collect():
        terms = np.frombuffer(r.terms, np.int64).tolist()
        got = [x for part in rows.get(r.block, []) for x in B._of_bytes(bytes(part.dfs)).tolist()]
        assert got == [df[t] for t in terms] and terms == sorted(set(terms))


def test_postings_of_asked_terms_only(spark, monkeypatch):
    """An index for one set of questions has the postings of their terms only; lengths, sizes and frequencies are of all."""
    p = spark.createDataFrame([(k, f"rice beans word{k} and other{k} words{k % 3}") for k in range(40)], "passage_id long, text string")
    q = spark.createDataFrame([(1, "rice beans"), (2, "unseen word7")], "query_id long, text string")
    for ranker, name in ((R.bm25_topk, "bm25_index"), (R.tfidf_topk, "tfidf_index")):
        plain, kept = getattr(R, name), []
        whole = plain(p)
        want = [tuple(r) for r in ranker(q, p, 5, index=whole).orderBy("query_id", "rank").collect()]
        monkeypatch.setattr(R, name, lambda *a, plain=plain, kept=kept: kept.append(plain(*a)) or kept[-1])
        assert [tuple(r) for r in ranker(q, p, 5).orderBy("query_id", "rank").collect()] == want
        met = {t for r in kept[0].blocks.collect() for t in r.terms}
        assert 3 <= len(met) <= 4 and whole.blocks.agg(F.max(F.size("terms"))).first()[0] > 4
        monkeypatch.setattr(R, "ASKED_TERMS", 1)  # too many: all terms
        assert [tuple(r) for r in ranker(q, p, 5).orderBy("query_id", "rank").collect()] == want
        monkeypatch.undo()


def test_question_blocks_keep_their_hits(spark, monkeypatch):
    """However many blocks of questions there are, a task gives the k best of each question once; a block's step gives no more than k of each."""
    monkeypatch.setattr(B, "PASSAGE_BLOCK", 5)
    monkeypatch.setattr(B, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    p = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(rng.normal(size=(80, 4)))], "passage_id long, vec array<double>, label int").repartition(2)
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(24, 4)))], "query_id long, vec array<double>")
    entries = q.select("query_id", F.lit(None).cast("array<long>").alias("permits"), "vec")
    hits = B.best_hits(B.question_blocks(entries, 24), B.vector_blocks(p), 3, "vectors", True, ("bigint", "bigint"))
    assert hits.count() == 2 * 24 * 3
    asked = B._Vectors(pa.array([{"query_id": r.query_id, "permits": [1, 4][r.query_id % 2 : r.query_id % 2 + 1], "vec": r.vec} for r in q.collect()], pa.struct([("query_id", pa.int64()), ("permits", pa.list_(pa.int64())), ("vec", pa.list_(pa.float64()))])))
    rows = p.collect()
    batch = pa.RecordBatch.from_pydict({"ids": [[r.passage_id for r in rows]], "labels": [[r.label for r in rows]], "vecs": [[x for r in rows for x in r.vec]]})
    monkeypatch.setattr(B, "VECTOR_STEP", 7)
    question, place, score = asked.scores(batch, 0, B._Best(24, 3, None))
    want = {(k, n) for k in range(24) for n in sorted((n for n, r in enumerate(rows) if r.label == (0, 2)[k % 2]), key=lambda n: -np.dot(asked.matrix[k], rows[n].vec))[:3]}
    assert set(zip(question.tolist(), place.tolist(), strict=True)) == want and len(score) == len(want)


def test_trace_ranks_once(spark, sf):
    """What is traced is of one saved ranking; no grid is left in the plan of the trace."""
    from rankweave.plans.answers import r11_gate_trace

    assert "MapInArrow" not in r11_gate_trace(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
