"""Findings of round 4: files of written runs, and stages of a composed ranking that count."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import retrieve as R
from rankweave.sources import runs as S


def files_of(path):
    return {run.name.removeprefix("run_id="): len(list(run.glob("part-*"))) for kind in path.iterdir() if kind.is_dir() for run in kind.iterdir()}


def test_a_run_is_not_spread_over_the_tasks(spark, tmp_path):
    """Tasks that have rows of every run don't write a file for each run; a run that is written again replaces only itself."""
    path = tmp_path / "runs"
    rows = spark.range(0, 600, 1, 8).select(F.when(F.col("id") % 30 < 15, "web").otherwise("pdf").alias("source_type"), F.format_string("run_%02d", F.col("id") % 30).alias("run_id"), F.col("id").alias("record_id"))
    S.write_run(rows, str(path))
    assert files_of(path) == {f"run_{k:02}": 1 for k in range(30)}
    S.write_run(rows.where("run_id = 'run_07' AND record_id < 100").withColumn("record_id", -F.col("record_id")), str(path))
    got = spark.read.parquet(str(path)).select("source_type", "run_id", "record_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(("web" if k % 30 < 15 else "pdf", f"run_{k % 30:02}", -k if k % 30 == 7 else k) for k in range(600) if k % 30 != 7 or k < 100)
    assert files_of(path) == {f"run_{k:02}": 1 for k in range(30)}


def test_files_of_runs_do_not_follow_the_number_of_shuffle_partitions(spark, tmp_path):
    """Many runs in few shuffle partitions aren't dealt to tasks that have rows of all of them."""
    path, settings = tmp_path / "runs", {"spark.sql.shuffle.partitions": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    rows = spark.range(0, 20000, 1, 8).select(F.lit("web").alias("source_type"), F.format_string("run_%03d", F.col("id") % 200).alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        S.write_run(rows, str(path))
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert files_of(path) == {f"run_{k:03}": 1 for k in range(200)} and spark.read.parquet(str(path)).distinct().count() == 20000


def test_a_very_large_run_is_dealt_to_several_tasks(spark, tmp_path):
    path, setting = tmp_path / "runs", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(0, 40000, 1, 8).select(F.lit("web").alias("source_type"), F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("run_id"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    spark.conf.set(setting, "256k")
    try:
        S.write_run(rows, str(path))
    finally:
        spark.conf.unset(setting)
    n = files_of(path)
    assert n["large"] > 1
    assert spark.read.parquet(str(path)).groupBy("run_id").count().orderBy("run_id").collect() == [("large", 39600), ("small", 400)]


def chosen(hits, vecs, n, weight=0.6):
    """n of (score, passage), best first, by maximal marginal relevance."""
    out, left = [], list(hits)
    while left and len(out) < n:
        out.append(max(left, key=lambda h: weight * h[0] - (1 - weight) * max((float(vecs[h[1]] @ vecs[c[1]]) for c in out), default=0)))
        left.remove(out[-1])
    return out


def shared_words(a, b):
    a, b = set(re.findall("[a-z0-9]+", a)), set(re.findall("[a-z0-9]+", b))
    return 2 * len(a & b) / (len(a) + len(b))


def ranking(seed=4, n=40):
    """Vectors without ties, in close groups, and texts that have nothing to do with them."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    vecs, asked = unit(np.repeat(rng.normal(size=(n // 4, 5)), 4, axis=0) + rng.normal(scale=0.05, size=(n, 5))), unit(rng.normal(size=(6, 5)))
    words = [f"w{k}" for k in range(12)]
    texts, questions = ([" ".join(rng.choice(words, 5)) for _ in range(m)] for m in (n, 6))
    hits = [sorted(((float(v @ a), p) for p, v in enumerate(vecs)), reverse=True) for a in asked]
    return vecs, asked, texts, questions, hits


def frames(spark, vecs, asked, texts, questions):
    p = spark.createDataFrame([(k, t, v.tolist()) for k, (t, v) in enumerate(zip(texts, vecs, strict=True))], "passage_id long, text string, vec array<double>")
    return spark.createDataFrame([(k, t, v.tolist()) for k, (t, v) in enumerate(zip(questions, asked, strict=True))], "query_id long, text string, vec array<double>"), p


@pytest.mark.parametrize("pool", [6, 50])
def test_mmr_decides_what_is_reranked(spark, pool):
    """Reranking gets the hits that MMR chose out of twice as many, not the source's best in another order."""
    vecs, asked, texts, questions, hits = ranking(n=40 if pool == 6 else 160)
    q, p = frames(spark, vecs, asked, texts, questions)

    def best(of):
        scored = {k: sorted((-shared_words(questions[k], texts[d]), d) for _, d in of(h)) for k, h in enumerate(hits)}
        return {(k, d, r) for k, rows in scored.items() for r, (_, d) in enumerate(rows[:5], 1)}

    def got(use_mmr):
        return {(r.query_id, r.passage_id, r.rank) for r in R.compose(R.Pipeline("dense", use_mmr=use_mmr, use_rerank=True, k=5, pool=pool), q, p).collect()}

    diverse, plain = best(lambda h: chosen(h[: 2 * pool], vecs, pool)), best(lambda h: h[:pool])
    assert diverse != plain and got(True) == diverse and got(False) == plain


def test_a_gate_keeps_the_order_of_mmr(spark):
    """Restricted questions get the permitted hits in MMR's order, which isn't that of the scores; MMR has the whole pool."""
    vecs, asked, texts, questions, hits = ranking(n=80)
    q, p = frames(spark, vecs, asked, texts, questions)
    held, permitted = q.where("query_id < 3").select("query_id"), q.select("query_id").crossJoin(p.where("passage_id % 3 != 0").select("passage_id"))
    got = R.compose(R.Pipeline("dense", use_mmr=True, use_gate=True, k=9, pool=50), q, p, held, permitted, gate_at="post").collect()
    want = {}
    for k, h in enumerate(hits):
        order = [d for _, d in chosen(h[:50], vecs, 50) if k > 2 or d % 3 != 0]
        assert order != sorted(order, key=[d for _, d in h].index)
        want[k] = order[:9]
    assert {k: [r.passage_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == k] for k in want} == want
    assert sorted(r.rank for r in got) == sorted([*range(1, 10)] * 6)
