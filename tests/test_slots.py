"""Functions of the caller: batches, failures of single rows, nulls and empty texts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankweave.functions import vectors as U


def test_encoder(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, " \n"), (4, "")], "id long, text string")
    got = {r.id: r.vec for r in U.encode(docs, "text", lambda t: np.stack([3 * t.str.len(), 4 * t.str.len()], 1)).collect()}
    assert np.allclose(got.pop(1), [0.6, 0.8]) and got == {2: [], 3: [], 4: []}
    plain = {r.id: r.vec for r in U.encode(docs, "text").collect()}
    assert len(plain[1]) == 64 and abs(sum(x * x for x in plain[1]) - 1) < 1e-9 and plain[2] == plain[3] == plain[4] == []


def test_scorer_that_fails_on_some_rows(spark):
    def score(q: pd.Series, p: pd.Series) -> pd.Series:
        if p.str.contains("bad").any():
            raise ValueError("no")
        return p.str.len() / q.str.len()

    df = spark.createDataFrame([(1, "ab", "abcd"), (2, "ab", "bad"), (3, "a", "xyz")], "id long, q string, p string").coalesce(1)
    assert {r.id: r.s for r in df.select("id", U.pair_scorer(score)("q", "p").alias("s")).collect()} == {1: 2.0, 2: None, 3: 3.0}


def test_completer_and_judge_that_fail(spark):
    def complete(prompt: str) -> str:
        return prompt[:: 1 // len(prompt)] if not prompt else prompt[::-1]

    df = spark.createDataFrame([(1, "abc", ["a", "b"]), (2, "", []), (3, None, ["a"])], "id long, t string, c array<string>")
    assert {r.id: r.a for r in df.select("id", U.completer(complete)("t").alias("a")).collect()} == {1: "cba", 2: None, 3: None}
    judged = U.judge(lambda q, a, c: len(a) / len(c))
    assert {r.id: r.a for r in df.select("id", judged(F.lit("q"), "t", "c").alias("a")).collect()} == {1: 1.5, 2: None, 3: None}


def test_chunks_in_a_lateral_join(spark):
    def split(text: str) -> list[tuple[int, int]]:
        if "bad" in text:
            raise ValueError("no")
        return [(k, k + 3) for k in range(0, len(text), 3)]

    spark.udtf.register("threes", U.chunk_table(split))
    docs = spark.createDataFrame([(1, "abcdé😀g"), (2, None), (3, ""), (4, "bad text")], "id long, whole string")
    got = spark.sql("SELECT id, c.chunk_no, c.text FROM {docs}, LATERAL threes(whole) c", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "abc"), (1, 1, "dé😀"), (1, 2, "g")]
    kept = spark.sql("SELECT id, c.chunk_no FROM {docs} LEFT JOIN LATERAL threes(whole) c ON true", docs=docs).collect()
    assert sorted({r.id for r in kept}) == [1, 2, 3, 4]
