"""The slots that a caller fills, with functions that SQL can express too."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rankweave.functions import vectors as U
from rankweave.plans.register import Plans
from rankweave.plans.standins import passages, table

plans = Plans()


def lengths(texts: pd.Series) -> np.ndarray:
    """An encoder: three for each character, and four."""
    n = texts.str.len().to_numpy(float)
    return np.stack([3 * n, 4 * n], 1)


@plans("SELECT doc_id AS passage_id, CASE WHEN regexp_matches(text, '[^\\s]') THEN [0.6, 0.8] ELSE [] END::DOUBLE[] AS vec FROM documents")
def u01_encode(spark, d):
    out = U.encode(passages(spark, d), "text", lengths)
    return out.select("passage_id", F.transform("vec", lambda x: F.round(x, 9)).alias("vec"))


def closeness(question: pd.Series, passage: pd.Series) -> pd.Series:
    """A scorer that fails on a batch with a text of over 2,000 characters."""
    if (passage.str.len() > 2000).any():
        raise ValueError("too long")
    return 1 / (1 + (question.str.len() - passage.str.len()).abs())


@plans("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN round(1.0 / (1 + abs(length(source) - length(text))), 9) END AS score FROM documents WHERE text IS NOT NULL")
def u02_pair_scorer(spark, d):
    """Each document with its source's name; long ones fail by themselves."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.round(U.pair_scorer(closeness)(F.col("source"), F.col("text")), 9).alias("score"))


def shout(prompt: str) -> str:
    """A model that refuses long prompts."""
    if len(prompt) > 1000:
        raise ValueError("too long")
    return prompt[:20].upper()


@plans("SELECT conv_id, turn, CASE WHEN length(text) <= 1000 THEN md5(upper(translate(left(text, 20), 'ß', 's'))) END AS digest FROM conversations")
def u03_completer(spark, d):
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", F.md5(U.completer(shout)(F.translate("text", "ß", "s"))).alias("digest"))


def halves(text: str) -> list[tuple[int, int]]:
    """Stretches of 500 characters."""
    return [(k, min(k + 500, len(text))) for k in range(0, len(text), 500)]


@plans("""SELECT doc_id, chunk_no::INT AS chunk_no, (chunk_no * 500)::INT AS "start", least(chunk_no * 500 + 500, length(text))::INT AS "end", md5(substr(text, chunk_no::BIGINT * 500 + 1, 500)) AS digest
FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 500.0)::BIGINT)) AS chunk_no FROM documents)""")
def u04_chunk_table(spark, d):
    """Chunks of all documents by a lateral join with a table function."""
    name = f"chunks_{uuid.uuid4().hex}"
    spark.udtf.register(name, U.chunk_table(halves))
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("whole"))
    return spark.sql(f"SELECT doc_id, c.chunk_no, c.start, c.end, md5(c.text) AS digest FROM {{docs}}, LATERAL {name}(whole) c", docs=docs)


def share(question: str, answer: str, contexts: list[str]) -> float:
    """A judge: the share of contexts that are as long as the answer; without contexts it fails."""
    return sum(len(c) >= len(answer) for c in contexts) / len(contexts)


@plans("""WITH c AS (SELECT conv_id, list(text) FILTER (role = 'user') AS asked, arg_max(text, turn) FILTER (role = 'assistant') AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CASE WHEN answer IS NOT NULL AND len(asked) > 0 THEN round(len(list_filter(asked, lambda x: length(x) >= length(answer))) / len(asked), 9) END AS score FROM c""")
def u05_judge(spark, d):
    t = table(spark, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "user", F.col("text"))).alias("asked"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))
    return t.select("conv_id", F.round(U.judge(share)(F.lit("q"), F.col("answer"), F.col("asked")), 9).alias("score"))
