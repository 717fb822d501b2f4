"""Vector expressions, the hashing encoder, and slots for models that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many rows of a batch are counted at a time.
_ROWS = 512


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays; null if either is."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(a: Column) -> Column:
    """a at unit length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def hashed_vectors(df: DataFrame, text_col: str, dims: int = 64) -> DataFrame:
    """df with vec: signed counts of hashed words [a-z0-9]+ at unit length; deterministic and without weights.

    Words become cell and sign in Spark, two bytes or four each; tasks count them by batches, so a word is looked at once, whatever dims is.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kind = "smallint" if 2 * dims <= 2**15 else "int"
    cells = F.transform(F.transform(words, lambda w: F.xxhash64(w)), lambda x: (F.pmod(x, F.lit(dims)) * 2 + F.pmod(F.shiftright(x, 20), F.lit(2))).cast(kind))

    @F.arrow_udf("array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        parts = [_signed_counts(lists.slice(at, _ROWS), dims) for at in range(0, len(lists), _ROWS)]
        flat = np.concatenate(parts) if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims, dtype=np.int32)), pa.array(flat))

    return df.withColumn("vec", counted(cells))


def _signed_counts(lists: pa.ListArray, dims: int) -> np.ndarray:
    """The unit vectors of lists of 2 * cell + sign, one behind the other."""
    cells = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    v = np.bincount(row * dims + (cells >> 1), np.where(cells & 1, -1.0, 1.0), len(lists) * dims).reshape(len(lists), dims)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / np.where(norm > 0, norm, 1)).ravel()


def encode(df: DataFrame, text_col: str, encoder: Callable[[pd.Series], np.ndarray] | None = None) -> DataFrame:
    """df with vec. encoder turns texts into rows of numbers; without one, hashed_vectors(). A blank text gives an empty vector."""
    if encoder is None:
        out = hashed_vectors(df, text_col)
        return out.withColumn("vec", F.when(F.col(text_col).rlike(r"\S"), F.col("vec")).otherwise(F.array().cast("array<double>")))

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            full = (part.fillna("").str.strip() != "").to_numpy()
            out = [np.zeros(0)] * len(part)
            if full.any():
                v = np.asarray(encoder(part[full]), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for k, row in zip(np.flatnonzero(full), v / np.where(norm > 0, norm, 1), strict=True):
                    out[k] = row
            yield pd.Series(out)

    return df.withColumn("vec", run(F.col(text_col)))


def _each(batch: Callable[[], object], one: Callable[[int], object], n: int) -> pd.Series:
    """The batch's numbers at once or, if the batch fails, row by row with null for the rows that fail."""
    try:
        return pd.Series(batch(), dtype=float)
    except Exception:  # the caller's model may raise anything; a failed row is null

        def single(k: int) -> float | None:
            try:
                return float(one(k))
            except Exception:  # as above
                return None

        return pd.Series([single(k) for k in range(n)], dtype=float)


def pair_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]):
    """A scorer of (question, passage) as a column function, in batches; rows that it fails on are null."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return _each(lambda: np.asarray(score(q, p), float), lambda k: np.asarray(score(q[k : k + 1], p[k : k + 1]), float)[0], len(q))

    return run


def token_f1(question: Column, passage: Column) -> Column:
    """The built-in scorer: F1 of the distinct words of both."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    a, b = words(question), words(passage)
    return F.coalesce(2.0 * F.size(F.array_intersect(a, b)) / F.nullif(F.size(a) + F.size(b), F.lit(0)), F.lit(0.0))


def completer(complete: Callable[[str], str]):
    """A model that completes a prompt, as a column function; an error becomes null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            try:
                return None if p is None else complete(p)
            except Exception:  # the caller's model may raise anything; operators treat null as a failed call
                return None

        return prompts.map(one)

    return run


def judge(score: Callable[[str, str, list[str]], float]):
    """A judge of (question, answer, contexts), as a column function; an error becomes null."""

    @F.pandas_udf("double")
    def run(question: pd.Series, answer: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(row: tuple) -> float | None:
            try:
                return float(score(row[0], row[1], list(row[2])))
            except Exception:  # as in completer()
                return None

        return pd.Series([one(r) for r in zip(question, answer, contexts, strict=True)], dtype=float)

    return run


def chunker(split: Callable[[str], list[tuple[int, int]]]):
    """A function of one text that gives bounds, as an operator on (source, doc_id, start, text)."""
    from rankweave.operators.chunk import _chunks

    return lambda docs: _chunks(docs, split)


def chunk_table(split: Callable[[str], list[tuple[int, int]]]):
    """A function of one text that gives bounds, as a table function of (text) -> (chunk_no, start, end, text), for LATERAL joins.

    A null text, or one that split fails on, has no chunks. Register it to use it in SQL:
    spark.udtf.register("chunks", chunk_table(split)).
    """

    class Chunks:
        def eval(self, text: str):
            try:
                bounds = [] if text is None else list(split(text))
            except Exception:  # the caller's function may raise anything; a failed text has no chunks
                bounds = []
            for k, (start, end) in enumerate(bounds):
                yield k, start, end, text[start:end]

    return F.udtf(Chunks, returnType="chunk_no int, start int, end int, text string")
