"""Ranking passages for a batch of questions. Hits are (query_id, passage_id, score, rank); ties go by passage_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.saved import saved
from rankweave.functions.vectors import token_f1
from rankweave.operators.blocks import ASKED_TERMS, BROADCAST_ENTRIES, PLACES, best_hits, block_frequencies, finished, finished_cosines, gram_blocks, grams, question_blocks, spread, vector_blocks, word_blocks


def ranked(scored: DataFrame, k: int | None, ties: str = "passage_id", places: int | None = None) -> DataFrame:
    """Hits by score, to so many places if given, so that sums in another order tie; the k best of each question."""
    score = F.col("score") if places is None else F.round("score", places)
    order = Window.partitionBy("query_id").orderBy(score.desc(), ties)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


@dataclass(frozen=True)
class WordIndex:
    """Passages as inverted blocks with impacts, and the document frequency of each term; saved, to be used again."""

    blocks: DataFrame
    df: DataFrame
    n: int


def _labelled(passages: DataFrame) -> DataFrame:
    return passages if "label" in passages.columns else passages.withColumn("label", F.lit(None).cast("int"))


def _frequencies(blocks: DataFrame, terms: str = "terms", counts: str = "counts") -> DataFrame:
    """(term, df) over inverted blocks: one row for each term of a block, not for each posting."""
    one = blocks.select(F.explode(F.arrays_zip(F.col(terms).alias("term"), F.col(counts).alias("n"))).alias("t"))
    return one.groupBy(F.col("t.term").alias("term")).agg(F.sum("t.n").alias("df"))


def bm25_index(passages: DataFrame, k1: float = 1.5, b: float = 0.75, asked: DataFrame | None = None) -> WordIndex:
    """An index of passages(passage_id, text[, label]) for BM25; jobs run at once. A label is a small number, or null.

    With asked(term), and not too many of them, it has the postings of these terms only; frequencies are always of all terms.
    """
    raw = saved(word_blocks(spread(_labelled(passages).select("passage_id", "label", "text")), _few(asked)))
    n, total = raw.agg(F.sum(F.size("ids")), F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()
    mean = (total or 0) / (n or 1) or 1.0
    return WordIndex(saved(finished(raw, lambda tf, size: tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)))), saved(_frequencies(raw, "all_terms", "all_counts")), n or 0)


def _few(asked: DataFrame | None) -> list | None:
    """The asked terms, at most ASKED_TERMS; none if there are more, or if all terms count."""
    if asked is None:
        return None
    found = [r.term for r in asked.select("term").distinct().limit(ASKED_TERMS + 1).collect()]
    return found if len(found) <= ASKED_TERMS else None


def _asking(queries: DataFrame, text: str) -> DataFrame:
    """(query_id, permits, text); queries may have permits, bits of the labels that a hit may have, array<long>."""
    permits = F.col("permits") if "permits" in queries.columns else F.lit(None).cast("array<long>")
    return queries.select("query_id", permits.alias("permits"), text)


def _terms_of(queries: DataFrame, terms: Column) -> DataFrame:
    """(query_id, permits, term, tf)."""
    return queries.select("query_id", "permits", F.explode(terms).alias("term")).groupBy("query_id", "permits", "term").agg(F.count("*").alias("tf"))


def _query_terms(queries: DataFrame, terms: Column) -> DataFrame:
    return _terms_of(_asking(queries, "text"), terms)


def _asked(queries: DataFrame, weighted: DataFrame, index: WordIndex, k: int | None, allowed: DataFrame | None) -> DataFrame:
    """Hits of weighted(query_id, permits, term, weight) in an index, each task's k best ranked again."""
    weighted = saved(weighted)
    n, entries = weighted.agg(F.count_distinct("query_id"), F.count("*")).first()
    asked, blocks = question_blocks(weighted, n), index.blocks
    kinds = dict(queries.dtypes)["query_id"], blocks.schema["ids"].dataType.elementType.simpleString()
    pairs = None
    if allowed is not None:
        asked = saved(asked)
        blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()))
        pairs = _pairs(allowed, asked, blocks)
    return ranked(best_hits(asked, blocks, k, "words", entries <= BROADCAST_ENTRIES, kinds, pairs), k, places=PLACES)


def _pairs(allowed: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qblock, block, pairs) of allowed(query_id, passage_id): a pair of blocks has few pairs of rows by its size."""
    questions = asked.select("qblock", F.explode(F.array_distinct("entries.query_id")).alias("query_id"))
    places = blocks.select("block", F.explode("ids").alias("passage_id"))
    met = allowed.select("query_id", "passage_id").join(questions, "query_id").join(places, "passage_id")
    return met.groupBy("qblock", "block").agg(F.collect_set(F.struct("query_id", "passage_id")).alias("pairs"))


def _padded(hits: DataFrame, queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """hits with passages of score 0, lowest ids first, up to k for each question."""
    low = passages.select("passage_id").distinct().orderBy("passage_id").limit(2 * k).agg(F.collect_list("passage_id").alias("low"))
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(low)).select("query_id", F.explode("low").alias("passage_id"))  # low is one row
    zero = zero.join(hits.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(hits.select("query_id", "passage_id", "score").unionByName(zero.select("query_id", "passage_id", "score")), k, places=PLACES)


def bm25_topk(queries: DataFrame, passages: DataFrame, k: int | None, k1: float = 1.5, b: float = 0.75, pad_zero: bool = False, index: WordIndex | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Okapi BM25 of queries(query_id, text[, permits]); jobs run at once. Statistics are the corpus's, whatever is permitted.

    A term that more than half of the passages have would count negatively; it counts a quarter of
    the mean idf of all terms instead. A query's repeated terms count repeatedly. Permitted hits are those whose label's
    bit is set in permits (all, where either is null), and those in allowed(query_id, passage_id). An index is built of
    passages unless given (bm25_index, with the same k1 and b). Passages without a common term are no hits.
    """
    asked = saved(_query_terms(queries, words(F.col("text"))))
    index = index or bm25_index(passages, k1, b, asked)
    raw = index.df.withColumn("raw", F.log(index.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = raw.select("term", F.when(F.col("raw") < 0, 0.25 * mean).otherwise(F.col("raw")).alias("idf"))
    weighted = asked.join(idf, "term").select("query_id", "permits", "term", (F.col("tf") * F.col("idf")).alias("weight"))
    hits = _asked(queries, weighted, index, k, allowed)
    return _padded(hits, queries, passages, k) if pad_zero else hits


def tfidf_index(passages: DataFrame, ngram_max: int = 2, min_df: int = 1, asked: DataFrame | None = None) -> WordIndex:
    """An index of passages(passage_id, text[, label]) for tf-idf cosines; jobs run at once. Terms are 64-bit hashes of n-grams.

    A passage's length needs the idf of all its terms: each term of a block meets its frequency once, however
    many passages of the block have it. With asked(term), and not too many of them, postings and frequencies of these terms
    only are kept; lengths are always of all terms.
    """
    p = spread(_labelled(passages).select("passage_id", "label", "text"))
    raw = saved(gram_blocks(p, ngram_max, _few(asked)).withColumn("block", F.monotonically_increasing_id()))
    n, total = raw.agg(F.sum(F.size("ids")), F.sum(F.length("terms") / 8).cast("long")).first()
    with_dfs = raw.drop("terms").join(block_frequencies(raw, total or 0), "block", "left")
    blocks = saved(finished_cosines(with_dfs, n or 0, min_df))
    return WordIndex(blocks, saved(_frequencies(blocks).where(F.col("df") >= min_df)), n or 0)


def _smoothed(n: int) -> Column:
    return F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1


def tfidf_topk(queries: DataFrame, passages: DataFrame, k: int | None, ngram_max: int = 2, min_df: int = 1, pad_zero: bool = False, index: WordIndex | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Cosine of tf-idf vectors with 1 + ln tf and smoothed idf; jobs run at once. Permitted hits and index as in bm25_topk()."""
    asked = saved(_terms_of(grams(_asking(queries, "text"), ngram_max), F.col("terms")))
    index = index or tfidf_index(passages, ngram_max, min_df, asked)
    idf = index.df.select("term", _smoothed(index.n).alias("idf"))
    w = (1 + F.log("tf")) * F.col("idf")
    q = asked.join(idf, "term").select("query_id", "permits", "term", "idf", w.alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    weighted = q.select("query_id", "permits", "term", (F.col("w") / length * F.col("idf")).alias("weight"))
    hits = _asked(queries, weighted, index, k, allowed)
    return _padded(hits, queries, passages, k) if pad_zero else hits


def dense_topk(queries: DataFrame, passages: DataFrame, k: int | None, allowed: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Exact inner products of queries(query_id, vec[, permits]) with passages(passage_id, vec[, label]); a count runs at once.

    Blocks of questions meet blocks of passages; each task keeps the best k for each question, so what is
    shuffled is tasks * questions * k rows. Permitted hits are as in bm25_topk(). blocks are saved
    vector_blocks() of the passages, to use them again. A question has one vector; all have one length.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(passages.dtypes)["passage_id"]
    permits = F.col("permits") if "permits" in queries.columns else F.lit(None).cast("array<long>")
    entries = queries.select("query_id", permits.alias("permits"), "vec")
    n, numbers = entries.agg(F.count("*"), F.sum(F.size("vec"))).first()
    asked = question_blocks(entries, n)
    blocks, pairs = vector_blocks(_labelled(passages)) if blocks is None else blocks, None
    if allowed is not None:
        blocks, asked = saved(blocks.withColumn("block", F.monotonically_increasing_id())), saved(asked)
        pairs = _pairs(allowed, asked, blocks)
    return ranked(best_hits(asked, blocks, k, "vectors", (numbers or 0) <= BROADCAST_ENTRIES, kinds, pairs), k)


def _pool(hits: DataFrame, pool: int | None) -> DataFrame:
    return hits if pool is None else hits.where(F.col("rank") <= pool)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int | None, alpha: float = 0.5, pool: int | None = 50) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each scaled to 0..1 over its question's pool; a list of equal scores is all 1, a missing side 0."""

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        h, of = _pool(hits, pool), Window.partitionBy("query_id")
        low, high = F.min("score").over(of), F.max("score").over(of)
        return h.select("query_id", "passage_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), ["query_id", "passage_id"], "full_outer")
    score = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return ranked(both.select("query_id", "passage_id", score.alias("score")), k)


def rrf(lists: list[DataFrame], k: int | None, c: int = 60, pool: int | None = 50) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (c + rank)."""
    every = [_pool(x, pool).select("query_id", "passage_id", "rank") for x in lists]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return ranked(out.groupBy("query_id", "passage_id").agg(F.sum(1.0 / (c + F.col("rank"))).alias("score")), k)


def mmr(candidates: DataFrame, vectors: DataFrame, k: int, weight: float = 0.6, pool: int = 40, normalise: bool = False) -> DataFrame:
    """Greedy choice by weight * score - (1 - weight) * closeness to what is chosen; hits keep the base score. It chooses of pool hits, or of k if that is more."""
    top = candidates.where(F.col("rank") <= max(pool, k)).join(vectors.select("passage_id", "vec"), "passage_id")
    kinds = dict(candidates.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank").reset_index(drop=True)
        v = np.stack(part["vec"].map(lambda x: np.asarray(x, float)))
        base = part["score"].to_numpy(float)
        worth = base
        if normalise:
            worth = (base - base.min()) / (base.max() - base.min()) if base.max() > base.min() else np.ones(len(base))
        near, chosen, left = np.zeros(len(part)), [], list(range(len(part)))
        while left and len(chosen) < k:
            value = weight * worth[left] - (1 - weight) * near[left]
            pick = left.pop(int(np.argmax(value)))
            close = v @ v[pick]
            near = close if not chosen else np.maximum(near, close)
            chosen.append(pick)
        return pd.DataFrame({"query_id": part["query_id"].iloc[chosen].to_numpy(), "passage_id": part["passage_id"].iloc[chosen].to_numpy(), "score": base[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return top.select("query_id", "passage_id", "score", "rank", "vec").groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, passage_id {kinds['passage_id']}, score double, rank int")


def rerank(candidates: DataFrame, queries: DataFrame, passages: DataFrame, k: int, pool: int = 20, scorer: Callable[[Column, Column], Column] = token_f1) -> DataFrame:
    """The shortlist, scored anew by scorer(question, passage)."""
    top = candidates.where(F.col("rank") <= pool).select("query_id", "passage_id")
    pairs = top.join(passages.select("passage_id", F.col("text").alias("_p")), "passage_id").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return ranked(pairs.select("query_id", "passage_id", scorer(F.col("_q"), F.col("_p")).alias("score")), k)


def merge_queries(hits: DataFrame, variants: DataFrame, k: int) -> DataFrame:
    """hits of variants(query_id of the variant, of) -> hits of the questions `of`: a passage's best score."""
    joined = hits.join(variants.select("query_id", "of"), "query_id")
    return ranked(joined.groupBy(F.col("of").alias("query_id"), "passage_id").agg(F.max("score").alias("score")), k)


def allowed_passages(allowed: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id): passages(passage_id, keys) of which any record is in allowed(query_id, key)."""
    return passages.select("passage_id", F.explode("keys").alias("key")).join(allowed, "key").select("query_id", "passage_id").distinct()


def gate(hits: DataFrame, restricted: DataFrame, permitted: DataFrame, k: int, keys: DataFrame | None = None) -> DataFrame:
    """hits of unrestricted questions as they are; of restricted(query_id) only permitted ones, numbered again in their order.

    permitted has (query_id, passage_id) or, with keys(passage_id, key), (query_id, key): a hit is
    permitted if any of its keys is. Only hits are joined, never all permitted pairs. To gate before ranking, give
    the retriever labels and permits, or pairs as `allowed`.
    """
    r = restricted.select("query_id").distinct()
    free = hits.join(r, "query_id", "left_anti").where(F.col("rank") <= k).select("query_id", "passage_id", "score", "rank")
    held = hits.join(r, "query_id", "left_semi").select("query_id", "passage_id", "score", "rank")
    if keys is None:
        held = held.join(permitted, ["query_id", "passage_id"], "left_semi")
    else:
        held = held.join(keys.select("passage_id", "key"), "passage_id").join(permitted, ["query_id", "key"], "left_semi").drop("key").distinct()
    order = Window.partitionBy("query_id").orderBy("rank", "passage_id")
    return free.unionByName(held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def gate_trace(questions: DataFrame, restricted: DataFrame, allowed: DataFrame, pool: DataFrame, survived: DataFrame) -> DataFrame:
    """For each question: was it filtered, how many records are allowed, how many hits there were and are, and why."""
    count = lambda d, name: d.groupBy("query_id").agg(F.count("*").alias(name))
    t = questions.select("query_id").join(restricted.select("query_id").distinct().withColumn("filtered", F.lit(True)), "query_id", "left")
    for d, name in ((allowed, "n_allowed"), (pool, "n_pool"), (survived, "n_survived")):
        t = t.join(count(d, name), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    t = t.withColumn("filtered", F.coalesce("filtered", F.lit(False)))
    reason = F.when(~F.col("filtered"), "no exclusion").when(F.col("n_allowed") == 0, "nothing allowed").when(F.col("n_survived") == 0, "nothing ranked is allowed").otherwise("filtered")
    return t.withColumn("reason", reason)


def graph_only(members: DataFrame, questions: DataFrame, cards: DataFrame, k: int, order: str = "overlap") -> DataFrame:
    """Hits without ranking by text: members(query_id, key), ordered by how many include terms a card names literally, then fewer items, then key; score 1 / rank."""
    m = members.join(questions.select("query_id", F.coalesce("include", F.array().cast("array<string>")).alias("include")), "query_id").join(cards.select("key", "title", "items"), "key")
    m = m.withColumn("overlap", F.size(F.array_intersect("include", "items")) if order == "overlap" else F.lit(0))
    w = Window.partitionBy("query_id").orderBy(*([F.desc("overlap"), F.size("items")] if order == "overlap" else []), "key")
    m = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    text = F.concat_ws("\n", "title", F.array_join(F.transform("items", lambda x: F.concat(F.lit("- "), x)), "\n"))
    return m.select("query_id", F.col("key").alias("passage_id"), (1.0 / F.col("rank")).alias("score"), "rank", text.alias("text"))


@dataclass(frozen=True)
class Pipeline:
    """A configuration: a source of candidates, and what is wrapped around it from inside to outside."""

    source: str = "rrf"
    use_mmr: bool = False
    use_rerank: bool = False
    use_gate: bool = False
    k: int = 5
    pool: int = 50

    @property
    def label(self) -> str:
        return "+".join([self.source, *("mmr",) * self.use_mmr, *("rerank",) * self.use_rerank, *("graph",) * self.use_gate])


def compose(p: Pipeline, queries: DataFrame, passages: DataFrame, restricted: DataFrame | None = None, permitted: DataFrame | None = None, gate_at: str = "pre", scorer: Callable = token_f1) -> DataFrame:
    """One plan: source, then MMR, rerank and gate. queries(query_id, text, vec), passages(passage_id, text, vec).

    MMR chooses the pool that reranking works on out of twice as many hits; reranking sees no order, only what is in its pool.
    gate_at "pre" lets restricted questions rank permitted passages only; "post" ranks all first and gates
    every hit of the source, or the whole pool that MMR or reranking work on.
    """
    if p.use_gate and gate_at == "pre":
        limited = restricted.select("query_id").distinct()
        free, held = queries.join(limited, "query_id", "left_anti"), queries.join(limited, "query_id", "left_semi")
        return _composed(p, free, passages, None, scorer).unionByName(_composed(p, held, passages, permitted, scorer))
    hits = _composed(p, queries, passages, None, scorer, whole=p.use_gate)
    return gate(hits, restricted, permitted, p.k) if p.use_gate else hits


def _composed(p: Pipeline, queries: DataFrame, passages: DataFrame, allowed: DataFrame | None, scorer: Callable, whole: bool = False) -> DataFrame:
    """The pipeline without its gate; whole leaves out the cut to k."""
    shortlist = p.use_mmr or p.use_rerank
    n = 2 * p.pool if p.use_mmr and p.use_rerank else p.pool if shortlist else None if whole else p.k
    k = p.pool if whole else p.k
    deep = None if n is None else max(n, p.pool)
    lists: dict[str, Callable[[], DataFrame]] = {
        "dense": lambda: dense_topk(queries, passages, deep, allowed), "bm25": lambda: bm25_topk(queries, passages, deep, allowed=allowed),
        "tfidf": lambda: tfidf_topk(queries, passages, deep, allowed=allowed),
    }
    if p.source in lists:
        hits = _pool(lists[p.source](), n)
    elif p.source == "rrf":
        hits = rrf([lists["dense"](), lists["bm25"]()], n, pool=deep)
    else:
        hits = hybrid(lists["dense"](), lists["bm25"](), n, pool=deep)
    if p.use_mmr:
        hits = mmr(hits, passages, p.pool, pool=n) if p.use_rerank else mmr(hits, passages, k)
    return rerank(hits, queries, passages, k, pool=p.pool, scorer=scorer) if p.use_rerank else hits
