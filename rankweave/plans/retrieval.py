"""Queries of the retrieval operators: benchmark texts as questions over the documents, and embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions.vectors import hashed_vectors
from rankweave.operators import evaluate as E
from rankweave.operators import retrieve as R
from rankweave.plans.register import Plans
from rankweave.plans.standins import passages, questions, table, with_

plans = Plans()
BM25 = with_("words", "post", "qt", "len", "idf0", "idf", "bm", "bm25")
TFIDF = with_("gram", "tw", "norm", "tf", "tfidf")
BOTH = with_("words", "post", "qt", "len", "idf0", "idf", "bm", "bm25", "gram", "tw", "norm", "tf", "tfidf")
RELEVANT = "rel AS (SELECT b.item_id AS query_id, d.doc_id AS passage_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
ROUNDED = "SELECT query_id, passage_id, round(round(score, 9), 5) AS score, rank FROM "


def rounded(hits):
    return hits.select("query_id", "passage_id", F.round(F.round("score", 9), 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def stable(hits):
    """Scores to nine places, so that sums in another order rank alike."""
    return hits.withColumn("score", F.round("score", 9))


def vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "passage_id")


def relevant(spark, d):
    """(query_id, passage_id): documents that contain a whole benchmark text."""
    golden = questions(spark, d).select(F.col("query_id").alias("record_id"), F.col("text").alias("atom"))
    return E.containing(passages(spark, d), "passage_id", golden).select(F.col("record_id").alias("query_id"), "passage_id").distinct()


def toxic(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("passage_id")).distinct()


@plans(BM25 + ", " + RELEVANT + """, ok AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM bm25 WHERE passage_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
n AS (SELECT query_id FROM rel GROUP BY 1), h AS (SELECT DISTINCT query_id FROM ok JOIN rel USING (query_id, passage_id) WHERE rank <= 5)
SELECT count(*) AS n_questions, round(avg(CASE WHEN h.query_id IS NULL THEN 0 ELSE 1 END), 4) AS hit_at_5 FROM n LEFT JOIN h USING (query_id)""")
def minimum_slice(spark, d):
    """BM25 for every benchmark text, without toxic documents; the share of questions with a document that has the text."""
    bad = toxic(spark, d).select("passage_id", F.lit(1).alias("label"))
    labelled = passages(spark, d).join(bad, "passage_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    only_0 = questions(spark, d).withColumn("permits", F.array(F.lit(1).cast("long")))
    top = R.bm25_topk(only_0, labelled, 5).select("query_id", "passage_id", "score", "rank")
    rel = relevant(spark, d)
    m = E.ranking_metrics(rel.select("query_id").distinct(), top.withColumnRenamed("passage_id", "record_id"), rel.withColumnRenamed("passage_id", "record_id"))
    return m.agg(F.count("*").alias("n_questions"), F.round(F.avg("hit"), 4).alias("hit_at_5"))


@plans(BM25 + ROUNDED + "bm25 WHERE rank <= 5")
def r03_bm25_topk(spark, d):
    return rounded(R.bm25_topk(questions(spark, d), passages(spark, d), 5))


@plans(TFIDF + ROUNDED + "tfidf WHERE rank <= 5")
def r04_tfidf_topk(spark, d):
    return rounded(R.tfidf_topk(questions(spark, d), passages(spark, d), 5))


@plans(with_("dn", "dense") + ROUNDED + "dense WHERE rank <= 10")
def r02_dense_topk(spark, d):
    return rounded(R.dense_topk(*vectors(spark, d), 10))


def _lists(spark, d, n=50):
    q, p = questions(spark, d), passages(spark, d)
    return [stable(f(q, p, n)) for f in (R.bm25_topk, R.tfidf_topk)]


@plans(BOTH + """, f AS (SELECT query_id, passage_id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM bm25 WHERE rank <= 50 UNION ALL SELECT * FROM tfidf WHERE rank <= 50) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM f) """ + ROUNDED + "r WHERE rank <= 5")
def r06_rrf(spark, d):
    return rounded(R.ranked(stable(R.rrf(_lists(spark, d), 200)).drop("rank"), 5))


@plans(BOTH + """, s AS (SELECT 'a' AS l, *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM (SELECT query_id, passage_id, round(score, 9) AS score FROM bm25 WHERE rank <= 50) WINDOW w AS (PARTITION BY query_id)
UNION ALL SELECT 'b', *, min(score) OVER w, max(score) OVER w FROM (SELECT query_id, passage_id, round(score, 9) AS score FROM tfidf WHERE rank <= 50) WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT query_id, passage_id, sum(0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END) AS score FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM f) """ + ROUNDED + "r WHERE rank <= 5")
def r05_hybrid(spark, d):
    a, b = _lists(spark, d)
    return rounded(R.ranked(stable(R.hybrid(a, b, 200)).drop("rank"), 5))


@plans(with_("dn", "dense") + """, v AS (SELECT passage_id, query_id // 40 AS of_, max(score) AS score FROM dense WHERE rank <= 20 GROUP BY ALL),
r AS (SELECT of_ AS query_id, passage_id, score, row_number() OVER (PARTITION BY of_ ORDER BY score DESC, passage_id) AS rank FROM v) """ + ROUNDED + "r WHERE rank <= 10")
def r09_merge_queries(spark, d):
    q, p = vectors(spark, d)
    return rounded(R.merge_queries(R.dense_topk(q, p, 20), q.select("query_id", F.floor(F.col("query_id") / 40).alias("of")), 10))


@plans(with_("dn") + """, r AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM dn JOIN embeddings e ON e.vec_id = passage_id WHERE query_id % 40 = 0 OR e.label != 3) """ + ROUNDED + "r WHERE rank <= 10")
def r10_gate(spark, d):
    """Every second question excludes the vectors of label 3, before ranking."""
    q, _ = vectors(spark, d)
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vec"), "label")
    held = q.where("query_id % 40 != 0").select("query_id")
    permits = F.when(F.col("query_id") % 40 != 0, F.array(F.expr("~shiftleft(1L, 3)")))
    hits = R.dense_topk(q.withColumn("permits", permits), p, 10)
    keys = p.select("passage_id", F.col("label").alias("key"))
    permitted = held.crossJoin(F.broadcast(keys.select("key").distinct().where("key != 3")))  # questions x the few labels
    return rounded(R.gate(hits, held, permitted, 10, keys))


@plans()
def r07_mmr(spark, d):
    q, p = vectors(spark, d)
    return rounded(R.mmr(R.dense_topk(q, p, 40), p, 10))


@plans(BM25 + """, pair AS (SELECT query_id, passage_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9]+')) AS c FROM bm25 JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = passage_id WHERE rank <= 20),
s AS (SELECT query_id, passage_id, 2.0 * len(list_intersect(a, c)) / (len(a) + len(c)) AS score FROM pair), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s) """ + ROUNDED + "r WHERE rank <= 5")
def r08_rerank(spark, d):
    q, p = questions(spark, d), passages(spark, d)
    return rounded(R.rerank(R.bm25_topk(q, p, 20), q, p, 5))


@plans()
def r13_compose(spark, d):
    """Dense and BM25 fused, diversified and reranked in one plan, with hashed vectors."""
    q, p = hashed_vectors(questions(spark, d), "text"), hashed_vectors(passages(spark, d), "text")
    return rounded(R.compose(R.Pipeline("rrf", use_mmr=True, use_rerank=True, k=5, pool=20), q, p))
