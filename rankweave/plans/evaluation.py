"""Queries of the scores: benchmark texts as golden records, orders as answers to set questions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.saved import saved
from rankweave.operators import chunk as C
from rankweave.operators import evaluate as E
from rankweave.operators import graph as G
from rankweave.operators import retrieve as R
from rankweave.plans import graph as PG
from rankweave.plans.register import Plans
from rankweave.plans.retrieval import BM25, RELEVANT, passages, questions, relevant, stable, vectors
from rankweave.plans.standins import ingredients, packed_recipes, table

plans = Plans()
STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
CONTENT = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda x: length(x) > 3 AND x NOT IN ({STOP}))"


def golden(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("record_id"), E.content_words(F.col("text")).alias("words"))


@plans(f"SELECT doc_id, list_sort({CONTENT}) AS words FROM documents")
def e01_content_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_sort(E.content_words(F.col("text"))).alias("words"))


OVERLAP = f"""WITH g AS (SELECT item_id AS record_id, {CONTENT} AS gw FROM benchmark), c AS (SELECT doc_id AS passage_id, {CONTENT} AS w FROM documents),
m AS (SELECT record_id, passage_id, count(*) AS n FROM (SELECT record_id, unnest(gw) AS x FROM g) JOIN (SELECT passage_id, unnest(w) AS x FROM c) USING (x) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, passage_id) AS at_ FROM m) """


@plans(OVERLAP + "SELECT g.record_id, b.passage_id, coalesce(n / len(w), 0) AS purity, coalesce(n / len(gw), 0) AS recall FROM g LEFT JOIN b ON b.record_id = g.record_id AND at_ = 1 LEFT JOIN c USING (passage_id)")
def e02_word_overlap(spark, d):
    return E.word_overlap(golden(spark, d), passages(spark, d))


@plans()
def e03_k_at_target(spark, d):
    """Chunks of 400 characters of all documents."""
    s = C.build_spans(table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text"))
    c = C.chunk_recursive(s, 400, 0).select(F.format_string("%12s#%05d", "doc_id", "chunk_no").alias("passage_id"), "text")
    return E.k_at_target(golden(spark, d), c)


@plans()
def e04_self_sufficiency(spark, d):
    """Vectors of one label as chunks of a record, whose vector is the label's lowest one."""
    e = table(spark, d, "embeddings")
    r = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vec")).withColumnRenamed("label", "record_id")
    return E.self_sufficiency(e.select(F.col("vec_id").alias("passage_id"), F.col("label").alias("main_doc")), e.select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vec")), r)


@plans("SELECT count(*) AS n_chunks, round(avg(length(text)), 1) AS mean_chars FROM documents")
def e05_chunk_profile(spark, d):
    return E.chunk_profile(passages(spark, d))


ATOMS = "atoms AS (SELECT item_id AS record_id, left(text, 30) AS title, unnest([left(text, 25), substr(text, 40, 30), substr(text, 90, 30)]) AS atom, unnest([0, 1, 2]) AS at_ FROM benchmark)"
PRINTS = f"""WITH {ATOMS}, n AS (SELECT record_id, atom, count(DISTINCT doc_id) AS n FROM atoms JOIN documents ON contains(text, atom) WHERE length(atom) >= 8 GROUP BY ALL HAVING count(DISTINCT doc_id) BETWEEN 1 AND 3),
g AS (SELECT record_id, list_sort(list_distinct(list(atom))) AS atoms, arg_max(atom, at_) FILTER (contains(title, atom)) AS title_atom FROM atoms JOIN n USING (record_id, atom) GROUP BY record_id),
fp AS (SELECT b.item_id AS record_id, coalesce(atoms, []) AS atoms, title_atom, title_atom IS NOT NULL OR len(coalesce(atoms, [])) >= 2 AS usable FROM benchmark b LEFT JOIN g ON g.record_id = b.item_id) """


def prints(spark, d):
    t = F.col("text")
    g = table(spark, d, "benchmark").select(F.col("item_id").alias("record_id"), F.substring(t, 1, 30).alias("title"), F.array(F.substring(t, 1, 25), F.substring(t, 40, 30), F.substring(t, 90, 30)).alias("atoms"))
    return E.fingerprints(g, table(spark, d, "documents").select("doc_id", "text"))


@plans(PRINTS + "SELECT record_id, atoms, title_atom, usable FROM fp")
def e06_fingerprints(spark, d):
    return prints(spark, d).select("record_id", "atoms", "title_atom", "usable")


MATCH = PRINTS + """, met AS (SELECT DISTINCT doc_id AS passage_id, record_id, a.atom, title_atom FROM (SELECT record_id, title_atom, unnest(atoms) AS atom FROM fp WHERE usable) a JOIN documents ON contains(text, a.atom)),
mt AS (SELECT passage_id, record_id FROM met GROUP BY ALL HAVING count(*) >= 2 OR coalesce(bool_or(atom = title_atom), false)) """


@plans(MATCH + "SELECT passage_id, record_id FROM mt")
def e07_match_records(spark, d):
    return E.match_records(passages(spark, d), prints(spark, d))


@plans(PRINTS + "SELECT count(*) AS total, count(*) FILTER (usable) AS usable, count(*) FILTER (title_atom IS NOT NULL) AS with_title_atom, round(avg(len(atoms)) FILTER (usable), 4) AS mean_atoms, coalesce(list(record_id ORDER BY record_id) FILTER (NOT usable), []) AS unusable FROM fp")
def e08_fingerprint_report(spark, d):
    return E.fingerprint_report(prints(spark, d))


@plans(MATCH + "SELECT record_id, list(passage_id ORDER BY passage_id) AS doc_ids FROM mt GROUP BY record_id")
def e09_golden_map(spark, d):
    return E.golden_map(table(spark, d, "documents").select("doc_id", "text"), prints(spark, d))


@plans("SELECT doc_id AS query_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS at_, count(*) OVER () AS n FROM documents) WHERE n <= 37 OR at_ IN (SELECT floor(i * (SELECT count(*) FROM documents) / 37) FROM range(37) t(i))")
def e10_sample_questions(spark, d):
    return E.sample_questions(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.lit("f").alias("family")), 37).select("query_id")


RANKED = BM25 + ", " + RELEVANT + """, qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS family FROM benchmark), n AS (SELECT query_id, count(*) AS n_relevant FROM rel GROUP BY 1),
top AS (SELECT query_id, passage_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM bm25 JOIN rel USING (query_id, passage_id) WHERE rank <= 5), got AS (SELECT query_id, count(*) AS found, sum(so_far / rank) AS total FROM top GROUP BY 1),
met AS (SELECT query_id, family, coalesce(n_relevant, 0) AS n_relevant, CASE WHEN n_relevant IS NOT NULL THEN (coalesce(found, 0) > 0)::INT::DOUBLE END AS hit, coalesce(found, CASE WHEN n_relevant IS NOT NULL THEN 0 END) / least(n_relevant, 5) AS recall, CASE WHEN n_relevant IS NOT NULL THEN coalesce(total, 0) / least(n_relevant, 5) END AS ap FROM qs LEFT JOIN n USING (query_id) LEFT JOIN got USING (query_id)),
dv AS (SELECT query_id, count(DISTINCT source) / count(*) AS diversity FROM bm25 JOIN documents ON doc_id = passage_id WHERE rank <= 5 GROUP BY query_id),
rs AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL ELSE coalesce((SELECT 1 - count(*) FILTER (passage_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) / count(*) FROM bm25 b WHERE b.query_id = qs.query_id AND rank <= 5), 1) END AS respected FROM qs) """


def ranked(spark, d):
    return stable(R.bm25_topk(questions(spark, d), passages(spark, d), 5))


def _metrics(spark, d, hits):
    q = questions(spark, d).select("query_id", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd").alias("family"))
    return q, E.ranking_metrics(q, hits.withColumnRenamed("passage_id", "record_id"), relevant(spark, d).withColumnRenamed("passage_id", "record_id"))


@plans(RANKED + "SELECT query_id, n_relevant, hit, recall, round(ap, 6) AS ap FROM met")
def e12_ranking_metrics(spark, d):
    """Hit, recall and average precision at five of BM25."""
    return _metrics(spark, d, ranked(spark, d))[1].withColumn("ap", F.round("ap", 6))


@plans(RANKED + "SELECT query_id, diversity FROM dv")
def e15_diversity(spark, d):
    return _diversity(spark, d, ranked(spark, d))


def _diversity(spark, d, hits):
    sources = table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), F.array("source").alias("doc_ids"))
    return E.diversity_at_k(hits.join(sources, "passage_id"))


def _constraints(spark, d):
    """Two of three questions exclude what is toxic."""
    held = F.col("query_id") % 3 != 0
    none = F.array().cast("array<string>")
    return questions(spark, d).select("query_id", none.alias("exclude"), F.when(held, F.array(F.lit("toxic"))).otherwise(none).alias("exclude_categories"))


def _items(spark, d):
    lab = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("key"), F.lit("toxic text").alias("item")).distinct()
    return lab, lab.select("item").distinct().withColumn("category", F.lit("toxic"))


def _violations(spark, d, ranking):
    hits = ranking.select("query_id", F.array(F.col("passage_id").cast("string")).alias("keys"))
    return hits, E.violations(hits, _constraints(spark, d), *_items(spark, d))


@plans(RANKED + "SELECT query_id, passage_id::VARCHAR AS key, ['toxic text'] AS offending FROM bm25 WHERE rank <= 5 AND query_id % 3 != 0 AND passage_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def e17_violations(spark, d):
    return _violations(spark, d, ranked(spark, d))[1]


@plans(RANKED + "SELECT query_id, respected FROM rs")
def e18_constraint_respected(spark, d):
    return _respected(spark, d, ranked(spark, d))[0]


def _respected(spark, d, ranking):
    hits, bad = _violations(spark, d, ranking)
    return E.constraint_respected_hits(hits, _constraints(spark, d), bad), bad


def _ranking_rows(spark, d):
    """Rows of the report, and what violates constraints, of one saved ranking."""
    hits = saved(ranked(spark, d))
    q, m = _metrics(spark, d, hits)
    respected, bad = _respected(spark, d, hits)
    return E.ranking_rows(q, m, _diversity(spark, d, hits), respected), bad


@plans(RANKED + """, rows AS (SELECT * FROM met LEFT JOIN dv USING (query_id) LEFT JOIN rs USING (query_id)) SELECT '(all)' AS family, count(*) AS n, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(ap), 4) AS ap, round(avg(diversity), 4) AS diversity, round(avg(respected), 4) AS respected FROM rows
UNION ALL SELECT family, count(*), round(avg(hit), 3), round(avg(recall), 3), round(avg(ap), 3), round(avg(diversity), 3), round(avg(respected), 3) FROM rows GROUP BY family""")
def e19_ranking_report(spark, d):
    return E.ranking_report(_ranking_rows(spark, d)[0])


@plans(RANKED + """, bd AS (SELECT query_id, list(passage_id::VARCHAR ORDER BY passage_id::VARCHAR) AS keys FROM bm25 WHERE rank <= 5 AND query_id % 3 != 0 AND passage_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY query_id)
SELECT query_id, family, round(respected, 6) AS respected, keys, (SELECT count(respected) FROM rs) AS n_constrained FROM bd JOIN qs USING (query_id) JOIN rs USING (query_id)""")
def e19_ranking_breaches(spark, d):
    out = E.ranking_breaches(*_ranking_rows(spark, d))
    return out.select("query_id", "family", F.round("respected", 6).alias("respected"), F.col("breaches.key").alias("keys"), "n_constrained")


SETS = PG.QUESTION_SQL + """, ex AS (SELECT q.query_id, r.key FROM q JOIN real r USING (course) JOIN edges e ON e.key = r.key AND e.item = q.inc WHERE r.n_items <= 4), ju AS (SELECT query_id, key FROM q JOIN real USING (course) WHERE n_items <= 5),
sz AS (SELECT q.query_id, (SELECT count(*) FROM hit h WHERE h.query_id = q.query_id) AS n_returned, (SELECT count(*) FROM ex h WHERE h.query_id = q.query_id) AS n_expected, (SELECT count(*) FROM ju h WHERE h.query_id = q.query_id) AS n_judged,
 (SELECT count(*) FROM hit h SEMI JOIN (SELECT * FROM ju UNION SELECT * FROM ex) j ON j.query_id = h.query_id AND j.key = h.key WHERE h.query_id = q.query_id) AS seen, (SELECT count(*) FROM hit h SEMI JOIN ex j ON j.query_id = h.query_id AND j.key = h.key WHERE h.query_id = q.query_id) AS yes FROM q),
pr AS (SELECT *, CASE WHEN n_expected = 0 THEN (seen = 0)::INT::DOUBLE WHEN seen = 0 THEN 0 ELSE yes / seen END AS precision, CASE WHEN n_expected = 0 THEN (seen = 0)::INT::DOUBLE ELSE yes / n_expected END AS recall FROM sz) """


def _sets(spark, d):
    q = PG.constraint_questions(spark, d)
    records = saved(packed_recipes(spark, d))
    wanted = F.broadcast(q.select("query_id", "course", F.col("include")[0].alias("item")))  # a question for each course and pair of families
    expected = records.where("n_items <= 4").select("key", "course", F.explode("items").alias("item")).join(wanted, ["item", "course"]).select("query_id", "key")
    judged = records.where("n_items <= 5").select("course", "key")
    return q, G.filter_sets(q, records, ingredients(spark, d)), expected, judged


@plans(SETS + "SELECT query_id, n_returned, n_expected, n_judged, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr")
def e20_set_scores(spark, d):
    return E.set_scores(*_sets(spark, d))


@plans(SETS + """, rows AS (SELECT string_split(query_id, '|')[1] AS family, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)
SELECT '(all)' AS family, count(*) AS n, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM rows UNION ALL SELECT family, count(*), round(avg(precision), 3), round(avg(recall), 3), round(avg(f1), 3) FROM rows GROUP BY family""")
def e21_graph_report(spark, d):
    q, returned, expected, judged = _sets(spark, d)
    s = E.set_scores(q, returned, expected, judged)
    return E.by_family(s.withColumn("family", F.split("query_id", r"\|")[0]), dict.fromkeys(("precision", "recall", "f1"), 4))


@plans(SETS + """, can AS (SELECT q.query_id, CASE WHEN EXISTS (SELECT 1 FROM ex WHERE ex.query_id = q.query_id) THEN EXISTS (SELECT 1 FROM ex SEMI JOIN hit ON hit.query_id = ex.query_id AND hit.key = ex.key WHERE ex.query_id = q.query_id) END AS ok, (SELECT count(*) FROM hit h WHERE h.query_id = q.query_id) = 0 AS refused FROM q)
SELECT query_id, (refused != ok)::INT::DOUBLE AS abstention FROM can""")
def e23_abstention(spark, d):
    q, returned, expected, _ = _sets(spark, d)
    refused = q.select("query_id").join(returned.select("query_id").distinct().withColumn("got", F.lit(True)), "query_id", "left").select("query_id", F.col("got").isNull().alias("refused"))
    return E.abstention(refused, E.answerable(q, returned, expected))


@plans("""WITH s AS (SELECT doc_id % 4 AS metric, quality::DOUBLE AS score, toxic = 1 AS refused, doc_id % 3 = 0 AS cached FROM labels)
SELECT ['cookable', 'relevancy', 'faithful', 'grounded'][metric + 1] AS metric, round(avg(CASE WHEN refused AND metric < 2 THEN NULL ELSE score END), 4) AS mean, count(CASE WHEN refused AND metric < 2 THEN NULL ELSE score END) AS n, count(*) FILTER (NOT cached) AS calls, count(*) FILTER (cached) AS cache_hits, round(count(*) FILTER (NOT cached) * 0.00007, 6)::DOUBLE AS usd FROM s GROUP BY metric""")
def e26_judged_report(spark, d):
    """Quality labels as a judge's scores, toxic documents as refusals."""
    metric = F.element_at(F.array(*map(F.lit, ("cookable", "relevancy", "faithful", "grounded"))), (F.col("doc_id") % 4 + 1).cast("int"))
    s = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"), metric.alias("metric"), F.col("quality").cast("double").alias("score"), (F.col("toxic") == 1).alias("refused"), (F.col("doc_id") % 3 == 0).alias("cached"), F.lit(0.00007).alias("usd"), F.lit(None).cast("string").alias("error"))
    return E.judged_report(s).drop("failures")


@plans("""WITH r AS (SELECT source AS config, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source) SELECT config, mean, rank() OVER (ORDER BY mean DESC) AS place, mean = max(mean) OVER () AS best FROM r""")
def e27_leaderboard(spark, d):
    """Sources as configurations, compared by the mean length of their documents."""
    runs = table(spark, d, "documents").groupBy(F.col("source").alias("config")).agg(F.round(F.avg("n_chars"), 4).alias("mean"))
    return E.leaderboard(runs, "mean").withColumn("place", F.col("place").cast("long"))


@plans("""WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS passage_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders),
m AS (SELECT query_id, l_partkey AS record_id, min(struct_pack(rank := rank, ord := l_partkey % 7)) AS best FROM h JOIN lineitem ON l_orderkey = passage_id GROUP BY ALL)
SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY best, record_id) AS rank FROM m""")
def e11_collapse_to_records(spark, d):
    """A customer's orders as ranked hits, parts as the records that they meet."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    hits = o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("passage_id"), rank.alias("rank"))
    matches = li.select(F.col("l_orderkey").alias("passage_id"), F.col("l_partkey").alias("record_id"))
    order = li.select(F.col("l_partkey").alias("record_id")).distinct().withColumn("ord", F.col("record_id") % 7)
    return E.collapse_to_records(hits, matches, order).withColumn("rank", F.col("rank").cast("long"))
