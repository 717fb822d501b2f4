"""Queries of prompts, answers, pantries and traces: orders as answers that claim their first parts, brands as pantries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions.saved import saved
from rankweave.operators import context as A
from rankweave.operators import evaluate as E
from rankweave.operators import graph as G
from rankweave.operators import retrieve as R
from rankweave.operators import vocab as V
from rankweave.plans.graph import QUESTION_SQL, constraint_questions
from rankweave.plans.register import Plans
from rankweave.plans.retrieval import vectors
from rankweave.plans.standins import ingredients, recipes, table, uses, with_
from rankweave.plans.text import VOC, _hits, vocabulary

plans = Plans()
NORMALISED = "nullif(trim(regexp_replace(regexp_replace({0}, '\\b(?:" + V.QUALIFIER + "|" + V.PREPARATION + ")\\b', ' ', 'g'), '\\s+', ' ', 'g')), '')"
ITEMS = VOC + """, res AS (SELECT DISTINCT p_name, norm.name AS nm, voc.name IS NULL AS unseen, canonical, split FROM norm LEFT JOIN voc ON voc.name = norm.name WHERE length(norm.name) >= 3),
im AS (SELECT p_name, unnest(CASE WHEN unseen THEN [nm] WHEN split IS NOT NULL THEN split WHEN canonical IS NOT NULL THEN [canonical] ELSE [] END) AS item FROM res),
li AS (SELECT l_orderkey AS k, l_linenumber AS n, p_name FROM lineitem JOIN part ON p_partkey = l_partkey) """


# --- pantries and courses ---------------------------------------------------------------------------
@plans(ITEMS + """, ln AS (SELECT DISTINCT p_brand AS pantry_id, '2 cups ' || p_name AS line, p_name FROM part UNION SELECT DISTINCT p_brand, 'a guess', NULL FROM part UNION SELECT DISTINCT p_brand, 'nothing at all here', NULL FROM part WHERE right(p_brand, 1) = '2'),
f AS (SELECT pantry_id, line, item FROM ln JOIN im USING (p_name) WHERE item IN (SELECT p_name FROM part) UNION SELECT pantry_id, line, 'red ring' FROM ln WHERE line = 'a guess' AND 'red ring' IN (SELECT p_name FROM part))
SELECT pantry_id, coalesce((SELECT list_sort(list(DISTINCT item)) FROM f WHERE f.pantry_id = b.pantry_id), []) AS known, coalesce((SELECT list_sort(list(DISTINCT line)) FROM ln WHERE ln.pantry_id = b.pantry_id AND NOT EXISTS (SELECT 1 FROM f WHERE f.pantry_id = ln.pantry_id AND f.line = ln.line)), []) AS unknown
FROM (SELECT DISTINCT pantry_id FROM ln) b""")
def g23_resolve_pantry(spark, d):
    """Lines of each brand's parts, one that a model guesses, and for some brands one that nobody knows."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("pantry_id"), "p_name").distinct()
    brands = p.select("pantry_id").distinct()
    lines = p.select("pantry_id", F.concat(F.lit("2 cups "), "p_name").alias("line")).unionByName(brands.withColumn("line", F.lit("a guess"))).unionByName(brands.where("pantry_id LIKE '%2'").withColumn("line", F.lit("nothing at all here")))
    guesses = spark.range(1).select(F.lit("a guess").alias("line"), F.lit("red ring").alias("guess"))
    return G.resolve_pantry(lines, vocabulary(spark, d), ingredients(spark, d), guesses)


@plans(with_("uses", "recipes") + """, r AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS place FROM recipes WHERE n_items <> 2)
SELECT key, CASE place % 25 % 3 WHEN 0 THEN 'soup' WHEN 1 THEN CASE WHEN place % 25 = 22 THEN 'other' ELSE 'main' END ELSE 'other' END AS course FROM r UNION ALL SELECT key, 'bread' FROM recipes WHERE n_items = 2""")
def g10_assign_course(spark, d):
    """Replies that call the rows of a batch soup, Main or lunch in turn, and one nothing."""
    r, u = recipes(spark, d), uses(spark, d)
    known = r.where("n_items = 2").select("key", F.lit("bread").alias("course"))
    prompts = G.course_prompts(r, u, known)
    said = lambda n: F.when(n == 23, "no course").otherwise(F.format_string('{"n": %s, "course": "%s"}', n, F.element_at(F.array(F.lit("soup"), F.lit(" Main"), F.lit("lunch")), (n - 1) % 3 + 1)))
    replies = prompts.select("batch_no", F.array_join(F.transform(F.sequence(F.lit(1), F.size("keys")), said), "\n").alias("reply"))
    return G.assign_course(prompts, replies, known)


@plans(ITEMS + f""", it AS (SELECT p_partkey, p.p_name, list(item) FILTER (item IS NOT NULL) AS items, {NORMALISED.format("p.p_name")} AS nm FROM part p LEFT JOIN im ON im.p_name = p.p_name GROUP BY ALL)
SELECT a.p_partkey AS p_partkey, coalesce(list_has_any(a.items, b.items), false) OR coalesce(contains(a.nm, b.nm) OR contains(b.nm, a.nm), false) AS same FROM it a JOIN it b ON b.p_partkey = a.p_partkey + 1""")
def v10_same_item(spark, d):
    """Each part and the next one."""
    p = V.normalise_lines(table(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name", "name")
    items = V.resolve(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", vocabulary(spark, d)).groupBy("p_partkey").agg(F.collect_set("item").alias("items"))
    one = p.join(items, "p_partkey", "left")
    other = one.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("name_b"), F.col("items").alias("items_b"))
    return one.join(other, "p_partkey").select("p_partkey", V.same_item(F.col("items"), F.col("items_b"), F.col("name"), F.col("name_b")).alias("same"))


# --- routes ---------------------------------------------------------------------------------------
@plans(QUESTION_SQL + """, c AS (SELECT key, list(item ORDER BY item) AS items FROM edges GROUP BY key), m AS (SELECT query_id, key, items, row_number() OVER (PARTITION BY query_id ORDER BY len(items), key) AS rank FROM hit JOIN c USING (key))
SELECT query_id, key AS passage_id, 1.0::DOUBLE / rank AS score, rank, 'Order ' || split_part(key, ':', 2) || chr(10) || array_to_string(list_transform(items, lambda x: '- ' || x), chr(10)) AS text FROM m WHERE rank <= 5""")
def r12_graph_only(spark, d):
    r, u, i = recipes(spark, d), uses(spark, d), ingredients(spark, d)
    q = constraint_questions(spark, d)
    cards = G.recipe_cards(r, r, u, r.select("key", F.lit(None).cast("string").alias("text")))
    out = R.graph_only(G.filter_recipes(q, r, u, i), q, cards, 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@plans(with_("dn", "dense") + """, h AS (SELECT query_id, label, query_id % 40 <> 0 AS held FROM dense JOIN embeddings ON vec_id = passage_id WHERE rank <= 10), k AS (SELECT count(DISTINCT label) AS n FROM embeddings WHERE label NOT IN (3, 4)),
t AS (SELECT query_id, any_value(held) AS filtered, count(*) AS n_pool, count(*) FILTER (NOT held OR label NOT IN (3, 4)) AS n_survived FROM h GROUP BY query_id)
SELECT query_id, filtered, CASE WHEN filtered AND query_id % 100 <> 20 THEN k.n ELSE 0 END AS n_allowed, n_pool, CASE WHEN query_id % 100 = 20 AND filtered THEN 0 ELSE n_survived END AS n_survived,
CASE WHEN NOT filtered THEN 'no exclusion' WHEN query_id % 100 = 20 THEN 'nothing allowed' WHEN n_survived = 0 THEN 'nothing ranked is allowed' ELSE 'filtered' END AS reason FROM t, k""")
def r11_gate_trace(spark, d):
    """Half of the questions exclude two labels, some of these all of them."""
    q, _ = vectors(spark, d)
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("passage_id"), F.col("embedding").alias("vec"), "label")
    held = q.where("query_id % 40 != 0").select("query_id")
    keys = p.select("passage_id", F.col("label").alias("key"))
    allowed = held.where("query_id % 100 != 20").crossJoin(F.broadcast(keys.select("key").distinct().where("key NOT IN (3, 4)")))  # questions x the few labels
    hits = saved(R.dense_topk(q, p, 10))
    return R.gate_trace(q, held, allowed, hits, R.gate(hits, held, allowed, 10, keys))


# --- prompts and answers --------------------------------------------------------------------------
@plans("SELECT conv_id AS query_id, length('Recipes:' || chr(10) || string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Question: q' || conv_id || chr(10))::BIGINT AS head_chars FROM conversations GROUP BY conv_id")
def a03_contexts_structured(spark, d):
    """How far the question reaches in each prompt."""
    out = A.contexts_structured(*_hits(spark, d))
    return out.select("query_id", (F.instr("prompt", "\n\nAnswer using only the recipes above, in exactly this shape:")).cast("long").alias("head_chars"))


@plans("""WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS passages, arg_max(text, turn) FILTER (role = 'assistant') AS reply FROM conversations GROUP BY conv_id)
SELECT conv_id AS query_id, md5(CASE WHEN conv_id % 5 = 0 OR conv_id % 3 = 0 OR reply IS NULL THEN 'NOT_IN_CONTEXT' ELSE reply END) AS digest, CASE WHEN conv_id % 5 = 0 THEN [] ELSE passages END AS passages, conv_id % 5 = 0 OR conv_id % 3 = 0 OR reply IS NULL AS refused, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 'm' END AS model FROM c""")
def a05_finalise_answers(spark, d):
    """Last assistant turns as replies; a fifth of the questions has no context, a third no reply."""
    h, q = _hits(spark, d)
    t = table(spark, d, "conversations").where("role = 'assistant' AND conv_id % 3 != 0").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("reply"))
    replies = q.where("query_id % 3 != 0").select("query_id").join(t, "query_id", "left").withColumns({"model": F.lit("m"), "elapsed_s": F.lit(1.0)})
    out = A.finalise_answers(q, replies, A.contexts_stuffed(h.where("query_id % 5 != 0"), q))
    return out.select("query_id", F.md5("text").alias("digest"), "passages", "refused", "model")


CLAIMS = ITEMS + f""", ans AS (SELECT DISTINCT k AS query_id, k % 4 = 0 AS refused FROM li), cl AS (SELECT DISTINCT k AS query_id, item FROM li JOIN im USING (p_name) WHERE n <= 3 AND k % 4 <> 0),
av AS (SELECT DISTINCT k AS query_id, item FROM li JOIN im USING (p_name) WHERE n > 1),
bad AS (SELECT query_id, item FROM cl WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.query_id = cl.query_id AND (av.item = cl.item OR contains({NORMALISED.format("av.item")}, {NORMALISED.format("cl.item")}) OR contains({NORMALISED.format("cl.item")}, {NORMALISED.format("av.item")})))),
gr AS (SELECT a.query_id, 1 - coalesce((SELECT count(*) FROM bad WHERE bad.query_id = a.query_id), 0) / nullif((SELECT count(*) FROM cl WHERE cl.query_id = a.query_id), 0) AS g, coalesce((SELECT list_sort(list(item)) FROM bad WHERE bad.query_id = a.query_id), []) AS invented FROM ans a),
fams AS (SELECT DISTINCT p_name AS item, string_split(p_name, ' ')[2] AS category FROM part), ban AS (SELECT item FROM fams WHERE category = 'anvil' UNION SELECT 'hot'),
re AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN NULL ELSE coalesce(1 - (SELECT count(*) FROM cl WHERE cl.query_id = ans.query_id AND cl.item IN (SELECT item FROM ban)) / nullif((SELECT count(*) FROM cl WHERE cl.query_id = ans.query_id), 0), 1) END AS respected FROM ans),
rw AS (SELECT ans.query_id, refused, query_id % 10 AS s, coalesce(g, 1) AS grounded, CASE WHEN query_id % 5 = 0 THEN NULL ELSE (refused = (query_id % 8 = 0))::INT::DOUBLE END AS abstention, respected FROM ans JOIN gr USING (query_id) JOIN re USING (query_id)) """


def _answers(spark, d):
    """(answers, claimed, available): a quarter refuses, the others claim their order's first three parts; the context lacks the first."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey")
    o = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("p_name").alias("p")))).alias("l"))
    bullets = F.array_join(F.transform(F.filter("l", lambda x: x["n"] <= 3), lambda x: F.concat(F.when(x["n"] == 2, "2) ").otherwise("- "), F.lit("2 tbsp "), x["p"])), "\n")
    text = F.when(F.col("query_id") % 4 == 0, A.REFUSAL).otherwise(F.concat(F.lit("Here it is:\n"), bullets, F.lit("\nSteps:\n- 3 cups of steps")))
    a = o.select("query_id", text.alias("text"), (F.col("query_id") % 4 == 0).alias("refused"))
    c = o.select("query_id", F.array_join(F.transform(F.filter("l", lambda x: x["n"] > 1), lambda x: F.concat(F.lit("* 2 cups "), x["p"])), "\n").alias("text"))
    v = saved(vocabulary(spark, d))
    return a, E.answer_items(a, v, named=True), E.context_items(c, v, named=True)


def _excluded(a):
    none, held = F.array().cast("array<string>"), F.col("query_id") % 3 != 0
    return a.select("query_id", F.when(held, F.array(F.lit("hot"))).otherwise(none).alias("exclude"), F.when(held, F.array(F.lit("anvil"))).otherwise(none).alias("exclude_categories"))


@plans(CLAIMS + "SELECT query_id, round(coalesce(g, 1), 6) AS grounded, invented FROM gr")
def e22_no_invented(spark, d):
    return E.no_invented(*_answers(spark, d)).withColumn("grounded", F.round("grounded", 6))


@plans(CLAIMS + "SELECT query_id, round(respected, 6) AS respected, CASE WHEN respected = 1 THEN 'respects what you excluded' WHEN respected IS NOT NULL THEN 'may include something you excluded' END AS badge FROM re")
def e24_constraint_respected_answers(spark, d):
    """With the badge that readers see (A7)."""
    a, claimed, _ = _answers(spark, d)
    return A.compliance_badge(E.constraint_respected_answers(a, claimed, _excluded(a), ingredients(spark, d)).withColumn("respected", F.round("respected", 6)))


def _rows(spark, d):
    a, claimed, available = _answers(spark, d)
    can = a.select("query_id", F.when(F.col("query_id") % 5 != 0, F.col("query_id") % 8 != 0).alias("answerable"))
    rows = a.join(E.no_invented(a, claimed, available), "query_id").join(E.abstention(a, can), "query_id").join(E.constraint_respected_answers(a, claimed, _excluded(a), ingredients(spark, d)), "query_id")
    return rows.withColumn("elapsed_s", (F.col("query_id") % 10).cast("double"))


MEANS = "count(*) AS n, round(avg(grounded), 4) AS grounded, round(avg(abstention), 4) AS abstention, round(avg(respected), 4) AS respected, round(avg(refused::INT::DOUBLE), 4) AS refusal_rate"


@plans(CLAIMS + f"SELECT {MEANS}, round(avg(s), 2) AS mean_seconds FROM rw")
def e25_generation_report(spark, d):
    return E.generation_report(_rows(spark, d))


@plans(CLAIMS + f"SELECT CASE WHEN query_id % 2 = 0 THEN 'graph' ELSE 'retrieval' END AS route, {MEANS} FROM rw GROUP BY 1")
def e30_route_comparison(spark, d):
    """Even orders as the graph's answers, odd ones as those of retrieval."""
    rows = _rows(spark, d)
    return E.route_comparison(rows.where("query_id % 2 = 0"), rows.where("query_id % 2 = 1"))
