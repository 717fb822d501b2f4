"""Queries of the graph tables over orders and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.functions.saved import saved
from rankweave.operators import evaluate as E
from rankweave.operators import extract as X
from rankweave.operators import graph as G
from rankweave.plans.register import Plans
from rankweave.plans.standins import terms_sql, ingredients, packed_recipes, recipes, steps, table, uses, with_

plans = Plans()
REAL = with_("uses", "recipes", "real")


def _world(spark, d):
    return recipes(spark, d), uses(spark, d), ingredients(spark, d)


#: Orders as records, and names of parts as a vocabulary: "red ring" is rejected, the first name of "hot" ones stands for all.
LINES = """li AS (SELECT DISTINCT 'o:' || l_orderkey AS key, p_name AS raw FROM lineitem JOIN part ON l_partkey = p_partkey), hot AS (SELECT min(p_name) AS hot FROM part WHERE p_name LIKE 'hot %'),
nm AS (SELECT key, raw, trim(regexp_replace(raw, '\\b(small|medium|large|big|tiny)\\b', ' ', 'g')) AS name FROM li),
item AS (SELECT key, raw, CASE WHEN name LIKE 'hot %' THEN (SELECT hot FROM hot) ELSE name END AS item FROM nm WHERE name != 'red ring' AND length(name) >= 3)"""


def records(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    step = F.struct("l_linenumber", F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"))
    r = li.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("ingredient_lines"), F.array_sort(F.collect_set(step)).alias("steps"))
    key = F.col("l_orderkey").cast("string")
    return r.select(F.lit("o").alias("source"), key.alias("record_id"), F.concat(F.lit("Order "), key).alias("title"), F.lit(None).cast("array<int>").alias("pages"), "ingredient_lines", F.col("steps.text").alias("step_lines"))


def names(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    hot = p.where("name LIKE 'hot %'").agg(F.min("name").alias("hot"))
    canonical = F.when(F.col("name") == "red ring", None).when(F.col("name").startswith("hot "), F.col("hot")).otherwise(F.col("name"))
    return p.join(F.broadcast(hot)).select("name", canonical.alias("canonical"), F.lit(None).cast("array<string>").alias("split"))  # hot is one row


@plans(f"WITH {LINES}, n AS (SELECT key, count(DISTINCT item) AS n FROM item GROUP BY key), s AS (SELECT 'o:' || l_orderkey AS key, count(*) AS n_steps FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1) "
"SELECT key, 'Order ' || key[3:] AS title, coalesce(n, 0) AS n_items, n_steps::INT AS n_steps, coalesce(n, 0) >= 2 AS is_recipe FROM s LEFT JOIN n USING (key)")
def g01_shape_recipes(spark, d):
    r = records(spark, d)
    return G.shape_recipes(r, G.shape_uses(r, names(spark, d))).drop("pages")


@plans(f"WITH {LINES} SELECT key, item, raw FROM item")
def g02_shape_uses(spark, d):
    return G.shape_uses(records(spark, d), names(spark, d))


@plans(f"WITH {LINES} SELECT DISTINCT key, item FROM item")
def e16_record_items(spark, d):
    return E.record_items(records(spark, d), names(spark, d))


@plans(with_("ingredients") + "SELECT category FROM ingredients GROUP BY category")
def g03_shape_categories(spark, d):
    return G.shape_categories(ingredients(spark, d))


STEPS = """st AS (SELECT 'o:' || l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t) - 1 AS step_no, t AS text
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag || ' ' || l_linestatus AS t FROM lineitem JOIN part ON l_partkey = p_partkey))"""


@plans(f"WITH {STEPS} SELECT key, key || '#s' || lpad(step_no::VARCHAR, 2, '0') AS step_id, step_no::INT AS step_no, text FROM st")
def g04_shape_steps(spark, d):
    return G.shape_steps(records(spark, d))


@plans("SELECT doc_id::VARCHAR AS step_id, unnest(CASE WHEN list_contains(t, 'deep fry') THEN list_filter(t, lambda x: x != 'fry') ELSE t END) AS action FROM (SELECT doc_id, " + terms_sql(X.ACTIONS) + " AS t FROM documents WHERE text IS NOT NULL)")
def g05_shape_performs(spark, d):
    """Documents as steps."""
    return G.shape_performs(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("step_id"), "text"))


NEEDS = """ne AS (SELECT DISTINCT 'o:' || l_orderkey || '#s' || lpad((l_linenumber - 1)::VARCHAR, 2, '0') AS step_id, 'o:' || l_orderkey AS key, l_linenumber - 1 AS step_no, l_returnflag AS equipment FROM lineitem)"""


def needs(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.format_string("o:%d#s%02d", "l_orderkey", (F.col("l_linenumber") - 1).cast("int")).alias("step_id"), F.col("l_returnflag").alias("equipment")).distinct()


@plans(f"WITH {NEEDS} SELECT key, step_id, step_no::INT AS step_no, '' AS actions, string_agg(equipment, ',' ORDER BY equipment) AS equipment FROM ne WHERE key IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY ALL")
def g19_steps_for(spark, d):
    """Steps of urgent orders; the flag of a line is the equipment."""
    keys = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("key"))
    none = spark.sql("SELECT '' AS step_id, '' AS action WHERE false")
    s = G.steps_for(keys, steps(spark, d), none, needs(spark, d))
    return s.select("key", "step_id", F.col("step_no").cast("int").alias("step_no"), F.array_join("actions", ",").alias("actions"), F.array_join("equipment", ",").alias("equipment"))


@plans(with_("uses", "recipes", "real") + f", {NEEDS} SELECT key FROM real WHERE key IN (SELECT key FROM ne WHERE equipment = 'R')")
def g20_needing_equipment(spark, d):
    return G.needing_equipment(recipes(spark, d), steps(spark, d), needs(spark, d), "R").select("key")


@plans("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber - 1 AS n FROM lineitem), t AS (SELECT 'o:' || l_orderkey || '#s' || lpad(n::VARCHAR, 2, '0') AS step_id, lead('o:' || l_orderkey || '#s' || lpad(n::VARCHAR, 2, '0')) OVER (PARTITION BY l_orderkey ORDER BY n) AS next_id FROM s)
SELECT step_id, next_id FROM t WHERE next_id IS NOT NULL""")
def g06_shape_next(spark, d):
    return G.shape_next(steps(spark, d))


@plans("SELECT l_returnflag AS flag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1")
def g07_assert_unique(spark, d):
    s = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return G.assert_unique(s, ["l_orderkey", "l_linenumber", "l_returnflag"]).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))


@plans("""WITH old AS (SELECT p_name AS item, max(p_brand) AS brand FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), new AS (SELECT p_name AS item, max(p_brand) AS brand FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT coalesce(new.item, old.item) AS item, coalesce(new.brand, old.brand) AS brand FROM old FULL JOIN new USING (item)""")
def g08_upsert(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("item"), F.col("p_brand").alias("brand"))
    return G.upsert(p.where("p_partkey % 2 = 0").groupBy("item").agg(F.max("brand").alias("brand")), p.where("p_partkey % 3 = 0").select("item", "brand"), ["item"])


@plans(with_("uses", "ingredients", "recipes") + """SELECT * FROM (SELECT 'Recipe' AS label, count(*) AS n FROM recipes UNION ALL SELECT 'Recipe(real)', count(*) FROM recipes WHERE is_recipe UNION ALL SELECT 'skipped', count(*) FROM recipes WHERE NOT is_recipe
UNION ALL SELECT 'Ingredient', count(*) FROM ingredients UNION ALL SELECT 'Category', count(DISTINCT category) FROM ingredients UNION ALL SELECT 'Step', (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) UNION ALL SELECT 'USES', count(*) FROM uses
UNION ALL SELECT 'NEXT', (SELECT count(*) - count(DISTINCT l_orderkey) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) UNION ALL SELECT 'PERFORMS', 0 UNION ALL SELECT 'NEEDS', 0)""")
def g09_graph_report(spark, d):
    r, u, i = _world(spark, d)
    s = steps(spark, d)
    return G.graph_report(r, i, s, u, G.shape_next(s), G.shape_performs(s), G.shape_needs(s))


@plans(REAL + "SELECT key FROM real WHERE key IN (SELECT key FROM uses WHERE item IN ('hot ring', 'red plate') GROUP BY key HAVING count(*) = 2)")
def g11_using_all(spark, d):
    r, u, _ = _world(spark, d)
    return G.using_all(r, u, ["hot ring", "red plate"]).select("key")


@plans(REAL + "SELECT key FROM real WHERE key IN (SELECT key FROM uses WHERE item IN ('hot ring', 'red plate'))")
def g12_using_any(spark, d):
    r, u, _ = _world(spark, d)
    return G.using_any(r, u, ["hot ring", "red plate"]).select("key")


@plans(REAL + "SELECT key FROM real WHERE key NOT IN (SELECT key FROM uses WHERE item IN ('hot ring', 'red plate'))")
def g13_without_items(spark, d):
    r, u, _ = _world(spark, d)
    return G.without_items(r, u, ["hot ring", "red plate"]).select("key")


@plans(with_("uses", "ingredients", "recipes", "real") + "SELECT key FROM real WHERE key NOT IN (SELECT key FROM uses JOIN ingredients USING (item) WHERE category IN ('ring', 'plate'))")
def g14_without_categories(spark, d):
    return G.without_categories(*_world(spark, d), ["ring", "plate", "none", ""]).select("key")


@plans(REAL + "SELECT key FROM real WHERE course = '1-URGENT'")
def g15_of_course(spark, d):
    return G.of_course(recipes(spark, d), "1-URGENT").select("key")


def stored_world(spark, d):
    """Records, uses and items, written once, as a graph that many questions are asked of."""
    u = saved(uses(spark, d))
    return saved(recipes(spark, d, u)), u, ingredients(spark, d)


def constraint_questions(spark, d):
    """A question for each pair of an order priority and a part's family: of that priority, with a name of one family and nothing of another."""
    c = table(spark, d, "orders").select(F.col("o_orderpriority").alias("course")).distinct()
    i = ingredients(spark, d).groupBy("category").agg(F.min("item").alias("include"), F.max("item").alias("exclude"))
    other = i.select(F.col("category").alias("ban"))
    q = c.join(F.broadcast(i)).join(F.broadcast(other)).where("category < ban")
    return q.select(F.concat_ws("|", "course", "category", "ban").alias("query_id"), "course", F.array("include").alias("include"), F.array("exclude").alias("exclude"), F.array("ban").alias("exclude_categories"))


QUESTION_SQL = with_("uses", "ingredients", "recipes", "real", "edges") + """, f AS (SELECT category, min(item) AS inc, max(item) AS exc FROM ingredients GROUP BY 1),
q AS (SELECT c.course || '|' || f.category || '|' || b.category AS query_id, c.course, f.inc, f.exc, b.category AS ban FROM (SELECT DISTINCT o_orderpriority AS course FROM orders) c, f, f b WHERE f.category < b.category),
hit AS (SELECT q.query_id, r.key FROM q JOIN real r USING (course) JOIN edges e ON e.key = r.key AND e.item = q.inc WHERE NOT EXISTS (SELECT 1 FROM edges x JOIN ingredients i USING (item) WHERE x.key = r.key AND (x.item = q.exc OR i.category = q.ban))) """


@plans(QUESTION_SQL + "SELECT query_id, key FROM hit")
def g16_filter_recipes(spark, d):
    return G.filter_sets(constraint_questions(spark, d), packed_recipes(spark, d), ingredients(spark, d))


def pantries(spark, d):
    """Customers' shelves: the parts of brands, one shelf for each brand."""
    return table(spark, d, "part").select(F.col("p_brand").alias("pantry_id"), F.col("p_name").alias("item")).distinct()


PANTRY = with_("uses", "recipes", "real", "edges") + """, own AS (SELECT DISTINCT p_brand AS pantry_id, p_name AS item FROM part), need AS (SELECT key, count(*) AS n_needed FROM edges GROUP BY key),
hits AS (SELECT pantry_id, key, count(*) AS h FROM own JOIN edges USING (item) GROUP BY ALL),
c AS (SELECT p.pantry_id, n.key, n_needed, n_needed - coalesce(h, 0) AS n_missing FROM (SELECT DISTINCT pantry_id FROM own) p CROSS JOIN need n LEFT JOIN hits ON hits.pantry_id = p.pantry_id AND hits.key = n.key),
top AS (SELECT *, row_number() OVER (PARTITION BY pantry_id ORDER BY n_missing, n_needed DESC, key) AS place FROM c WHERE n_missing <= 3) """


@plans(PANTRY + """SELECT pantry_id, key, n_needed, n_missing, place, coalesce((SELECT list(e.item ORDER BY e.item) FROM edges e WHERE e.key = top.key AND NOT EXISTS (SELECT 1 FROM own WHERE own.pantry_id = top.pantry_id AND own.item = e.item)), []) AS missing FROM top WHERE place <= 20""")
def g17_pantry_gap(spark, d):
    r, u, _ = stored_world(spark, d)
    return G.pantry_gap(pantries(spark, d), r, u)


SUBST = with_("uses", "ingredients", "recipes", "real", "edges") + """, ctx AS (SELECT DISTINCT a.item, b.item AS ctx FROM edges a JOIN edges b USING (key) WHERE a.item != b.item),
sz AS (SELECT item, count(*) AS n FROM ctx GROUP BY item), sh AS (SELECT a.item, b.item AS other, count(*) AS shared FROM ctx a JOIN ctx b USING (ctx) JOIN ingredients i ON i.item = a.item JOIN ingredients j ON j.item = b.item AND i.category = j.category WHERE a.item != b.item GROUP BY ALL HAVING count(*) >= 3),
tg AS (SELECT a.item, b.item AS other, count(*) AS together FROM edges a JOIN edges b USING (key) WHERE a.item != b.item GROUP BY ALL), nr AS (SELECT item, count(*) AS n_rec FROM edges GROUP BY item),
sc AS (SELECT item, other, shared, coalesce(together, 0) AS together, round(shared / (x.n + y.n - shared) * (1 - coalesce(together, 0) / n_rec), 3) AS score FROM sh JOIN sz x USING (item) JOIN sz y ON y.item = other JOIN nr USING (item) LEFT JOIN tg USING (item, other)),
sub AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS place FROM sc) """


@plans(SUBST + "SELECT item, other, shared, together, score, place FROM sub WHERE place <= 8")
def g18_substitutes(spark, d):
    i = ingredients(spark, d)
    return G.substitutes(i.select("item"), recipes(spark, d), uses(spark, d), i)


@plans(with_("uses", "ingredients", "recipes", "real", "edges") + """, e AS (SELECT key, item, category FROM edges JOIN ingredients USING (item)), b AS (SELECT category, count(DISTINCT key) AS r, count(DISTINCT item) AS i FROM e GROUP BY 1)
SELECT 'real' AS measure, '' AS name, (SELECT count(*) FROM real) AS n UNION ALL SELECT 'records', category, r FROM b UNION ALL SELECT 'items', category, i FROM b UNION ALL SELECT 'free_of', category, (SELECT count(*) FROM real) - r FROM b""")
def g22_graph_stats(spark, d):
    r, u, i = _world(spark, d)
    return G.graph_stats(r, u, i)


@plans(with_("uses", "recipes") + "SELECT key, n_items, list(item ORDER BY item) AS items FROM recipes JOIN uses USING (key) GROUP BY ALL")
def g21_recipe_cards(spark, d):
    r, u, _ = _world(spark, d)
    texts = r.select("key", F.lit(None).cast("string").alias("text"))
    return G.recipe_cards(r, r, u, texts).select("key", F.size("items").cast("long").alias("n_items"), "items")


@plans(PANTRY + SUBST.replace(with_("uses", "ingredients", "recipes", "real", "edges"), ", " + with_("ingredients").removeprefix("WITH ").strip()) + """, pick AS (SELECT pantry_id, key FROM top WHERE place <= 20),
miss AS (SELECT pantry_id, key, e.item, row_number() OVER (PARTITION BY pantry_id, key ORDER BY e.item) AS at FROM pick JOIN edges e USING (key) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pantry_id = pick.pantry_id AND o.item = e.item)),
swap AS (SELECT m.pantry_id, m.key, m.item, arg_min(s.other, s.place) AS other FROM miss m JOIN sub s ON s.item = m.item AND s.place <= 8 JOIN own o ON o.pantry_id = m.pantry_id AND o.item = s.other WHERE m.at <= 6 GROUP BY ALL)
SELECT pantry_id, key, n_needed, n_needed - count(miss.item) AS n_have, count(swap.other) AS n_swaps, coalesce(list(miss.item ORDER BY miss.item) FILTER (miss.item IS NOT NULL AND swap.other IS NULL), []) AS buy, count(*) FILTER (miss.item IS NOT NULL AND swap.other IS NULL) = 0 AS can_make
FROM pick JOIN need USING (key) LEFT JOIN miss USING (pantry_id, key) LEFT JOIN swap USING (pantry_id, key, item) GROUP BY pantry_id, key, n_needed""")
def g24_can_i_make(spark, d):
    r, u, i = _world(spark, d)
    p = pantries(spark, d)
    pairs = G.pantry_gap(p, r, u).select("pantry_id", "key")
    out = G.can_i_make(pairs, p, u, G.substitutes(i.select("item"), r, u, i))
    return out.select("pantry_id", "key", "n_needed", F.size("have").cast("long").alias("n_have"), F.size("swaps").cast("long").alias("n_swaps"), "buy", "can_make")
