"""The given tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, in order of doc_id; the title is the start of the first line."""
    t = table(spark, d, "documents")
    return t.select("source", F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("doc_id"), F.substring(F.split("text", "\n")[0], 1, 40).alias("title"), "text")


def passages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _order_key(number: str) -> Column:
    return F.concat(F.lit("o:"), F.col(number).cast("string")).alias("key")


def _order_items(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (l_orderkey, item), dealt by order once."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").select("l_orderkey", "item").repartition("l_orderkey").distinct()


def uses(spark: SparkSession, d: str) -> DataFrame:
    """Orders use the names of their parts; an item's family is its second word."""
    return _order_items(spark, d).select(_order_key("l_orderkey"), "item", F.col("item").alias("raw"))


def packed_recipes(spark: SparkSession, d: str) -> DataFrame:
    """(key, course, items, n_items) of real records, a row for each."""
    sets = _order_items(spark, d).groupBy("l_orderkey").agg(F.collect_list("item").alias("items")).where("size(items) >= 2")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("course"))
    return sets.join(o, "l_orderkey").select(_order_key("l_orderkey"), "course", "items", F.size("items").cast("long").alias("n_items"))


def ingredients(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_name").alias("item"), F.split("p_name", " ")[1].alias("category")).distinct()


def recipes(spark: SparkSession, d: str, used: DataFrame | None = None) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("course"), F.lit(None).cast("array<int>").alias("pages"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    n = (uses(spark, d) if used is None else used).groupBy("key").agg(F.count_distinct("item").alias("n_items"))
    return o.join(n, "key").withColumn("is_recipe", F.col("n_items") >= 2)


def steps(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    key = F.concat(F.lit("o:"), F.col("l_orderkey").cast("string"))
    return li.select(key.alias("key"), F.format_string("%s#s%02d", key, F.col("l_linenumber") - 1).alias("step_id"), (F.col("l_linenumber") - 1).alias("step_no"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text")).dropDuplicates(["step_id"])


def frames(events: DataFrame) -> DataFrame:
    """Events as progress frames: a user is a job, errors have failed."""
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("running").alias("state"), F.col("event_type").alias("message"),
        F.get_json_object("props", "$.k").cast("int").alias("units_read"), F.lit(100).alias("units_total"), F.floor("value").cast("int").alias("recipes_found"), F.length("props").alias("chars_read"),
    )


#: The same shapes in SQL, as common table expressions.
SQL = {
    "uses": "uses AS (SELECT DISTINCT 'o:' || l_orderkey AS key, p_name AS item FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "ingredients": "ingredients AS (SELECT DISTINCT p_name AS item, string_split(p_name, ' ')[2] AS category FROM part)",
    "recipes": "recipes AS (SELECT 'o:' || o_orderkey AS key, o_orderpriority AS course, n AS n_items, n >= 2 AS is_recipe FROM orders JOIN (SELECT key, count(DISTINCT item) AS n FROM uses GROUP BY key) ON key = 'o:' || o_orderkey)",
    "real": "real AS (SELECT key, course, n_items FROM recipes WHERE is_recipe)",
    "edges": "edges AS (SELECT DISTINCT key, item FROM uses JOIN real USING (key))",
    "words": "words AS (SELECT doc_id AS passage_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)",
    "post": "post AS (SELECT passage_id, term, count(*) AS tf FROM words GROUP BY ALL)",
    "qt": "qt AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL)",
    "len": "len AS (SELECT doc_id AS passage_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS dl FROM documents)",
    "idf0": "idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM post GROUP BY term), (SELECT count(*) AS n FROM documents))",
    "idf": "idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0)",
    "bm": "bm AS (SELECT query_id, passage_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM len)))) AS score FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN len USING (passage_id) GROUP BY ALL)",
    "bm25": "bm25 AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM bm)",
    "gram": """gram AS (SELECT 'p' AS kind, doc_id AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z_][0-9A-Za-z_]+'), lambda x: length(x) > 1) AS w FROM documents)
      UNION ALL SELECT 'q', item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9A-Za-z_][0-9A-Za-z_]+') AS w FROM benchmark))""",
    "tw": "tw AS (SELECT kind, id, g.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM (SELECT kind, id, term, count(*) AS tf FROM gram GROUP BY ALL) g JOIN (SELECT term, count(DISTINCT id) AS df FROM gram WHERE kind = 'p' GROUP BY term) d USING (term))",
    "norm": "norm AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM tw GROUP BY ALL)",
    "tf": "tf AS (SELECT q.id AS query_id, p.id AS passage_id, sum(q.w * p.w) / (any_value(a.n) * any_value(b.n)) AS score FROM tw q JOIN tw p ON q.term = p.term AND q.kind = 'q' AND p.kind = 'p' JOIN norm a ON a.kind = 'q' AND a.id = q.id JOIN norm b ON b.kind = 'p' AND b.id = p.id GROUP BY ALL)",
    "tfidf": "tfidf AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, passage_id) AS rank FROM tf)",
    "dn": "dn AS (SELECT q.vec_id AS query_id, p.vec_id AS passage_id, list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0)",
    "dense": "dense AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM dn)",
}


def with_(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def terms_sql(forms):
    """A list of the terms of lower(text), in SQL: word borders are those of all scripts."""
    border = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
    cases = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|{border})(?:{'|'.join(words)})($|{border})') THEN '{term}' END" for term, words in forms.items())
    return f"list_sort(list_filter([{cases}], lambda x: x IS NOT NULL))"
