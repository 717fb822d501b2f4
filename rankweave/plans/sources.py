"""Run files, questions and golden sets: written from orders to the shared folder, read back, compared with SQL over the orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankweave.functions.saved import shared_folder
from rankweave.operators import evaluate as E
from rankweave.plans.register import Plans
from rankweave.plans.standins import table
from rankweave.sources import runs as S

plans = Plans()
#: Orders of one run file.
RUN_ORDERS = 2000


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _orders(spark, d):
    """Orders as records of runs; the last run is of another type and some records name a type of their own."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    o = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("l"))
    key = F.col("l_orderkey")
    return o.select(
        F.floor(key / RUN_ORDERS).alias("run"), key.cast("string").alias("recipe_id"), F.concat(F.lit("Order "), key.cast("string")).alias("title"), F.when(key % 5 == 0, "pdf").alias("source_type"),
        F.when(key % 7 == 0, "by hand").alias("origin"), F.array((key % 100).cast("int")).alias("pages"), F.transform("l", lambda x: x["p_name"]).alias("ingredient_lines"), F.array(F.lit("Mix.")).alias("step_lines"),
    )


def _run_files(spark, d) -> str:
    """The folder of JSON run files: one for each run of orders, and one that is broken."""
    o = _orders(spark, d)
    recipe = F.struct(*(c for c in o.columns if c != "run"))
    runs = o.groupBy("run").agg(F.sort_array(F.collect_list(recipe)).alias("recipes"), F.count("*").cast("int").alias("n_recipes"))
    last = runs.agg(F.max("run").alias("last"))
    runs = runs.crossJoin(F.broadcast(last))  # one row
    told = F.struct(
        F.concat(F.lit("run "), F.col("run").cast("string")).alias("run_id"), F.when(F.col("run") == F.col("last"), "last").otherwise("web").alias("source_type"), F.concat(F.lit("orders of "), F.col("run").cast("string"), F.lit(".")).alias("origin"),
        (F.col("n_recipes") + 1).alias("n_units_total"), F.col("n_recipes").alias("n_units_read"), "n_recipes", "recipes",
    )
    folder = _folder(spark)
    broken = last.select(F.lit('{"run_id": "broken", "recipes": [').alias("value"), F.lit(-1).cast("long").alias("run"))
    runs.select(F.to_json(told).alias("value"), "run").unionByName(broken).repartition("run").write.partitionBy("run").text(folder)
    return f"{folder}/*"


RUNS = f"""WITH l AS (SELECT l_orderkey AS k, list(p_name ORDER BY l_linenumber, p_name) AS l FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
r AS (SELECT k, k // {RUN_ORDERS} AS run, l, k // {RUN_ORDERS} = (SELECT max(l_orderkey) // {RUN_ORDERS} FROM lineitem) AS last FROM l),
rec AS (SELECT 'run ' || run AS run_id, k::VARCHAR AS record_id, 'Order ' || k AS title, CASE WHEN k % 5 = 0 THEN 'pdf' WHEN last THEN 'last' ELSE 'web' END AS source_type,
  CASE WHEN k % 7 = 0 THEN 'by hand' ELSE 'orders of ' || run || '.' END AS origin, [(k % 100)::INT] AS pages, l AS ingredient_lines, ['Mix.'] AS step_lines,
  (row_number() OVER (PARTITION BY run ORDER BY k::VARCHAR) - 1)::INT AS record_no FROM r),
file AS (SELECT run, CASE WHEN any_value(last) THEN 'last' ELSE 'web' END AS source_type, 'orders of ' || run || '.' AS origin, count(*) AS n FROM r GROUP BY run) """


@plans(RUNS + "SELECT run_id, record_no, record_id, title, source_type, origin, pages, ingredient_lines, step_lines FROM rec")
def s01_read_runs(spark, d):
    r = S.read_runs(spark, _run_files(spark, d))
    return r.select("run_id", "record_no", "record_id", "title", "source_type", "origin", "pages", "ingredient_lines", "step_lines")


@plans(RUNS + "SELECT 'run ' || run AS run_id, n::INT AS n_recipes FROM file WHERE source_type = 'last'")
def s02_latest_run(spark, d):
    """The latest run of a type that one run has."""
    return S.latest_run(S.read_run_files(spark, _run_files(spark, d)), "last").select("run_id", "n_recipes")


@plans(RUNS + "SELECT 'by origin' AS choice, 'run ' || run AS run_id FROM file WHERE run = 0 UNION ALL SELECT 'fallback', 'run ' || run FROM file WHERE source_type = 'last'")
def s03_select_run(spark, d):
    runs = S.read_run_files(spark, _run_files(spark, d))
    by_origin = S.select_run(runs, "orders of 0.").select(F.lit("by origin").alias("choice"), "run_id")
    return by_origin.unionByName(S.select_run(runs, "nowhere", "last").select(F.lit("fallback").alias("choice"), "run_id"))


@plans(RUNS + "SELECT source_type, origin, n::INT AS n_records, n::INT AS n_units_read, (n + 1)::INT AS n_units_total FROM file")
def s04_list_runs(spark, d):
    return S.list_runs(S.read_run_files(spark, _run_files(spark, d))).select("source_type", "origin", "n_records", "n_units_read", "n_units_total")


@plans(RUNS + "SELECT count(DISTINCT run_id) AS n_runs, count(*) AS n_records, (SELECT count(DISTINCT p_name) FROM part JOIN lineitem ON l_partkey = p_partkey) AS n_names, list_sort(list(DISTINCT origin)) AS origins FROM rec")
def s05_corpus_stats(spark, d):
    r = S.read_runs(spark, _run_files(spark, d))
    return S.corpus_stats(r.withColumn("source", F.col("run_id")), r.select(F.explode("ingredient_lines").alias("canonical")))


@plans(r"SELECT item_id * 2 + 1 AS line_no, 'u_' || printf('%04d', item_id * 2 + 1) AS query_id, 'user' AS family, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM benchmark WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')")
def s07_read_questions(spark, d):
    """A list of the benchmark's texts, each followed by a line that does not count."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: F.concat(F.lit("  "), F.regexp_replace(x["text"], r"\s+", " "), F.when(x["item_id"] % 2 == 0, "\n").otherwise("\r\n# a comment"))), "\n")
    folder = _folder(spark)
    table(spark, d, "benchmark").agg(lines.alias("value")).write.text(folder)
    return S.read_questions(spark, folder).withColumn("line_no", F.col("line_no").cast("long"))


def _golden(spark, d):
    """A golden file of the benchmark's texts: records of over four content words, questions, and relevant ids."""
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "item_id", "text")
    recipe = F.struct("item_id", "id", F.concat(F.lit("T"), F.col("id")).alias("title"), F.array(F.col("item_id").cast("int")).alias("source_pages"), F.array(F.struct(F.lit("Rye").alias("name"), F.lit(None).cast("string").alias("display")), F.struct(F.lit("Beetroot").alias("name"), F.lit("two beetroots").alias("display"))).alias("ingredients"), F.array(F.struct("text")).alias("method"))
    span = F.struct("item_id", F.col("id").alias("recipe_id"), F.array(F.substring("text", 1, 20)).alias("atoms"))
    asked = F.struct("item_id", F.concat(F.lit("q"), F.col("id")).alias("query_id"), F.lit("lookup").alias("family"), F.concat(F.lit("What is "), F.col("id")).alias("question"), F.array("id", F.lit("0")).alias("relevant_ids"))
    whole = b.agg(*(F.array_sort(F.collect_list(c)).alias(n) for n, c in (("recipes", recipe), ("spans", span), ("queries", asked))))
    folder = _folder(spark)
    whole.select(F.to_json(F.struct("recipes", F.struct(F.lit("\n\n").alias("separator"), "spans").alias("corpus"), F.struct("queries").alias("evaluation"))).alias("value")).write.text(folder)
    return S.read_golden(spark, folder, E.content_words)


STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)


@plans(f"""WITH g AS (SELECT item_id::VARCHAR AS recipe_id, 'T' || item_id AS title, [item_id::INT] AS pages, list_sort(list_filter(list_distinct(regexp_extract_all(lower('T' || item_id || ' Rye two beetroots ' || text), '[a-z]+')), lambda x: length(x) > 3 AND x NOT IN ({STOP}))) AS words,
['beetroot'] AS ingredient_names, [left(text, 20)] AS atoms FROM benchmark) SELECT * FROM g WHERE len(words) >= 5""")
def s08_read_golden(spark, d):
    return _golden(spark, d)[0].select("recipe_id", "title", "pages", F.array_sort("words").alias("words"), "ingredient_names", "atoms")


@plans("SELECT 'q' || item_id AS query_id, 'lookup' AS family, 'What is ' || item_id AS question, true AS has_labels, list_sort(list_distinct([item_id::VARCHAR, '0'])) AS relevant FROM benchmark")
def s09_questions_for_eval(spark, d):
    """Labelled questions win over the plain list; with them what they call relevant."""
    _, labelled, qrels = _golden(spark, d)
    plain = labelled.withColumn("query_id", F.concat(F.lit("plain "), "query_id"))
    relevant = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("recipe_id")).alias("relevant"))
    return S.questions_for_eval(labelled, plain).join(relevant, "query_id")


@plans(RUNS + "SELECT source_type, run_id, record_id, title || CASE WHEN run_id = 'run 0' THEN ' again' ELSE '' END AS title, ingredient_lines FROM rec WHERE source_type <> 'pdf'")
def s10_write_run(spark, d):
    """All runs written, and one of them again: it replaces itself only."""
    o = _orders(spark, d)
    last = F.floor(F.lit(table(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0]) / RUN_ORDERS)
    r = o.where("source_type IS NULL").select(F.when(F.col("run") == last, "last").otherwise("web").alias("source_type"), F.concat(F.lit("run "), F.col("run").cast("string")).alias("run_id"), F.col("recipe_id").alias("record_id"), "title", "ingredient_lines")
    folder = _folder(spark)
    S.write_run(r, folder)
    S.write_run(r.where("run_id = 'run 0'").withColumn("title", F.concat("title", F.lit(" again"))), folder)
    return spark.read.parquet(folder).select("source_type", "run_id", "record_id", "title", "ingredient_lines")
