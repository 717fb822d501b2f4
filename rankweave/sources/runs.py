"""Ingestion runs, questions and golden sets: readers, writers, and a cache by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORD = (
    "recipe_id STRING, title STRING, source_type STRING, origin STRING, pages ARRAY<INT>, url STRING, ingredient_lines ARRAY<STRING>, "
    "step_lines ARRAY<STRING>, servings_hint STRING, time_hint STRING, detected_by STRING, raw_text STRING"
)
RUN = (
    "run_id STRING, source_type STRING, origin STRING, started_at STRING, finished_at STRING, elapsed_seconds DOUBLE, n_units_total INT, n_units_read INT, "
    f"n_units_empty INT, empty_units ARRAY<INT>, n_recipes INT, warnings ARRAY<STRING>, recipes ARRAY<STRUCT<{RECORD.replace(' STRING', ': STRING').replace(' ARRAY', ': ARRAY')}>>"
)
GOLDEN = (
    "recipes ARRAY<STRUCT<id: STRING, title: STRING, course: STRING, source_pages: ARRAY<INT>, ingredients: ARRAY<STRUCT<name: STRING, display: STRING>>, "
    "method: ARRAY<STRUCT<text: STRING>>>>, corpus STRUCT<corpus_sha256: STRING, separator: STRING, spans: ARRAY<STRUCT<recipe_id: STRING, atoms: ARRAY<STRING>>>>, "
    "evaluation STRUCT<queries: ARRAY<STRUCT<query_id: STRING, family: STRING, question: STRING, relevant_ids: ARRAY<STRING>, rationale: STRING>>>"
)

#: Runs are dealt by hash to so many parts before they are written: a part over Spark's advisory size is split, which gives all its runs more files.
PARTS = 2048


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run file that can be parsed, with the file's name, time and size."""
    raw = spark.read.schema(f"{RUN}, _corrupt_record STRING").option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    meta = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("file_size")]
    return raw.select("*", *meta).where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record; its type and origin fall back to the run's."""
    runs = read_run_files(spark, path).withColumnsRenamed({"source_type": "run_type", "origin": "run_origin"})
    rows = runs.select("run_id", "file", "modified", "run_type", "run_origin", F.posexplode_outer("recipes").alias("record_no", "r")).where("r IS NOT NULL")
    source = F.regexp_replace("file", r"\.json$", "").alias("source")
    kept = ["pages", "url", "ingredient_lines", "step_lines", "servings_hint", "time_hint", "detected_by", "raw_text"]
    return rows.select(
        source, "run_id", "file", "modified", "record_no", F.col("r.recipe_id").alias("record_id"), F.col("r.title").alias("title"),
        F.coalesce("r.source_type", "run_type").alias("source_type"), F.coalesce("r.origin", "run_origin").alias("origin"), *(F.col(f"r.{c}").alias(c) for c in kept),
    )


def latest_run(runs: DataFrame, source_type: str | None = None) -> DataFrame:
    """The newest run file, of a type if one is given; ties go by the file's name. Empty if there is none."""
    of_type = runs if source_type is None else runs.where(F.col("source_type") == source_type)
    return of_type.orderBy(F.desc("modified"), F.desc("file")).limit(1)


def select_run(runs: DataFrame, origin_like: str, source_type: str | None = None) -> DataFrame:
    """The first run by file name whose origin contains a string, or else the latest of the type."""
    of_type = runs if source_type is None else runs.where(F.col("source_type") == source_type)
    named = of_type.where(F.col("origin").contains(origin_like)).orderBy("file").limit(1).withColumn("choice", F.lit(0))
    return named.unionByName(latest_run(runs, source_type).withColumn("choice", F.lit(1))).orderBy("choice").limit(1).drop("choice")


def list_runs(runs: DataFrame) -> DataFrame:
    """An overview, newest first; records are counted, or taken from the header where the list is missing."""
    n = F.when(F.size("recipes") >= 0, F.size("recipes")).otherwise(F.col("n_recipes")).alias("n_records")
    return runs.select("file", "source_type", "origin", n, "n_units_read", "n_units_total", "started_at", "finished_at", "file_size", "modified").orderBy(F.desc("modified"), "file")


def corpus_stats(records: DataFrame, names: DataFrame) -> DataFrame:
    """One row: runs, records, distinct canonical names(canonical), sorted origins."""
    whole = records.agg(F.count_distinct("source").alias("n_runs"), F.count("*").alias("n_records"), F.array_sort(F.collect_set("origin")).alias("origins"))
    return whole.crossJoin(names.agg(F.count_distinct("canonical").alias("n_names")))


def read_pages(pages: DataFrame, id_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """(page_no, doc_id, title, text): blanks are collapsed, empty pages go, the title is the first full line."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(text_col), r"[ \t]+", " "), r"\n\s*\n+", "\n"))
    p = pages.select(F.col(id_col).alias("page_no"), text.alias("text")).where(r"text RLIKE '\\S'")
    first = F.trim(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)[0])
    return p.select("page_no", F.format_string("p_%04d", F.col("page_no")).alias("doc_id"), F.substring(first, 1, 180).alias("title"), "text")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, query_id, family, question) of a plain list; blank lines and those after # are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.select((F.col("at") + 1).alias("line_no"), F.trim("line").alias("question")).where("question != '' AND NOT startswith(question, '#')")
    return lines.select("line_no", F.format_string("u_%04d", "line_no").alias("query_id"), F.lit("user").alias("family"), "question")


def read_golden(spark: SparkSession, path: str, words: Callable) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(golden, questions, qrels) of a golden file; words(column) gives a text's content words."""
    g = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    spans = g.select(F.explode("corpus.spans").alias("s")).select("s.recipe_id", "s.atoms")
    r = g.select(F.posexplode("recipes").alias("ord", "r"))
    shown = F.transform("r.ingredients", lambda i: F.coalesce(i["display"], i["name"], F.lit("")))
    text = F.concat_ws(" ", F.col("r.title"), F.array_join(shown, " "), F.array_join(F.transform("r.method", lambda m: m["text"]), " "))
    names = F.filter(F.transform("r.ingredients", lambda i: F.lower(i["name"])), lambda n: F.length(n) > 3)
    golden = r.select("ord", F.col("r.id").alias("recipe_id"), F.col("r.title").alias("title"), F.col("r.source_pages").alias("pages"), words(text).alias("words"), names.alias("ingredient_names"))
    golden = golden.where(F.size("words") >= 5).join(spans, "recipe_id", "left")
    q = g.select(F.explode("evaluation.queries").alias("q")).select("q.query_id", "q.family", "q.question", "q.relevant_ids")
    return golden, q.drop("relevant_ids"), q.select("query_id", F.explode("relevant_ids").alias("recipe_id"))


def questions_for_eval(labelled: DataFrame, user: DataFrame) -> DataFrame:
    """(query_id, family, question, has_labels): the labelled questions if there are any, or else the plain list."""
    any_labelled = labelled.limit(1).select(F.lit(True).alias("some"))
    cols = ["query_id", "family", "question"]
    plain = user.select(*cols).join(any_labelled, F.lit(True), "left_anti").withColumn("has_labels", F.lit(False))
    return labelled.select(*cols).withColumn("has_labels", F.lit(True)).unionByName(plain)


def write_run(records: DataFrame, path: str) -> None:
    """Records as Parquet by type and run; a run that is written again replaces only itself.

    A run's records meet first, as else each task has a file for each run. Adaptive execution (Spark's default; without it
    the hint does nothing) joins small parts and deals a very large run to several tasks.
    """
    records.hint("rebalance", PARTS, "source_type", "run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_type", "run_id").parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A table (a vocabulary, labels, spans) as Parquet; given partitions replace only themselves."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def cached_apply(df: DataFrame, cache: DataFrame, key_cols: list[str], fn: Callable[[DataFrame], DataFrame], value_col: str) -> tuple[DataFrame, DataFrame]:
    """(df with value_col, cache with the new rows): fn runs on the distinct inputs that cache(hash, value) lacks.

    fn takes key_cols and adds value_col; a null value is a failure and isn't cached.
    """
    digest = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("\1")) for c in key_cols)), 256)
    hashed = df.withColumn("hash", digest)
    known = cache.select("hash", F.col("value").alias(value_col))
    missing = hashed.select("hash", *key_cols).dropDuplicates(["hash"]).join(known, "hash", "left_anti")
    new = fn(missing).select("hash", value_col).where(F.col(value_col).isNotNull())
    both = known.unionByName(new)
    return hashed.join(both, "hash", "left").drop("hash"), both.select("hash", F.col(value_col).alias("value"))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_at = 1").drop("_at")
