"""Prompts from ranked passages, and answers from what a model made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marker of a refusal and the prompts.
REFUSAL = "NOT_IN_CONTEXT"
JOINER = "\n\n---\n\n"
ANSWER_PROMPT = "Recipes:\n%s\n\nQuestion: %s\n\nAnswer using only the recipes above. List ingredients with their quantities where given."
STRUCTURED_PROMPT = (
    "Recipes:\n%s\n\nQuestion: %s\n\nAnswer using only the recipes above, in exactly this shape:\n\nDISH: <name, or NOT_IN_CONTEXT if the recipes do not answer the question>\nINGREDIENTS:\n"
    '- <ingredient with quantity where given>\nSTEPS:\n1. <step>\nNOTES: <anything the recipes say about timing or servings, or "none">\n\nDo not add an ingredient that is not listed above.'
)
MAP_PROMPT = (
    "Recipe:\n%s\n\nQuestion: %s\n\nIf this recipe helps answer the question, summarise only the relevant part in at\nmost three lines, keeping quantities exactly as written. If it does not help,\n"
    "reply NOT_IN_CONTEXT and nothing else."
)
REDUCE_PROMPT = "Notes gathered from separate recipes:\n%s\n\nQuestion: %s\n\nWrite one answer from these notes. Use only what they say. If none of them\nanswer the question, reply NOT_IN_CONTEXT."
# End of fixed values.


def _joined(hits: DataFrame, key: Column) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("passage_id"), F.col("text"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), JOINER).alias("context"), F.transform(rows, lambda x: x["passage_id"]).alias("passages"))


def _prompted(joined: DataFrame, questions: DataFrame, prompt: str) -> DataFrame:
    return questions.select("query_id", "question").join(joined, "query_id").withColumn("prompt", F.format_string(prompt, "context", "question"))


def contexts_stuffed(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """hits(query_id, passage_id, rank, text) -> (query_id, question, context, passages, prompt), passages in rank order."""
    return _prompted(_joined(hits, F.col("rank")), questions, ANSWER_PROMPT)


def contexts_reordered(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """As contexts_stuffed, with the best passages at both ends: ranks 1, 3, 5 ... 6, 4, 2."""
    key = F.when(F.col("rank") % 2 == 1, F.col("rank")).otherwise(F.lit(10**9) - F.col("rank"))
    return _prompted(_joined(hits, key), questions, ANSWER_PROMPT)


def contexts_structured(hits: DataFrame, questions: DataFrame) -> DataFrame:
    return _prompted(_joined(hits, F.col("rank")), questions, STRUCTURED_PROMPT)


def map_prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """One prompt for each passage."""
    return hits.join(questions.select("query_id", "question"), "query_id").select("query_id", "rank", "passage_id", "question", F.format_string(MAP_PROMPT, "text", "question").alias("prompt"))


def reduce_prompts(notes: DataFrame, questions: DataFrame) -> DataFrame:
    """notes(query_id, rank, note) -> (query_id, question, prompt, refused): notes that say something; without any, a refusal and no prompt."""
    said = notes.where(~F.col("note").contains(REFUSAL) & F.col("note").rlike(r"\S"))
    g = said.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.trim("note").alias("note")))), lambda x: F.concat(F.lit("- "), x["note"])), "\n\n").alias("notes"))
    out = questions.select("query_id", "question").join(g, "query_id", "left")
    return out.select("query_id", "question", F.when(F.col("notes").isNotNull(), F.format_string(REDUCE_PROMPT, "notes", "question")).alias("prompt"), F.col("notes").isNull().alias("refused"))


def finalise_answers(questions: DataFrame, replies: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, question, text, passages, refused, model, elapsed_s); no context or no reply is a refusal."""
    out = questions.select("query_id", "question").join(contexts.select("query_id", "passages"), "query_id", "left").join(replies.select("query_id", "reply", "model", "elapsed_s"), "query_id", "left")
    text = F.when(F.col("passages").isNull(), F.lit(REFUSAL)).otherwise(F.coalesce("reply", F.lit(REFUSAL)))
    return out.select("query_id", "question", text.alias("text"), F.coalesce("passages", F.array().cast(dict(contexts.dtypes)["passages"])).alias("passages"), text.contains(REFUSAL).alias("refused"), "model", F.round("elapsed_s", 2).alias("elapsed_s"))


def citations(contexts: DataFrame) -> DataFrame:
    """contexts(query_id, rank, source, doc_ids, text) -> (query_id, rank, key, label): each first record once, in order of rank."""
    label = F.substring(F.trim(F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"\S"))[0]), 1, 58)
    c = contexts.where("source IS NOT NULL AND source != '' AND size(doc_ids) > 0").select("query_id", "rank", F.concat_ws(":", "source", F.col("doc_ids")[0]).alias("key"), label.alias("label"))
    return c.groupBy("query_id", "key").agg(F.min("rank").alias("rank"), F.min_by("label", "rank").alias("label"))


def compliance_badge(scores: DataFrame, col: str = "respected") -> DataFrame:
    """scores with badge; null for an unrestricted question."""
    return scores.withColumn("badge", F.when(F.col(col) == 1, "respects what you excluded").when(F.col(col).isNotNull(), "may include something you excluded"))
