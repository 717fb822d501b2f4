"""Questions: expansion, constraints read from replies, conversations and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.operators.graph import COURSES

# Families, their words, and the openings of follow-ups.
FAMILIES = ("dairy", "gluten", "nut", "meat", "fish", "egg")
TAG_TERMS = {
    "dairy": "milk ghee butter yogurt curd cream paneer cheese", "gluten": "wheat flour semolina rava vermicelli maida", "nuts": "almond cashew pistachio peanut walnut",
    "meat": "chicken lamb mutton beef pork", "fish": "fish prawn shrimp crab", "egg": "egg eggs",
}
FOLLOW_UP = (
    r"(?i)^\s*(what about|how about|and |but |ok |okay |also |instead|can i|could i|is there|any other|the second|the first|that one|"
    r"without|with |make it|same |show me more|more\b)"
)
# End of fixed values.


# Forms of questions that have two parts.
SWAP = r"instead of (.+?)\?|run out of (.+?)\.|replacement for (.+?)\?"
COURSE = r"^A (\w+) dish with no (\w+) in it\.$"
AVOID = r"^I am avoiding (\w+)\. What can I make\?$"
DIET = r"^A (vegetarian|vegan) (\w+)\.$"
TIME = r"(?:finish in|only have) (\d+) minutes"
# End of fixed values.


def _variants(q: DataFrame, extra: Column) -> DataFrame:
    texts = F.concat(F.array("question"), F.coalesce(extra, F.array().cast("array<string>")))
    return q.select(F.col("query_id").alias("of"), F.posexplode(texts).alias("variant", "text")).select(F.concat_ws("#", F.col("of").cast("string"), F.col("variant").cast("string")).alias("query_id"), "of", "variant", "text")


def expand_passthrough(questions: DataFrame) -> DataFrame:
    """questions(query_id, question) -> (query_id, of, variant, text): the question itself."""
    return _variants(questions, F.lit(None).cast("array<string>"))


def expand_decompose(questions: DataFrame, split_col: str | None = None) -> DataFrame:
    """The question and the two parts of the first template that fits, or else up to three lines of a model's split."""
    q = F.col("question")
    tag = F.create_map(*(F.lit(x) for pair in TAG_TERMS.items() for x in pair))
    part = lambda pattern, group: F.regexp_extract(q, pattern, group)
    words = lambda c: F.coalesce(F.element_at(tag, c), c)
    term = F.concat(part(SWAP, 1), part(SWAP, 2), part(SWAP, 3))
    parts = (
        F.when(q.rlike(COURSE), F.array(F.concat(part(COURSE, 1), F.lit(" recipe")), words(part(COURSE, 2)))).when(q.rlike(AVOID), F.array(F.lit("recipe"), words(part(AVOID, 1))))
        .when(q.rlike(DIET), F.array(F.concat(part(DIET, 2), F.lit(" recipe")), part(DIET, 1))).when(q.rlike(SWAP), F.array(F.concat(F.lit("recipes using "), term), F.concat(F.lit("substitute for "), term)))
        .when(q.rlike(TIME), F.array(F.lit("quick recipe short cooking time"), F.concat(part(TIME, 1), F.lit(" minutes"))))
    )
    if split_col:
        lines = F.filter(F.transform(F.split(split_col, r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \-*]+|[ \-*]+$", "")), lambda x: x != "")
        parts = F.coalesce(parts, F.slice(lines, 1, 3))
    return _variants(questions, parts)


def expand_hypothetical(questions: DataFrame, document_col: str) -> DataFrame:
    """The question and, if it isn't blank, a hypothetical document that a model has written."""
    return _variants(questions, F.when(F.col(document_col).rlike(r"\S"), F.array(document_col)))


def parse_constraints(replies: DataFrame, reply_col: str = "reply", courses: tuple[str, ...] = COURSES) -> DataFrame:
    """replies with include, exclude, exclude_categories, substitute_for, course, dish and source ("model" or "unparsed")."""
    kind = "include STRING, exclude STRING, exclude_categories STRING, substitute_for STRING, course STRING, dish STRING"
    r = replies.withColumn("_j", F.from_json(F.nullif(F.regexp_extract(F.coalesce(reply_col, F.lit("")), r"(?s)(\{.*\})", 1), F.lit("")), kind + ", _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    ok = F.col("_j").isNotNull() & F.col("_j._corrupt_record").isNull()
    none = F.array().cast("array<string>")

    def strings(name: str) -> Column:
        values = F.from_json(F.col(f"_j.{name}"), "array<string>")
        clean = F.filter(F.transform(F.coalesce(values, none), lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != "")
        return F.when(ok & F.col(f"_j.{name}").rlike(r"^\s*\["), clean).otherwise(none)

    families = F.array(*map(F.lit, FAMILIES))
    text = lambda name: F.when(ok, F.trim(F.coalesce(F.col(f"_j.{name}"), F.lit("")))).otherwise("")
    out = r.withColumns({"include": F.filter(strings("include"), lambda x: ~x.isin(*FAMILIES)), "_ex": strings("exclude"), "substitute_for": F.lower(text("substitute_for")), "dish": text("dish"), "_c": F.lower(text("course"))})
    out = out.withColumn("exclude_categories", F.array_union(F.filter(strings("exclude_categories"), lambda x: x.isin(*FAMILIES)), F.array_intersect("_ex", families)))
    out = out.withColumn("exclude", F.filter("_ex", lambda x: ~x.isin(*FAMILIES) & ((F.col("substitute_for") == "") | (x != F.col("substitute_for")))))
    return out.withColumn("course", F.when(F.col("_c").isin(*courses), F.col("_c")).otherwise("")).withColumn("source", F.when(ok, "model").otherwise("unparsed")).drop("_j", "_ex", "_c")


def constraint_flags(df: DataFrame) -> DataFrame:
    """df with restricting (it excludes something), narrows (it sets any condition) and empty (it says nothing)."""
    restricting = (F.size("exclude") > 0) | (F.size("exclude_categories") > 0)
    narrows = restricting | (F.size("include") > 0) | (F.col("course") != "")
    return df.withColumns({"restricting": restricting, "narrows": narrows, "empty": ~narrows & (F.col("substitute_for") == "") & (F.col("dish") == "")})


def conversation_summary(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> (conv_id, title, n_turns, last_turn), those with most turns first."""
    title = F.substring(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), 1, 58)
    return turns.groupBy("conv_id").agg(title.alias("title"), F.count("*").alias("n_turns"), F.max("turn").alias("last_turn")).orderBy(F.desc("last_turn"), "conv_id")


def transcript(turns: DataFrame, n: int = 6) -> DataFrame:
    """Each user turn with the last n turns before it, 300 characters of each."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.concat(F.when(F.col("role") == "user", "You: ").otherwise("Assistant: "), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    t = turns.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))
    return t.where("role = 'user'").select("conv_id", "turn", "text", "history")


def has_subject(questions: DataFrame, names: DataFrame, id_cols: list[str], col: str = "question") -> DataFrame:
    """questions with has_subject: is any one or two of its words, of over three characters, in names(canonical)."""
    w = questions.select(*id_cols, F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = F.expr("if(size(w) < 2, array(), transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i])))")
    phrases = w.select(*id_cols, F.explode(F.array_distinct(F.concat("w", pairs))).alias("canonical")).where(F.length("canonical") > 3)
    named = phrases.join(names.select("canonical").distinct(), "canonical", "left_semi").select(*id_cols).distinct().withColumn("has_subject", F.lit(True))
    return questions.join(named, id_cols, "left").withColumn("has_subject", F.coalesce("has_subject", F.lit(False)))


def is_follow_up(df: DataFrame, col: str = "question") -> DataFrame:
    """df(has_subject) with follow_up."""
    n = F.size(F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda x: x != ""))
    opens = F.coalesce(F.col(col), F.lit("")).rlike(FOLLOW_UP)
    return df.withColumn("follow_up", F.when(opens, ~F.col("has_subject") | (n <= 5)).otherwise((n <= 4) & ~F.col("has_subject")))


def resolve_follow_ups(questions: DataFrame, rewrites: DataFrame, id_cols: list[str]) -> DataFrame:
    """questions(question, history, follow_up) with resolved and rewritten; rewrites(id_cols, reply) come from a model."""
    q = questions.join(rewrites.select(*id_cols, "reply"), id_cols, "left")
    reply = F.regexp_replace(F.trim("reply"), '^"+|"+$', "")
    use = F.col("follow_up") & (F.coalesce("history", F.lit("")) != "") & F.coalesce((reply != "") & (F.length(reply) <= 400), F.lit(False))
    out = q.withColumn("resolved", F.when(use, reply).otherwise(F.col("question")))
    return out.withColumn("rewritten", use & (F.lower("resolved") != F.lower(F.trim("question")))).drop("reply")
