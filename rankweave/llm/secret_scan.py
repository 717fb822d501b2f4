"""Secret findings whose false positives a random forest removes.

Candidates are long runs of key characters (dots included), addresses with a user and a password, and
shorter words that mix letters, digits and marks or cases, in the words of whole texts. The forest
looks at a candidate's length, its changes between kinds of characters, how much of it the corpus's
own short words cover, the path it is in, and the words next to it. Which neighbours and paths matter
it learns, as they come hashed; whether one of the neighbours names a secret at all is a feature
besides, so that what it learns of one name holds for names that no label has. It learns from labelled findings; where there are none,
distant_labels() names half of those of which the form alone is proof, and leaves the others to the forest. All
of it is DataFrame expressions and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import saved

#: Rows of each label that the forest learns from, and words of the dictionary. More of either refine probabilities; candidates and findings do not depend on them.
MAX_TRAINING, DICTIONARY_WORDS = 20_000, 300
HASHED = 256
#: Fixed forms: of candidates, of what surrounds a value in its word, and of issued keys.
CANDIDATE = (
    r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@[^\s]+"
    r"|[A-Za-z0-9+/_=~-][A-Za-z0-9+/_=.~-]{14,}[A-Za-z0-9+/_=~-]"
    r"|(?=[!-~]*[0-9])(?=[!-~]*[A-Za-z])(?=[!-~]*(?:[^A-Za-z0-9.,-]|[a-z][A-Z]))[!-~]{8,}"
)
ASSIGNED = r"^([A-Za-z_][A-Za-z0-9_.-]*)[\x22\x27]?[:=]+(?!//)[\x22\x27]?"
AROUND = r"^[\x22\x27`(<\[{]+|[\x22\x27`)>\]},;.!?:]+$"
ISSUED = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@[^\s]+)$"
SHORT_HEX = r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,})$"
HEX_KEY, SECRET_NAME = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$", r"(?i)(token|secret|passw|pwd|api.?key|auth|bearer|credential|private)"
PLAIN, MAIL = r"^(?:[A-Za-z]+|[0-9]+|[a-z]+(?:[-_/.][a-z]+)+)$", r"^[^\s@:/]+@[^\s@:/]+\.[A-Za-z]{2,}\W*$"
FEATURES = ("length", "changes", "digits", "capitals", "letters", "kinds", "covered", "quoted", "named")
CONTEXT = ("name", "before", "before2", "after", "folder", "ending")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, path, place, value, word, name, before, before2, after): place is the word's number in the text, from 0.

    name is what the value is assigned to within its word, before, before2 and after the letters of
    the words next to it; each is empty where there is none. Null, empty and blank texts have none; texts count
    whole, however long; rows that repeat a doc_id have theirs each, and a null doc_id too. A null path is empty.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    d = d.where(F.col("text").rlike(r"[0-9]|[!-~]{16}")).select("doc_id", "path", F.split("text", r"[\x20\x09-\x0D]+").alias("words"))
    long = "filter(transform(words, (w, i) -> struct(w AS word, i AS place)), s -> length(s.word) >= 8 AND s.word RLIKE '[0-9]|[!-~]{16}')"
    d = d.select("doc_id", "path", "words", F.explode_outer(F.expr(long)).alias("s")).where("s IS NOT NULL")
    letters = lambda place: F.expr(f"lower(regexp_replace(coalesce(get(words, s.place {place}), ''), '[^A-Za-z]', ''))")
    d = d.select("doc_id", "path", F.col("s.word").alias("word"), F.col("s.place").alias("place"), letters("- 1").alias("before"), letters("- 2").alias("before2"), letters("+ 1").alias("after"))
    core = F.regexp_replace("word", AROUND, "")
    d = d.withColumn("name", F.lower(F.regexp_extract(core, ASSIGNED, 1))).withColumn("value", F.explode(F.regexp_extract_all(F.regexp_replace(core, ASSIGNED, ""), F.lit(CANDIDATE), F.lit(0))))
    return d.select("doc_id", "path", "place", "value", "word", "name", "before", "before2", "after")


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of three to six ASCII letters, counted over all whole texts; ties go by the alphabet. Null and empty texts have none."""
    short = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"(?<![a-z])[a-z]{3,6}(?![a-z])"), F.lit(0))).alias("word"))
    top = short.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(words)
    return [r["word"] for r in top.collect()]


def _named() -> Column:
    """Whether the name of a candidate, or a word just before it, says that a secret follows."""
    return F.concat_ws(" ", "name", "before", "before2").rlike(SECRET_NAME)


def features(found: DataFrame, known: list[str]) -> DataFrame:
    """Adds FEATURES and CONTEXT to candidates."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    rest = F.length(F.regexp_replace(F.lower(v), "(?:" + "|".join(sorted(known, key=lambda w: (-len(w), w))) + ")", "")) if known else F.length(v)
    columns = {
        "length": n, "changes": share(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"),
        "digits": share("[0-9]"), "capitals": share("[A-Z]"), "letters": share("[A-Za-z]"), "kinds": F.size(F.array_distinct(F.split(v, ""))) / n,
        "covered": 1 - rest / n, "quoted": F.col("word").rlike("[\"'`]"), "named": _named(),
    }
    found = found.select("*", *(columns[c].cast("double").alias(c) for c in FEATURES))
    return found.withColumn("folder", F.regexp_extract("path", "^(?:.*/)?([^/]+)/[^/]*$", 1)).withColumn("ending", F.lower(F.regexp_extract("path", r"([^/.]+)$", 1)))


def distant_labels(found: DataFrame) -> DataFrame:
    """(doc_id, value, secret) of candidates whose form is proof: issued keys, hexadecimal keys that are named so, and shorter ones that are assigned to such a name; words, numbers and mail addresses.

    Only every second of such values has its label, by a hash; for the others what the forest learnt of these must do. Others
    have no label either. A value that is labelled twice in a document is a secret if one place says so.
    """
    true = F.col("value").rlike(ISSUED) | (F.col("value").rlike(HEX_KEY) & _named()) | (F.col("value").rlike(SHORT_HEX) & F.col("name").rlike(SECRET_NAME))
    label = F.when(true, 1).when(F.col("value").rlike(PLAIN) | F.col("value").rlike(MAIL), 0)
    taught = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    return found.where(taught).select("doc_id", "value", label.alias("secret")).where("secret IS NOT NULL").distinct()


def secrets(
    docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5, trees: int = 40, max_training: int = MAX_TRAINING
) -> DataFrame:
    """(doc_id, place, value, probability): the findings that the forest takes for secrets.

    labelled(doc_id, value, secret 0/1) are findings somebody has judged; of each label about
    max_training are learnt from, drawn by a hash. Without labels of both kinds nothing can be
    learnt, and all candidates are returned with a probability of null. Null and empty texts have no
    candidates, very long ones all of theirs; rows that repeat a doc_id give their findings each; a
    null path is an empty one. A probability that ties with threshold is a finding. An empty table
    gives an empty result. Other columns are ignored. Jobs run when this is called.
    """
    found = saved(features(candidates(docs, id_col, text_col, path_col), dictionary(docs, text_col)))
    labelled = (distant_labels(found) if labelled is None else labelled).select("doc_id", "value", F.col("secret").cast("double").alias("label")).where("label IS NOT NULL")
    labelled = labelled.groupBy("doc_id", "value").agg(F.max("label").alias("label"))
    judged = saved(found.join(labelled, ["doc_id", "value"]).select("label", "doc_id", "value", "place", *FEATURES, *CONTEXT))
    sizes = {r["label"]: r["count"] for r in judged.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return found.select("doc_id", "place", "value", F.lit(None).cast("double").alias("probability"))
    drawn = F.pmod(F.xxhash64("doc_id", "value", "place"), F.lit(1 << 30))
    training = judged.where(" OR ".join(f"label = {k}" for k in sizes))
    for label, n in sizes.items():
        training = training.where((F.col("label") != label) | (drawn < int((1 << 30) * min(1.0, max_training / n))))
    # The forest draws rows by partition and order; these depend on the rows alone, so equal rows give an equal forest.
    training = training.repartition(8, "doc_id", "value", "place").sortWithinPartitions("doc_id", "value", "place", *FEATURES, *CONTEXT)
    # Both labels weigh the same: how often the labelled ones are secrets says nothing about the others.
    weight = F.lit(0.0)
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, 1 / min(n, max_training)).otherwise(weight)
    training = training.withColumn("weight", weight * min(*sizes.values(), max_training))
    hashed = FeatureHasher(inputCols=list(CONTEXT), outputCol="hashed", numFeatures=HASHED)
    vectors = VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", probabilityCol="chance", numTrees=trees, maxDepth=8, featureSubsetStrategy="0.2", seed=7)
    model = forest.fit(vectors.transform(hashed.transform(training)).select("label", "weight", "vector"))
    rated = model.transform(vectors.transform(hashed.transform(found))).withColumn("probability", F.round(vector_to_array("chance")[1], 6))
    return rated.where(F.col("probability") >= threshold).select("doc_id", "place", "value", "probability")
