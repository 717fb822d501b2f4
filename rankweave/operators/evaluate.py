"""Scores of chunking, ranking, set answers and generated answers. Null means unknown, zero means bad."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.numbering import numbered
from rankweave.functions.saved import saved
from rankweave.operators.automaton import contained
from rankweave.operators.vocab import normalised, resolve

# Words without content, and prices in USD for a million tokens (in, out).
STOP_WORDS = (
    "the", "and", "for", "with", "into", "from", "that", "this", "then", "are", "was", "add", "until", "about", "all", "its", "you", "your", "have", "has", "not", "but", "any", "over", "off", "out",
    "use", "using", "can", "let", "tsp", "tbsp", "cup", "cups", "teaspoon", "teaspoons", "tablespoon", "tablespoons", "gram", "grams", "litre", "litres", "ounce", "ounces", "minute", "minutes", "hour",
    "hours", "each", "some", "more", "few", "little", "well", "also", "when", "while", "till", "salt", "water", "oil",
)
PRICES = (("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00))
# End of fixed values.
FAMILY_TOTAL = "(all)"


def content_words(text: Column) -> Column:
    """Distinct words of at least four ASCII letters, without stop words."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return F.filter(w, lambda x: (F.length(x) > 3) & ~x.isin(*STOP_WORDS))


# --- chunks ---------------------------------------------------------------------------------------
def word_overlap(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """golden(record_id, words), chunks(passage_id, text) -> (record_id, passage_id, purity, recall) of the chunk that shares most words, the first on a tie."""
    c = chunks.select("passage_id", content_words(F.col("text")).alias("w"))
    g = golden.select("record_id", F.array_distinct("words").alias("gw"))
    met = g.select("record_id", F.explode("gw").alias("word")).join(c.select("passage_id", F.explode("w").alias("word")), "word").groupBy("record_id", "passage_id").agg(F.count("*").alias("n"))
    best = met.withColumn("at", F.row_number().over(Window.partitionBy("record_id").orderBy(F.desc("n"), "passage_id"))).where("at = 1")
    out = g.join(best, "record_id", "left").join(c, "passage_id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("record_id", "passage_id", F.coalesce(n / F.nullif(F.size("w"), F.lit(0)), F.lit(0.0)).alias("purity"), F.coalesce(n / F.nullif(F.size("gw"), F.lit(0)), F.lit(0.0)).alias("recall"))


def word_scores(overlap: DataFrame) -> DataFrame:
    return overlap.agg(F.round(F.avg("purity"), 4).alias("word_purity"), F.round(F.avg("recall"), 4).alias("word_recall"), F.count("*").alias("n_records"))


#: Chunks of a record that one step of the cover looks at.
COVER_GROUP = 1024


def _covered(part: pd.DataFrame, most: int) -> tuple[list, float, int, bool]:
    """(words newly held, need left, picks, is it done) by greedy picks that no chunk outside part could beat.

    part is in order of the number of words left, and a last row beyond COVER_GROUP is only a bound: a chunk's gain never
    grows, so nothing outside gains more than that row. The first pick is always sure.
    """
    held, ids = [set(h) for h in part["held"]], part["passage_id"].tolist()
    bound = len(held[COVER_GROUP]) if len(held) > COVER_GROUP else 0
    held, ids = held[:COVER_GROUP], ids[:COVER_GROUP]
    need, picks, taken = float(part["need"].iloc[0]), 0, set()
    while need > 0 and picks < most:
        gains = [len(h) for h in held]
        best = max(gains, default=0)
        if not best or (picks and best <= bound):
            return sorted(taken), need, picks, not best and not bound
        new = set(held[min((i for i, g in enumerate(gains) if g == best), key=lambda i: ids[i])])
        taken |= new
        held, need, picks = [h - new for h in held], need - len(new), picks + 1
    return sorted(taken), need, picks, True


def k_at_target(golden: DataFrame, chunks: DataFrame, target: float = 0.9, most: int = 25) -> DataFrame:
    """(record_id, k): how many chunks a greedy cover takes to hold the share target of the record's words; jobs run at once.

    A pick is the chunk with the most words not yet held, the smallest passage_id on a tie. A step gathers the
    COVER_GROUP best chunks of each record and picks as long as no other chunk could gain as much, so a few
    steps do for most records whatever their chunks. Sets of words that are left alike, or empty, are merged after each step.
    """
    # a chunk's words stay together, so that its sets are made where they lie if the golden records are few enough to be broadcast
    c = chunks.select("passage_id", content_words(F.col("text")).alias("w")).repartition("passage_id").select("passage_id", F.explode("w").alias("word"))
    g = golden.select("record_id", F.size(F.array_distinct("words")).alias("n_words"), F.explode(F.array_distinct("words")).alias("word"))
    met = c.join(g, "word").groupBy("passage_id", "record_id", "n_words").agg(F.array_sort(F.collect_set("word")).alias("held"))
    left = met.withColumn("need", target * F.col("n_words")).where("need > 0").groupBy("record_id", "need", "held").agg(F.min("passage_id").alias("passage_id")).withColumn("k", F.lit(0))
    kind = dict(golden.dtypes)["record_id"]

    def step(part: pd.DataFrame) -> pd.DataFrame:
        done = int(part["k"].iloc[0])
        words, need, picks, ended = _covered(part.sort_values("at"), most - done)
        return pd.DataFrame({"record_id": part["record_id"].iloc[:1], "taken": [words], "need": [need], "k": [done + picks], "ended": [ended or done + picks >= most]})

    order = Window.partitionBy("record_id").orderBy(F.desc(F.size("held")), "passage_id")
    counted = []
    while True:
        left = saved(left)
        group = left.withColumn("at", F.row_number().over(order)).where(F.col("at") <= COVER_GROUP + 1)
        steps = saved(group.groupBy("record_id").applyInPandas(step, f"record_id {kind}, taken array<string>, need double, k int, ended boolean"))
        counted.append(steps.where("ended").select("record_id", "k"))
        going = steps.where("NOT ended")
        if going.isEmpty():
            break
        rest = left.select("record_id", "held", "passage_id").join(going, "record_id").select("record_id", "need", F.array_except("held", "taken").alias("held"), "passage_id", "k")
        left = rest.groupBy("record_id", "need", "held", "k").agg(F.min("passage_id").alias("passage_id"))
    return golden.select("record_id").join(reduce(DataFrame.unionByName, counted), "record_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))


def strided(df: DataFrame, n: int, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Every row if there are at most n, else the rows at floor(i * count / n) in an order, for each of keys; a job runs at once.

    Rows are numbered over a range partitioned order of any kind of columns, so no task has all rows.
    """
    placed = numbered(df, *keys, *order, number="_n")
    same = [F.col(f"_of_{k}").eqNullSafe(F.col(k)) for k in keys]
    sizes = placed.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.min("_n").alias("_base"), F.count("*").alias("_size"))
    placed = placed.join(sizes, reduce(lambda a, b: a & b, same, F.lit(True))) if keys else placed.crossJoin(F.broadcast(sizes))  # one row
    at, size = F.col("_n") - F.col("_base"), F.col("_size")
    step = F.floor(F.ceil(at * n / size) * size / n)
    return placed.where((size <= n) | ((step == at) & (F.ceil(at * n / size) < n))).select(*df.columns)


def self_sufficiency(chunks: DataFrame, chunk_vecs: DataFrame, record_vecs: DataFrame, sample: int = 120) -> DataFrame:
    """One row: the mean of 1 / rank of a chunk's own record among all records, by vectors, over a strided sample.

    chunks(passage_id, main_doc), vectors (passage_id, vec) and (record_id, vec); chunks that own no record are left out.
    """
    from rankweave.functions.vectors import dot

    s = strided(chunks.where("main_doc IS NOT NULL"), sample, ["passage_id"]).join(chunk_vecs.select("passage_id", "vec"), "passage_id")
    own = s.join(record_vecs.select(F.col("record_id").alias("main_doc"), F.col("vec").alias("rv")), "main_doc").select("passage_id", "vec", dot(F.col("vec"), F.col("rv")).alias("own"))
    above = record_vecs.select("record_id", F.col("vec").alias("rv")).crossJoin(F.broadcast(own.limit(sample))).where(dot(F.col("vec"), F.col("rv")) > F.col("own") + 1e-12)  # own has at most `sample` rows
    ranks = own.select("passage_id").join(above.groupBy("passage_id").agg(F.count("*").alias("n")), "passage_id", "left").select((1 / (1 + F.coalesce("n", F.lit(0)))).alias("r"))
    return ranks.agg(F.round(F.avg("r"), 4).alias("self_sufficiency"), F.count("*").alias("n_chunks"))


def chunk_profile(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"))


# --- fingerprints ---------------------------------------------------------------------------------
def containing(texts: DataFrame, text_id: str, atoms: DataFrame) -> DataFrame:
    """(text_id, record_id, atom) where the whole text contains the atom of atoms(record_id, atom)."""
    a = atoms.select("record_id", "atom").distinct()
    return contained(texts, text_id, a).join(a, "atom").select(text_id, "record_id", "atom")


def fingerprints(golden: DataFrame, docs: DataFrame, least_chars: int = 8, most_docs: int = 3) -> DataFrame:
    """golden(record_id, title, atoms), docs(doc_id, text) -> (record_id, title, title_atom, atoms, usable): atoms that one to three documents contain."""
    a = golden.select("record_id", F.posexplode("atoms").alias("at", "atom")).where(F.length("atom") >= least_chars)
    n = containing(docs, "doc_id", a.select("record_id", "atom")).groupBy("record_id", "atom").agg(F.count_distinct("doc_id").alias("n")).where(F.col("n").between(1, most_docs))
    kept = a.join(n, ["record_id", "atom"]).join(golden.select("record_id", "title"), "record_id")
    g = kept.groupBy("record_id").agg(F.array_sort(F.collect_set("atom")).alias("atoms"), F.max_by(F.when(F.col("title").contains(F.col("atom")), F.col("atom")), F.when(F.col("title").contains(F.col("atom")), F.col("at"))).alias("title_atom"))
    out = golden.select("record_id", "title").join(g, "record_id", "left").withColumn("atoms", F.coalesce("atoms", F.array().cast("array<string>")))
    return out.withColumn("usable", F.col("title_atom").isNotNull() | (F.size("atoms") >= 2))


def match_records(passages: DataFrame, prints: DataFrame, id_col: str = "passage_id") -> DataFrame:
    """(passage, record_id) where the passage contains the record's title atom or two of its atoms."""
    u = prints.where("usable")
    met = containing(passages, id_col, u.select("record_id", F.explode("atoms").alias("atom"))).distinct().join(u.select("record_id", "title_atom"), "record_id")
    g = met.groupBy(id_col, "record_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col("atom") == F.col("title_atom")), F.lit(False)).alias("by_title"))
    return g.where("n >= 2 OR by_title").select(id_col, "record_id")


def fingerprint_report(prints: DataFrame) -> DataFrame:
    u = F.col("usable")
    return prints.agg(F.count("*").alias("total"), F.sum(u.cast("long")).alias("usable"), F.sum(F.col("title_atom").isNotNull().cast("long")).alias("with_title_atom"), F.round(F.avg(F.when(u, F.size("atoms"))), 4).alias("mean_atoms"), F.array_sort(F.collect_list(F.when(~u, F.col("record_id")))).alias("unusable"))


def golden_map(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(record_id, doc_ids): the documents that a golden record is, by content."""
    return match_records(docs, prints, "doc_id").groupBy("record_id").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def sample_questions(questions: DataFrame, limit: int, family: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """A strided sample of questions(query_id, family), of one family, and with a label in known(query_id), if these are given."""
    q = questions if family is None else questions.where(F.col("family") == family)
    q = q if known is None else q.join(known.select("query_id").distinct(), "query_id", "left_semi")
    return strided(q, limit, ["query_id"])


# --- ranking --------------------------------------------------------------------------------------
def collapse_to_records(hits: DataFrame, matches: DataFrame, golden_order: DataFrame) -> DataFrame:
    """hits(query_id, passage_id, rank), matches(passage_id, record_id), golden_order(record_id, ord) -> (query_id, record_id, rank) of distinct records by their best hit."""
    m = hits.join(matches, "passage_id").join(golden_order, "record_id").groupBy("query_id", "record_id").agg(F.min(F.struct("rank", "ord")).alias("best"))
    return m.select("query_id", "record_id", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "record_id")).alias("rank"))


def ranking_metrics(questions: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, n_relevant, hit, recall, ap): null for a question without labels. Recall and AP divide by min(relevant, k)."""
    labels = qrels.select("query_id", "record_id").distinct()
    n = labels.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    top = ranked.where(F.col("rank") <= k).select("query_id", "record_id", "rank").join(labels, ["query_id", "record_id"])
    so_far = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    got = top.withColumn("precision", so_far / F.col("rank")).groupBy("query_id").agg(F.count("*").alias("found"), F.sum("precision").alias("total"))
    out = questions.select("query_id").join(n, "query_id", "left").join(got, "query_id", "left")
    known, most = F.col("n_relevant").isNotNull(), F.least("n_relevant", F.lit(k))
    found = F.coalesce("found", F.lit(0))
    return out.select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), F.when(known, (found > 0).cast("double")).alias("hit"), F.when(known, found / most).alias("recall"), F.when(known, F.coalesce("total", F.lit(0.0)) / most).alias("ap"))


def hit_at_k(questions: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    return ranking_metrics(questions, ranked, qrels, k).select("query_id", "hit")


def recall_at_k(questions: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    return ranking_metrics(questions, ranked, qrels, k).select("query_id", "recall")


def average_precision(questions: DataFrame, ranked: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    return ranking_metrics(questions, ranked, qrels, k).select("query_id", "ap")


def diversity_at_k(hits: DataFrame, k: int = 5) -> DataFrame:
    """hits(query_id, passage_id, rank, doc_ids) -> (query_id, diversity): distinct first records over hits."""
    top = hits.where(F.col("rank") <= k)
    return top.groupBy("query_id").agg((F.count_distinct(F.coalesce(F.get("doc_ids", F.lit(0)).cast("string"), F.concat(F.lit("?"), F.col("passage_id").cast("string")))) / F.count("*")).alias("diversity"))


def record_items(records: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Distinct (key, item) of records(source, record_id, ingredient_lines), without the graph."""
    lines = records.select(F.concat_ws(":", "source", "record_id").alias("key"), F.explode("ingredient_lines").alias("raw"))
    return resolve(lines, "raw", vocabulary).select("key", "item").distinct()


def _banned(constraints: DataFrame, categories: DataFrame) -> DataFrame:
    """Distinct (query_id, item) that a question excludes by name or family."""
    names = constraints.select("query_id", F.explode("exclude").alias("item"))
    by = constraints.select("query_id", F.explode("exclude_categories").alias("category")).join(categories.where("category != 'none'").select("item", "category"), "category")
    return names.unionByName(by.select("query_id", "item")).distinct()


def violations(hits: DataFrame, constraints: DataFrame, items: DataFrame, categories: DataFrame) -> DataFrame:
    """hits(query_id, keys) -> (query_id, key, offending): returned records with items(key, item) that the question excludes."""
    shown = hits.select("query_id", F.explode("keys").alias("key")).distinct()
    bad = shown.join(items, "key").join(_banned(constraints, categories), ["query_id", "item"])
    return bad.groupBy("query_id", "key").agg(F.array_sort(F.collect_set("item")).alias("offending"))


def _restricted(constraints: DataFrame) -> DataFrame:
    return constraints.select("query_id", ((F.size("exclude") > 0) | (F.size("exclude_categories") > 0)).alias("restricted"))


def constraint_respected_hits(hits: DataFrame, constraints: DataFrame, bad: DataFrame) -> DataFrame:
    """(query_id, respected): the share of returned records without a violation; null if unrestricted, 1 if nothing was returned."""
    shown = hits.select("query_id", F.explode("keys").alias("key")).groupBy("query_id").agg(F.count_distinct("key").alias("n"))
    wrong = bad.groupBy("query_id").agg(F.count_distinct("key").alias("bad"))
    r = _restricted(constraints).join(shown, "query_id", "left").join(wrong, "query_id", "left")
    share = F.coalesce((F.col("n") - F.coalesce("bad", F.lit(0))) / F.col("n"), F.lit(1.0))
    return r.select("query_id", F.when(F.col("restricted"), share).alias("respected"))


def by_family(rows: DataFrame, metrics: dict[str, int], family_col: str = "family") -> DataFrame:
    """Means of metrics for each family and for all (FAMILY_TOTAL), rounded to the given places for all and to three for a family; nulls are skipped."""
    total = F.grouping(family_col) == 1
    aggs = [F.count("*").alias("n")] + [F.when(F.max(F.lit(True)), F.avg(m)).alias(m) for m in metrics]
    g = rows.groupingSets([[], [family_col]], family_col).agg(*aggs, total.alias("is_total"))
    name = F.when(F.col("is_total"), F.lit(FAMILY_TOTAL)).otherwise(F.col(family_col))
    return g.select(name.alias("family"), "n", *(F.when(F.col("is_total"), F.round(m, p)).otherwise(F.round(m, 3)).alias(m) for m, p in metrics.items()))


def ranking_rows(questions: DataFrame, metrics: DataFrame, diversity: DataFrame, respected: DataFrame) -> DataFrame:
    """One row for each question(query_id, family) with all ranking scores."""
    return questions.select("query_id", "family").join(metrics, "query_id", "left").join(diversity, "query_id", "left").join(respected, "query_id", "left")


def ranking_report(rows: DataFrame) -> DataFrame:
    return by_family(rows, dict.fromkeys(("hit", "recall", "ap", "diversity", "respected"), 4))


def ranking_breaches(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """ranking_rows() of questions that got what they exclude, with their violations(query_id, key, offending): (query_id, family, respected, breaches, n_constrained).

    n_constrained counts all questions that exclude something, with and without a breach.
    """
    found = bad.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("key", "offending"))).alias("breaches"))
    counted = rows.agg(F.count("respected").alias("n_constrained"))
    return rows.select("query_id", "family", "respected").join(found, "query_id").crossJoin(F.broadcast(counted))  # one row


# --- set answers ----------------------------------------------------------------------------------
def _marked(**sets: DataFrame) -> DataFrame:
    """(query_id, key) of sets(query_id, key) with a column for each set that says whether it has the pair; pairs are shuffled once."""
    rows = [x.select("query_id", "key", *(F.lit(name == n).alias(n) for n in sets)) for name, x in sets.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("query_id", "key").agg(*(F.max(n).alias(n) for n in sets))


def set_scores(questions: DataFrame, returned: DataFrame, expected: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, sizes, precision, recall, f1): returned, expected and judged are (query_id, key); what isn't judged counts neither way.

    Where questions share what is judged, judged may have other columns of questions instead of query_id: (course, key) is judged
    for all questions of the course, and no row is made for each of them.
    Nothing expected: 1, 1, 1 if nothing judged is returned, else 0. Nothing returned of what is expected: 0, 0, 0.
    """
    count = lambda *flags: F.count(F.when(reduce(lambda a, b: a & b, flags), True))
    shared = [c for c in judged.columns if c != "key"]
    if shared == ["query_id"]:
        pairs = _marked(r=returned, e=expected, j=judged)
        n_judged, on = pairs.where("j").groupBy("query_id").agg(F.count("*").alias("n_judged")), ["query_id"]
    else:
        different = judged.distinct()
        n_judged, on = different.groupBy(*shared).agg(F.count("*").alias("n_judged")), shared
        pairs = _marked(r=returned, e=expected).join(questions.select("query_id", *shared), "query_id")
        pairs = pairs.join(different.withColumn("j", F.lit(True)), [*shared, "key"], "left").withColumn("j", F.coalesce("j", F.lit(False)))
    n = pairs.groupBy("query_id").agg(count(F.col("r")).alias("n_returned"), count(F.col("e")).alias("n_expected"), count(F.col("r"), F.col("j") | F.col("e")).alias("n_seen"), count(F.col("r"), F.col("e")).alias("n_right"))
    out = questions.select("query_id", *(c for c in on if c != "query_id")).join(n, "query_id", "left").join(n_judged, on, "left")
    out = out.select("query_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_returned", "n_expected", "n_judged", "n_seen", "n_right")))
    none = F.col("n_expected") == 0
    p = F.when(none, (F.col("n_seen") == 0).cast("double")).otherwise(F.coalesce(F.col("n_right") / F.nullif("n_seen", F.lit(0)), F.lit(0.0)))
    rec = F.when(none, p).otherwise(F.col("n_right") / F.col("n_expected"))
    out = out.withColumn("precision", p).withColumn("recall", rec)
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))).drop("n_seen", "n_right")


def graph_rows(questions: DataFrame, scores: DataFrame, constraints: DataFrame, respected: DataFrame) -> DataFrame:
    """Set scores with extraction agreement: does the parsed question restrict exactly when its family implies it."""
    implied = F.col("family").isin("exclusion", "constraint")
    out = questions.select("query_id", "family").join(scores, "query_id").join(_restricted(constraints), "query_id", "left").join(respected, "query_id", "left")
    return out.withColumn("agrees", (implied == F.coalesce("restricted", F.lit(False))).cast("double")).drop("restricted")


def graph_report_scored(rows: DataFrame) -> DataFrame:
    return by_family(rows, dict.fromkeys(("precision", "recall", "f1", "agrees", "respected"), 4))


# --- answers --------------------------------------------------------------------------------------
def answer_items(answers: DataFrame, vocabulary: DataFrame, named: bool = False) -> DataFrame:
    """answers(query_id, text) -> distinct (query_id, item[, item_name]) that bulleted or numbered lines before STEPS: claim; named as in resolve()."""
    head = F.split("text", r"(?i)\bSTEPS?\b\s*:", 2)[0]
    lines = answers.select("query_id", F.explode(F.regexp_extract_all(head, F.lit(r"(?m)^\s*(?:[-*•]|\d+[.)])[^\S\n]*(\S.*)$"), F.lit(1))).alias("line"))
    return resolve(lines, "line", vocabulary, named).drop("line").distinct()


def context_items(contexts: DataFrame, vocabulary: DataFrame, named: bool = False) -> DataFrame:
    """contexts(query_id, text) -> distinct (query_id, item[, item_name]) of their lines; named as in resolve()."""
    lines = contexts.select("query_id", F.explode(F.split("text", r"\r?\n")).alias("raw")).select("query_id", F.regexp_replace("raw", r"^[ \-*•]+|[ \-*•]+$", "").alias("line")).where("line != ''")
    return resolve(lines, "line", vocabulary, named).drop("line").distinct()


def _named(items: DataFrame) -> DataFrame:
    """items(query_id, item) with item_name; the rules run on distinct items, where it isn't there yet."""
    if "item_name" in items.columns:
        return items.select("query_id", "item", "item_name")
    names = items.select("item").where("item IS NOT NULL").distinct().withColumn("item_name", normalised(F.col("item")))
    return items.select("query_id", "item").join(names, "item", "left").select("query_id", "item", "item_name")


def no_invented(answers: DataFrame, claimed: DataFrame, available: DataFrame) -> DataFrame:
    """(query_id, grounded, invented): the share of claimed items that the context has; 1 if nothing is claimed. Names match if equal or one contains the other.

    claimed and available are distinct (query_id, item[, item_name]); an answer's items meet in its row.
    """
    both = _named(claimed).withColumn("mine", F.lit(True)).unionByName(_named(available).withColumn("mine", F.lit(False)))
    of = lambda mine: F.collect_set(F.when(mine & F.col("item").isNotNull(), F.struct("item", "item_name")))
    one = both.groupBy("query_id").agg(F.count(F.when(F.col("mine"), True)).alias("n"), of(F.col("mine")).alias("claimed"), of(~F.col("mine")).alias("available"))
    alike = lambda a, b: (a["item"] == b["item"]) | F.coalesce(a["item_name"].contains(b["item_name"]) | b["item_name"].contains(a["item_name"]), F.lit(False))
    lost = F.filter("claimed", lambda a: ~F.exists("available", lambda b: alike(a, b)))
    one = one.select("query_id", "n", F.array_sort(F.array_distinct(F.transform(lost, lambda x: x["item"]))).alias("invented"))
    out = answers.select("query_id").join(one, "query_id", "left").withColumn("invented", F.coalesce("invented", F.array().cast("array<string>")))
    return out.select("query_id", F.coalesce((F.col("n") - F.size("invented")) / F.nullif("n", F.lit(0)), F.lit(1.0)).alias("grounded"), "invented")


def answerable(questions: DataFrame, retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, answerable): was any expected record retrieved; null if nothing is expected."""
    pairs = _marked(got=retrieved, known=expected).where("known").groupBy("query_id").agg(F.max("got").alias("answerable"))
    return questions.select("query_id").join(pairs, "query_id", "left").select("query_id", "answerable")


def abstention(answers: DataFrame, can: DataFrame) -> DataFrame:
    """(query_id, abstention): 1 if it was refused exactly when it could not be answered; null if that is unknown."""
    return answers.select("query_id", "refused").join(can, "query_id", "left").select("query_id", (F.col("refused") != F.col("answerable")).cast("double").alias("abstention"))


def constraint_respected_answers(answers: DataFrame, claimed: DataFrame, constraints: DataFrame, categories: DataFrame) -> DataFrame:
    """(query_id, respected): the share of claimed items that aren't excluded; 1 if none is claimed, null if unrestricted.

    A claimed item looks up its families; families are not made into items for each question.
    """
    none = F.array().cast("array<string>")
    families = categories.where("category != 'none' AND item IS NOT NULL").groupBy("item").agg(F.collect_set("category").alias("families"))
    held = constraints.select("query_id", F.coalesce("exclude", none).alias("exclude"), F.coalesce("exclude_categories", none).alias("ban"))
    bad = F.coalesce(F.array_contains("exclude", F.col("item")), F.lit(False)) | F.coalesce(F.arrays_overlap("families", "ban"), F.lit(False))
    met = claimed.select("query_id", "item").join(families, "item", "left").join(held, "query_id", "left")
    n = met.groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(bad, True)).alias("bad"))
    out = answers.select("query_id").join(_restricted(constraints), "query_id", "left").join(n, "query_id", "left")
    return out.select("query_id", F.when(F.col("restricted"), F.coalesce(1 - F.coalesce("bad", F.lit(0)) / F.col("n"), F.lit(1.0))).alias("respected"))


def generation_report(rows: DataFrame) -> DataFrame:
    """rows(refused, elapsed_s, grounded, abstention, respected) -> one row of means."""
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("grounded", "abstention", "respected")), F.round(F.avg(F.col("refused").cast("double")), 4).alias("refusal_rate"), F.round(F.avg("elapsed_s"), 2).alias("mean_seconds"))


def judged_report(scores: DataFrame) -> DataFrame:
    """scores(query_id, metric, score, refused, cached, usd, error) of an outside judge -> (metric, mean, n, calls, cache_hits, usd, failures). A refusal has no cookable and relevancy scores."""
    score = F.when(F.col("refused") & F.col("metric").isin("cookable", "relevancy"), None).otherwise(F.col("score"))
    return scores.groupBy("metric").agg(
        F.round(F.avg(score), 4).alias("mean"), F.count(score).alias("n"), F.sum((~F.col("cached")).cast("long")).alias("calls"), F.sum(F.col("cached").cast("long")).alias("cache_hits"), F.round(F.sum(F.when(~F.col("cached"), F.col("usd")).otherwise(0.0)), 6).alias("usd"),
        F.slice(F.array_sort(F.collect_list(F.col("error"))), 1, 5).alias("failures"),
    )


def route_comparison(graph_rows: DataFrame, retrieval_rows: DataFrame) -> DataFrame:
    """Both routes' answers scored alike: one row for each route."""
    both = graph_rows.withColumn("route", F.lit("graph")).unionByName(retrieval_rows.withColumn("route", F.lit("retrieval")))
    return both.groupBy("route").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("grounded", "abstention", "respected")), F.round(F.avg(F.col("refused").cast("double")), 4).alias("refusal_rate"))


def leaderboard(runs: DataFrame, metric: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """runs(config, metric, ...) with place and best (is it as good as the best), for each of keys."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return runs.withColumn("place", F.rank().over(w.orderBy(F.desc_nulls_last(metric)))).withColumn("best", F.col(metric) == F.max(metric).over(w))


def combinations(sources: list[str], use_mmr: bool = True, use_rerank: bool = True, use_gate: bool = True, k: int = 5) -> list:
    """Configurations to compare: each source alone, with MMR, with reranking, with the gate, and with both."""
    from rankweave.operators.retrieve import Pipeline

    out = []
    for s in sources:
        out.append(Pipeline(s, k=k))
        out += [Pipeline(s, use_mmr=True, k=k)] * use_mmr + [Pipeline(s, use_rerank=True, k=k)] * use_rerank + [Pipeline(s, use_gate=True, k=k)] * use_gate
        out += [Pipeline(s, use_rerank=True, use_gate=True, k=k)] * (use_rerank and use_gate)
    return out


def cost_ledger(calls: DataFrame, prices: tuple[tuple[str, float, float], ...] = PRICES) -> DataFrame:
    """calls(span, model, seconds, tokens_in, tokens_out) -> (span, calls, seconds, tokens, usd, seconds_each) and a total, slowest first. The first price whose name the model contains counts."""
    usd = F.lit(0.0)
    for name, into, out in reversed(prices):
        usd = F.when(F.coalesce("model", F.lit("")).contains(name), F.round(F.col("tokens_in") / 1e6 * into + F.col("tokens_out") / 1e6 * out, 6)).otherwise(usd)
    c = calls.withColumn("usd", usd)
    g = c.rollup("span").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").alias("usd"), F.grouping("span").alias("total"))
    g = g.select(F.when(F.col("total") == 1, FAMILY_TOTAL).otherwise(F.col("span")).alias("span"), "calls", F.round("seconds", 3).alias("seconds"), "tokens_in", "tokens_out", F.round("usd", 6).alias("usd"), F.round(F.col("seconds") / F.col("calls"), 3).alias("seconds_each"))
    return g.orderBy(F.desc("seconds"), "span")
