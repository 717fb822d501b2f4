"""Benchmark passages in documents, by winnowed fingerprints that are joined and extended.

Both sides keep, of each stretch of HELD consecutive hashes of KGRAM-word runs, the least one with
its place (winnowing). As KGRAM + HELD - 1 is the length of a window, a document and an item that
share a window share a fingerprint at the same place in it. Fingerprints are joined; each match
names an alignment of an item with a document, which is extended over the whole item word by word,
so only true windows count. Items shorter than a window are found by their first word instead, and
extended alike. All of it is DataFrame expressions.

If the items' texts are within BROADCAST_CHARS in all, fingerprints and items are broadcast, else
they are joined by shuffle. Alignments are brought back to the documents' words by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import identified, saved

WINDOW, KGRAM, HELD = 10, 5, 6
BROADCAST_CHARS = 16_000_000
_PLACE_BITS = 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(text: Column) -> Column:
    """Words of letters, digits and other non-ASCII characters; A-Z lower-cased; null has none."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), F.array().cast("array<string>"))


def _fingerprinted(df: DataFrame) -> DataFrame:
    """Adds prints: 64-bit numbers, the hash in the upper bits and the place of its first word in the lower ones."""
    kgram = ", ".join(f"get(hashes, i + {j})" for j in range(KGRAM))
    df = df.withColumn("hashes", F.expr("transform(words, w -> xxhash64(w))"))
    df = df.withColumn("runs", F.expr(f"if(size(hashes) < {KGRAM}, array(), transform(sequence(0, size(hashes) - {KGRAM}), i -> (xxhash64({kgram}) & {-(1 << _PLACE_BITS)}) | cast(i AS bigint)))"))
    df = df.withColumn("prints", F.expr(f"if(size(runs) < {HELD}, array(), array_distinct(transform(sequence(0, size(runs) - {HELD}), i -> array_min(slice(runs, i + 1, {HELD})))))"))
    return df.drop("hashes", "runs")


def _print_and_place(df: DataFrame, column: str, place: str) -> DataFrame:
    return df.withColumn("print", F.shiftright(column, _PLACE_BITS)).withColumn(place, (F.col(column).bitwiseAND((1 << _PLACE_BITS) - 1)).cast("int")).drop(column)


def _seeds(docs: DataFrame, items: DataFrame, broadcast: bool) -> DataFrame:
    """docs(doc_id, words), items(item_id, item_words) -> (doc_id, n_words, alignments of (item_id, shift)): one row for each doc_id."""
    prints = items.where(f"size(item_words) >= {WINDOW}").withColumnRenamed("item_words", "words")
    prints = _fingerprinted(prints).select("item_id", F.explode_outer("prints").alias("at")).where("at IS NOT NULL")
    prints = _print_and_place(prints, "at", "item_place")
    short = items.where(f"size(item_words) BETWEEN 1 AND {WINDOW - 1}")
    some_short = not short.isEmpty()
    if some_short:  # their prints are first words, told apart by lying above all others
        first = F.shiftright(F.xxhash64(F.col("item_words")[0]), _PLACE_BITS) + (1 << (64 - _PLACE_BITS))
        prints = prints.unionByName(short.select("item_id", first.alias("print"), F.lit(0).alias("item_place")))

    seeds = f"transform(prints, p -> struct(shiftright(p, {_PLACE_BITS}) AS print, cast(p & {(1 << _PLACE_BITS) - 1} AS int) AS place))"
    if some_short:
        seeds = f"concat({seeds}, transform(words, (w, i) -> struct(shiftright(xxhash64(w), {_PLACE_BITS}) + {1 << (64 - _PLACE_BITS)} AS print, i AS place)))"
    mark = "array(struct(cast(null AS bigint) AS print, cast(null AS int) AS place))"  # gives each document a row
    docs = _fingerprinted(docs).select("doc_id", F.size("words").cast("long").alias("n_words"), F.expr(f"concat({mark}, {seeds})").alias("seeds"))
    rows = docs.select("doc_id", "n_words", F.explode_outer("seeds").alias("seed")).select("doc_id", "n_words", "seed.print", "seed.place")
    rows = rows.join(F.broadcast(prints) if broadcast else prints, "print", "left").where("item_id IS NOT NULL OR print IS NULL")
    alignment = F.when(F.col("item_id").isNotNull(), F.struct("item_id", (F.col("place") - F.col("item_place")).alias("shift")))
    return rows.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(alignment).alias("alignments"))


def _extended(texts: DataFrame, seeds: DataFrame, items: DataFrame, broadcast: bool) -> DataFrame:
    """(doc_id, item_ids, spans) of the documents in which an alignment, extended over its item, has a shared window.

    A document's alignments are together in one row, so its words are there once.
    """
    pairs = seeds.where("size(alignments) > 0").select("doc_id", F.explode("alignments").alias("a")).select("doc_id", "a.item_id", "a.shift")
    pairs = pairs.join(F.broadcast(items) if broadcast else items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shift", "item_words")).alias("a"))
    d = texts.join(pairs, "doc_id").withColumn("words", folded_words(F.col("text")))
    same = f"struct(x.item_id, x.shift, least({WINDOW}, size(x.item_words)) AS size, transform(x.item_words, (w, j) -> coalesce(get(ws, x.shift + j) = w, false)) AS same)"
    d = d.withColumn("a", F.expr(f"transform(array(words), ws -> transform(a, x -> {same}))[0]"))  # words as a variable, so they are made once
    d = d.withColumn("a", F.expr("transform(a, x -> struct(x.item_id, x.shift, x.size, filter(sequence(0, size(x.same) - x.size), i -> NOT array_contains(slice(x.same, i + 1, x.size), false)) AS starts))"))
    d = d.withColumn("a", F.expr("filter(a, x -> size(x.starts) > 0)"))
    low = "transform(filter(x.starts, (i, k) -> k = 0 OR get(x.starts, k - 1) < i - 1), i -> x.shift + i)"
    high = "transform(filter(x.starts, (i, k) -> k = size(x.starts) - 1 OR get(x.starts, k + 1) > i + 1), i -> x.shift + i + x.size - 1)"
    spans = F.expr(f"flatten(transform(a, x -> arrays_zip({low}, {high})))").cast("array<struct<low:int,high:int>>")
    return d.select("doc_id", F.expr("transform(a, x -> x.item_id)").alias("item_ids"), spans.alias("spans"))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids, spans, contaminated): one row for each doc_id of docs.

    A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one
    window. n_hit counts the document's words inside any occurrence of a window, spans are these
    stretches (first and last word, from 0; they can overlap), item_ids the items that have an
    occurring window, sorted as strings. Null, empty and wordless texts and items match nothing.
    Rows that repeat a doc_id are taken as one document, and so are those of a null doc_id, which
    is never contaminated: n_words is the largest of theirs. Rows that repeat an item_id add their windows. Items with a null id are
    left out. Empty tables give an empty result or no hits. Other columns are ignored.
    """
    docs = identified(docs, id_col, text_col)
    items = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    items = items.select("item_id", folded_words(F.col("text")).alias("item_words"))
    small = chars <= broadcast_chars
    seeds = saved(_seeds(docs.select("doc_id", folded_words(F.col("text")).alias("words")), items, small))
    found = _extended(docs, seeds, items, small).groupBy("doc_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("item_ids", "spans")))

    out = seeds.select("doc_id", "n_words").join(found, "doc_id", "left")
    merged = """aggregate(spans, struct(0L AS n, -1 AS last),
        (acc, s) -> struct(acc.n + greatest(0, s.high - greatest(acc.last + 1, s.low) + 1) AS n, greatest(acc.last, s.high) AS last), acc -> acc.n)"""
    out = out.select("doc_id", "n_words", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("spans", F.array().cast("array<struct<low:int,high:int>>")).alias("spans"))
    return out.select("doc_id", "n_words", F.expr(merged).alias("n_hit"), "item_ids", "spans").withColumn("contaminated", F.col("n_hit") > 0)
