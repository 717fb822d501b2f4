"""Corpus offsets and chunks. Offsets are half-open and count characters from 0."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions.numbering import numbered
from rankweave.functions.slices import map_rows

SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")
SECTION_HEADING = r"(?im)^(?:ingredients?|method|directions?|steps?|preparation)[ \t\r\f\v]*:?[ \t\r\f\v]*$"
CHUNKS = "source string, doc_id string, chunk_no int, start long, end long, text string"


def build_spans(docs: DataFrame, separator: str = "\n\n", order_col: str = "ord") -> DataFrame:
    """docs(source, ord, doc_id, title, text) -> spans with start and end in their source's joined text.

    Blank documents are skipped. Lengths are numbered and summed in order without their texts, over ranges of the
    order, so a source of any size is no single task; then each text meets its offset. A job runs at once. Within a source
    the values of the order are unique and not null.
    """
    d = docs.where(r"text RLIKE '\\S'").withColumn("_step", (F.length("text") + len(separator)).cast("long"))
    placed = numbered(d.select("source", order_col, "_step"), "source", order_col, number="n", total="before", of="_step")
    first = placed.groupBy(F.col("source").alias("of")).agg(F.min("n").alias("first_n"), F.min("before").alias("first_before"))
    offsets = placed.join(first, F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col(order_col).alias("at"), (F.col("before") - F.col("first_before")).alias("start"), (F.col("n") - F.col("first_n") + 1).alias("n"))
    d = d.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col(order_col) == F.col("at")))
    return d.select("source", F.coalesce("doc_id", F.format_string("d_%04d", "n")).alias("doc_id"), F.substring(F.coalesce("title", F.lit("")), 1, 180).alias("title"), "start", (F.col("start") + F.length("text")).alias("end"), "text")


def corpus_summary(spans: DataFrame) -> DataFrame:
    """For each source: a fingerprint, characters, documents, and their mean, least and greatest length."""
    n = F.col("end") - F.col("start")
    mark = F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.sha2("text", 256)), 256)
    return spans.groupBy("source").agg(
        F.sha2(F.concat_ws("", F.bit_xor(F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")).cast("string"), F.bit_xor(F.conv(F.substring(mark, 16, 15), 16, 10).cast("long")).cast("string"), F.count("*").cast("string")), 256).alias("fingerprint"),
        F.max("end").alias("n_chars"), F.count("*").alias("n_docs"), F.avg(n).alias("mean_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"),
    )


def touching(passages: DataFrame, spans: DataFrame, width: int = 1024) -> DataFrame:
    """passages(source, passage_id, start, end) with doc_ids, the documents each overlaps in order; an overlap join by buckets of width."""
    over = lambda d: F.explode(F.sequence(F.floor(d["start"] / width), F.floor((d["end"] - 1) / width)))
    p = passages.where("end > start")
    p = p.select("source", "passage_id", F.col("start").alias("ps"), F.col("end").alias("pe"), over(p).alias("bucket"))
    s = spans.where("end > start")
    s = s.select("source", "doc_id", F.col("start").alias("ss"), F.col("end").alias("se"), over(s).alias("bucket"))
    met = p.join(s, ["source", "bucket"]).where("ps < se AND ss < pe")
    met = met.select("source", "passage_id", "doc_id", "ss", (F.least("pe", "se") - F.greatest("ps", "ss")).alias("shared")).distinct()
    ids = met.groupBy("source", "passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ss", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"), F.max_by("doc_id", F.struct("shared", -F.col("ss"))).alias("main_doc"))
    return passages.join(ids, ["source", "passage_id"], "left").withColumn("doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>")))


def chunk_fixed(spans: DataFrame, size: int = 800, overlap: int = 0, separator: str = "\n\n") -> DataFrame:
    """(source, window, start, end, text): windows of the joined text, which can cross documents; the last is clipped and none starts after it."""
    if size <= 0:
        raise ValueError("size must be positive")
    step, k = max(1, size - overlap), len(separator)
    totals = spans.groupBy("source").agg(F.max("end").alias("total"))  # combined before the shuffle, so a source of any size is no single task
    s = spans.join(totals, "source").withColumn("whole", F.when(F.col("end") < F.col("total"), F.concat("text", F.lit(separator))).otherwise(F.col("text"))).withColumn("stop", F.col("start") + F.length("whole"))
    top = F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step))
    low = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1)
    high = F.least(top, F.floor((F.col("stop") - 1) / step))
    s = s.where(low <= high).select("source", "start", "stop", "whole", "total", F.explode(F.sequence(low, high)).alias("window"))
    a, b = F.col("window") * step, F.least(F.col("window") * step + size, F.col("total"))
    piece = F.expr("substring(whole, cast(lo - start AS int) + 1, cast(hi - lo AS int))")
    s = s.withColumn("lo", F.greatest(a, F.col("start"))).withColumn("hi", F.least(b, F.col("stop"))).where("hi > lo")
    return s.groupBy("source", "window").agg(F.min("lo").alias("start"), F.max("hi").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", piece.alias("p")))), lambda x: x["p"]), "").alias("text"))


def _pieces(text: str, start: int, end: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """text[start:end] cut before each occurrence of the first separator that occurs."""
    for k, sep in enumerate(separators):
        if sep == "":
            return [(i, i + 1) for i in range(start, end)]
        cuts, at = [start], text.find(sep, start, end)
        while at != -1:
            if at > start:
                cuts.append(at)
            at = text.find(sep, at + len(sep), end)
        if len(cuts) > 1:
            return list(zip(cuts, [*cuts[1:], end], strict=True))
    return [(start, end)]


def recursive_bounds(text: str, size: int = 800, overlap: int = 120) -> list[tuple[int, int]]:
    """Chunks of at most size characters, cut at the coarsest separator that allows it; neighbours share up to overlap."""
    out: list[tuple[int, int]] = []

    def merged(parts: list[tuple[int, int]]) -> None:
        held: list[tuple[int, int]] = []
        for part in parts:
            if held and part[1] - held[0][0] > size:
                out.append((held[0][0], held[-1][1]))
                while held and (held[-1][1] - held[0][0] > overlap or part[1] - held[0][0] > size):
                    held.pop(0)
            held.append(part)
        if held:
            out.append((held[0][0], held[-1][1]))

    def cut(start: int, end: int, separators: tuple[str, ...]) -> None:
        usable = next((separators[k:] for k, s in enumerate(separators) if s == "" or text.find(s, start, end) != -1), ("",))
        small: list[tuple[int, int]] = []
        for a, b in _pieces(text, start, end, usable):
            if b - a <= size:
                small.append((a, b))
                continue
            merged(small)
            small = []
            if len(usable) > 1:
                cut(a, b, usable[1:])
            else:
                out.append((a, b))
        merged(small)

    if text:
        cut(0, len(text), SEPARATORS)
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            trimmed.append((a, b))
    return trimmed


def sentence_bounds(text: str, min_len: int = 40) -> list[tuple[int, int]]:
    """Sentences and lines; one shorter than min_len joins the one before."""
    out, start = [], 0
    for stop, after in [*((m.start(), m.end()) for m in re.finditer(r"(?<=[.!?:])\s+|\n+", text)), (len(text), len(text))]:
        if stop > start:
            if out and stop - start < min_len:
                out[-1] = (out[-1][0], stop)
            else:
                out.append((start, stop))
        start = after
    return out


def record_bounds(text: str, max_chars: int) -> list[tuple[int, int]]:
    """The whole text, or pieces of at most max_chars that end at a line's end where they can."""
    if not max_chars or len(text) <= max_chars:
        return [(0, len(text))]
    out, at = [], 0
    while at < len(text):
        stop = min(at + max_chars, len(text))
        newline = text.rfind("\n", at, stop) if stop < len(text) else -1
        stop = newline if newline > at else stop
        out.append((at, stop))
        at = stop
    return out


def _chunks(docs: DataFrame, bounds: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """docs(source, doc_id, start, text) -> chunks, by a function of one text; narrow, no shuffle."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for s, d, base, t in rows:
            for k, (a, b) in enumerate(bounds(t)):
                yield s, d, k, base + a, base + b, t[a:b]

    return map_rows(docs.select("source", "doc_id", "start", "text").where("text IS NOT NULL"), run, CHUNKS)


def chunk_recursive(docs: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    return _chunks(docs, lambda t: recursive_bounds(t, size, overlap))


def sentence_units(docs: DataFrame, min_len: int = 40) -> DataFrame:
    return _chunks(docs, lambda t: sentence_bounds(t, min_len))


def recursive_units(docs: DataFrame, size: int = 200) -> DataFrame:
    return _chunks(docs, lambda t: recursive_bounds(t, size, 0))


def chunk_record(docs: DataFrame, max_chars: int = 0) -> DataFrame:
    """One chunk for each document; only those over max_chars are cut."""
    whole = docs.where("text IS NOT NULL")
    fits = whole if not max_chars else whole.where(F.length("text") <= max_chars)
    one = fits.select("source", "doc_id", F.lit(0).alias("chunk_no"), F.col("start").cast("long").alias("start"), (F.col("start") + F.length("text")).cast("long").alias("end"), "text")
    return one if not max_chars else one.unionByName(_chunks(whole.where(F.length("text") > max_chars), lambda t: record_bounds(t, max_chars)))


def chunk_sections(docs: DataFrame, min_chars: int = 220) -> DataFrame:
    """docs(source, doc_id, title, start, text) cut at section headings, the title put before each piece that lacks it."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for source, doc_id, title, base, text in rows:
            cuts = [m.start() for m in re.finditer(SECTION_HEADING, text)]
            edges = sorted({0, len(text), *(cuts if len(text) >= 2 * min_chars else ())})
            title, k = (title or "").strip(), 0
            for a, b in zip(edges, edges[1:], strict=False):
                piece = text[a:b].strip()
                if len(piece) >= 20:
                    named = not title or piece.lower().startswith(title.lower()[:24])
                    yield source, doc_id, k, base + a, base + b, piece if named else f"{title}\n{piece}"
                    k += 1

    return map_rows(docs.select("source", "doc_id", "title", "start", "text").where("text IS NOT NULL"), run, CHUNKS)


def group_adjacent(units: DataFrame, threshold: float = 0.55, keys: tuple[str, ...] = ("source", "doc_id")) -> DataFrame:
    """units(keys, chunk_no, vec) with group_no: a new group where the cosine with the unit before is below threshold."""
    from rankweave.functions.vectors import dot

    order = Window.partitionBy(*keys).orderBy("chunk_no")
    new = (dot(F.col("vec"), F.lag("vec").over(order)) < threshold).cast("int")
    return units.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("group_no", F.sum("new").over(order)).drop("new")


def group_centroid(units: DataFrame, threshold: float = 0.50) -> DataFrame:
    """units(source, doc_id, chunk_no, start, end, vec) with group_no: a new group where the cosine with the group's mean direction is below threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, group, total = None, 0, None  # a document may go on in the next batch
        for batch in batches:
            out, vec = [], batch.column("vec")
            flat, ends = vec.flatten().to_numpy(zero_copy_only=False).astype(float), vec.offsets.to_numpy() - vec.offsets[0].as_py()
            for k, key in enumerate(zip(batch.column("source").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                v = flat[ends[k] : ends[k + 1]]
                if key != of:
                    of, group, total = key, 0, None
                if total is not None:
                    norm = np.linalg.norm(total)
                    if (v @ total / norm if norm else 0.0) < threshold:
                        group, total = group + 1, None
                total = v.copy() if total is None else total + v
                out.append(group)
            kept = batch.select(["source", "doc_id", "chunk_no", "start", "end"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, pa.int32())], names=[*kept.schema.names, "group_no"])

    keys = ("source", "doc_id")
    cols = units.select(*keys, "chunk_no", "start", "end", "vec").repartition(*keys).sortWithinPartitions(*keys, "chunk_no")
    return cols.mapInArrow(run, "source string, doc_id string, chunk_no int, start long, end long, group_no int")


def _split_group(start: int, ends: list[int], max_chars: int) -> list[tuple[int, int]]:
    out, stop = [], ends[-1]
    while stop - start > max_chars:
        cut = max((e for e in ends if start < e <= start + max_chars), default=start + max_chars)
        out.append((start, cut))
        start = cut
    return [*out, (start, stop)] if stop > start else out


def bounds(grouped: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Units with group_no -> (source, doc_id, start, end): groups, cut at the unit end nearest to max_chars where they are longer."""
    g = grouped.groupBy("source", "doc_id", "group_no").agg(F.min("start").alias("start"), F.array_sort(F.collect_list("end")).alias("ends"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(s, d, a, b) for s, d, start, ends in part.itertuples(index=False) for a, b in _split_group(int(start), [int(e) for e in ends], max_chars)]
            yield pd.DataFrame(rows, columns=["source", "doc_id", "start", "end"])

    return g.select("source", "doc_id", "start", "ends").mapInPandas(run, "source string, doc_id string, start long, end long")


def _semantic(docs: DataFrame, units: DataFrame, encode: Callable[[DataFrame, str], DataFrame], group: Callable[[DataFrame], DataFrame], max_chars: int) -> DataFrame:
    cut = bounds(group(encode(units, "text")), max_chars)
    base = docs.select("source", "doc_id", F.col("start").alias("base"), F.col("text").alias("whole"))
    text = F.expr("substring(whole, cast(start - base AS int) + 1, cast(end - start AS int))")
    number = (F.row_number().over(Window.partitionBy("source", "doc_id").orderBy("start")) - 1).cast("int")
    return cut.join(base, ["source", "doc_id"]).select("source", "doc_id", number.alias("chunk_no"), "start", "end", text.alias("text"))


def chunk_semantic_adjacent(docs: DataFrame, encode: Callable, threshold: float = 0.55, min_len: int = 40, max_chars: int = 1200) -> DataFrame:
    """Sentences, grouped with their neighbours while alike; encode(df, column) adds unit vectors as vec."""
    return _semantic(docs, sentence_units(docs, min_len), encode, lambda u: group_adjacent(u, threshold), max_chars)


def chunk_semantic_centroid(docs: DataFrame, encode: Callable, threshold: float = 0.50, min_len: int = 40, max_chars: int = 1200) -> DataFrame:
    return _semantic(docs, sentence_units(docs, min_len), encode, lambda u: group_centroid(u, threshold), max_chars)


def chunk_recursive_semantic_adjacent(docs: DataFrame, encode: Callable, threshold: float = 0.55, size: int = 200, max_chars: int = 1200) -> DataFrame:
    return _semantic(docs, recursive_units(docs, size), encode, lambda u: group_adjacent(u, threshold), max_chars)


def chunk_recursive_semantic_centroid(docs: DataFrame, encode: Callable, threshold: float = 0.50, size: int = 200, max_chars: int = 1200) -> DataFrame:
    return _semantic(docs, recursive_units(docs, size), encode, lambda u: group_centroid(u, threshold), max_chars)


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): the union of overlapping or touching intervals of each key."""
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    d = df.where("end > start").withColumn("reach", F.max("end").over(before))
    d = d.withColumn("island", F.sum(F.coalesce((F.col("start") > F.col("reach")).cast("int"), F.lit(0))).over(so_far))
    return d.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """How much two intervals share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
