"""Removal of passages that an earlier document already has: winnowed anchors, extended both ways.

Seeds: each window of `length` words is named by the least hash among its runs of RUN words, its
anchor (winnowing), so two equal windows always have the same anchor, and a document has an anchor
for about each fifth word. Only anchors that two documents share go on. Extension: around each shared
anchor all windows that it names, to its left and right, are compared in full, by a hash of the
whole window; the smallest doc_id that has a window is a minimum over its holders, so copies never
meet in pairs. Overlapping windows add up to maximal repeats, which are removed.

An anchor or window has one narrow row for each document that holds it. The rows of one key are sorted
in one task, which spills what it cannot hold; a key has at most one row for each document, of about
a hundred that a document has. Minima that are joined back would split a hot key, but send every row
twice, more than the disk that this operator may use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.llm.shared import identified
from rankweave.llm.words import Block, blocks, lists, mixed, run_hashes

RUN = 5


def _windows(block: Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its first word in the block, the index of its text, its anchor, its hash."""
    h = block.hashes()
    total = len(h)
    if total < length:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    run = min(RUN, length)
    at = np.arange(total - run + 1)
    least = run_hashes(h, at, at + run)
    reach, width = length - run + 1, 1
    while width < reach:  # least of ever longer stretches
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    owner = block.owners()
    start = np.flatnonzero(owner[: total - length + 1] == owner[length - 1 :])
    return start, owner[start], least[start], run_hashes(h, start, start + length)


def _of_text(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that tell the same value in two texts of a block apart."""
    return mixed(values ^ mixed(text.astype(np.uint64) + np.uint64(1)))


def _distinct(text: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values: the distinct values of each of n texts."""
    if len(values):
        change = np.ones(len(values), bool)
        change[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        text, values = text[change], values[change]
        order = np.lexsort((values, text))
        text, values = text[order], values[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        text, values = text[new], values[new]
    return np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))), values


def _listed(column: pa.Array, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """(text index, value) of a column of lists, for the rows of a block; null is an empty list."""
    cut = column.slice(rows.start, len(rows))
    text = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(cut).to_numpy(zero_copy_only=False)
    return text, (values if len(values) else np.zeros(0, np.int64)).astype(np.int64).view(np.uint64)


def _among(values: np.ndarray, text: np.ndarray, column: pa.Array, rows: range) -> np.ndarray:
    """Whether each value is in its text's list."""
    listed_text, listed = _listed(column, rows)
    return np.isin(_of_text(values, text), _of_text(listed, listed_text))


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                _, text, anchor, _ = _windows(block, length)
                offsets, values = _distinct(text, anchor, len(block.rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.rows)), lists(offsets, values.view(np.int64))], ["doc_id", "anchors"])

    return run


def _extended(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                _, text, anchor, window = _windows(block, length)
                seeded = _among(anchor, text, batch.column(2), block.rows)
                offsets, values = _distinct(text[seeded], window[seeded], len(block.rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, len(block.rows)), lists(offsets, values.view(np.int64))], ["doc_id", "windows"])

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                n = len(block.rows)
                start, text, _, window = _windows(block, length)
                hit = start[_among(window, text, batch.column(2), block.rows)]
                depth = np.zeros(len(block.start) + 1, np.int64)
                np.add.at(depth, hit, 1)
                np.add.at(depth, hit + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                owner = block.owners()
                last = np.zeros(len(kept), bool)
                at = np.flatnonzero(kept)
                last[at] = np.append(owner[at[1:]] != owner[at[:-1]], True)[: len(at)]
                data = np.append(block.data, np.uint8(0x20))
                edge = np.zeros(len(data) + 1, np.int8)
                edge[block.start[kept]] += 1
                np.subtract.at(edge, block.end[kept], 1)
                take = np.cumsum(edge[:-1]) > 0
                gap = block.end[kept & ~last]
                take[gap], data[gap] = True, 0x20
                sizes = np.concatenate(([0], np.cumsum(take)))
                out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(sizes[block.offsets].astype(np.int64)), pa.py_buffer(data[take]))
                count = np.bincount(owner[kept], minlength=n)
                words = block.counts()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.rows.start, n), pa.array(words.astype(np.int64)), pa.array((words - count).astype(np.int64)), out.cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): one row for each row of docs.

    A word (`[^\\x20\\x09-\\x0D]+`) goes if it is inside `length` consecutive words that also occur
    in a document with a smaller doc_id; this is judged on the input, not on what is left. kept_text
    has the other words, joined by one space. Null, empty and blank texts have no words and give an
    empty kept_text; texts of fewer than `length` words stay. Of rows with the same doc_id none
    takes words from another. A null doc_id is in no order: such a row stays whole and takes
    nothing. An empty table gives an empty result. Other columns are ignored. Windows are told
    apart by 64-bit hashes.
    """
    docs = identified(docs, id_col, text_col)
    keyed = docs.repartition("doc_id")  # both joins with texts read this one exchange

    anchors = docs.where("doc_id is not null").mapInArrow(_anchors(length), "doc_id long, anchors array<long>").select("doc_id", F.explode("anchors").alias("anchor"))
    holders = Window.partitionBy("anchor")
    shared = anchors.withColumn("low", F.min("doc_id").over(holders)).withColumn("high", F.max("doc_id").over(holders)).where("low < high")
    seeds = shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    found = keyed.join(seeds, "doc_id", "left").select("doc_id", "text", "anchors")  # as below, so that the exchange is the same
    windows = found.mapInArrow(_extended(length), "doc_id long, windows array<long>").select("doc_id", F.explode("windows").alias("window"))
    repeated = windows.withColumn("low", F.min("doc_id").over(Window.partitionBy("window"))).where("doc_id > low")
    repeated = repeated.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))

    marked = keyed.join(repeated, "doc_id", "left").select("doc_id", "text", "windows")
    return marked.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_text string")
