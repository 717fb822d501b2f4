"""Lines that an earlier document already has, found by shared lines and aligned by patience diff.

A line is known by a hash of its text without the white space around it. Lines that are long enough
to be a block by themselves, runs of consecutive lines that are just long enough, and two long lines with
blank ones between are seeds: each line of a block that counts is in a seed of the block. Seeds are the keys by
which documents meet: each document that has a shared one is paired with the first document that has it; so a
key that n documents share gives about n pairs, whether it is rare or not, and every seed shared with an
earlier document is in one of the pairs.

Each pair is aligned by patience diff over its seeds: seeds that are unique in both give the longest increasing chain, and the
stretches between are aligned likewise. Around each aligned seed the equal lines make a block, and
aligned blocks are deleted from the later document. No alignment in order holds blocks that have moved across each other;
so what is left of the later document is aligned again, until no seed of it is in the earlier one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import saved
from rankweave.llm.words import blocks, lists, run_hashes


def _runs(h: np.ndarray, size: np.ndarray, offsets: np.ndarray, least_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts' offsets in, and hashes of, runs of two or more lines that have least_bytes, but not without their last line or not without their first.

    Runs begin and end with lines that are not blank; two lines of least_bytes with only blank ones between are a run too. Every
    line of a block of at least least_bytes is in such a run of the block, or is one itself.
    """
    total = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(h)
    low, high = offsets[:-1][owner[at]], offsets[1:][owner[at]]
    end = np.searchsorted(total, total[at] + least_bytes)
    start = np.searchsorted(total, total[at + 1] - least_bytes, "right") - 1
    onward, back = (end <= high) & (end > at + 1), (start >= low) & (start < at)
    over = np.flatnonzero((np.diff(at) > 1) & (size[at[:-1]] >= least_bytes) & (size[at[1:]] >= least_bytes) & (at[1:] < high[:-1]))
    pairs = np.concatenate((at[onward] * len(total) + end[onward], start[back] * len(total) + at[back] + 1, at[over] * len(total) + at[over + 1] + 1))
    first, after = np.divmod(np.unique(pairs), len(total))
    return np.searchsorted(first, offsets), run_hashes(h, first, after)


def line_hashes(docs: DataFrame, least_bytes: int) -> DataFrame:
    """docs(doc_id, text_hash, text) -> (doc_id, text_hash, hashes, sizes, keys): for each line its hash (0 if blank) and its bytes; the distinct keys of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                newline = np.flatnonzero(block.data == 10)
                start = np.sort(np.concatenate((block.offsets[:-1], newline + 1)))
                end = np.sort(np.concatenate((newline, block.offsets[1:])))
                first = np.searchsorted(block.start, start)
                after = np.searchsorted(block.start, end)
                full = after > first
                low, high = block.start[first[full]], block.end[after[full] - 1]
                h, size = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
                h[full], size[full] = np.maximum(run_hashes(block.data, low, high), np.uint64(1)), high - low
                inside = np.concatenate(([0], np.cumsum(block.data == 10)))[block.offsets]
                offsets = inside + np.arange(len(inside))
                n = len(block.rows)
                ids = [batch.column(k).slice(block.rows.start, n) for k in (0, 1)]
                first_run, runs = _runs(h, size, offsets, least_bytes)
                long = np.flatnonzero(size >= least_bytes)
                owner = np.concatenate((np.searchsorted(offsets, long, "right") - 1, np.repeat(np.arange(n), np.diff(first_run))))
                key = np.concatenate((h[long], runs))
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                keys = lists(np.concatenate(([0], np.cumsum(np.bincount(owner[new], minlength=n)))), key[new].view(np.int64))
                yield pa.RecordBatch.from_arrays([*ids, lists(offsets, h.view(np.int64)), lists(offsets, size), keys], ["doc_id", "text_hash", "hashes", "sizes", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, hashes array<long>, sizes array<long>, keys array<long>")


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, in which the second increases too."""
    tails: list[int] = []
    at, before = [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(tails, j)
        before[k] = at[place - 1] if place else -1
        tails[place : place + 1] = [j]
        at[place : place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, increasing in both, by patience diff; 0 stands for a blank line."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alow, ahigh, blow, bhigh = todo.pop()
        while alow < ahigh and blow < bhigh and a[alow] == b[blow]:
            out.append((alow, blow))
            alow, blow = alow + 1, blow + 1
        while alow < ahigh and blow < bhigh and a[ahigh - 1] == b[bhigh - 1]:
            ahigh, bhigh = ahigh - 1, bhigh - 1
            out.append((ahigh, bhigh))
        if alow == ahigh or blow == bhigh:
            continue
        in_a, in_b = Counter(a[alow:ahigh]), Counter(b[blow:bhigh])
        place = {b[j]: j for j in range(blow, bhigh) if in_b[b[j]] == 1}
        anchors = _chain([(i, place[a[i]]) for i in range(alow, ahigh) if a[i] and in_a[a[i]] == 1 and a[i] in place])
        if not anchors:  # no unique line: the first occurrences are as good as any
            place = {}
            for j in range(bhigh - 1, blow - 1, -1):
                place[b[j]] = j
            seen = set()
            anchors = _chain([(i, place[a[i]]) for i in range(alow, ahigh) if a[i] and a[i] in place and not (a[i] in seen or seen.add(a[i]))])
        for (i, j), (k, m) in zip([(alow - 1, blow - 1), *anchors], [*anchors, (ahigh, bhigh)], strict=True):
            if anchors:
                todo.append((i + 1, k, j + 1, m))
        out += anchors
    return sorted(out)


def seeds(lines: list[int], sizes: list[int], least_bytes: int) -> list[tuple[int, int]]:
    """(first, after) of seeds in order; the ends are not blank."""
    places = [k for k, line in enumerate(lines) if line]
    total = [0]
    for k in places:
        total.append(total[-1] + sizes[k])
    out = set()
    for k, place in enumerate(places):
        after = bisect_left(total, total[k] + least_bytes)
        if after < len(total):
            out.add((place, places[after - 1] + 1))
        before = bisect_right(total, total[k + 1] - least_bytes) - 1
        if before >= 0:
            out.add((places[before], place + 1))
        if k and place - places[k - 1] > 1 and min(sizes[place], sizes[places[k - 1]]) >= least_bytes:
            out.add((places[k - 1], place + 1))
    return sorted(out)


def _doomed(a: list[int], b: list[int], sizes: list[int], least_bytes: int) -> list[int]:
    """Lines of b in blocks that alignments of its seeds with those of a hold, until none is left; sizes are of b."""
    size_of = dict(zip(b, sizes, strict=True))
    names: dict[tuple, int] = {}
    in_a = [(low, names.setdefault(tuple(a[low:high]), len(names) + 1)) for low, high in seeds(a, [size_of.get(x, least_bytes) for x in a], least_bytes)]
    left = [(low, high, names.get(tuple(b[low:high]))) for low, high in seeds(b, sizes, least_bytes)]
    left, gone = [seed for seed in left if seed[2]], set()
    while left:
        shift, stop = None, 0
        for i, j in aligned([name for _, name in in_a], [name for *_, name in left]):
            at, (low, high, _) = in_a[i][0], left[j]
            if shift == at - low and high <= stop:
                continue  # within the block before
            shift, start, stop = at - low, low, high
            while stop < len(b) and stop + shift < len(a) and b[stop] == a[stop + shift]:
                stop += 1
            while start and start + shift and b[start - 1] == a[start + shift - 1]:
                start -= 1
            first, last = start, stop
            while not b[first]:
                first += 1
            while not b[last - 1]:
                last -= 1
            gone.update(range(first, last))
        rest = [seed for seed in left if not gone.issuperset(range(seed[0], seed[1]))]
        if len(rest) == len(left):
            break
        left = rest
    return sorted(gone)


def _aligned_pairs(least_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                gone = [_doomed(*row, least_bytes) for row in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "text_hash", "gone"])

    return run


def without_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = 30, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_deleted, kept_text, carried): one row for each row of docs.

    carried is a struct of the columns named in carry; other columns are ignored.

    A line goes if it is in a block that a document of a smaller doc_id has too: consecutive lines
    that begin and end with lines that are not blank and have at least least_bytes of text in all,
    counted without white space around lines. Blank lines inside a block go with it. All is judged on
    the input, so results depend on no order. kept_text has the other lines as they were. A null text
    stays null; an empty one has one blank line; texts count whole, however long. Rows that repeat a
    doc_id are judged each by its own text, and take nothing from each other; a null doc_id is in no
    order and stays whole. An empty table gives an empty result. A job runs when this is called.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(c) for c in carry or (id_col,))).alias("carried"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    row = ["doc_id", "text_hash"]
    lines = saved(line_hashes(docs.where("doc_id IS NOT NULL").select(*row, "text"), least_bytes).where("size(keys) > 0").dropDuplicates(row))
    held = lines.select(*row, F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.min(F.struct(*row)).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last")
    pairs = held.join(shared, "key").where("doc_id > first.doc_id").select(*row, F.col("first")["doc_id"].alias("a"), F.col("first")["text_hash"].alias("hash_a")).distinct()

    texts = pairs.join(lines.select(F.col("doc_id").alias("a"), F.col("text_hash").alias("hash_a"), F.col("hashes").alias("of_a")), ["a", "hash_a"]).join(lines.drop("keys"), row)
    gone = texts.select(*row, "of_a", "hashes", "sizes").mapInArrow(_aligned_pairs(least_bytes), "doc_id long, text_hash long, gone array<int>")
    gone = gone.where(F.size("gone") > 0).groupBy(*row).agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    out = docs.join(gone, row, "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone")
    rest = F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n")
    return out.select("doc_id", F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("kept_text"), "carried")
