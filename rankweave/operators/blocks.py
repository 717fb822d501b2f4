"""A grid of question blocks and passage blocks, with the best hits kept while it is walked.

Passages are packed into rows of some hundreds: a block of vectors, or a small inverted index with, for each
term, its postings and the greatest impact that any of them has. Questions are packed too. A pair of a
question block and a passage block is one step of NumPy; a task keeps the k best hits of each question it
has met, so what leaves it are at most k rows a question, whatever the passages. A question whose terms'
greatest impacts in a block cannot reach its k-th best score skips that block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions and passages of a block, and bytes of the passages of a block unless one alone has more.
QUERY_BLOCK, PASSAGE_BLOCK, BLOCK_BYTES = 4096, 512, 1 << 21
#: Terms of blocks that meet in one group to be counted, and asked terms up to which an index for these alone is made.
RANGE_TERMS, ASKED_TERMS = 1 << 20, 1 << 17
#: A side of at most so many entries (terms of questions, or numbers of their vectors) is broadcast, about 64 MB.
BROADCAST_ENTRIES = 1 << 21
#: A task has the hits of question blocks of so many entries at a time, so of all that are broadcast.
KNOWN_ENTRIES = 1 << 21
#: Scores of words are sums in some order; places to which they count.
PLACES = 9


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if it has fewer partitions than there are cores; a larger table stays where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _row(values: pa.Array) -> pa.Array:
    """A column of one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _runs(texts: pa.Array, more: bytes, least: int) -> tuple[pa.Array, np.ndarray]:
    """(words, place of each one's text): runs of at least so many of a-z, 0-9 and more, found in the bytes of lower-cased texts."""
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    low, data = int(at[0]), texts.buffers()[2]
    data = np.frombuffer(data, np.uint8, int(at[-1]) - low, low) if data is not None else np.zeros(0, np.uint8)
    at = at.astype(np.int64) - low
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a word ends with its text
    known = np.zeros(256, bool)
    known[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789" + more, np.uint8)] = True
    inside = known[data]
    start = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    stop = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1
    length = stop - start
    if least > 1:
        size = np.repeat(length, length)
        kept, long = data[inside][size >= least], length >= least
        start, length = start[long], length[long]
    else:
        kept = data[inside]
    ends = np.append(0, np.cumsum(length)).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(kept))), np.searchsorted(at, start, "right") - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of MurmurHash3, one to one."""
    for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(33))) * factor
    return x ^ (x >> np.uint64(33))


def _grams(texts: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, place of its text) of each n-gram of up to most words of two characters or more, by text."""
    words, of = _runs(texts, b"_", 2)
    coded = words.dictionary_encode()
    each = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    one = each[coded.indices.to_numpy()] if len(words) else each
    gram, found, places = one, [one], [of]
    for n in range(2, most + 1):
        gram = _mixed(gram[: max(0, len(one) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :])
        whole = of[n - 1 :] == of[: len(gram)]
        found.append(gram[whole])
        places.append(of[: len(gram)][whole])
    return np.concatenate(found).view(np.int64), np.concatenate(places)


def grams(df: DataFrame, most: int) -> DataFrame:
    """df with hashes of the n-grams of its column text as terms, array<long>, in place of the text."""
    kept = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = _grams(_texts(batch.column(len(kept))), most)
            found = found[np.argsort(of, kind="stable")]
            ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(batch))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))], [*kept, "terms"])

    schema = [f"{c} {df.schema[c].dataType.simpleString()}" for c in kept] + ["terms array<bigint>"]
    return df.select(*kept, F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, ", ".join(schema))


def _texts(column: pa.Array) -> pa.Array:
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def _cut(texts: pa.Array) -> np.ndarray:
    """Bytes of each text."""
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes(x: np.ndarray) -> bytes:
    """Numbers of at least 0 in the least width that holds them all."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _of_bytes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)


def _postings(code: np.ndarray, of: np.ndarray, n: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, docs, tfs) of occurrences: by term, then by text."""
    pair = np.sort(code * n + of)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
    tf, pair = np.diff(np.append(first, len(pair))), pair[first]
    return np.bincount(pair // n, minlength=n_terms), pair % n, tf


def _picked(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the postings of the terms at such places."""
    start, size = (np.cumsum(counts) - counts)[at], counts[at]
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)


def word_blocks(passages: DataFrame, asked: list[str] | None = None) -> DataFrame:
    """Inverted blocks of passages(passage_id, label, text) by words of a-z and 0-9; label may be null.

    (ids, labels, sizes, terms, counts, docs, tfs, all_terms, all_counts): the postings of terms[t] are the next counts[t] of docs and
    tfs, docs being places in ids, sizes the words of each passage. Of asked terms only, if given, there are postings; all_terms are
    those of the block and all_counts the passages that have them. No passage is split.
    """
    kind = dict(passages.dtypes)["passage_id"]
    wanted = None if asked is None else pa.array(asked, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            size, low = _cut(texts), 0
            while low < len(batch):
                high = low + max(1, int(np.searchsorted(np.cumsum(size[low : low + PASSAGE_BLOCK]), BLOCK_BYTES, "right")))
                words, of = _runs(texts.slice(low, high - low), b"", 1)
                n, coded = high - low, words.dictionary_encode()
                terms = every = coded.dictionary
                counts, docs, tfs = _postings(coded.indices.to_numpy().astype(np.int64), of, n, len(terms))
                each = pa.array(counts, pa.int32())
                if wanted is not None:
                    at = np.flatnonzero(pc.is_in(every, value_set=wanted).to_numpy(zero_copy_only=False))
                    take, terms, counts = _picked(counts, at), every.take(pa.array(at)), counts[at]
                    docs, tfs = docs[take], tfs[take]
                one = [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(np.bincount(of, minlength=n), pa.int32()), terms, pa.array(counts, pa.int32()), pa.array(docs, pa.int32()), pa.array(tfs, pa.int32()), every, each]
                yield pa.RecordBatch.from_arrays([_row(x) for x in one], [*names, "all_terms", "all_counts"])
                low = high

    names = ["ids", "labels", "sizes", "terms", "counts", "docs", "tfs"]
    out = f"ids array<{kind}>, labels array<int>, sizes array<int>, terms array<string>, counts array<int>, docs array<int>, tfs array<int>, all_terms array<string>, all_counts array<int>"
    return passages.select("passage_id", F.col("label").cast("int").alias("label"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, out)


def gram_blocks(passages: DataFrame, most: int, asked: list[int] | None = None) -> DataFrame:
    """Inverted blocks of passages(passage_id, label, text) by hashes of n-grams; label may be null.

    (ids, labels, terms, counts, docs, tfs, names, at): as word_blocks(), but all postings are there, packed into bytes (terms 8 each and
    ascending, the others of the width that they need); names are the asked terms, or all, and at their places in terms.
    """
    kind = dict(passages.dtypes)["passage_id"]
    wanted = None if asked is None else np.sort(np.array(asked, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(2))
            size, low = _cut(texts), 0
            while low < len(batch):
                high = low + max(1, int(np.searchsorted(np.cumsum(size[low : low + PASSAGE_BLOCK]), BLOCK_BYTES, "right")))
                found, of = _grams(texts.slice(low, high - low), most)
                n, coded = high - low, pa.array(found).dictionary_encode()
                terms = coded.dictionary.to_numpy()
                order = np.argsort(terms)
                place = np.empty(len(terms), np.int64)
                place[order] = np.arange(len(terms))
                terms = terms[order]
                counts, docs, tfs = _postings(place[coded.indices.to_numpy()], of, n, len(terms))
                at = np.arange(len(terms)) if wanted is None else np.flatnonzero(np.isin(terms, wanted))
                packed = [pa.array([x], pa.binary()) for x in (terms.tobytes(), _bytes(counts), _bytes(docs), _bytes(tfs))]
                yield pa.RecordBatch.from_arrays([_row(batch.column(0).slice(low, n)), _row(batch.column(1).slice(low, n)), *packed, _row(pa.array(terms[at])), pa.array([_bytes(at)], pa.binary())], ["ids", "labels", "terms", "counts", "docs", "tfs", "names", "at"])
                low = high

    out = f"ids array<{kind}>, labels array<int>, terms binary, counts binary, docs binary, tfs binary, names array<bigint>, at binary"
    return passages.select("passage_id", F.col("label").cast("int").alias("label"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(run, out)


def block_frequencies(blocks: DataFrame, total: int) -> DataFrame:
    """(block, dfs): for gram_blocks() with a column block, how many passages have each of a block's terms, packed as (part, dfs) by part.

    The hashes are cut into equal ranges, so many that one has about RANGE_TERMS of the total; a range of a block is a row of
    packed numbers in the shuffle. Rows of a range meet in one group, which is bounded whatever the passages.
    """
    parts = max(1, -(-total // RANGE_TERMS))
    bounds = np.array([(k << 64) // parts - (1 << 63) for k in range(1, parts)], np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                terms, counts = np.frombuffer(batch.column(1)[k].as_py(), np.int64), _of_bytes(batch.column(2)[k].as_py())
                ends = np.concatenate(([0], np.searchsorted(terms, bounds), [len(terms)]))
                own = np.flatnonzero(np.diff(ends))
                columns = [pa.array(np.full(len(own), batch.column(0)[k].as_py())), pa.array(own, pa.int32()), pa.array([terms[ends[p] : ends[p + 1]].tobytes() for p in own], pa.binary()), pa.array([_bytes(counts[ends[p] : ends[p + 1]]) for p in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "part", "terms", "counts"])

    def summed(rows: pa.Table) -> pa.Table:
        terms = [np.frombuffer(x, np.int64) for x in rows.column("terms").to_pylist()]
        ends = np.cumsum([len(x) for x in terms])[:-1]
        every, counts = np.concatenate(terms), np.concatenate([_of_bytes(x) for x in rows.column("counts").to_pylist()])
        order = np.argsort(every)
        every = every[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        dfs = np.empty(len(every), np.int64)
        dfs[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(np.append(first, len(every))))
        return pa.table([rows.column("block"), rows.column("part"), pa.array([_bytes(x) for x in np.split(dfs, ends)], pa.binary())], ["block", "part", "dfs"])

    pieces = blocks.select("block", "terms", "counts").mapInArrow(cut, "block bigint, part int, terms binary, counts binary")
    met = pieces.groupBy("part").applyInArrow(summed, "block bigint, part int, dfs binary")
    return met.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "dfs"))).alias("dfs"))


def _list(column: pa.Array, row: int) -> pa.Array:
    return column[row].values


def _numbers(column: pa.Array, row: int, kind: type = np.int64) -> np.ndarray:
    return _list(column, row).to_numpy(zero_copy_only=False).astype(kind)


def finished(blocks: DataFrame, impact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """word_blocks() with impact(tfs, size of the passage of each) for each posting, and the greatest of each term as tops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                counts, docs, tfs, size = (_numbers(batch.column(c), k) for c in ("counts", "docs", "tfs", "sizes"))
                yield _with_impacts([batch.column(c).slice(k, 1) for c in INDEX], counts, impact(tfs, size[docs]))

    return blocks.select(*INDEX, "tfs", "sizes").mapInArrow(run, _index_schema(blocks))


def finished_cosines(blocks: DataFrame, n: int, min_df: int) -> DataFrame:
    """gram_blocks() with dfs of block_frequencies() as blocks of the named terms' shares in tf-idf vectors of length 1, without the query's idf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                counts, docs, tfs, at = (_of_bytes(batch.column(c)[k].as_py()) for c in ("counts", "docs", "tfs", "at"))
                packed = (batch.column("dfs")[k].values or pa.array([])) if batch.column("dfs")[k].is_valid else []
                df = np.concatenate([_of_bytes(x) for x in packed.field("dfs").to_pylist()]) if len(packed) else np.zeros(0)
                idf = np.where(df >= min_df, np.log((1 + n) / (1 + df)) + 1, 0.0)
                once = 1 + np.log(tfs)
                length = np.sqrt(np.bincount(docs, (once * np.repeat(idf, counts)) ** 2, len(_list(batch.column("ids"), k))))
                take = _picked(counts, at)
                counts, docs = counts[at], docs[take]
                one = [batch.column("ids").slice(k, 1), batch.column("labels").slice(k, 1), batch.column("names").slice(k, 1), _row(pa.array(counts, pa.int32())), _row(pa.array(docs, pa.int32()))]
                yield _with_impacts(one, counts, once[take] / np.where(length > 0, length, np.inf)[docs])

    return blocks.select("ids", "labels", "names", "counts", "docs", "tfs", "at", "dfs").mapInArrow(run, _index_schema(blocks.withColumn("terms", F.col("names"))))


INDEX = ("ids", "labels", "terms", "counts", "docs")


def _index_schema(blocks: DataFrame) -> str:
    ids, terms = (blocks.schema[c].dataType.simpleString() for c in ("ids", "terms"))
    return f"ids {ids}, labels array<int>, terms {terms}, counts array<int>, docs array<int>, impacts array<double>, tops array<double>"


def _with_impacts(columns: list[pa.Array], counts: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    tops = np.maximum.reduceat(found, np.cumsum(counts) - counts) if len(counts) else found
    return pa.RecordBatch.from_arrays([*columns, _row(pa.array(found, pa.float64())), _row(pa.array(tops, pa.float64()))], [*INDEX, "impacts", "tops"])


def vector_blocks(passages: DataFrame) -> DataFrame:
    """(ids, labels, vecs): blocks of passages(passage_id, label, vec), the vectors one after the other; all have one length."""
    kind = dict(passages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), PASSAGE_BLOCK):
                part = batch.slice(low, PASSAGE_BLOCK)
                yield pa.RecordBatch.from_arrays([_row(x) for x in (part.column(0), part.column(1), part.column(2).flatten())], ["ids", "labels", "vecs"])

    return passages.select("passage_id", F.col("label").cast("int").alias("label"), "vec").mapInArrow(run, f"ids array<{kind['passage_id']}>, labels array<int>, vecs {kind['vec']}")


def question_blocks(entries: DataFrame, n: int) -> DataFrame:
    """(qblock, entries) of n questions' entries(query_id, permits, ...), each question whole in one block."""
    blocks = max(1, -(-n // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    return entries.select(block.alias("qblock"), F.struct(*entries.columns).alias("entry")).groupBy("qblock").agg(F.collect_list("entry").alias("entries"))


class _Best:
    """The k best hits of each question of a block so far, all hits without k."""

    def __init__(self, n: int, k: int | None, places: int | None) -> None:
        self.k, self.places = k, places
        self.least = np.full(n, -np.inf)
        self.question, self.passage, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, question: np.ndarray, passage: np.ndarray, score: np.ndarray) -> None:
        score = score if self.places is None else np.round(score, self.places)
        if self.k is not None:
            good = score >= self.least[question]
            question, passage, score = question[good], passage[good], score[good]
        if not len(question):
            return
        self.question, self.score = np.concatenate((self.question, question)), np.concatenate((self.score, score))
        self.passage = passage if self.passage is None else np.concatenate((self.passage, passage))
        if self.k is not None:
            order = np.lexsort((self.passage, -self.score, self.question))
            of = self.question[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            order = order[place < self.k]
            self.question, self.passage, self.score = self.question[order], self.passage[order], self.score[order]
            last = np.flatnonzero(place[place < self.k] == self.k - 1)
            self.least[self.question[last]] = self.score[last]


class _Words:
    """Questions as weights of terms."""

    def __init__(self, entries: pa.Array) -> None:
        ids, terms = entries.field("query_id").dictionary_encode(), entries.field("term").dictionary_encode()
        self.ids, self.terms = ids.dictionary, terms.dictionary
        term, of, weight = terms.indices.to_numpy(), ids.indices.to_numpy(), entries.field("weight").to_numpy(zero_copy_only=False)
        order = np.lexsort((of, term))
        self.term, self.of, self.weight = term[order], of[order].astype(np.int64), weight[order]
        self.permits, self.size = _permits(entries, ids), len(self.term)

    def scores(self, batch: pa.RecordBatch, row: int, best: _Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, place of the passage, score) of all pairs that share a term, but those of questions that cannot get better."""
        at = pc.index_in(self.terms, value_set=_list(batch.column("terms"), row))
        at = at.fill_null(-1).to_numpy()[self.term]
        met = at >= 0
        at, of, weight = at[met], self.of[met], self.weight[met]
        if best.k is not None:
            most = np.bincount(of, np.maximum(weight, 0) * _numbers(batch.column("tops"), row, float)[at], len(self.ids))
            hopeful = (most >= best.least - 10.0 ** (1 - PLACES))[of]
            at, of, weight = at[hopeful], of[hopeful], weight[hopeful]
        counts, n = _numbers(batch.column("counts"), row), len(batch.column("ids")[row].values)
        docs, impacts = _numbers(batch.column("docs"), row), _numbers(batch.column("impacts"), row, float)
        start, size = (np.cumsum(counts) - counts)[at], counts[at]
        total = np.cumsum(size)
        posting = np.repeat(start - total + size, size) + np.arange(int(total[-1]) if len(total) else 0)
        questions, place = np.unique(of, return_inverse=True)
        cell = np.repeat(place, size) * n + docs[posting]
        score = np.bincount(cell, np.repeat(weight, size) * impacts[posting], len(questions) * n)
        found = np.flatnonzero(np.bincount(cell, minlength=len(score)))
        return questions[found // n], found % n, score[found]


#: Questions of a block whose vectors meet those of a block of passages at a time.
VECTOR_STEP = 256


class _Vectors:
    """Questions as vectors."""

    def __init__(self, entries: pa.Array) -> None:
        ids = entries.field("query_id").dictionary_encode()
        self.ids = ids.dictionary
        self.matrix = entries.field("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        self.of = ids.indices.to_numpy()
        self.permits, self.size = _permits(entries, ids), self.matrix.size

    def scores(self, batch: pa.RecordBatch, row: int, best: _Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, paired = len(batch.column("ids")[row].values), "pairs" in batch.schema.names
        vecs = _numbers(batch.column("vecs"), row, float).reshape(n, -1).T
        labels = None if self.permits is None else _list(batch.column("labels"), row).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for low in range(0, len(self.of), VECTOR_STEP):
            of = self.of[low : low + VECTOR_STEP]
            score = self.matrix[low : low + VECTOR_STEP] @ vecs
            good = score == score
            if best.k is not None:
                if labels is not None:
                    score = np.where(_permitted(self.permits, of[:, None], labels[None, :]), score, -np.inf)
                good = score >= best.least[of][:, None]
                many = np.flatnonzero(np.count_nonzero(good, 1) > best.k)
                if len(many) and not paired:  # others of the block are better, and permitted
                    good[many] &= score[many] >= np.partition(score[many], n - best.k, 1)[:, n - best.k, None]
            question, place = np.nonzero(good)
            found.append((of[question].astype(np.int64), place, score[question, place]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _permits(entries: pa.Array, ids: pa.DictionaryArray) -> np.ndarray | None:
    """For each question the bits of the labels that it permits; all where it has none."""
    column = entries.field("permits")
    if column.null_count == len(column):
        return None
    size = max(map(len, (x for x in column.to_pylist() if x is not None)), default=1) or 1
    out = np.full((len(ids.dictionary), size), -1, np.int64)
    for k, bits in zip(ids.indices.to_pylist(), column.to_pylist(), strict=True):
        if bits is not None:
            out[k] = [*bits, *[0] * (size - len(bits))]
    return out


def _permitted(permits: np.ndarray, question: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Whether each question's bits have the label's; no label (-1) is permitted, one beyond the bits only where all are set."""
    word = np.clip(labels >> 6, 0, permits.shape[1] - 1)
    bit = (permits[question, word] >> (labels & 63)) & 1
    return np.where(labels < 0, True, np.where((labels >> 6) >= permits.shape[1], (permits[question] == -1).all(-1), bit == 1))


def best_hits(questions: DataFrame, blocks: DataFrame, k: int | None, kind: str, small: bool, id_kinds: tuple[str, str], allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, passage_id, score): for each task of the grid the k best hits of each question; all hits without k.

    questions are question_blocks() with weights of terms (kind "words") or vectors (kind "vectors"),
    blocks finished() ones or vector_blocks(). small says that the questions fit BROADCAST_ENTRIES. allowed
    has (qblock, block, pairs) where only pairs of (query_id, passage_id) may be hits; blocks then need a column block.
    """
    if allowed is None:
        grid = blocks.crossJoin(F.broadcast(questions) if small else questions)  # packed rows, one for each pair of blocks
    else:
        grid = allowed.join(blocks, "block").join(F.broadcast(questions) if small else questions, "qblock")
    paired = allowed is not None
    unpacked = {"words": _Words, "vectors": _Vectors}[kind]
    places = PLACES if kind == "words" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}

        def rows(at: int) -> Iterator[pa.RecordBatch]:
            asked, best = known.pop(at)
            if best.passage is not None:
                for low in range(0, len(best.score), 1 << 16):
                    cut = slice(low, low + (1 << 16))
                    columns = [asked.ids.take(pa.array(best.question[cut])), pa.array(best.passage[cut]).cast(passage_type[0]), pa.array(best.score[cut])]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "passage_id", "score"])

        passage_type: list = []
        for batch in batches:
            passage_type[:] = [batch.schema.field("ids").type.value_type]
            for row in range(len(batch)):
                at = batch.column("qblock")[row].as_py()
                if at not in known:
                    asked = unpacked(batch.column("entries")[row].values)
                    while known and sum(x.size for x, _ in known.values()) + asked.size > KNOWN_ENTRIES:  # blocks of questions come in turns
                        yield from rows(next(iter(known)))
                    known[at] = asked, _Best(len(asked.ids), k, places)
                asked, best = known[at]
                question, place, score = asked.scores(batch, row, best)
                if asked.permits is not None:
                    labels = _list(batch.column("labels"), row).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    ok = _permitted(asked.permits, question, labels[place])
                    question, place, score = question[ok], place[ok], score[ok]
                ids = _list(batch.column("ids"), row)
                if paired:
                    pairs = batch.column("pairs")[row].values
                    one = pc.index_in(pairs.field("query_id"), value_set=asked.ids).fill_null(0).to_numpy().astype(np.int64)
                    two = pc.index_in(pairs.field("passage_id"), value_set=ids).fill_null(0).to_numpy().astype(np.int64)
                    ok = np.isin(question * len(ids) + place, one * len(ids) + two)
                    question, place, score = question[ok], place[ok], score[ok]
                names = ids.to_numpy(zero_copy_only=False)
                best.add(question, (names.astype(str) if names.dtype == object else names)[place], score)
                if k is None:
                    yield from rows(at)
        for at in list(known):
            yield from rows(at)

    return grid.mapInArrow(run, f"query_id {id_kinds[0]}, passage_id {id_kinds[1]}, score double")
