"""Co-training of two quality classifiers, one on the text and one on the page's metadata.

Each view learns from labelled documents and, for some rounds, passes its confident guesses on all
unlabelled documents to the other view as pseudo-labels. Both views are naive Bayes: a model is the
counts of marks among good and bad documents, so learning is a grouped sum that Spark makes over any
number of documents, labelled or not, and no sample of them is drawn. In each round both views are
calibrated on labelled documents that neither has learnt from; a guess is confident if its
calibrated probability is. In the end the calibrated views are combined.

The text view has marks for the ranges of some counts (length, symbols, capitals, repeats and so
on) and marks for words that go with a label. The metadata view has marks for language, source,
both together, and the range of the length given. What comes to the driver are counts of marks (at
most 2 ** WORD_BITS + 2 ** META_BITS) and at most MAX_CALIBRATION labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.quality_rules import _counts
from rankweave.llm.shared import saved
from rankweave.llm.words import BLACK, LOWER, Block, blocks, mixed

#: Labelled rows, drawn by a hash, on which views are calibrated and combined; a larger number only narrows the error.
MAX_CALIBRATION = 20_000
WORD_BITS, META_BITS = 18, 14
#: A text's word marks are its distinct words of letters; a word counts in the model if its tie with the label is this strong (chi-square) and it is in this many labelled texts.
LEAST_TIE, LEAST_TEXTS = 20.0, 4
ROUNDS, SURE, SMOOTHING = 3, 0.97, 0.5
#: Upper edges of the ranges of each ratio of the text view.
_RANGES = {
    "words": (20, 50, 100, 300, 1000, 5000), "symbols": (0.005, 0.02, 0.05, 0.1, 0.3), "capitals": (0.02, 0.05, 0.1, 0.3, 0.6), "repeats": (0.01, 0.05, 0.1, 0.2, 0.35, 0.5), "variety": (0.1, 0.2, 0.35, 0.5, 0.7),
    "exclamations": (0.005, 0.02, 0.1, 0.3), "length": (2.5, 3.5, 5, 7, 9, 12), "lines": (0.05, 0.2, 0.4), "ends": (0.05, 0.3, 0.6, 0.9),
}
_LETTER = BLACK & ~np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"))


def _style(block: Block) -> tuple[np.ndarray, int]:
    """For each text the numbers of its marks, one for each range, and how many numbers there are."""
    c = {k: v.astype(float) for k, v in _counts(block).items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    values = {
        "words": c["n_words"], "symbols": c["n_symbols"] / words, "capitals": c["n_upper"] / np.maximum(c["n_letters"], 1), "repeats": c["n_repeat_words"] / words, "variety": c["n_distinct"] / words,
        "exclamations": c["n_exclaim"] / words, "length": c["word_chars"] / words, "lines": c["n_dup_lines"] / lines, "ends": c["n_ended"] / lines,
    }
    marks, base = [], 0
    for name, edges in _RANGES.items():
        marks.append(np.searchsorted(edges, values[name]) + base)
        base += len(edges) + 1
    return np.stack(marks, 1), base


N_STYLE = sum(len(x) + 1 for x in _RANGES.values())


def _meta_marks(lang: pa.Array, source: pa.Array, size: pa.Array) -> np.ndarray:
    """Marks of the metadata view; null is a value like any other."""
    import xxhash

    coded = []
    for column in (lang, source):
        values = column.dictionary_encode(null_encoding="encode")
        coded.append((values.indices.to_numpy(zero_copy_only=False).astype(np.int64), values.dictionary.to_pylist()))
    scale = np.ceil(np.log2(np.maximum(size.fill_null(0).to_numpy(zero_copy_only=False), 0) + 1.0)).astype(np.int64) + 1
    scale[size.is_null().to_numpy(zero_copy_only=False)] = 0
    mark = lambda key: xxhash.xxh3_64_intdigest(key) & ((1 << META_BITS) - 1)
    (one, ones), (two, twos) = coded
    pair, which = np.unique(one * max(len(twos), 1) + two, return_inverse=True)
    both = [mark(f"both {ones[p // len(twos)]} {twos[p % len(twos)]}") for p in pair.tolist()]
    tables = ([mark(f"lang {x}") for x in ones], [mark(f"source {x}") for x in twos], both, [mark(f"size {k}") for k in range(66)])
    return np.stack([np.array(t, np.int64)[k] for t, k in zip(tables, (one, two, which, scale), strict=True)], 1)


def _word_marks(texts: pa.Array) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(rows, text index, word mark) of the distinct folded words of letters."""
    for block in blocks(texts, _LETTER):
        owner = block.owners()
        mark = (mixed(block.hashes(LOWER)) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
        code = np.unique((owner << WORD_BITS) | mark)
        yield block.rows, code >> WORD_BITS, code & ((1 << WORD_BITS) - 1)


def _marks(batch: pa.RecordBatch) -> Iterator[tuple[range, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a batch of (doc_id, text, lang, source, size): rows, style, metadata, text index and word mark."""
    meta = _meta_marks(*(batch.column(k) for k in (2, 3, 4)))
    style = np.concatenate([_style(block)[0] for block in blocks(batch.column(1))]) if len(batch) else np.zeros((0, len(_RANGES)), np.int64)
    for rows, owner, word in _word_marks(batch.column(1)):
        at = slice(rows.start, rows.stop)
        yield rows, style[at], meta[at], owner, word


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        for rows, style, meta, owner, word in _marks(batch):
            n = len(rows)
            fixed = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1).astype(np.int32))) for m in (style, meta)]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(word.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, n), *fixed, words], ["doc_id", "style", "meta", "words"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression, by Newton's method."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class View:
    """Naive Bayes over marks: a weight for each mark, zero for those hardly seen; calibrated by a line."""

    weights: np.ndarray
    constant: float
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def learnt(cls, counts: np.ndarray, documents: np.ndarray) -> View:
        """From counts[label, mark] and documents[label]."""
        odds = np.log((counts[1] + SMOOTHING) / (documents[1] + 2 * SMOOTHING)) - np.log((counts[0] + SMOOTHING) / (documents[0] + 2 * SMOOTHING))
        return cls(np.where(counts.sum(0) >= 2, odds, 0.0), float(np.log((documents[1] + 1) / (documents[0] + 1))))

    def logit(self, owner: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, from (document, mark)."""
        return self.line[0] * (np.bincount(owner, self.weights[marks], n) + self.constant) + self.line[1]


@dataclass
class Model:
    """Both views and their combination: a logit is combine @ (text, meta, 1)."""

    text: View
    meta: View
    combine: np.ndarray
    rounds: list[tuple[int, int]]
    held_out_accuracy: float | None

    def views(self) -> tuple[View, View]:
        return self.text, self.meta


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists."""
    rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column)
    return rows, (values.to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)).astype(np.int64)


def _marked(known: DataFrame, told: np.ndarray) -> DataFrame:
    """known(doc_id, good, style, meta, words) -> (doc_id, good, text, meta): lists of marks; words are those told."""
    mask = np.zeros(1 << WORD_BITS, bool)
    mask[told] = True
    mask = known.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words = _listed(batch.column(4))
            kept = mask.value[words]
            style_rows, style = _listed(batch.column(2))
            owner, marks = np.concatenate((style_rows, rows[kept])), np.concatenate((style, N_STYLE + words[kept]))
            order = np.argsort(owner, kind="stable")
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(batch))))).astype(np.int32)
            text = pa.ListArray.from_arrays(pa.array(offsets), pa.array(marks[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, batch.column(3)], ["doc_id", "good", "text", "meta"])

    return known.select("doc_id", "good", "style", "meta", "words").mapInArrow(run, "doc_id long, good int, text array<int>, meta array<int>")


_SIZES = (N_STYLE + (1 << WORD_BITS), 1 << META_BITS)


def _summed(counts: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """(counts[label, mark] of each view, documents[view, label]) from rows (view, mark, good, n); mark -1 counts documents."""
    rows = counts.groupBy("view", "mark", "good").agg(F.sum("n").alias("n")).toArrow()
    view, mark, good, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("view", "mark", "good", "n"))
    out, documents = [np.zeros((2, size)) for size in _SIZES], np.zeros((2, 2))
    for k in (0, 1):
        at = (view == k) & (mark >= 0)
        out[k][good[at], mark[at]] = n[at]
    at = mark < 0
    documents[view[at], good[at]] = n[at]
    return out, documents


def _partial(parts: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (view, mark, good, n) that count, in one task, (view, label of each document, document, mark)."""
    totals = [np.zeros((2, size + 1), np.int64) for size in _SIZES]
    for view, label, owner, marks in parts:
        for value in (0, 1):
            chosen = label == value
            totals[view][value, :-1] += np.bincount(marks[chosen[owner]], minlength=_SIZES[view])
            totals[view][value, -1] += chosen.sum()
    found = [(v, *np.nonzero(t)) for v, t in enumerate(totals)]
    mark = np.concatenate([np.where(m == _SIZES[v], -1, m) for v, _, m in found])
    columns = [np.concatenate([np.full(len(m), v) for v, _, m in found]), mark, np.concatenate([g for _, g, _ in found]), np.concatenate([totals[v][g, m] for v, g, m in found])]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["view", "mark", "good", "n"])


_COUNTED = "view long, mark long, good long, n long"


def _of_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts():
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for view in (0, 1):
                yield view, label, *_listed(batch.column(2 + view))

    yield _partial(parts())


def _exchanged(views: tuple[View, View], sure: float):
    """Counts for each view of the documents that the other one is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                marks = [_listed(batch.column(2 + view)) for view in (0, 1)]
                for view, teacher in ((0, 1), (1, 0)):
                    p = _sigmoid(views[teacher].logit(*marks[teacher], len(batch)))
                    yield view, np.where(p >= sure, 1, np.where(p <= 1 - sure, 0, -1)), *marks[view]

        yield _partial(parts())

    return run


#: Parts of the labelled documents, by a hash: for the views and their words, for calibration and combination, and for the accuracy alone.
TRAINING, CALIBRATION, TEST = "pmod(xxhash64(doc_id), 4) != 0", "pmod(xxhash64(doc_id), 16) IN (4, 8, 12)", "pmod(xxhash64(doc_id), 16) = 0"


def _calibration(held: DataFrame, most: int) -> pa.Table:
    """At most about `most` of the labelled rows, drawn by a hash."""
    n = held.count()
    return held.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))).toArrow()


def _truth(rows: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels of some rows, and their marks in both views."""
    marks = [_listed(rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))) for c in ("text", "meta")]
    return rows.column("good").to_numpy().astype(float), marks


def telling_words(known: DataFrame) -> np.ndarray:
    """Marks of the words whose presence goes with the label, counted over all of some labelled documents."""
    n, good = known.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not 0 < good < n:
        return np.zeros(0, np.int64)
    share = good / n
    words = known.select("good", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    tie = F.pow(F.col("g") - F.col("n") * share, 2) / F.greatest(F.col("n") * (share * (1 - share)) * (1 - F.col("n") / n), F.lit(1e-9))
    return words.where((F.col("n") >= LEAST_TEXTS) & (tie >= LEAST_TIE)).select("word").toArrow().column("word").to_numpy().astype(np.int64)


def co_train(marked: DataFrame, rounds: int = ROUNDS, sure: float = SURE, max_calibration: int = MAX_CALIBRATION) -> Model:
    """Fits a Model on marked(doc_id, good, text, meta); good is 1, 0, or null for an unlabelled document.

    Every fourth labelled document, by a hash, is held out, three of four of them for calibration and one for nothing but
    the model's accuracy; views and telling words are learnt from the others. In each round a view
    hands on all unlabelled documents whose calibrated probability is at least `sure` for either
    label; together they weigh no more than the labelled ones. With labels of one kind only, or none,
    every document has the same score.
    """
    labelled = marked.where("good IS NOT NULL")
    counts, documents = _summed(labelled.where(TRAINING).mapInArrow(_of_labelled, _COUNTED))
    held, test = (_calibration(labelled.where(rows), max_calibration) for rows in (CALIBRATION, TEST))
    truth, marks = _truth(held)
    able = documents.all() and len(set(truth)) == 2
    extra, added, taught = [np.zeros_like(c) for c in counts], np.zeros((2, 2)), []
    for k in range(rounds + 1):
        views = []
        for v in (0, 1):
            weight = min(1.0, documents[v].sum() / max(added[v].sum(), 1.0))
            view = View.learnt(counts[v] + weight * extra[v], documents[v] + weight * added[v])
            if able:
                view.line = tuple(_logistic(view.logit(*marks[v], len(truth))[:, None], truth, penalty=0.1))
            views.append(view)
        if k == rounds or not able:
            break
        extra, added = _summed(marked.where("good IS NULL").mapInArrow(_exchanged(tuple(views), sure), _COUNTED))
        taught.append((int(added[0].sum()), int(added[1].sum())))
    combine, accuracy = np.array([1.0, 0.0, 0.0]), None
    if able:
        both = np.stack([views[v].logit(*marks[v], len(truth)) for v in (0, 1)], 1)
        combine = _logistic(both, truth, penalty=0.1)
        told, marks = _truth(test)
        both = np.stack([views[v].logit(*marks[v], len(told)) for v in (0, 1)], 1)
        accuracy = float(((both @ combine[:2] + combine[2] > 0) == told).mean()) if len(told) else None
    return Model(*views, combine, taught, accuracy)


def _learnt(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], max_calibration: int) -> tuple[DataFrame, DataFrame, Model]:
    """docs' columns under fixed names, their marks, and the model. Runs jobs."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "size": "long"}
    docs = docs.select(*(F.col(c).cast(kind).alias(name) for c, (name, kind) in zip(names, kinds.items(), strict=True)))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("good").cast("int").alias("good"))
    labels = labels.where("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    features = docs.mapInArrow(_features, "doc_id long, style array<int>, meta array<int>, words array<int>")
    # by sorted keys at every size, so that a larger table has the plan of a smaller one
    known = saved(features.join(labels.hint("merge"), "doc_id", "left"))
    marked = saved(_marked(known, telling_words(known.where("good IS NOT NULL").where(TRAINING))))
    return docs, marked, co_train(marked, max_calibration=max_calibration)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker's memory stays small."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def _scores(m: Model, text: tuple, meta: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text score, metadata score, quality) of n documents, from (document, mark) of either view."""
    one, two = m.text.logit(*text, n), m.meta.logit(*meta, n)
    return _sigmoid(one), _sigmoid(two), _sigmoid(m.combine[0] * one + m.combine[1] * two + m.combine[2])


def _quality(m: Model, batch: pa.RecordBatch) -> np.ndarray:
    """Quality of each row of (doc_id, text, lang, source, size)."""
    out = [np.zeros(0)]
    for rows, style, meta, owner, word in _marks(batch):
        n = len(rows)
        text = np.concatenate((np.repeat(np.arange(n), style.shape[1]), owner)), np.concatenate((style.reshape(-1), N_STYLE + word))
        out.append(_scores(m, text, (np.repeat(np.arange(n), meta.shape[1]), meta.reshape(-1)), n)[2])
    return np.concatenate(out)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_scores(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = COLUMNS, threshold: float = 0.5, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """(doc_id, text_score, meta_score, quality, kept): one row for each row of docs.

    columns names the id, the text, and the metadata: language, source and length. labels(doc_id,
    good 0/1) are of any subset; a null label or doc_id is left out and of repeated ones the
    smallest counts. text_score and meta_score are the calibrated probabilities of a good document
    in each view, quality is that of both, kept is quality >= threshold (a tie is kept). Null, empty
    and blank texts have the marks of no words, texts count whole, however long; null metadata is a
    value of its own. A null doc_id has no label. Rows that repeat a doc_id are scored each and share
    its label. An empty table gives an empty result; without labels of both kinds every document has
    the same score. Other columns are ignored. Jobs run when this is called.
    """
    _, marked, model = _learnt(docs, labels, columns, max_calibration)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rated = _scores(model.value, _listed(batch.column(1)), _listed(batch.column(2)), len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rated)], ["doc_id", "text_score", "meta_score", "quality"])

    scored = marked.select("doc_id", "text", "meta").mapInArrow(run, "doc_id long, text_score double, meta_score double, quality double")
    return scored.withColumn("kept", F.col("quality") >= threshold)


def good_documents(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = COLUMNS, threshold: float = 0.5, max_calibration: int = MAX_CALIBRATION) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores() keeps.

    As there for nulls, empty and long texts, ties, repeats and empty tables. Texts are not
    shuffled: the model rates them in a second pass. Jobs run when this is called.
    """
    named, _, model = _learnt(docs, labels, columns, max_calibration)
    model = docs.sparkSession.sparkContext.broadcast(model)
    names, own, at = named.columns, docs.columns, [docs.columns.index(c) for c in columns]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            rated = pa.RecordBatch.from_arrays([part.column(k).cast(kind) for k, kind in zip(at, kinds, strict=True)], names)
            yield part.filter(pa.array(_quality(model.value, rated) >= threshold)).rename_columns(own)

    return docs.mapInArrow(run, docs.schema)
