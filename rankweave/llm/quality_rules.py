"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule is a pair of SQL conditions over counts of the text: bad, good, or neither (it abstains).
Expectation-maximisation over all documents finds how often documents are good and how accurate
each rule is on good and on bad ones; a document's posterior probability of being good then replaces the demand that all
rules pass. Documents with the same votes have the same posterior, so the estimation needs only
the number of documents for each pattern of votes: at most 3 ** (number of rules) rows, whatever
the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.shared import identified, saved
from rankweave.llm.words import Block, blocks, run_hashes

#: Name, condition of a bad document, condition of a good one. No rule restates the base rule (length, repeats).
RULES: tuple[tuple[str, str, str], ...] = (
    ("word_length", "word_chars < 3.5 * n_words OR word_chars > 7 * n_words", "word_chars BETWEEN 4 * n_words AND 6 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 AND n_lines > 2"),
    ("capitals", "10 * n_upper > 4 * n_letters", "10 * n_upper <= n_letters"),
    ("variety", "ln(n_distinct) < 0.9 * ln(n_words)", "ln(n_distinct) >= 0.94 * ln(n_words)"),
    ("sentence_ends", "10 * n_ended < 7 * n_lines", "10 * n_ended >= 9 * n_lines"),
    ("exclamations", "20 * n_exclaim > n_words", "50 * n_exclaim <= n_words"),
)
MAX_RULES = 12
#: Documents that the prior counts for, of each kind, and how they would vote (bad, abstain, good).
PRIOR, PRIOR_VOTES = 2.0, ((0.5, 0.3, 0.2), (0.1, 0.3, 0.6))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_distinct", "n_upper", "n_letters", "n_exclaim")


def _bytes_of(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


_SYMBOLS, _UPPER, _EXCLAIM, _ENDS = _bytes_of("#*$%&|<>"), _bytes_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_of("!"), _bytes_of(".!?")
_LETTERS = _UPPER | _bytes_of("abcdefghijklmnopqrstuvwxyz")


def _repeats(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (owner, value): is there an equal one, and is this an equal one's later occurrence."""
    order = np.lexsort((value, owner))  # stable, so occurrences stay in order
    same = (owner[order][1:] == owner[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, any_other = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    later[order[1:]] = same
    any_other[order[1:]] |= same
    any_other[order[:-1]] |= same
    return any_other, later


def _counts(block: Block) -> dict[str, np.ndarray]:
    data, n, offsets = block.data, len(block.rows), block.offsets

    def within(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mark)))
        return total[offsets[1:]] - total[offsets[:-1]]

    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    owner = block.owners()
    out = {"n_words": block.counts(), "word_chars": np.bincount(owner, points[block.end] - points[block.start], n)}
    out |= {"n_symbols": within(_SYMBOLS[data]), "n_upper": within(_UPPER[data]), "n_letters": within(_LETTERS[data]), "n_exclaim": within(_EXCLAIM[data])}

    h = block.hashes()
    out["n_distinct"] = np.bincount(owner[~_repeats(owner, h)[1]], minlength=n)
    at = np.arange(max(0, len(h) - 2))
    at = at[owner[at] == owner[at + 2]]
    often, _ = _repeats(owner[at], run_hashes(h, at, at + 3))
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[often] + k] = True
    out["n_repeat_words"] = np.bincount(owner[covered], minlength=n)

    newline = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], newline + 1)))
    end = np.sort(np.concatenate((newline, offsets[1:])))
    words = np.searchsorted(block.start, end) - np.searchsorted(block.start, start)
    has = words > 0
    start, end = start[has], end[has]
    line_owner = np.searchsorted(offsets, start, "right") - 1
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = np.bincount(line_owner[_repeats(line_owner, run_hashes(data, start, end))[1]], minlength=n)
    last = block.end[np.searchsorted(block.end, end, "right") - 1] - 1
    out["n_ended"] = np.bincount(line_owner[_ENDS[data[last]]], minlength=n)
    return out


def text_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, counts): a narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                counts = _counts(block)
                ids = batch.column(0).slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], ["doc_id", *_COUNTS])

    return docs.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))


def estimate(patterns: list[tuple[list[int], int]], n_rules: int, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good documents, rates) from (votes, number of documents).

    rates[c, j, v + 1] is how often rule j votes v on documents that are bad (c = 0) or good
    (c = 1): its accuracy on either kind, and how often it abstains; they sum to 1. The first guess
    takes the documents with fewer bad votes for the better ones. After that only the votes count, but
    for a prior of PRIOR documents of each kind, which keeps rates off 0 and 1. So a bad vote of a
    rule that does not agree with the others comes to weigh little.
    """
    prior_counts = PRIOR * np.repeat(np.array(PRIOR_VOTES)[:, None, :], n_rules, 1)
    if not patterns:
        return 0.5, prior_counts / PRIOR
    votes, weight = np.array([v for v, _ in patterns]).reshape(len(patterns), n_rules) + 1, np.array([w for _, w in patterns], float)
    which, n_bad = np.arange(n_rules), (votes == 0).sum(1)
    good = np.where(n_bad > 0, 0.5 - 0.1 * np.minimum(n_bad, 4), 0.9)
    for _ in range(rounds):
        rates = prior_counts.copy()
        for c, share in enumerate((weight * (1 - good), weight * good)):
            for v in range(3):
                rates[c, :, v] += share @ (votes == v)
        rates /= rates.sum(2, keepdims=True)
        prior = float((weight @ good + PRIOR) / (weight.sum() + 2 * PRIOR))
        logit = math.log(prior / (1 - prior)) + np.log(rates[1, which, votes] / rates[0, which, votes]).sum(1)
        was, good = good, 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(good - was).max() < 1e-9:
            break
    return prior, rates


def quality_by_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """(doc_id, counts, votes, quality, base_failed, kept): one row for each row of docs.

    votes has 1 (good), -1 (bad) or 0 (abstains) for each rule, quality is the posterior. kept is
    false if base_failed (under 50 words, or more than half of the words in repeated three-word
    windows), and otherwise whether quality >= threshold (a tie is kept). The estimation counts every
    document that is not base_failed. Null, empty and blank texts have no words: base_failed, and
    rules whose condition is null abstain. Texts count whole, however long. A null doc_id is rated
    like any other; rows that repeat one are rated each. An empty table gives an empty result. Other
    columns are ignored. At most MAX_RULES rules. A job runs when this is called.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    counts = saved(text_counts(identified(docs, id_col, text_col)))
    votes: list[Column] = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, bad, good in rules]
    failed = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    voted = counts.withColumn("votes", F.array(*votes)).withColumn("base_failed", failed)
    patterns = [(list(r["votes"]), r["n"]) for r in voted.where("NOT base_failed").groupBy("votes").agg(F.count("*").alias("n")).collect()]  # at most 3 ** MAX_RULES
    prior, rates = estimate(sorted(patterns), len(rules))
    logit = F.lit(math.log(prior / (1 - prior)))
    for j, (on_bad, on_good) in enumerate(zip(rates[0], rates[1], strict=True)):
        weight = [float(x) for x in np.log(on_good / on_bad)]
        logit = logit + F.get(F.array(*(F.lit(x) for x in weight)), F.col("votes")[j] + 1)
    out = voted.withColumn("quality", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
