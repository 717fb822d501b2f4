"""What alignments delete, what a classifier may not learn from, memory of short texts, and counted tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import line_dedup, minhash_dedup, secret_scan
from rankweave.llm import quality_classifier as qc
from rankweave.llm.chat_format import chat_windows
from rankweave.llm.minhash_dedup import near_duplicates


def every_block(a, b, sizes, least):
    """Lines of b in equal stretches that begin and end with lines and have least bytes, by trying all."""
    gone = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n, total = 0, 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                total += sizes[j + n]
                n += 1
                if b[j] and b[j + n - 1] and total >= least:
                    gone.update(range(j, j + n))
    return sorted(gone)


def test_the_crossing_block_with_a_blank_line():
    a, b = [4, 0, 1, 1, 1, 0, 4], [4, 4, 3, 2, 1, 0, 4, 4, 1, 4, 2]
    for size in (24, 30, 35):
        sizes = [size if x else 0 for x in b]
        assert line_dedup._doomed(a, b, sizes, 30) == every_block(a, b, sizes, 30)


@pytest.mark.parametrize("seed", range(4))
def test_alignments_find_every_block(seed):
    rng = random.Random(seed)
    for _ in range(700):
        kinds = rng.randint(2, 7)
        size = {k: rng.choice([5, 14, 24, 30, 35]) for k in range(1, kinds)} | {0: 0}
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 12))] for _ in "ab")
        if rng.random() < 0.5:  # moved blocks
            cut = sorted(rng.sample(range(len(a) + 1), min(3, len(a) + 1)))
            b = [x for part in [a[p:q] for p, q in zip([0, *cut], [*cut, len(a)], strict=True)][::-1] for x in part] + b[:2]
        sizes = [size[x] for x in b]
        assert line_dedup._doomed(a, b, sizes, 30) == every_block(a, b, sizes, 30), (a, b, sizes)


def test_nothing_goes_without_an_alignment(monkeypatch):
    monkeypatch.setattr(line_dedup, "aligned", lambda a, b: [])
    assert line_dedup._doomed([1, 2, 3], [1, 2, 3], [40, 40, 40], 30) == []


def test_blocks_meet_whose_lines_were_first_seen_apart(spark):
    """Two long lines with a blank one between: each is in an earlier document, both only in the second."""
    x, y = "the first long line of a block, as it is", "the second long line of a block, as it is"
    rows = [(0, x), (1, y), (2, f"{x}\n\n{y}"), (3, f"own words of the third text here\n{x}\n\n{y}\nand its end, which no other has")]
    got = {r.doc_id: r.kept_text for r in line_dedup.without_shared_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: x, 1: y, 2: "", 3: "own words of the third text here\nand its end, which no other has"}


def test_held_out_documents_teach_nothing(spark):
    """A word that tells the label of documents outside the training part only is not learnt, and the accuracy shows it."""
    rows = spark.range(1600).select("id", F.expr(qc.TRAINING.replace("doc_id", "id")).alias("train"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2))).alias("good"))
    text = F.when(F.col("train"), F.lit("common words alike in all of them")).otherwise(F.when(F.col("good") == 1, "common excellent words").otherwise("common terrible words"))
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(30).cast("long").alias("n_chars"))
    known = docs.select("doc_id", F.array(F.when(F.col("text").contains("excellent"), F.lit(7)).otherwise(F.lit(8))).alias("words")).join(rows.select(F.col("id").alias("doc_id"), "good"), "doc_id")
    assert qc.telling_words(known.where(qc.TRAINING)).tolist() == [] and set(qc.telling_words(known)) == {7, 8}
    _, _, model = qc._learnt(docs, rows.select(F.col("id").alias("doc_id"), "good"), qc.COLUMNS, qc.MAX_CALIBRATION)
    assert abs(model.held_out_accuracy - 0.5) < 0.2


def test_parts_of_the_labelled_documents(spark):
    parts = spark.range(4000).select(F.col("id").alias("doc_id")).select(*(F.expr(p).cast("int").alias(n) for n, p in (("a", qc.TRAINING), ("b", qc.CALIBRATION), ("c", qc.TEST))))
    a, b, c, most = parts.agg(F.avg("a"), F.avg("b"), F.avg("c"), F.max(F.col("a") + F.col("b") + F.col("c"))).first()
    assert np.allclose((a, b, c), (3 / 4, 3 / 16, 1 / 16), atol=0.02) and most == 1


def test_blocks_of_short_texts_are_bounded(spark, monkeypatch):
    """Many texts of two shingles in one bucket: a meeting holds two blocks of members, however few shingles they have."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 100)
    texts = spark.range(1500).selectExpr("id AS doc_id", "concat('hello world u', id div 2) AS text")
    nodes = texts.selectExpr("struct(doc_id, xxhash64(text) AS text_hash) AS node", "2 AS n", "doc_id AS label", "0L AS home", "1L AS key")
    sizes = minhash_dedup._blocks_of_strangers(nodes, texts.selectExpr("doc_id", "xxhash64(text) AS text_hash", "text"), 80).groupBy("i", "j").count().agg(F.max("count")).first()[0]
    assert sizes <= 2 * 100 * 1.6
    got = near_duplicates(texts, words=2).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 2 and r.kept == (r.doc_id % 2 == 0) for r in got) and len(got) == 1500


def test_tokens_of_a_column(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "one two three", [7] * 200, 200) for k in range(6)] + [(2, 0, "user", "one two three", None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids array<int>, told int")
    by_ids, by_number, rough = (sorted(map(tuple, chat_windows(turns, **k).select("conv_id", "window", "n_turns", "n_tokens").collect())) for k in ({"tokens_col": "ids"}, {"tokens_col": "told"}, {}))
    assert by_ids == by_number and len(by_ids) > len(rough) and (2, 0, 1, 7) in by_ids and (2, 0, 1, 7) in rough
    assert all(n <= 512 for _, _, _, n in by_ids)


def test_secrets_of_the_unlabelled_half(spark):
    """Every second value has no label: recall and precision among those, of keys that are issued, named or assigned, and of words, numbers and addresses."""
    rng = random.Random(6)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexa, rows, true = "0123456789abcdef", [], set()
    for i in range(600):
        value = [some(hexa, 40), some(hexa, 17) + "7a", "AKIA" + some("ABCDEFGHIJ234567", 16), some("abcdefghij", 18), f"user.{i}@mail{i}.example.com", some("0123456789", 16)][i % 6]
        rows.append((i, "the tion er " + ["token = ", "password=", "", "see ", "", "number "][i % 6] + value + " an the er", "web"))
        if i % 6 < 3:
            true.add((i, value))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.candidates(docs)
    labelled = {(r.doc_id, r.value) for r in secret_scan.distant_labels(found).collect()}
    silent = {(r.doc_id, r.value) for r in found.collect()} - labelled
    got = {(r.doc_id, r.value) for r in secret_scan.secrets(docs).collect()} & silent
    assert 0.4 < len(silent) / (len(silent) + len(labelled)) < 0.6
    assert len(got & true) / len(silent & true) >= 0.9 and len(got & true) / len(got) >= 0.9
