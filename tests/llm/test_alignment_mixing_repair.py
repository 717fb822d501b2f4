"""Token alignment, mixing of sources and repair of conversations against plain Python."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import alignment, mixing, queries
from rankweave.llm import structure_repair as repair

CLASHES = ("size", "n", "a", "b", "links", "link", "item", "rest", "k", "of", "target", "row", "rows", "cost", "audit", "place", "block")
A, B = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "   ", "two  spaces  and an end ", "\n\t x▁y ▁", "a\0b \r\n c", "日本語テキスト 🎉🎉 é ü", "<|endoftext|> <s> </s> <unk> <0x41>", "A" * 3000,
    "The thin thing's there, isn't it? 12345 678", "It's " * 400, "The thin thing's there, isn't it? 12345 678",
]


@pytest.fixture(scope="module")
def shared(spark):
    return alignment.aligner(spark, A, B, public_tokenizers.PATTERN)


def plain_alignment(texts):
    """(n_a, n_b, n_groups, digest, links) of each text by the libraries, with dictionaries of ends."""
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    of = alignment.byte_level_characters()
    tokens = {k: bytes(of[c] for c in t) for t, k in one.get_vocab().items() if t != "<|endoftext|>"}
    piece = lambda k: bytes([int(other.id_to_piece(k)[3:-1], 16)]) if other.is_byte(k) else other.id_to_piece(k).replace("▁", " ").encode()
    for text in texts:
        raw, a, b = (" " + (text or "")).encode(), [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)
        sides = [[tokens[k] for k in a], [piece(k) for k in b]]
        if not text or any(b"".join(s) != raw for s in sides):
            yield 0, 0, 0, "", []
            continue
        ends = [{e: k for k, e in enumerate(itertools.accumulate(map(len, s)))} for s in sides]
        groups, links, at = [], [], (0, 0)
        for end in sorted(ends[0].keys() & ends[1].keys()):
            stop = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, a[at[0] : stop[0]])) + "|" + ",".join(map(str, b[at[1] : stop[1]])))
            links.append((a[stop[0] - 1], b[stop[1] - 1]))
            at = stop
        yield len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def test_alignment_is_that_of_the_libraries(spark, sf, shared):
    given = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts = TEXTS + given
    docs = spark.createDataFrame([(None if k == 4 else k % 70, t) for k, t in enumerate(texts)], "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    expected = list(plain_alignment(texts))
    assert sum(1 for e in expected if e[0]) > 60
    count = Counter(link for e in expected for link in e[4])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = [(None if k == 4 else k % 70, *e[:3], len(e[4]), sum(count[x] == most[x[1]] for x in e[4]), sum(count[x] for x in e[4]), e[3]) for k, e in enumerate(expected)]
    aligned = alignment.align(docs, shared, digest=True).withColumn("n_groups", F.size("links").cast("long"))
    got = alignment.with_link_counts(aligned, shared).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    counts = alignment.link_counts(aligned, shared).collect()
    assert {(r["a"], r["b"]): r["count"] for r in counts} == count


def test_groups_hold_the_same_bytes(spark, shared):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    by = shared.value
    tokens_a = {k: t for t, k in by.a.ranks.items()}
    for row in alignment.align(docs, shared).collect():
        at = (0, 0)
        for stop in zip(row.a_ends, row.b_ends, strict=True):
            assert b"".join(tokens_a[k] for k in row.a[at[0] : stop[0]]) == b"".join(by.b.tokens[k] for k in row.b[at[1] : stop[1]])
            at = stop
        assert at == (len(row.a), len(row.b))


def test_alignment_of_nothing(spark, shared):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.with_link_counts(alignment.align(empty, shared), shared).collect() == []


def plain_targets(sizes, weights=(3, 1, 2), percent=150, limit=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()) * percent / 100, set()
    while True:
        rest = total - sum(limit * sizes[s] for s in capped)
        share = {s: limit * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        above = {s for s in names if share[s] > limit * sizes[s] + 1e-9}
        if not above:
            return share
        capped |= above


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = rng.choice([0, 1, 2, 5, rng.randint(1, 60), rng.randint(1, 400)])
        source = rng.choice(["a", "a", "a", "b", "é", "Z", "z", "", None, f"s{k % 7}"])
        rows.append((rng.choice([k, k, k, None, 7]), rng.choice([" ", "\n\t "]).join(["w"] * words) if words else rng.choice([None, "", " \x0b\n"]), source))
    return rows + [(5, "same row", "a")] * 150 + [(9, "x " * 20_000, "b"), (10, "x " * 20_000, "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rows = mix_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    got = mixing.mixed(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken = Counter(), Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
        largest[source] = max(largest[source], size(text))
    targets = plain_targets(sizes)
    assert sorted(map(repr, ((r.doc_id, r.source, r.size) for r in got))) == sorted(map(repr, ((d, s, size(t)) for d, t, s in rows)))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r.size and r.copies - 1 <= r.target / max(r.source_size, 1) <= r.copies + 1 and r.copies <= 2
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= largest[source] / 2 + 1
    again = mixing.mixed(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_keeps_expected_copies(spark):
    """Of 12,000 equal fractions in two sizes, each size gets its share, whichever it meets."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'a', 'a b c d e f g') AS text", "if(id < 6000, 'x', 'y') AS source")
    got = mixing.mixed(docs).groupBy("source", "size").agg(F.avg("copies").alias("copies"), F.first(F.expr("target / source_size")).alias("factor")).collect()
    for r in got:
        assert r.copies == pytest.approx(r.factor, abs=0.03)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []
    [row] = mixing.mixed(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert (row.size, row.source_size, row.target, row.copies, row.taken) == (0, 0, 0.0, 0, 0)


GOOD = re.compile("(s?(ua)+)?")


def every_repair(rows):
    """The least (cost, audit) by trying all edits of (initial, fault) with up to two insertions in each gap."""
    gaps = [(), *itertools.product("ua", repeat=1), *itertools.product("ua", repeat=2)]
    best = None
    choices = [
        [("D", "", 3)] + ([] if f in ("b", "d") else [("K", i, f == "t"), ("R", "u", 2 + (f == "t")), ("R", "a", 2 + (f == "t"))])
        for i, f in rows
    ]
    for edits in itertools.product(*choices):
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k, extra in enumerate(inserted):
                roles, audit, cost = roles + "".join(extra), audit + "I" * len(extra), cost + 2 * len(extra)
                if k < len(rows):
                    roles, audit, cost = roles + (edits[k][1] or ("" if edits[k][0] == "D" else "?")), audit + edits[k][0], cost + int(edits[k][2])
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def row_by_row(rows):
    """The least (cost, audit) by the states' cells, one row after the other."""
    cells = dict(repair.INSERTIONS)
    for row in rows:
        cells = repair.combined(cells, repair.row_cells(*row))
    return min(cells[0, q] for q in (0, 3))


def test_repairs_are_the_cheapest():
    kinds = [(i, f) for i in ("s", "u", "a", "x", "") for f in ("", "b", "d", "t")]
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            assert repair.parsed(tuple(rows)) == every_repair(rows), rows
    rng = random.Random(3)
    for _ in range(25):
        rows = tuple(rng.choice(kinds) for _ in range(3))
        assert repair.parsed(rows) == every_repair(rows), rows
    for n in (5, 9, 64, 65, 700):
        rows = tuple(rng.choice(kinds) for _ in range(n))
        assert repair.parsed(rows) == row_by_row(rows)


def test_audits_tell_the_repair():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "b", "t"])) for _ in range(rng.randint(0, 9))]
        _, audit = repair.parsed(tuple((r[0], f) for r, f in rows))
        done = repair.edits([r for r, _ in rows], audit)
        assert GOOD.fullmatch("".join(role[0] for _, _, role in done if role))
        assert [k for e, k, _ in done if e != "I"] == list(range(len(rows)))


def test_conversations_are_repaired(spark):
    rows = [
        (1, 3, "assistant", "Yes."), (1, 0, "system", "Be good.\n"), (1, 1, "user", "Hello"), (1, 1, "user", "Hello"), (1, None, "user", " \t"),
        (2, 0, "user", "A?"), (2, 5, "assistant", "B!"), (3, 0, None, None), (None, 1, "assistant", "C."), (4, None, "user", "Only this."), (5, 0, "assistant", "Out."),
    ]
    turns = spark.createDataFrame([(*r, r[0] != 5) for r in rows], "conv_id long, turn long, role string, text string, here boolean").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    got = {r.conv_id: r for r in repair.repaired_conversations(turns, present_col="here").collect()}
    told = lambda c: tuple(got[c][k] for k in ("rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    said = lambda c: [(e.role, e.text, e.turn) for e in got[c].repaired if e.edit != "D"]
    assert told(1) == (5, 1, 1, 1, 1, 2, 7, "DKKDK")
    assert said(1) == [("system", "Be good.\n", 0), ("user", "Hello", 1), ("assistant", "Yes.", 3)]
    assert told(2) == (2, 4, 0, 0, 0, 0, 0, "KK")
    assert told(3) == (1, 0, 1, 0, 0, 0, 3, "D") and said(3) == []
    assert told(None) == (1, 0, 0, 0, 0, 0, 2, "IK") and said(None) == [("user", "", None), ("assistant", "C.", 1)]
    assert told(4) == (1, 0, 0, 0, 0, 0, 2, "KI")
    assert told(5) == (0, 0, 0, 0, 0, 0, 0, "") and got[5].repaired == []
    assert repair.repaired_conversations(turns.limit(0)).collect() == []


def test_a_long_conversation_is_repaired(spark):
    turns = spark.range(5001).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, '.') AS text")
    [row] = repair.repaired_conversations(turns).collect()
    assert (row.rows, row.cost, row.audit) == (5001, 2, "K" * 5001 + "I")


def test_registered_queries_have_a_row_for_each_input_row(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.op12_mix_sources(spark, sf).count() == n
