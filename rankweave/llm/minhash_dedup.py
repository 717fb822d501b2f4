"""Near-duplicate documents: one-permutation MinHash with optimal densification, and star-shaped candidates.

Each text becomes the set of its distinct shingles. Texts with the same set are one node. A node's
set goes through one permutation, whose values are dealt into BINS bins; the least value of each bin
is the signature. An empty bin takes the value of another bin, drawn by hashes of the bin and the
number of the try until it meets a full one (optimal densification), so sets of any size, even of a
few shingles, have bins that agree with the chance of their similarity. BANDS bands of the signature
name the buckets.

Within a bucket, the member with most company (the hub) is compared with the others (a star); the
comparison counts both full sets. So a group of n copies gives about n pairs. A bucket is open while
its members are in different components. Its strangers, the members outside its largest component,
are then hubs as well. In a bucket of up to SMALL members that is a pair for each stranger and member.
The members of larger ones are dealt into blocks of about BLOCK_SHINGLES and at most about BLOCK_MEMBERS; a block with strangers of a
bucket meets the blocks with members of the same bucket and another component, unless their sizes
rule a link out. A meeting gives at most the links that connect them, and no rows are made for pairs.
So no link between members of a bucket is lost. Where many documents are alike but not linked, this
work grows with the strangers times the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components, merged
from rankweave.llm.shared import identified, saved
from rankweave.llm.words import LOWER, Block, blocks, lists, mixed, run_hashes

BINS, BANDS, SALTS, SMALL, BLOCK_SHINGLES, BLOCK_MEMBERS = 128, 32, 64, 16, 1 << 16, 1024
#: Up to so many texts of two blocks that have a shingle, pairs are counted one by one, beyond by a matrix product.
FEW = 16
_TAG = np.uint64(0xA24BAED4963EE407)


def _sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle) of the distinct shingles, sorted by both."""
    h, n = block.hashes(LOWER), block.counts()
    per = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), per)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = block.first[owner] + rank
    shingle = run_hashes(h, start, start + np.minimum(n, words)[owner])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def signatures(owner: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """An n x BINS array; owner and shingle are sorted, and each of the n has at least one shingle."""
    part = (shingle >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)
    cell = owner * BINS + part
    least = np.ones(len(cell), bool)
    least[1:] = cell[1:] != cell[:-1]
    sig, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[cell[least]], full[cell[least]] = shingle[least], True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        row, hole = np.divmod(empty, BINS)
        drawn = mixed(np.arange(BINS, dtype=np.uint64) + np.uint64(attempt * BINS) + _TAG) % np.uint64(BINS)
        source = row * BINS + drawn.astype(np.int64)[hole]
        found = full[source]
        sig[empty[found]] = sig[source[found]]
        empty, attempt = empty[~found], attempt + 1
    return sig.reshape(n, BINS)


def bands(owner: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """An n x BANDS array of bucket keys; owner and shingle as for signatures()."""
    sig = signatures(owner, shingle, n).reshape(n, BANDS, BINS // BANDS)
    key = np.tile(mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)), (n, 1))
    for j in range(sig.shape[2]):
        key = mixed(key ^ sig[:, :, j])
    return key


def bucket_keys(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text_hash, text) -> (doc_id, text_hash, n_shingles, set_a, set_b, keys): set_a and set_b together name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                owner, shingle = _sets(block, words)
                n = len(block.rows)
                size = np.bincount(owner, minlength=n)
                end, name = np.cumsum(size), []
                for salt in (np.uint64(3), np.uint64(5)):
                    total = np.zeros(len(owner) + 1, np.uint64)
                    np.cumsum(mixed(shingle * salt + salt), out=total[1:])
                    name.append(pa.array((total[end] - total[end - size]).view(np.int64)))
                has = size > 0
                dense = np.cumsum(has) - 1
                shuffled = mixed(shingle)
                order = np.lexsort((shuffled, owner))
                keys = bands(dense[owner[order]], shuffled[order], int(has.sum())).reshape(-1)
                offsets = np.concatenate(([0], np.cumsum(np.where(has, BANDS, 0))))
                ids = [batch.column(k).slice(block.rows.start, n) for k in (0, 1)]
                columns = [*ids, pa.array(size.astype(np.int64)), *name, lists(offsets, keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, keys array<long>")


def confirmed(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """pairs(a, b, text_a, text_b) -> (a, b) of those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                owners, shingles = [], []
                for side in (2, 3):
                    for block in blocks(part.column(side)):
                        owner, shingle = _sets(block, words)
                        owners.append(owner + block.rows.start)
                        shingles.append(shingle)
                owner, shingle = np.concatenate(owners), np.concatenate(shingles)
                order = np.lexsort((shingle, owner))
                owner, shingle = owner[order], shingle[order]
                same = (owner[1:] == owner[:-1]) & (shingle[1:] == shingle[:-1])
                both = np.bincount(owner[1:][same], minlength=len(part))
                either = np.bincount(owner, minlength=len(part)) - both
                linked = pa.array((100 * both >= percent * either) & (either > 0))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(linked), part.column(1).filter(linked)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct pairs of nodes (a, hash_a, b, hash_b), each with both texts."""
    out = pairs.distinct()
    for side in "ab":
        of = texts.select(F.col("doc_id").alias(side), F.col("text_hash").alias(f"hash_{side}"), F.col("text").alias(f"text_{side}"))
        out = out.join(of, [side, f"hash_{side}"])
    return out


def _pair(one: str, other: str) -> list:
    """Columns of a pair of structs (doc_id, text_hash), the lesser first."""
    low, high = F.least(one, other), F.greatest(one, other)
    return [low["doc_id"].alias("a"), low["text_hash"].alias("hash_a"), high["doc_id"].alias("b"), high["text_hash"].alias("hash_b")]


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with the label of their doc_id; one without links is its own."""
    of = labels.select(F.col("id").alias("of"), "label")
    return members.join(of, members["node"]["doc_id"] == of["of"], "left").withColumn("label", F.coalesce("label", F.col("node")["doc_id"])).drop("of")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label, home, held): members of buckets with more than one component; home is the label of the largest, held counts all."""
    now = _labelled(members.select("key", "node", "n"), labels)
    sizes = now.groupBy("key", "label").agg(F.count("*").alias("size"))
    homes = sizes.groupBy("key").agg(F.max_by("label", F.struct("size", -F.col("label"))).alias("home"), F.count("*").alias("labels"), F.sum("size").alias("held"))
    return now.join(homes.where("labels > 1").drop("labels"), "key")


def _links(ids: np.ndarray, labels: np.ndarray, texts: pa.Array, words: int, percent: int) -> list[tuple[int, int]]:
    """Links between texts of different labels, as few as connect what they connect."""
    owners, shingles = [], []
    for block in blocks(texts):
        owner, shingle = _sets(block, words)
        owners.append(owner + block.rows.start)
        shingles.append(shingle)
    owner, shingle, n = np.concatenate(owners), np.concatenate(shingles), len(ids)
    size = np.bincount(owner, minlength=n)
    order = np.lexsort((owner, shingle))
    owner, shingle = owner[order], shingle[order]
    _, column, count = np.unique(shingle, return_inverse=True, return_counts=True)
    rare = count[column] <= FEW
    few_owner, few_column = owner[rare], column[rare]
    cells = []
    for step in range(1, FEW):
        same = few_column[step:] == few_column[:-step]
        cells.append(few_owner[:-step][same] * n + few_owner[step:][same])
    both = np.bincount(np.concatenate(cells), minlength=n * n).reshape(n, n).astype(np.float32)
    _, column = np.unique(column[~rare], return_inverse=True)
    owner = owner[~rare]
    for low in range(0, int(column.max(initial=-1)) + 1, 4096):
        cut = slice(*np.searchsorted(column, (low, low + 4096)))
        has = np.zeros((n, min(4096, int(column.max()) + 1 - low)), np.float32)
        has[owner[cut], column[cut] - low] = 1
        both += has @ has.T
    either = size[:, None] + size[None, :] - both
    linked = np.triu((100 * both >= percent * either) & (either > 0) & (labels[:, None] != labels[None, :]), 1)
    root = {int(x): int(x) for x in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = top(int(labels[i])), top(int(labels[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _pairs_of_strangers(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components in the same small bucket, one of them a stranger."""
    hubs = members.where("label != home").select("key", F.col("node").alias("hub_node"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))
    meet = members.join(hubs, "key").where("label != hub_label").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return meet.select(*_pair("node", "hub_node"))


def _blocks_of_strangers(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(i, j, doc_id, label, text): the documents of each two blocks that are to meet."""
    dealt = members.groupBy("node").agg(F.min(F.struct("key", "home")).alias("first"), F.any_value("n").alias("n"), F.any_value("label").alias("label"))
    dealt = dealt.select("node", "n", "label", F.col("first")["home"].alias("group"), (F.col("label") == F.col("first")["home"]).alias("at_home"))
    mass = dealt.groupBy("group", "at_home").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_MEMBERS)).alias("parts"))
    dealt = dealt.join(mass, ["group", "at_home"]).withColumn("block", F.xxhash64("group", "at_home", F.pmod(F.xxhash64("node"), F.col("parts"))))
    dealt = saved(dealt.select("node", "n", "label", "block"))

    strange = F.max(F.col("label") != F.col("home")).alias("strange")
    held = members.select("key", "node", "home").join(dealt, "node").groupBy("key", "block")
    held = held.agg(strange, F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"))
    left = held.where("strange").select("key", *(F.col(c).alias(f"{c}_i") for c in ("block", "low", "high", "least", "most")))
    meet = left.join(held, "key").where("NOT (low = high AND low_i = high_i AND low = low_i)")
    meet = meet.where(100 * F.least("most", "most_i") >= percent * F.greatest("least", "least_i"))
    meet = meet.select(F.least("block_i", "block").alias("i"), F.greatest("block_i", "block").alias("j")).distinct()

    sides = meet.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    of = texts.select(F.struct("doc_id", "text_hash").alias("node"), "text")
    return dealt.join(of, "node").join(sides, "block").select("i", "j", F.col("node")["doc_id"].alias("doc_id"), "label", "text")


def links_of_strangers(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """members, a result of _open(), and texts(doc_id, text_hash, text) -> (a, b): links that join components."""
    few = confirmed(_with_texts(_pairs_of_strangers(members.where(F.col("held") <= SMALL), percent), texts), words, percent)
    rows = _blocks_of_strangers(members.where(F.col("held") > SMALL), texts, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meeting in _runs(batches):
            ids, labels = (meeting[c].to_numpy() for c in ("doc_id", "label"))
            links = np.array(_links(ids, labels, meeting["text"].combine_chunks(), words, percent), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return few.unionByName(rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair (i, j), of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(i)], strict=True):
            if high > low:
                if held and last != (i[low], j[low]):
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(low, high - low))
                last = (i[low], j[low])
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct
    `words`-word shingles (ASCII letters lower-cased; a text of fewer words is one shingle).
    component_id is the smallest doc_id reachable by links, kept is doc_id = component_id. Texts
    count whole, however long. A null, empty or blank text has an empty set and is linked with
    nothing: component_id is its doc_id. A null doc_id is linked with nothing either: component_id
    null, kept true. Rows that repeat a doc_id are one document in the links, with all their texts;
    each gets a row. An empty table gives an empty result. Other columns are ignored. Jobs run when
    this is called. Bands of 4 of 128 values miss a pair of similarity 0.8 with a chance of about
    5e-8; sets are told apart by 128-bit and shingles by 64-bit hashes.
    """
    docs = identified(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    sets = saved(bucket_keys(docs.select("doc_id", "text_hash", "text"), words))
    real = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    node = F.min(F.struct("doc_id", "text_hash")).alias("node")
    folded = real.groupBy("set_a", "set_b").agg(node, F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"), F.collect_set("salt").alias("salts"))
    nodes = saved(folded)

    rows = nodes.select("node", "n", F.explode("keys").alias("key"))
    members = saved(rows.join(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    weighed = members.join(members.groupBy("node").agg(F.sum("size").alias("mass")), "node")
    hubs = weighed.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.struct(-F.col("mass"), "node")).alias("hub"))
    wanted = members.select(F.col("node")["doc_id"].alias("doc_id"), F.col("node")["text_hash"].alias("text_hash")).distinct()
    texts = saved(docs.join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]))

    star = members.join(hubs, "key").select("node", "n", F.col("hub")["node"].alias("hub_node"), F.col("hub")["n"].alias("hub_n"))
    star = star.where(F.col("node") != F.col("hub_node")).where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    links = confirmed(_with_texts(star.select(*_pair("node", "hub_node")), texts), words, percent)
    split = real.groupBy("doc_id").agg(F.min("text_hash").alias("one"), F.max("text_hash").alias("other")).where("one != other")
    split = real.join(split.select("doc_id"), "doc_id", "left_semi").join(nodes.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    labels = components(links.unionByName(split.select(F.col("node")["doc_id"].alias("a"), F.col("doc_id").alias("b"))))

    strangers = saved(_open(members, labels))
    if not strangers.isEmpty():
        more = saved(links_of_strangers(strangers, texts, words, percent))
        if not more.isEmpty():
            labels = merged(labels, more)

    of = labels.select(F.col("id").alias("of"), "label")
    named = nodes.select("set_a", "set_b", F.col("node")["doc_id"].alias("rep"), F.explode("salts").alias("salt"))
    named = named.join(of, named["rep"] == of["of"], "left").select("set_a", "set_b", "salt", F.coalesce("label", "rep").alias("label"))
    placed = real.select("doc_id", "n_shingles", "set_a", "set_b", "salt").join(named, ["set_a", "set_b", "salt"]).select("doc_id", "n_shingles", "label")
    alone = sets.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("label"))
    out = placed.unionByName(alone).withColumnRenamed("label", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
