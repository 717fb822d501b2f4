"""Alignment of two tokenizers over the same bytes: where tokens of both end together.

A is a byte-level BPE, B a piece model. Each text is encoded by both; the cumulative ends of the
tokens, in bytes, are put into dictionaries from end to index. The ends that both dictionaries hold,
in order, cut the two lists of ids into groups, and the two tokens that end there are a link.

The dictionaries of a stretch of texts are arrays, as ends are small whole numbers: dictionary[end] is
the index of the token that ends there, or -1.

The tokens of a link end at the same byte, so one's bytes are a suffix of the other's. Hence the pairs
of ids that can ever be linked follow from the vocabularies alone, at most one for each suffix of each
token (some hundred thousand), whatever the corpus: links are numbers of this list, and counts of all
of them are a small table of proven size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.byte_bpe import Vocabulary, _encoded, _stretches
from rankweave.llm.shared import identified, saved
from rankweave.llm.words import run_hashes

#: The mark that stands for a space in pieces.
SPACE_MARK = "▁"


def byte_level_characters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def vocabulary_of_json(text: str) -> Vocabulary:
    """The vocabulary of a byte-level BPE's JSON; ids must be in the order of the merges, as ranks are."""
    model = json.loads(text)["model"]
    bytes_of = byte_level_characters()
    ids = {bytes(bytes_of[c] for c in token): k for token, k in model["vocab"].items()}
    merged = [ids[bytes(bytes_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("ids of the byte-level BPE are not in the order of its merges")
    return Vocabulary(ids)


class Pieces:
    """A piece model with the bytes of its pieces."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        self._load()

    def __getstate__(self) -> bytes:
        return self.model

    def __setstate__(self, model: bytes) -> None:
        self.__init__(model)

    def _load(self) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        names = [self.processor.id_to_piece(k) for k in range(self.processor.get_piece_size())]
        of_byte = [self.processor.is_byte(k) for k in range(len(names))]
        self.tokens = [
            bytes([int(name[3:-1], 16)]) if byte else name.replace(SPACE_MARK, " ").encode()
            for name, byte in zip(names, of_byte, strict=True)
        ]
        self.size = np.array(list(map(len, self.tokens)), np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        #: No piece goes on over a space into the next word, and blanks are kept as they are: words can be encoded apart.
        self.space = self.processor.piece_to_id(SPACE_MARK)
        probe = self.processor.normalize("a  b ")
        inside = any(" " in t.lstrip(b" ").decode("utf-8", "replace") for t in self.tokens)
        self.by_words = not inside and names[self.space] == SPACE_MARK and probe.replace(SPACE_MARK, " ") == " a  b "

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of ids, ids) of texts that each begin with the space that the model puts there."""
        starts = np.zeros(len(data) + 1, bool)
        if self.by_words:
            blank = data == 0x20
            starts[:-1] = blank
            starts[1:-1] &= ~blank[:-1]
        starts[offsets] = True
        start = np.flatnonzero(starts[:-1])
        end = np.append(start[1:], len(data))
        _, first, which = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a + 1 : b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        ids = self.processor.encode(words, num_threads=1) if words else []
        if "" in words:  # the space at the end of a text, to which the model adds none
            ids[words.index("")] = [self.space]
        count = np.array(list(map(len, ids)), np.int64)
        flat = np.array([k for one in ids for k in one], np.int64)
        begin, counts = (np.cumsum(count) - count)[which], count[which]
        stop = np.cumsum(counts)
        out = flat[np.repeat(begin - stop + counts, counts) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return np.concatenate(([0], stop))[np.searchsorted(start, offsets)], out


def possible_pairs(a: Vocabulary, b: Pieces) -> np.ndarray:
    """All (a id * pieces + b id) whose tokens can end together, in order: one is a suffix of the other."""
    of_b: dict[bytes, list[int]] = {}
    for k, token in enumerate(b.tokens):
        of_b.setdefault(token, []).append(k)
    n, found = len(b.tokens), set()
    for token, k in a.ranks.items():
        for cut in range(len(token)):
            found.update(k * n + other for other in of_b.get(token[cut:], ()))
    for k, token in enumerate(b.tokens):
        for cut in range(1, len(token)):
            if (other := a.ranks.get(token[cut:])) is not None:
                found.add(other * n + k)
    return np.array(sorted(found), np.int64)


class Aligner:
    """Both tokenizers, and the pairs that they can link."""

    def __init__(self, a: Vocabulary, b: Pieces, pattern: str) -> None:
        self.a, self.b, self.pattern = a, b, pattern
        self.pairs = possible_pairs(a, b)
        names = [str(k).encode() for k in range(max(len(a.size), len(b.size)))]
        #: Decimal ids with room for a separator behind them, and their lengths.
        self.digits = np.frombuffer(b"".join(x.ljust(len(names[-1]) + 1, b"\0") for x in names), np.uint8).reshape(len(names), -1)
        self.length = np.array(list(map(len, names)), np.int64)

    def align(self, data: np.ndarray, offsets: np.ndarray) -> Aligned:
        """Alignment of texts, none empty, each with a space put before it."""
        sides = [_encoded(self.a, self.pattern, data, offsets), self.b.encoded(data, offsets)]
        spans, whole = np.diff(offsets), np.ones(len(offsets) - 1, bool)
        for k, tokens in enumerate((self.a, self.b)):
            whole &= _total(tokens.size[sides[k][1]], sides[k][0]) == spans
        for (at, ids), tokens in zip(sides, (self.a, self.b), strict=True):
            own = ids[np.repeat(whole, np.diff(at))]
            size = tokens.size[own]
            end = np.cumsum(size)
            back = tokens.bytes[np.repeat(tokens.at[own] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)]
            kept = np.flatnonzero(whole)
            wrong = np.add.reduceat(back != data[np.repeat(whole, spans)], np.cumsum(spans[kept]) - spans[kept]) if len(kept) else kept
            whole[kept[wrong > 0]] = False
        (count_a, a), (count_b, b) = ((np.where(whole, np.diff(at), 0), ids[np.repeat(whole, np.diff(at))]) for at, ids in sides)
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        size = int(end_a[-1]) if len(end_a) else 0
        index_a, index_b = np.full(size + 1, -1, np.int64), np.full(size + 1, -1, np.int64)
        index_a[end_a], index_b[end_b] = np.arange(len(a)), np.arange(len(b))
        common = np.flatnonzero((index_a >= 0) & (index_b >= 0))
        pair = np.searchsorted(self.pairs, a[index_a[common]].astype(np.int64) * len(self.b.tokens) + b[index_b[common]])
        groups = np.diff(np.searchsorted(common, np.cumsum(np.where(whole, spans, 0)), "right"), prepend=0)
        return Aligned(self, a, b, count_a, count_b, index_a[common], index_b[common], groups, pair)


def _total(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


class Aligned:
    """Tokens of a stretch of texts; the links (last_a[k], last_b[k]) close its groups, in order."""

    def __init__(self, by: Aligner, a: np.ndarray, b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, groups: np.ndarray, pair: np.ndarray) -> None:
        self.by, self.a, self.b, self.count_a, self.count_b = by, a, b, count_a, count_b
        self.last_a, self.last_b, self.groups, self.pair = last_a, last_b, groups, pair

    def digests(self) -> list[str]:
        """For each text the digest of its groups, written a1,a2|b1;a3|b2,b3; '' where it has no tokens."""
        group_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        before_b = np.concatenate(([0], self.last_b + 1))[group_a]
        place_a, place_b = np.arange(len(self.a)) + before_b, np.arange(len(self.b)) + self.last_a[group_b] + 1
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[self.last_a]], mark[place_b[self.last_b]] = ord("|"), ord(";")
        length = self.by.length[ids]
        text = self.by.digits[ids]
        text[np.arange(len(ids)), length] = mark
        flat = text[np.arange(text.shape[1]) <= length[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(length + 1)))[np.concatenate(([0], np.cumsum(self.count_a + self.count_b)))].tolist()
        return [hashlib.sha256(flat[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _spread(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.astype(np.int32)))


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which texts have bytes, their bytes with a space before each, offsets)."""
    full = np.flatnonzero(np.diff(offsets))
    return full, np.insert(data, offsets[full], 0x20), np.concatenate(([0], np.cumsum(np.diff(offsets)[full] + 1)))


def aligner(spark, a_json: str, b_model: str, pattern: str):
    """Both tokenizers, read from their files by the driver, as a broadcast of some tens of MB whatever the corpus."""
    with open(a_json, encoding="utf-8") as one, open(b_model, "rb") as other:
        return spark.sparkContext.broadcast(Aligner(vocabulary_of_json(one.read()), Pieces(other.read()), pattern))


def align(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row for each row of docs: (doc_id, a, b, a_ends, b_ends, links), all arrays of int.

    shared is aligner()'s. a and b are the ids of space+text; group k are the ids up to a_ends[k] and
    b_ends[k] (counts of ids, exclusive) from where the group before stops; links[k] is the number of the
    pair of ids that closes it, in the list of possible pairs. With digest the columns are (doc_id, n_a, n_b,
    groups_sha256, links) instead.

    Null and empty texts, and those that either tokenizer does not give back byte by byte, have no
    tokens. A null doc_id is kept, repeated rows are aligned each, a very long text is aligned whole by
    itself, an empty table gives an empty result; other columns are ignored. Words and pieces that repeat
    within a stretch of texts are told by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value
        for batch in batches:
            for low, data, offsets in _stretches(batch.column(1)):
                n = len(offsets) - 1
                full, spaced, at = _spaced(data, offsets)
                found = by.align(spaced, at)

                def each(values: np.ndarray, full: np.ndarray = full, n: int = n) -> np.ndarray:
                    out = np.zeros(n, np.int64)
                    out[full] = values
                    return out

                count_a, count_b, groups = each(found.count_a), each(found.count_b), each(found.groups)
                columns = [batch.column(0).slice(low, n)]
                if digest:
                    told = np.full(n, "", object)
                    told[full] = found.digests()
                    columns += [pa.array(count_a), pa.array(count_b), pa.array(told, pa.string())]
                else:
                    before_a, before_b = (np.repeat(np.cumsum(c) - c, groups) for c in (count_a, count_b))
                    columns += [_spread(count_a, found.a), _spread(count_b, found.b), _spread(groups, found.last_a + 1 - before_a), _spread(groups, found.last_b + 1 - before_b)]
                columns.append(_spread(groups, found.pair))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = {"doc_id": "long"} | ({"n_a": "long", "n_b": "long", "groups_sha256": "string"} if digest else dict.fromkeys(("a", "b", "a_ends", "b_ends"), "array<int>")) | {"links": "array<int>"}
    names = list(kinds)
    return identified(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def _counts(aligned: DataFrame) -> DataFrame:
    return aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count"))


def link_counts(aligned: DataFrame, shared) -> DataFrame:
    """(a, b, count): how many links of all rows hold each pair of ids that any holds."""
    n = len(shared.value.b.tokens)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = shared.value.pairs[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array((pair // n).astype(np.int32)), pa.array((pair % n).astype(np.int32)), batch.column(1)], ["a", "b", "count"])

    return _counts(aligned).mapInArrow(named, "a int, b int, count long")


def with_link_counts(aligned: DataFrame, shared) -> DataFrame:
    """aligned with n_links, n_best and count_sum, and links left out; jobs run at once.

    n_best are the links whose pair is as frequent over all rows as any of its b id, count_sum adds the
    counts of the links' pairs. The counts, no more than there are possible pairs, go to the driver and
    are broadcast; nothing there grows with the corpus. aligned is written first, to be read twice.
    """
    aligned = saved(aligned)
    spark, n, pairs = aligned.sparkSession, len(shared.value.b.tokens), shared.value.pairs
    found = _counts(aligned).toArrow()
    count = np.zeros(len(pairs), np.int64)
    count[found.column("link").to_numpy()] = found.column("count").to_numpy()
    most = np.zeros(n, np.int64)
    np.maximum.at(most, pairs % n, count)
    counted = spark.sparkContext.broadcast((count, count == most[pairs % n]))
    kept = [c for c in aligned.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = counted.value
        for batch in batches:
            links = batch.column("links")
            size = links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, link = np.concatenate(([0], np.cumsum(size))), links.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            more = [size, _total(best[link].astype(np.int64), at), _total(count[link], at)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x) for x in more], [*kept, "n_links", "n_best", "count_sum"])

    kinds = [f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept] + ["n_links long", "n_best long", "count_sum long"]
    return aligned.mapInArrow(run, ", ".join(kinds))
