"""Byte-level BPE by dynamic programming over prefixes, and decoding.

For each prefix of a piece's bytes, exactly one token can end its encoding; the table stores that
token. A token fits behind a prefix if the last token of that prefix and it can stand side by side:
undoing their merges step by step, no merge across the seam comes before the merges that made
them. So a table grows by appended bytes without looking at what is before the last few, stays valid up
to an edit, and ids are read off backwards.

Pieces are the matches of a pattern. Equal pieces of a stretch of texts are encoded once, and all of
them step by step together: NumPy takes one more byte of every piece at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.words import run_hashes

#: Bytes of texts that are encoded together, and the longest piece that is encoded together with others.
STRETCH_BYTES, TOGETHER_BYTES = 1 << 21, 32
#: The pattern of fixed form whose pieces follow from classes of characters; pieces of others are found by regex.
BY_CLASS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER, _SPACE = 1, 2, 3
_STEP = np.uint64(0x9E3779B97F4A7C55)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


class _Table:
    """Maps 64-bit numbers to numbers from 0; -1 for those it lacks. Open addressing, for many look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] < 0
            _, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


class Vocabulary:
    """Tokens with ranks, and which of them can stand side by side."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.tokens = {rank: token for token, rank in ranks.items()}
        n = max(self.tokens, default=-1) + 1
        #: The two tokens that a token was last merged from; a byte is its own.
        self.left, self.right = np.arange(n), np.arange(n)
        self.pairs: dict[tuple[int, int], int] = {}
        for rank in sorted(self.tokens):
            token = self.tokens[rank]
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut], n), ranks.get(token[cut:], n)
                if a < rank and b < rank and self.side_by_side(a, b):
                    self.left[rank], self.right[rank] = a, b
                    self.pairs[a, b] = rank
                    break
        #: Whether merging a token's bytes gives the token.
        self.whole = np.array([len(self.tokens.get(k, b"ab")) == 1 or self.left[k] != k for k in range(n)], bool)
        self._suffixes: dict | None = None
        self._tables()

    def _tables(self) -> None:
        order = sorted(self.tokens)
        data = np.frombuffer(b"".join(self.tokens[k] for k in order), np.uint8)
        size = np.zeros(len(self.left), np.int64)
        size[order] = [len(self.tokens[k]) for k in order]
        end = np.cumsum(size)
        self.bytes, self.size, self.at = data, size, end - size
        self.by_span = _Table(run_hashes(data, self.at[order], end[order]), np.array(order, np.int32))
        stepped = np.zeros(len(order), np.uint64)
        for k in range(self.longest):
            more = size[order] > k
            stepped[more] = stepped[more] * _STEP + data[self.at[order][more] + k].astype(np.uint64) + np.uint64(1)
        self.by_steps = _Table(stepped, np.array(order, np.int32))
        pairs = np.array(list(self.pairs), np.uint64).reshape(-1, 2)
        self.by_pair = _Table((pairs[:, 0] << np.uint64(32)) | pairs[:, 1], np.array(list(self.pairs.values()), np.int32))

    @classmethod
    def from_text(cls, lines: str) -> Vocabulary:
        """Lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())})

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two again."""
        most = len(self.left)  # a merge across the seam must come before this one to count
        while True:
            across = self.pairs.get((a, b))
            if across is not None and across < most:
                return False
            if a > b and self.right[a] != a:
                most, a = a, int(self.right[a])
            elif self.left[b] != b:
                most, b = b + 1, int(self.left[b])
            elif self.right[a] != a:
                most, a = a, int(self.right[a])
            else:
                return True

    def all_side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """side_by_side() for arrays."""
        out = np.ones(len(a), bool)
        todo, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        most = np.full(len(a), len(self.left), np.int64)
        while len(todo):
            across = self.by_pair.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            no = (across >= 0) & (across < most)
            out[todo[no]] = False
            further, before = self.right[a], self.left[b]
            undo_a = (further != a) & ((a > b) | (before == b))
            undo_b = ~undo_a & (before != b)
            most = np.where(undo_a, a, b + 1)
            on = ~no & (undo_a | undo_b)
            todo, most, a, b = todo[on], most[on], np.where(undo_a, further, a)[on], np.where(undo_b, before, b)[on]
        return out

    def _endings(self) -> dict:
        """A trie of the tokens' bytes from the last to the first; None holds a token's rank."""
        if self._suffixes is None:
            self._suffixes = {}
            for token, rank in self.ranks.items():
                at = self._suffixes
                for byte in reversed(token):
                    at = at.setdefault(byte, {})
                at[None] = rank
        return self._suffixes

    def _last(self, piece: bytes, end: int, last: list[int]) -> int:
        """The last token of piece[:end], from those of shorter prefixes."""
        at, start, fitting = self._endings(), end, []
        while start and (at := at.get(piece[start - 1])) is not None:
            start -= 1
            if None in at:
                fitting.append((start, at[None]))
        for start, token in reversed(fitting):
            if self.side_by_side(last[start], token) if start else self.whole[token]:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Completes last, the last token of each prefix of piece, from its present length on.

        last[0] is unused. To append bytes, pass the longer piece and the old table.
        """
        for end in range(len(last), len(piece) + 1):
            last.append(self._last(piece, end, last))
        return last

    def edited(self, piece: bytes, last: list[int], low: int, high: int, put: bytes) -> tuple[bytes, list[int], int]:
        """The piece with piece[low:high] replaced by put, its table, and how many prefixes were looked at anew.

        A last token depends on no more than the `longest` bytes and last tokens before it. So the old
        table holds up to the edit, and again once so many in a row behind it are as they were.
        """
        new, shift = piece[:low] + put + piece[high:], low + len(put) - high
        table, same, end = last[: low + 1], 0, low + 1
        while end <= len(new) and same < self.longest:
            table.append(self._last(new, end, table))
            same = same + 1 if end > low + len(put) and table[end] == last[end - shift] else 0
            end += 1
        return new, table + last[end - shift :], end - low - 1

    def ids(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of length end (default: of the whole piece)."""
        at, out = len(last) - 1 if end is None else end, []
        while at > 0:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.ids(self.extend(piece, [-1]))

    def encode_all(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids) of pieces of at most TOGETHER_BYTES, none of them a token itself."""
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        n, most = len(start), int(size[0])
        active = n - np.searchsorted(size[::-1], np.arange(1, most + 1))  # pieces with so many bytes
        hashes, last = np.zeros((most, n), np.uint64), np.full((most + 1, n), -1, np.int32)
        for end in range(1, most + 1):
            k = int(active[end - 1])
            byte = data[start[:k] + end - 1].astype(np.uint64) + np.uint64(1)
            hashes[:end, :k] = hashes[:end, :k] * _STEP + byte
            token = self.by_steps.get(hashes[:end, :k].reshape(-1)).reshape(end, k)
            left = np.arange(k)
            for low in range(end):
                at = left[token[low, left] >= 0]
                if len(at):
                    fits = self.whole[token[low, at]] if not low else self.all_side_by_side(last[low, at], token[low, at])
                    last[end, at[fits]] = token[low, at[fits]]
                    left = left[last[end, left] < 0]
                if not len(left):
                    break
            if len(left):
                raise ValueError("the vocabulary lacks a byte")
        at, steps, rows = size.copy(), [], []
        row = np.arange(n)
        while len(row):
            steps.append(last[at[row], row])
            rows.append(row)
            at[row] -= self.size[steps[-1]]
            row = row[at[row] > 0]
        owner, ids = order[np.concatenate(rows)], np.concatenate(steps)
        step = np.repeat(np.arange(len(rows)), list(map(len, rows)))
        return np.bincount(owner, minlength=n), ids[np.lexsort((-step, owner))]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, where those of each id end)."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.bytes[np.repeat(self.at[ids] - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)], end


def _class_table() -> np.ndarray:
    """The class of each character: letter, number, white space, or another."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for match in regex.finditer(pattern, every):
            low, high = ord(match[0][0]), ord(match[0][-1]) + 1
            table[low:high] = kind
    table[0xD800:0xE000] = 0
    return table


_loaded: dict[str, np.ndarray] = {}


def pieces_by_class(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each match of BY_CLASS starts in the UTF-8 bytes of texts; matches leave no gaps."""
    if "classes" not in _loaded:
        _loaded["classes"] = _class_table()
    char = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(char):
        return char
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    lead = padded[char]
    code = lead.astype(np.int32)
    for least, bits, more in ((0xC0, 5, 1), (0xE0, 4, 2), (0xF0, 3, 3)):  # a longer form overwrites a shorter one
        at = np.flatnonzero(lead >= least)
        value = lead[at].astype(np.int32) & ((1 << bits) - 1)
        for k in range(1, more + 1):
            value = (value << 6) | (padded[char[at] + k] & 0x3F)
        code[at] = value
    kind = _loaded["classes"][code]
    opens = np.zeros(len(char) + 1, bool)
    opens[np.searchsorted(char, offsets)] = True
    opens[0] = True
    low = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])) | opens[:-1])
    high = np.append(low[1:], len(char))
    of, final, first = kind[low], opens[high], opens[low]
    final[-1] = True
    starts = np.zeros(len(char) + 1, bool)
    spaces = of == _SPACE
    starts[low[spaces & (final | (high - low > 1))]] = True
    starts[high[spaces & ~final] - 1] = True
    joined = np.zeros(len(low), bool)
    joined[1:] = ~first[1:] & spaces[:-1] & (code[low[1:] - 1] == 0x20)
    starts[low[~spaces & ~joined]] = True
    mark = np.flatnonzero(~joined & ~final & (high - low == 1) & (code[low] == 0x27))
    mark = mark[of[np.minimum(mark + 1, len(of) - 1)] == _LETTER]
    word, size = low[mark + 1] if len(mark) else mark, (high - low)[mark + 1] if len(mark) else mark
    one, two = code[word], code[np.minimum(word + 1, len(code) - 1)]
    taken = np.isin(one, list(b"stmd")).astype(np.int64)
    for pair in (b"re", b"ve", b"ll"):
        taken[(one == pair[0]) & (two == pair[1]) & (size > 1)] = 2
    starts[word[taken > 0]] = False
    rest = (taken > 0) & (size > taken)
    starts[word[rest] + taken[rest]] = True
    return char[starts[:-1]]


def _pieces_by_regex(pattern: regex.Pattern, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of each match in the bytes."""
    start, size = [], []
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        text = data[low:high].tobytes().decode()
        lead = np.flatnonzero((data[low:high] & 0xC0) != 0x80)
        width = np.append(lead, high - low)
        for match in pattern.finditer(text):
            if match.end() > match.start():
                start.append(low + width[match.start()])
                size.append(width[match.end()] - width[match.start()])
    return np.array(start, np.int64), np.array(size, np.int64)


def _encoded(vocabulary: Vocabulary, pattern: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of ids, ids) of texts."""
    if pattern == BY_CLASS:
        start = pieces_by_class(data, offsets)
        size = np.diff(np.append(start, len(data)))
    else:
        start, size = _pieces_by_regex(regex.compile(pattern), data, offsets)
    name, first, which = np.unique(run_hashes(data, start, start + size), return_index=True, return_inverse=True)
    known = vocabulary.by_span.get(name)
    at, length = start[first], size[first]
    count, parts = np.ones(len(name), np.int64), [known[known >= 0].astype(np.int64)]
    owners = [np.flatnonzero(known >= 0)]
    together = np.flatnonzero((known < 0) & (length <= TOGETHER_BYTES))
    count[together], ids = vocabulary.encode_all(data, at[together], length[together])
    owners.append(np.repeat(together, count[together]))
    parts.append(ids.astype(np.int64))
    for k in np.flatnonzero((known < 0) & (length > TOGETHER_BYTES)):
        ids = vocabulary.encode(data[at[k] : at[k] + length[k]].tobytes())
        count[k] = len(ids)
        owners.append(np.full(len(ids), k))
        parts.append(np.array(ids, np.int64))
    flat = np.concatenate(parts)[np.argsort(np.concatenate(owners), kind="stable")]
    begin = np.cumsum(count) - count
    counts = count[which]
    end = np.cumsum(counts)
    ids = flat[np.repeat(begin[which] - end + counts, counts) + np.arange(int(end[-1]) if len(end) else 0)]
    return np.concatenate(([0], end))[np.searchsorted(start, offsets)], ids.astype(np.int32)


def _lines(path: str) -> str:
    with open(path, encoding="ascii") as file:
        return file.read()


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary.from_text(_lines(path)))


def _stretches(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of stretches of whole texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + STRETCH_BYTES, "right")) - 1)
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, tokens array<int>), with decoded also the bytes of the tokens: one row for each row of docs.

    Each match of pattern in the whole text is encoded by itself, a very long one alone; there are no
    special tokens. Null and empty texts have no tokens and no bytes. A null doc_id is kept. Repeated
    rows are encoded each; an empty table gives an empty result. Other columns are ignored. The
    vocabulary, a file of base64 tokens with ranks, is read by the driver and broadcast: its size is
    some times that of the file. Equal pieces are told by 64-bit hashes.
    """
    vocabulary = _shared(docs, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for low, data, offsets in _stretches(batch.column(1)):
                at, ids = _encoded(known, pattern, data, offsets)
                columns = [batch.column(0).slice(low, len(at) - 1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                if decoded:
                    back, end = known.decode(ids)
                    ends = np.concatenate(([0], end))[at].astype(np.int32)
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends), pa.py_buffer(back)]))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tokens", "decoded"][: len(columns)])

    schema = "doc_id long, tokens array<int>" + (", decoded binary" if decoded else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, tokens, decoded binary): the bytes of the tokens, one row for each row of encoded.

    Null and empty arrays decode to no bytes, of any length and number of repeats each; a null doc_id
    is kept, an empty table gives an empty result, other columns are ignored. An id that the
    vocabulary lacks, or null, fails.
    """
    vocabulary = _shared(encoded, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                count = part.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = part.column(1).flatten()
                ids = ids.to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, np.int32)
                if len(ids) and (ids.dtype.kind == "f" or ids.min() < 0 or ids.max() >= len(vocabulary.value.size) or not vocabulary.value.size[ids].all()):
                    raise ValueError("an id that the vocabulary lacks")
                back, end = vocabulary.value.decode(ids)
                ends = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(count)))].astype(np.int32)
                out = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(back)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], ["doc_id", "tokens", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).alias("tokens")).mapInArrow(run, "doc_id long, tokens array<int>, decoded binary")
