"""Which texts contain which atoms: one Aho-Corasick automaton for each bounded batch of atoms, run once over every whole text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.functions.saved import saved
from rankweave.operators.blocks import _row, spread

#: Characters of the atoms of one automaton (some hundred bytes each), of all atoms that are broadcast, and of packed texts.
BATCH_CHARS, BROADCAST_CHARS, PACK_CHARS = 1 << 19, 1 << 24, 1 << 20
#: Texts whose hits are one batch.
STEP = 512


def _packed(texts: DataFrame) -> DataFrame:
    """(ids, texts) of (id, text): whole texts by about PACK_CHARS, a longer one alone; nulls are left out."""
    kind = dict(texts.dtypes)[texts.columns[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, chars = 0, 0
            sizes = pc.utf8_length(batch.column(1)).to_pylist()
            for high, size in enumerate(sizes):
                if high > low and chars + size > PACK_CHARS:
                    yield pa.RecordBatch.from_arrays([_row(c.slice(low, high - low)) for c in batch.columns], ["ids", "texts"])
                    low, chars = high, 0
                chars += size
            if low < len(batch):
                yield pa.RecordBatch.from_arrays([_row(c.slice(low)) for c in batch.columns], ["ids", "texts"])

    return texts.where(F.col(texts.columns[1]).isNotNull()).mapInArrow(run, f"ids array<{kind}>, texts array<string>")


class _Automaton:
    """Finds the different ones of some atoms in a text."""

    def __init__(self, atoms: list[str]) -> None:
        self.automaton, self.always = ahocorasick.Automaton(), [""] * ("" in atoms)
        for word in filter(None, atoms):
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def hits(self, ids: pa.Array, texts: pa.Array, id_col: str) -> pa.RecordBatch:
        """Texts become objects one at a time."""
        place, found = [], []
        for n, text in enumerate(texts):
            if text.is_valid:
                hits = dict.fromkeys(self.always + [word for _, word in self.automaton.iter(text.as_py())] if len(self.automaton) else self.always)
                place += [n] * len(hits)
                found += hits
        return pa.RecordBatch.from_arrays([ids.take(pa.array(place, pa.int64())), pa.array(found, pa.string())], [id_col, "atom"])


def contained(texts: DataFrame, id_col: str, atoms: DataFrame, text_col: str = "text") -> DataFrame:
    """(<id>, atom): for each row of texts, the different atoms(atom) that its whole text contains; a job runs at once.

    An empty atom is in every text but null ones, null atoms and texts have no hits. The atoms of one automaton go to the tasks as they
    are. More are dealt out to batches by a hash; each batch meets each pack of texts once, and an automaton is built once for a batch in a task.
    """
    different = saved(atoms.select(F.col("atom").cast("string").alias("atom")).where("atom IS NOT NULL").distinct())
    chars = different.agg(F.sum(F.length("atom") + 8)).first()[0] or 0
    kind = dict(texts.dtypes)[id_col]
    given = spread(texts.select(id_col, F.col(text_col).cast("string").alias("text")))
    if chars <= BATCH_CHARS:
        few = [r.atom for r in different.collect()]  # at most BATCH_CHARS

        def once(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _Automaton(few)
            for batch in rows:
                for low in range(0, len(batch), STEP):
                    yield automaton.hits(batch.column(0).slice(low, STEP), batch.column(1).slice(low, STEP), id_col)

        return given.where("text IS NOT NULL").mapInArrow(once, f"`{id_col}` {kind}, atom string")
    batches = -(-chars // BATCH_CHARS)
    sets = different.groupBy(F.pmod(F.xxhash64("atom"), F.lit(batches)).alias("of")).agg(F.collect_list("atom").alias("atoms"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, _Automaton] = {}
        for batch in rows:
            for k in range(len(batch)):
                at = batch.column("of")[k].as_py()
                if at not in built:
                    while len(built) > 3:
                        del built[next(iter(built))]
                    built[at] = _Automaton(batch.column("atoms")[k].as_py())
                yield built[at].hits(batch.column("ids")[k].values, batch.column("texts")[k].values, id_col)

    grid = _packed(given).crossJoin(F.broadcast(sets) if chars <= BROADCAST_CHARS else sets)  # packs x batches
    return grid.mapInArrow(run, f"`{id_col}` {kind}, atom string")
