"""Mixing sources to target weights by pivotal dependent rounding.

A source's target and size give each of its documents the same number of copies, a whole and a
fractional part. The fraction of a document times its size is its mass, in words. Two documents of a source
meet: mass moves from one to the other, in a direction drawn so that both keep their expected
number of copies, until one of them is a whole copy or none. The other one goes on to meet the next. So
every meeting keeps the words of the source as they are, and settles one document.

Documents meet in blocks that a hash deals out, BLOCK to each on average; what a block leaves over, one document at most,
meets the leftovers of other blocks in the same way, level by level, until each source has one. That one has
nobody to trade with and goes to the nearer side, so a source's words differ from its target by no more
than half of that document (and 2**-31 of the source, as fractions are counted in units of 2**-30).

All draws are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.numbering import numbered
from rankweave.llm.shared import saved

#: Documents of a block, on average, and the unit of fractions.
BLOCK, UNIT = 64, 1 << 30
#: Row copies that one array holds.
_RUN = 1 << 16


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null has none. Each word shrinks to a letter, no array of words is made."""
    letters = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(letters, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: float = 150, limit: int = 2) -> DataFrame:
    """(source, source_size, n, target) from (source, size, n); jobs run at once.

    Sources by code point, null last, weigh as weights say, repeating. They share percent % of all sizes by weight;
    a target stops at limit times its source's size, the excess is shared again until none is above.
    Each round learns one number from the sources, so any number of them will do.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n"))
    place = numbered(sources, F.col("source").asc_nulls_last(), number="place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = saved(place.select("source", "source_size", "n", weight.alias("weight")))
    most = F.col("source_size") * float(limit)
    whole = float(sources.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    share, full = 0.0, -1
    while True:
        above = F.col("weight") * share > most
        row = sources.agg(F.count_if(above), F.sum(F.when(above, most).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == full or not row[2]:
            break
        full, share = row[0], (whole - row[1]) / row[2]
    return sources.select("source", "source_size", "n", F.least(F.col("weight") * share, most).alias("target"))


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def _meeting(state: Column, other: Column) -> Column:
    """The state (rest, done) of a block after its leftover has met another document."""
    rest = state["rest"]
    cap, other_cap = rest["size"] * UNIT, other["size"] * UNIT
    moves = F.struct(F.least(cap - rest["mass"], other["mass"]).alias("up"), F.least(rest["mass"], other_cap - other["mass"]).alias("down"))
    # other's draw decides; up and down are in proportion to the chance of the opposite move
    moved = _let(moves, lambda m: F.when(other["draw"] * (m["up"] + m["down"]).cast("double") < m["down"], m["up"]).otherwise(-m["down"]))
    pair = _let(moved, lambda by: F.array(rest.withField("mass", rest["mass"] + by), other.withField("mass", other["mass"] - by)))
    settled = lambda x: (x["mass"] == 0) | (x["mass"] == x["size"] * UNIT)
    met = _let(pair, lambda two: F.struct(F.filter(two, lambda x: ~settled(x))[0].alias("rest"), F.concat(state["done"], F.filter(two, settled)).alias("done")))
    return F.when(rest.isNull(), F.struct(other.alias("rest"), state["done"].alias("done"))).otherwise(met)


def _level(items: DataFrame, level: int) -> DataFrame:
    """(source, n, rest, done) of each block of (source, n, item), with n the number of blocks of the source."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    key = F.xxhash64("item.doc_id", "item.size", F.lit(level))
    dealt = items.select("source", blocks.alias("n"), F.pmod(key, blocks).alias("block"), F.col("item").withField("draw", _uniform("item.doc_id", "item.size", F.lit(level), F.lit("draw"))).alias("item"))
    order = F.struct(F.xxhash64("item.doc_id", "item.size", F.lit(level), F.lit("order")).alias("order"), "item")
    blocks = dealt.groupBy("source", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(order)).alias("items"))
    kind = dealt.schema["item"].dataType.simpleString()
    start = F.expr(f"CAST(named_struct('rest', NULL, 'done', array()) AS struct<rest:{kind},done:array<{kind}>>)")
    folded = F.aggregate("items.item", start, _meeting)
    return blocks.select("source", "n", folded.alias("state")).select("source", "n", "state.rest", "state.done")


def _uniform(*of) -> Column:
    """A number from [0, 1) for each row, a hash of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), percent: float = 150, limit: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of docs; jobs run at once.

    size is the number of words, copies how often the mix takes the row (at most limit times), taken its words
    in the mix, target and source_size those of its source. A null text has size 0 and is taken without
    words; null sources are one source; a null doc_id is one as any other; rows equal in doc_id, source and size share
    their whole copies and one fraction among themselves, so any number of repeats is a single partner.
    Very long texts count whole, one of over 2**33 words would overflow. An empty table stays empty. Other
    columns are ignored.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    sizes = saved(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(sizes, weights, percent, limit)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = F.round(factor * UNIT).cast("long")
    rules = targets.select(F.col("source").alias("of"), F.col("n").alias("n_keys"), F.expr(f"{UNIT}L").alias("unit"), units.alias("units"), "source_size", "target")
    rows = sizes.join(rules, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole, part = F.expr("n * (units % unit) div unit"), F.expr("n * (units % unit) % unit")
    rows = rows.select("source", "n_keys", F.struct("doc_id", "size", "n", whole.alias("whole"), (part * F.col("size")).alias("mass")).alias("item"))
    trade = F.col("item.mass") > 0
    parts = [rows.where(~trade).select("source", "item.doc_id", "item.size", "item.n", "item.whole")]
    items = rows.where(trade).select("source", F.col("n_keys").alias("n"), "item")
    blocks, level = targets.agg(F.max("n")).first()[0] or 0, 0
    taken = F.expr("whole + if(2 * mass >= size * %dL, 1L, 0L)" % UNIT)
    while blocks:
        met = saved(_level(items, level))
        blocks, level = -(-blocks // BLOCK), level + 1
        settled = met.select("source", F.explode("done").alias("item"))
        items = met.where("rest IS NOT NULL").select("source", "n", F.col("rest").alias("item"))
        if blocks == 1:
            settled, blocks = settled.unionByName(items.select("source", "item")), 0
        parts.append(settled.select("source", "item.*").select("source", "doc_id", "size", "n", taken.alias("whole")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    # row k of n equal ones has one copy more than the others where k < whole
    out = out.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {_RUN})")).alias("run"))
    out = out.select("*", F.explode(F.expr(f"sequence(run * {_RUN}, least(n, (run + 1) * {_RUN}) - 1)")).alias("k"))
    out = out.join(rules.drop("n_keys"), F.col("source").eqNullSafe(F.col("of")))
    copies = F.expr("units div unit + if(k < whole, 1L, 0L)")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
