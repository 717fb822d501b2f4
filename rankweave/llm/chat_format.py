"""Chat turns as training windows of a token budget, with reversible escapes and a loss mask.

Turns are laid out by prefix sums of their tokens. The budget of a window pays for the conversation's
leading system turn, which every window has, for `history` tokens of repeated turns, and for its own
turns, which get the rest. With so many tokens to a stretch, the turns that lie within one stretch
make a window, and a turn that crosses a stretch's end stands alone; so windows are aligned to turns.
A turn that stands alone may need more than its stretch; then less history is repeated, or none. So
a window exceeds the budget only where the system turn and a single turn do. Targets are the
assistant texts; repeated ones are masked, so each is trained on once.

Everything is grouped by (conversation, window) at most: window functions give the prefix sums, a
range frame finds the windows that repeat a turn, and no whole conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

#: Strings with a meaning to the template or to common chat templates; texts have them only escaped.
#: Each is a first character and a rest; the escape is "~" between the two.
FIRST, REST = r"(<|\[)", r"(?=/?s>|</?SYS>>|\||/?INST\])"
#: The end of a role.
BAR = r"(\|)"
TURN_OPEN, ROLE_END, TURN_END = "<|", "|>", "</s>"


def escaped(text: Column) -> Column:
    """text without control strings: one "~" more after the first character of each, or of an escaped one."""
    return F.regexp_replace(text, FIRST + "(~*)" + REST, "$1~$2")


def unescaped(text: Column) -> Column:
    """The inverse of escaped()."""
    return F.regexp_replace(text, FIRST + "~(~*)" + REST, "$1$2")


def escaped_role(role: Column) -> Column:
    """A role that can be ended by ROLE_END."""
    return F.regexp_replace(escaped(role), BAR + "(~*)(?=>)", "$1~$2")


def unescaped_role(role: Column) -> Column:
    """The inverse of escaped_role()."""
    return unescaped(F.regexp_replace(role, BAR + "~(~*)(?=>)", "$1$2"))


def rough_tokens(text: Column) -> Column:
    """ASCII words and other marks: an estimate of tokens that needs no vocabulary."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]"))


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = 512, history: int = 128, overhead: int = 4, tokens=rough_tokens, tokens_col: str | None = None
) -> DataFrame:
    """(conv_id, window, n_turns, n_repeated, n_tokens, formatted, loss): rows for each window.

    formatted is the window's turns, each `<|role|>text</s>`; the first n_repeated are repeated.
    loss is an array of (start, length) in characters of formatted, the texts to be learnt. A turn
    has overhead tokens besides those of its text; tokens_col, a column of ids
    (as the byte-level BPE makes them) or of their number, tells these, and where it is null or not given tokens(text), an estimate by default. n_tokens has those of
    repeated turns too. A null role or text counts as empty; a very long turn is a window of its own.
    Turns are ordered by turn, then role and text, so ties and repeated rows have a fixed order; all
    rows count. A null conv_id is a conversation like any other. An empty table gives an empty
    result. Other columns are ignored. A conversation's turns are sorted in one task.
    """
    said = [F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text")))]
    if tokens_col is None:
        told = F.lit(None)
    elif isinstance(turns.schema[tokens_col].dataType, ArrayType):
        told = F.when(F.col(tokens_col).isNotNull(), F.size(tokens_col))
    else:
        told = F.col(tokens_col)
    t = turns.select(*said, told.cast("long").alias("told"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("place", F.row_number().over(in_order)).withColumn("system", (F.col("place") == 1) & (F.col("role") == "system"))
    t = t.withColumn("n_tokens", (F.coalesce("told", tokens(F.col("text"))) + overhead).cast("long")).drop("told")
    counted = F.when(F.col("system"), F.lit(0)).otherwise(F.col("n_tokens")).cast("long")
    t = t.withColumn("end", F.sum(counted).over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - counted)
    t = t.withColumn("kept", F.coalesce(F.max(F.when(F.col("system"), F.col("n_tokens"))).over(Window.partitionBy("conv_id")), F.lit(0)))
    room = F.greatest(budget - history - F.col("kept"), F.lit(1))
    stretch = F.floor(F.col("start") / room)
    t = t.withColumn("alone", F.col("end") > (stretch + 1) * room).withColumn("window", F.when(F.col("system"), 0).otherwise(2 * stretch + F.col("alone").cast("int")))
    # How far back a window that opens with this turn repeats turns.
    t = t.withColumn("reach", F.when(F.col("alone"), F.least(F.lit(history), F.greatest(F.lit(0), budget - F.col("kept") - F.col("n_tokens")))).otherwise(F.lit(history)))

    by_place = Window.partitionBy("conv_id").orderBy("place")
    opens = F.coalesce(F.col("window") != F.lag("window").over(by_place), F.lit(True)) & ~F.col("system")
    t = t.withColumn("opens", opens | (~F.col("system") & (F.lag("system").over(by_place))))
    # A turn is repeated in the windows that open within their reach after its start.
    ahead = Window.partitionBy("conv_id").orderBy("start").rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("opens"), F.struct("window", "start", "reach"))).over(ahead)
    t = t.withColumn("later", later)
    t = t.withColumn("again", F.when(~F.col("system"), F.expr("transform(filter(later, w -> w.start - start <= w.reach), w -> w.window)")))
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.first(F.when(F.col("system"), F.struct("place", "role", "text", "n_tokens"))).over(so_far)
    t = t.withColumn("lead", F.when(F.col("opens") & (F.col("window") > 0), lead))

    def entry(window, repeated, of=""):
        return F.struct(window.alias("window"), F.lit(repeated).alias("repeated"), *(F.col(of + c).alias(c) for c in ("place", "role", "text", "n_tokens")))

    entries = [F.array(entry(F.col("window"), False)), F.coalesce(F.transform("again", lambda w: entry(w, True)), F.array())]
    entries.append(F.when(F.col("lead").isNotNull(), F.array(entry(F.col("window"), True, "lead."))).otherwise(F.array()))
    laid = t.select("conv_id", F.explode(F.concat(*entries)).alias("e")).select("conv_id", "e.*")
    laid = laid.withColumn("head", F.concat(F.lit(TURN_OPEN), escaped_role(F.col("role")), F.lit(ROLE_END))).withColumn("body", escaped(F.col("text")))

    length = F.length("head") + F.length("body") + len(TURN_END)
    until = F.sum(length).over(Window.partitionBy("conv_id", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    laid = laid.withColumn("at", until - F.length("body") - len(TURN_END))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    piece = F.struct("place", F.concat("head", "body", F.lit(TURN_END)).alias("piece"))
    mask = F.when(target, F.struct(F.col("at").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    out = laid.groupBy("conv_id", "window").agg(
        F.count("*").alias("n_turns"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("pieces"), F.array_sort(F.collect_list(mask)).alias("loss")
    )
    return out.select("conv_id", "window", "n_turns", "n_repeated", "n_tokens", F.array_join("pieces.piece", "").alias("formatted"), "loss")


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses): what formatted says, unescaped, without the repeated turns.

    turns is an array of (role, text) in order, losses the texts under the mask in order.
    """
    parts = F.slice(F.split("formatted", TURN_END), F.col("n_repeated").cast("int") + 1, (F.col("n_turns") - F.col("n_repeated")).cast("int"))
    turn = lambda p: F.struct(
        unescaped_role(F.substring_index(F.substring(p, len(TURN_OPEN) + 1, 2**31 - 1), ROLE_END, 1)).alias("role"),
        unescaped(F.substring(p, F.locate(ROLE_END, p) + len(ROLE_END), 2**31 - 1)).alias("text"),
    )
    losses = F.expr("transform(loss, l -> substring(formatted, cast(l.start AS int) + 1, cast(l.length AS int)))")
    return windows.select("conv_id", "window", F.transform(parts, turn).alias("turns"), F.transform(losses, unescaped).alias("losses"), F.length("formatted").alias("formatted_chars"))
