"""Streams of progress frames, run files and conversation turns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from rankweave.sources.runs import RUN

TERMINAL = ("done", "failed", "cancelled")


def dedupe_progress(frames: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """frames(job_id, seq, at, ...): a frame that is replayed within the delay is delivered once. The same call works on a batch."""
    if not frames.isStreaming:
        return frames.dropDuplicates(["job_id", "seq"])
    return frames.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


def job_status(frames: DataFrame) -> DataFrame:
    """frames(job_id, seq, state, message, units_read, units_total, recipes_found) -> the latest of each job, its frames, and whether it has ended."""
    last = F.max_by(F.struct("state", "message", "units_read", "units_total", "recipes_found"), "seq").alias("last")
    g = frames.groupBy("job_id").agg(last, F.max("seq").alias("seq"), F.count("*").alias("n_frames"), F.bool_or(F.col("state").isin(*TERMINAL)).alias("ended"))
    return g.select("job_id", "seq", "last.*", "n_frames", "ended")


def progress_rates(frames: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Units, records and characters of each job in windows of time; frames later than the delay are dropped in a stream."""
    f = frames.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay) if frames.isStreaming else frames
    g = f.groupBy("job_id", F.window("at", width)).agg(F.count("*").alias("n_frames"), F.max("units_read").alias("units_read"), F.max("recipes_found").alias("recipes_found"), F.max("chars_read").alias("chars_read"))
    return g.select("job_id", F.col("window.start").alias("window_start"), "n_frames", "units_read", "recipes_found", "chars_read")


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of micro-batches that may be delivered again: each batch is a partition of the table at path, which a replay replaces.

    The batch's number is kept with its rows, so merged() knows which of two rows came later.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_id", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return write


def merged(spark: SparkSession, path: str, keys: tuple[str, ...] = ("source", "record_id")) -> DataFrame:
    """A batch_sink() table with the latest batch's rows of each key; rows of one key within a batch all stay."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("batch_id").alias("_latest"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(latest, reduce(and_, same, F.col("batch_id") == F.col("_latest")), "left_semi").drop("batch_id")


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_a_batch: int = 1000):
    """Starts a query that hands the records of newly landed run files to sink(records, batch number); runs what is there and stops.

    A batch whose end was not noted is delivered again under its number, so the sink has to be one like batch_sink().
    """
    runs = spark.readStream.schema(RUN).option("multiLine", True).option("maxFilesPerTrigger", files_a_batch).json(path).withColumn("file", F.col("_metadata.file_name"))

    def take(batch: DataFrame, number: int) -> None:
        r = batch.select("run_id", F.regexp_replace("file", r"\.json$", "").alias("source"), F.col("source_type").alias("run_type"), F.col("origin").alias("run_origin"), F.explode("recipes").alias("r"))
        sink(r.select("source", "run_id", F.col("r.recipe_id").alias("record_id"), F.coalesce("r.source_type", "run_type").alias("source_type"), F.coalesce("r.origin", "run_origin").alias("origin"), "r.title", "r.pages", "r.ingredient_lines", "r.step_lines", "r.raw_text"), number)

    return runs.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _milliseconds(span: str) -> int:
    amount, unit = span.split()
    return int(amount) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def _said(role: str | None, text: str | None) -> str:
    return ("You: " if role == "user" else "Assistant: ") + (text or "")[:300]


def conversation_state(turns: DataFrame, n: int = 6, idle: str = "1 hour", at_col: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """A stream of turns(conv_id, turn, role, text[, at]) -> each user turn with the transcript of the last n turns before it.

    With at_col, a timestamp, time is the turns' own: turns later than the delay are dropped, a gap of more than idle
    starts a conversation anew, and a timer drops the state once the watermark is past it. The batch form is
    conversation_history(). Without it the clock counts: a conversation that is idle for long is forgotten.
    """
    gap = _milliseconds(idle)
    timed = at_col is not None
    kept = turns.select("conv_id", "turn", "role", "text", (F.col(at_col) if timed else F.lit(None)).cast("timestamp").alias("at"))
    kept = kept.withWatermark("at", delay) if timed else kept

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lines, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        out = []
        for row in pd.concat(list(parts)).sort_values(["at", "turn"] if timed else "turn").itertuples(index=False):
            if timed:
                now = int(row.at.timestamp() * 1000)
                lines = [] if last is not None and now - last > gap else lines
                last = now if last is None else max(last, now)
            if row.role == "user":
                out.append((key[0], row.turn, row.text, "\n".join(lines[-n:])))
            lines.append(_said(row.role, row.text))
        state.update((lines[-n:], last))
        if timed:
            state.setTimeoutTimestamp(max(last + gap, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(gap)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "history"])

    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.ProcessingTimeTimeout
    return kept.groupBy("conv_id").applyInPandasWithState(run, "conv_id long, turn long, text string, history string", "lines array<string>, last long", "append", timeout)


def conversation_history(turns: DataFrame, n: int = 6, idle: str = "1 hour") -> DataFrame:
    """The batch form of conversation_state() with at: user turns of turns(conv_id, turn, role, text, at) with what was said before, up to a gap of more than idle."""
    turns, order = turns.withColumn("at", F.col("at").cast("timestamp")), Window.partitionBy("conv_id").orderBy("at", "turn")
    before = F.lag("at").over(order)
    starts = before.isNull() | (F.unix_millis("at") - F.unix_millis(before) > _milliseconds(idle))
    t = turns.withColumn("_session", F.sum(starts.cast("int")).over(order))
    line = F.concat(F.when(F.col("role") == "user", "You: ").otherwise("Assistant: "), F.substring(F.coalesce("text", F.lit("")), 1, 300))
    last = Window.partitionBy("conv_id", "_session").orderBy("at", "turn").rowsBetween(-n, -1)
    return t.withColumn("history", F.array_join(F.collect_list(line).over(last), "\n")).where("role = 'user'").select("conv_id", "turn", "text", "history")
