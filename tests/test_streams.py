"""Streams give what batches give, whatever is replayed, late or idle."""

import datetime as dt
import json

from rankweave.operators.question import transcript
from rankweave.plans.standins import frames
from rankweave.streaming import progress as T


def _run(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def _files(spark, tmp_path, schema, *batches):
    """A stream that reads one of the batches after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/landed/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/landed/*")


def _at(minutes):
    return (dt.datetime(2024, 5, 1, 10) + dt.timedelta(minutes=minutes)).isoformat()


def test_job_status_and_duplicates(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*")
    _run(T.job_status(frames(stream)), "status", "complete")
    want = {r.job_id: (r.seq, r.state, r.n_frames) for r in T.job_status(frames(batch)).collect()}
    assert {r.job_id: (r.seq, r.state, r.n_frames) for r in spark.table("status").collect()} == want
    _run(T.dedupe_progress(frames(stream)), "frames", "append")
    assert spark.table("frames").count() == batch.count()


def test_conversations(spark, sf):
    batch = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id < 20")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/conversations.parquet*").where("conv_id < 20")
    _run(T.conversation_state(stream), "turns", "append")
    want = {(r.conv_id, r.turn): r.history for r in transcript(batch).collect()}
    assert {(r.conv_id, r.turn): r.history for r in spark.table("turns").collect()} == want


FRAMES = "job_id long, seq long, at string, units_read int, recipes_found int, chars_read int"


def test_a_replayed_frame_counts_once(spark, tmp_path):
    frame = lambda seq, minutes: (1, seq, _at(minutes), seq, 0, 0)
    stream = _files(spark, tmp_path, FRAMES, [frame(1, 0), frame(2, 1)], [frame(1, 0), frame(2, 1), frame(3, 2)], [frame(3, 2)])
    _run(T.dedupe_progress(stream), "once", "append")
    assert sorted(r.seq for r in spark.table("once").collect()) == [1, 2, 3]


def test_a_late_frame_is_dropped_and_the_rest_is_the_batch(spark, tmp_path):
    """The watermark is ten minutes behind the latest frame; a frame before it changes no window that is out."""
    on_time = [(1, 1, _at(0), 1, 0, 5), (1, 2, _at(0.5), 2, 1, 6), (2, 1, _at(1), 4, 0, 7)]
    ahead, more, late, end = [(1, 3, _at(30), 9, 2, 8)], [(3, 1, _at(30), 1, 1, 1)], [(1, 4, _at(0.2), 100, 50, 99), (1, 5, _at(25), 8, 2, 8)], [(9, 1, _at(90), 0, 0, 0)]
    stream = _files(spark, tmp_path, FRAMES, on_time, ahead, more, late, end)  # the watermark of a batch holds from the next but one
    _run(T.progress_rates(stream), "rates", "append")
    batch = spark.createDataFrame([*on_time, *ahead, *more, late[1]], FRAMES)
    batch = batch.withColumn("at", batch["at"].cast("timestamp"))
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, T.progress_rates(batch).collect()))


TURNS = "conv_id long, turn long, role string, text string, at string"


def test_an_idle_conversation_starts_anew(spark, tmp_path):
    """By a timer where the watermark passes, and by the gap itself where it does not; both as in the batch form."""
    first = [(1, 0, "user", "hello", _at(0)), (1, 1, "assistant", "hi", _at(1)), (2, 0, "user", "one", _at(2))]
    second = [(1, 2, "user", "more", _at(20)), (3, 0, "user", "far ahead", _at(300))]
    third = [(1, 3, "user", "after a long time", _at(301)), (2, 1, "user", "two", _at(302)), (2, 2, "assistant", "x" * 400, _at(303)), (2, 3, "user", "three", _at(304))]
    stream = _files(spark, tmp_path, TURNS, first, second, third)
    _run(T.conversation_state(stream, at_col="at"), "timed", "append")
    got = {(r.conv_id, r.turn): r.history for r in spark.table("timed").collect()}
    assert got[1, 2] == "You: hello\nAssistant: hi" and got[1, 3] == "" and got[2, 1] == "" and got[2, 3] == "You: two\nAssistant: " + "x" * 300
    batch = spark.createDataFrame([*first, *second, *third], TURNS)
    assert got == {(r.conv_id, r.turn): r.history for r in T.conversation_history(batch).collect()}


def test_state_of_an_idle_conversation_goes(spark, tmp_path):
    stream = _files(spark, tmp_path, TURNS, [(1, 0, "user", "hello", _at(0))], [(2, 0, "user", "far ahead", _at(300))], [(2, 1, "user", "on", _at(310))], [(2, 2, "user", "on", _at(320))])
    q = _run(T.conversation_state(stream, at_col="at"), "idle", "append")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def _land(folder, name, run, titles):
    folder.mkdir(exist_ok=True)
    recipes = [{"recipe_id": f"r{k}", "title": t, "ingredient_lines": ["salt"]} for k, t in titles.items()]
    (folder / f"{name}.json").write_text(json.dumps({"run_id": run, "source_type": "web", "origin": "o", "recipes": recipes}))


def test_run_files_are_taken_once_and_a_replay_changes_nothing(spark, tmp_path):
    landed, table = tmp_path / "runs", str(tmp_path / "table")
    seen, write = [], T.batch_sink(table)

    def sink(batch, number):
        seen.append((number, batch.persist()))
        write(batch, number)

    rows = lambda: sorted((r.source, r.record_id, r.title, r.source_type) for r in T.merged(spark, table).collect())
    _land(landed, "a", "1", {1: "old", 2: "kept"})
    T.ingest_stream(spark, str(landed), str(tmp_path / "marks"), sink).awaitTermination(120)
    assert rows() == [("a", "r1", "old", "web"), ("a", "r2", "kept", "web")]
    _land(landed, "b", "2", {1: "other"})
    T.ingest_stream(spark, str(landed), str(tmp_path / "marks"), sink).awaitTermination(120)
    whole = rows()
    assert whole == [("a", "r1", "old", "web"), ("a", "r2", "kept", "web"), ("b", "r1", "other", "web")] and [n for n, _ in seen] == [0, 1]
    number, batch = seen[-1]
    write(batch, number)  # the end of the batch was not noted
    assert rows() == whole
    write(batch.limit(0).unionByName(spark.createDataFrame([("a", "1", "r1", "web", "o", "new", None, ["salt"], None, None)], batch.schema)), 2)
    assert rows() == [("a", "r1", "new", "web"), ("a", "r2", "kept", "web"), ("b", "r1", "other", "web")]
