"""Batch forms of the streaming operators over the events; the tests run them as streams too."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.plans.register import Plans
from rankweave.plans.standins import frames, table
from rankweave.streaming import progress as T

plans = Plans()


@plans("SELECT user_id AS job_id, event_id AS seq FROM events")
def t01_dedupe_progress(spark, d):
    f = frames(table(spark, d, "events"))
    return T.dedupe_progress(f.unionByName(f.where("seq % 3 = 0"))).select("job_id", "seq")


@plans("""SELECT user_id AS job_id, max(event_id) AS seq, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'failed' ELSE 'running' END AS state, arg_max(event_type, event_id) AS message, count(*) AS n_frames, bool_or(event_type = 'error') AS ended FROM events GROUP BY user_id""")
def t02_job_status(spark, d):
    return T.job_status(frames(table(spark, d, "events"))).select("job_id", "seq", "state", "message", "n_frames", "ended")


@plans("""SELECT user_id AS job_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_frames, max((props->>'$.k')::INT) AS units_read, max(floor(value)::INT) AS recipes_found, max(length(props)) AS chars_read FROM events GROUP BY ALL""")
def t03_progress_rates(spark, d):
    out = T.progress_rates(frames(table(spark, d, "events")), "1 hour")
    return out.withColumn("chars_read", F.col("chars_read").cast("long"))


@plans("""WITH e AS (SELECT user_id AS conv_id, event_id AS turn, ts, CASE WHEN event_type = 'click' THEN 'user' ELSE 'assistant' END AS role, event_type || ' ' || event_id AS text FROM events),
g AS (SELECT *, lag(ts) OVER w AS earlier FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY ts, turn)),
s AS (SELECT *, sum(CASE WHEN earlier IS NULL OR epoch_ms(ts) - epoch_ms(earlier) > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ts, turn) AS session FROM g),
h AS (SELECT *, list(CASE WHEN role = 'user' THEN 'You: ' ELSE 'Assistant: ' END || text) OVER (PARTITION BY conv_id, session ORDER BY ts, turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS l FROM s)
SELECT conv_id, turn, text, coalesce(array_to_string(l, chr(10)), '') AS history FROM h WHERE role = 'user'""")
def t05_conversation_history(spark, d):
    """Users' events as their conversations; a gap of six hours starts anew."""
    e = table(spark, d, "events")
    role = F.when(F.col("event_type") == "click", "user").otherwise("assistant")
    turns = e.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.concat_ws(" ", "event_type", "event_id").alias("text"), F.col("ts").alias("at"))
    return T.conversation_history(turns, idle="6 hours")


@plans("""WITH e AS (SELECT event_type AS span, ['gpt-4o-mini', 'gpt-4o', 'own'][user_id % 3 + 1] AS model, value AS seconds, (props->>'$.k')::BIGINT AS k FROM events), u AS (SELECT *, CASE model WHEN 'gpt-4o-mini' THEN round(k * 1000 / 1e6 * 0.15 + k * 100 / 1e6 * 0.6, 6) WHEN 'gpt-4o' THEN round(k * 1000 / 1e6 * 2.5 + k * 100 / 1e6 * 10, 6) ELSE 0 END AS usd FROM e)
SELECT coalesce(span, '(all)') AS span, count(*) AS calls, sum(k * 1000)::BIGINT AS tokens_in, sum(k * 100)::BIGINT AS tokens_out, round(sum(usd), 4) AS usd FROM u GROUP BY ROLLUP (span)""")
def e29_cost_ledger(spark, d):
    from rankweave.operators.evaluate import cost_ledger

    k = F.get_json_object("props", "$.k").cast("long")
    model = F.element_at(F.array(F.lit("gpt-4o-mini"), F.lit("gpt-4o"), F.lit("own")), (F.col("user_id") % 3 + 1).cast("int"))
    calls = table(spark, d, "events").select(F.col("event_type").alias("span"), model.alias("model"), F.col("value").alias("seconds"), (k * 1000).alias("tokens_in"), (k * 100).alias("tokens_out"))
    return cost_ledger(calls).select("span", "calls", "tokens_in", "tokens_out", F.round("usd", 4).alias("usd"))
