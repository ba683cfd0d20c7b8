"""Streams give what the batch form of the same job gives."""

import datetime as dt
import time

from pyspark.sql import Window as W, functions as F

from salesloom.operators import questions as QU, ranks
from salesloom.plans import text_queries as TQ
from salesloom.streaming import admission, carryover, drain, rollups

FAR = dt.datetime(2030, 1, 1)


def sliced(spark, events, path, slices=3):
    """Events as files in time order, and a last file that moves the watermark past them."""
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                           F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - low) * slices / (high - low + 1))
    for i in range(slices):
        events.filter(at == i).coalesce(1).write.mode("append").parquet(path)
    end = spark.createDataFrame([(-1, FAR, -1)], "event_id long, ts timestamp_ntz, user_id long")
    for c, t in events.dtypes:
        if c not in end.columns:
            end = end.withColumn(c, F.lit(None).cast(t))
    end.select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    return drain.read_table_stream(spark, path, events.schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_admission_rules(spark, context, tmp_path):
    events = context.t.events.filter(F.col("user_id") % 4 == 0)
    for i, rule in enumerate((TQ.SLIDING, TQ.BUCKET, TQ.BUDGET)):
        stream = sliced(spark, events, str(tmp_path / f"e{i}"))
        got = drain.drain(admission.admit_stream(stream, rule, delay="1 hour"), f"admission{i}").filter("event_id >= 0")
        assert got.filter("late").count() == 0
        want = admission.admit(events, rule)
        assert rows(got.select("event_id", "admitted", "retry_after")) == rows(
            want.select("event_id", "admitted", "retry_after"))


def test_late_events_are_marked(spark, context, tmp_path):
    events = context.t.events.filter(F.col("user_id") == 1).orderBy("ts")
    path = str(tmp_path / "late")
    late_id = events.first()["event_id"]
    events.filter(F.col("event_id") != late_id).coalesce(1).write.mode("append").parquet(path)
    events.filter(F.col("event_id") == late_id).coalesce(1).write.mode("append").parquet(path)
    stream = drain.read_table_stream(spark, path, events.schema)
    got = drain.drain(admission.admit_stream(stream, TQ.SLIDING, delay="1 second"), "late")
    assert [r["event_id"] for r in got.filter("late").collect()] == [late_id]


def key(row):
    return tuple((x is not None, x) for x in row[:2])


def test_period_carry_over_in_any_file_order(spark, context, tmp_path):
    turns = TQ.turns(context.t.conversations.filter("conv_id < 30"))
    want = QU.carry_period(QU.understand(turns.filter("role = 'user'"))).select("session_id", "turn", "period")
    want = sorted(map(tuple, want.collect()), key=key)
    for i, order in enumerate((F.col("turn"), -F.col("turn"), F.xxhash64("turn", "session_id"))):
        cut = F.ntile(4).over(W.orderBy(order))
        for n in (1, 2, 3, 4):
            turns.withColumn("_n", cut).filter(F.col("_n") == n).drop("_n").coalesce(1).write.mode("append").parquet(str(tmp_path / f"q{i}"))
        stream = drain.read_table_stream(spark, str(tmp_path / f"q{i}"), turns.schema)
        got = drain.drain(carryover.carry_period_stream(stream), "carry")
        assert got.filter("late").count() == 0
        assert sorted(map(tuple, got.drop("late").collect()), key=key) == want


def test_a_gap_is_passed_over_by_the_watermark(spark, tmp_path):
    """Turn 1 is missing until the watermark has left turn 2 an hour behind; then it is late."""
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    batches = [[(1, 0, "pipeline for Q4", at(0)), (1, 2, "and solar?", at(1))], [(2, 0, "x", at(50))], [(2, 1, "x", at(200))],
               [(2, 2, "x", at(300))], [(1, 1, "pipeline for Q1", at(301)), (1, 3, "and mining?", at(301)), (1, 3, "and again?", at(301)),
                                        (1, None, "no number", at(301))], [(3, 0, "x", at(900))]]
    schema = "session_id long, turn long, question string, ts timestamp"
    for rows_of in batches:
        spark.createDataFrame(rows_of, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    stream = drain.read_table_stream(spark, str(tmp_path / "g"), spark.createDataFrame([], schema).schema)
    got = drain.drain(carryover.carry_period_stream(stream, patience="1 hour"), "gap").filter("session_id = 1").collect()
    by_turn = {(r["turn"], r["late"]): r["period"] for r in got}
    assert by_turn[0, False] == by_turn[2, False] == by_turn[3, False] != None  # noqa: E711
    assert by_turn[1, True] not in (None, by_turn[0, False]) and (3, True) in by_turn and (None, True) in by_turn and len(got) == 6


def test_a_busy_key_is_one_sort(spark, tmp_path):
    """A hundred thousand events of one key in one batch, and what is left of a key that is idle."""
    n = 100_000
    events = spark.range(n).select(
        (F.col("id") * 7919 % n).alias("event_id"), F.lit(5).cast("long").alias("user_id"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("id") * 7919 % n) * 50_000).alias("ts"))
    stream, delay = drain.replayed(events, str(tmp_path / "busy"), {"event_id": -1, "user_id": -1}, slices=1)
    start = time.time()
    got = drain.drain(admission.admit_stream(stream, admission.TokenBucket(10, 60), delay=delay), "busy").filter("event_id >= 0")
    assert got.count() == n and time.time() - start < 120
    want = admission.admit(events, admission.TokenBucket(10, 60))
    assert got.filter("admitted").count() == want.filter("admitted").count()


def test_an_idle_key_starts_anew(spark, tmp_path):
    start = 1_704_067_200
    at = [start, start + 1, start + 2, start + 100, start + 101, start + 5000]
    rows_of = [(i, 1, dt.datetime.fromtimestamp(t)) for i, t in enumerate(at)] + [(90, 2, dt.datetime.fromtimestamp(start + 2000))]
    events = spark.createDataFrame(rows_of, "event_id long, user_id long, ts timestamp")
    rule = admission.SlidingWindow(2, 60)
    stream, _ = drain.replayed(events.coalesce(1), str(tmp_path / "idle"), {"event_id": -1, "user_id": -1}, slices=5, files=1)
    got = drain.drain(admission.admit_stream(stream, rule, delay="1 second"), "idle").filter("event_id >= 0")
    assert rows(got.select("event_id", "admitted", "retry_after")) == rows(
        admission.admit(events, rule).select("event_id", "admitted", "retry_after"))


def test_windowed_latency(spark, context, tmp_path):
    log = TQ.run_events(context.t.events)
    stream = sliced(spark, context.t.events, str(tmp_path / "w"))
    log_stream = TQ.run_events(stream)
    got = drain.drain(rollups.stage_latency(log_stream.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours",
                                            "1 hour"), "latency")
    want = rollups.stage_latency(log.withColumn("ts", F.col("ts").cast("timestamp")), "6 hours")
    want = want.withColumnsRenamed({"p50_ms": "p50_ms_approx", "p95_ms": "p95_ms_approx"})  # a few rows: no error yet
    assert rows(got.filter(F.col("window_start") < FAR)) == rows(want)


def test_update_mode_rollups(spark, context, tmp_path):
    stream = sliced(spark, context.t.events, str(tmp_path / "u"))
    log_stream = TQ.run_events(stream)
    log = TQ.run_events(context.t.events)
    summary = drain.drain_updates(rollups.run_summary(log_stream), ["run_id"], "summary")
    assert rows(summary.filter("run_id >= 0")) == rows(rollups.run_summary(log))
    stages = drain.drain_updates(rollups.current_stages(log_stream), ["run_id", "name"], "stages")
    assert rows(stages.filter("run_id >= 0")) == rows(rollups.current_stages(log))


def test_quantiles_are_exact_in_large_groups(spark):
    n = 300_000
    log = spark.range(n).select(F.lit("a").alias("name"), F.lit("ok").alias("status"), ((F.col("id") * 7919) % n).alias("duration_ms"))
    row = rollups.stage_latency(log.unionByName(log.limit(0))).first()
    assert (row.events, row.p50_ms, row.p95_ms, row.max_ms) == (n, n // 2 - 1, n * 95 // 100 - 1, n - 1)


def test_quantiles_of_odd_groups(spark):
    """Spread over many magnitudes, infinite, not a number, null, null names; no window over a group."""
    wide = [("w", "ok", float(2.0 ** ((i * 37) % 2000 - 1000))) for i in range(2000)]
    odd = [("o", None, x) for x in (None, float("inf"), float("-inf"), 1.0, 1.0, 2.0)] + [(None, "x", None)] * 3
    many = [("m", "ok", x) for x in [float("-inf"), *range(3000), float("inf")]]
    log = spark.createDataFrame(wide + odd + [(a, b, float(c)) for a, b, c in many], "name string, status string, duration_ms double")
    counts = log.filter("duration_ms IS NOT NULL").groupBy("name", "status", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    wanted = {"p50": (50, 100), "p95": (95, 100), "least": (0, 1), "most": (1, 1)}
    found = ranks.exact_quantiles(counts.cache(), ["name", "status"], "duration_ms", "n", wanted)
    got = {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}
    groups = {}
    for a, b, v in wide + odd + many:
        if v is not None:
            groups.setdefault((a, b), []).append(float(v))
    for g, values in groups.items():
        values.sort()
        at = lambda p, of: values[max(0, -(-len(values) * p // of) - 1)]
        assert got[g][0] == at(50, 100) and got[g][1] == at(95, 100) and got[g][3] == values[-1]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_carry_over_reads_tables_of_many_files(spark, tmp_path):
    from salesloom.plans.context import Context
    from salesloom.plans.text_queries import streamed_carry_over
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("conv_id < 12")
    table.coalesce(1).write.parquet(str(tmp_path / "one" / "conversations.parquet"))
    table.repartitionByRange(3, "turn").write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    one, many = [sorted(map(tuple, streamed_carry_over(Context(spark, str(tmp_path / p))).collect()), key=key) for p in ("one", "many")]
    assert one == many and len(one) == TQ.questions(table).count() > table.filter("role = 'user'").count()
