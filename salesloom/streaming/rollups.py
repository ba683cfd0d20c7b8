"""Run-event rollups. Those marked so work on tables and on streams alike."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from salesloom import contracts as C
from salesloom.functions.scalars import count_if, moment
from salesloom.operators.numbering import number_within
from salesloom.operators.ranks import exact_quantiles
from salesloom.session import stored

QUANTILES = {"p50_ms": (50, 100), "p95_ms": (95, 100)}
#: On streams: a quantile is off by one rank in so many at most.
STREAM_ACCURACY = 100_000


def stage_latency(events: DataFrame, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Count, mean, median, p95 and maximum duration by stage and status. Table or stream.

    Reads ts, name, status, duration_ms. Quantiles of a table are exact at every size. On a stream the watermark closes
    each window, and quantiles are approximate and called p50_ms_approx and p95_ms_approx.
    """
    keys = ["name", "status"]
    by = [*([F.window("ts", window).alias("window")] if window else []), *keys]
    duration = F.col("duration_ms")
    mean = lambda total, n: F.round((total / n.cast("decimal(20,0)")).cast("decimal(28,10)"), 4).cast("double")
    if events.isStreaming:
        rolled = events.withWatermark("ts", delay).groupBy(*by).agg(
            F.count(F.lit(1)).alias("events"), mean(F.sum(duration.cast("decimal(18,4)")), F.count(duration)).alias("mean_ms"),
            *[F.percentile_approx(duration, p / of, STREAM_ACCURACY).alias(f"{name}_approx")
              for name, (p, of) in QUANTILES.items()], F.max(duration).alias("max_ms"))
    else:
        rolled = _exact_latency(events.groupBy(*by, "duration_ms"), [*(["window"] if window else []), *keys], mean)
    if not window:
        return rolled
    return rolled.select(F.col("window.start").alias("window_start"), *[c for c in rolled.columns if c != "window"])


def _exact_latency(by_duration: GroupedData, keys: list[str], mean) -> DataFrame:
    """Equal durations are counted first; quantiles are then found among the counts by rank."""
    duration = F.col("duration_ms")
    counts = stored(by_duration.agg(F.count(F.lit(1)).alias("n"), F.count("duration_ms").alias("known")), "durations")
    total = F.sum(duration.cast("decimal(18,4)") * F.col("known").cast("decimal(20,0)"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("events"), mean(total, F.sum("known")).alias("mean_ms"),
                                      F.max(duration).alias("max_ms"))
    ranked = exact_quantiles(counts.filter(duration.isNotNull()), keys, "duration_ms", "known", QUANTILES)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    met = whole.join(ranked.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    return met.select(*keys, "events", "mean_ms", *QUANTILES, "max_ms")


def run_summary(events: DataFrame) -> DataFrame:
    """Stages, duration, tools and rows of every run. Table or stream (update mode).

    Reads run_id, event, duration_ms, rows_in, rows_out.
    """
    is_stage, is_tool = F.col("event") == "stage", F.col("event") == "tool"
    rows = F.coalesce(F.nullif("rows_out", F.lit(0)), F.col("rows_in"), F.lit(0))
    return events.groupBy("run_id").agg(
        count_if(is_stage).alias("stages"),
        F.coalesce(F.sum(F.when(is_stage, F.col("duration_ms").cast("decimal(18,4)"))).cast("double"), F.lit(0.0))
        .alias("duration_ms"),
        count_if(is_tool).alias("tools"),
        F.coalesce(F.sum(F.when(is_tool, rows)), F.lit(0)).cast("long").alias("rows"))


REPLAY_PAGE = 1000


def replay(events: DataFrame, columns: list[str]) -> DataFrame:
    """Every event with its position in its run, in order of seq. A huge run is spread over tasks."""
    return number_within(events.select("run_id", "seq", *columns), ["run_id"], ["seq"], "position")


def replay_record(events: DataFrame, columns: list[str], page: int = REPLAY_PAGE) -> DataFrame:
    """Ordered event lists per run, in pages of bounded length, with the state of the run."""
    placed = replay(events, columns).withColumn("page", F.floor((F.col("position") - 1) / page).cast("long"))
    pages = placed.groupBy("run_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("position", *columns))).alias("events"))
    return pages.join(run_states(events), "run_id")


def run_states(events: DataFrame) -> DataFrame:
    """A run with an error event is in error, else completed."""
    return events.groupBy("run_id").agg(
        F.when(F.max(F.col("event") == "run.error"), "error").otherwise("completed").alias("state"),
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("created_at"))


def recent_runs(events: DataFrame, n: int = C.RECENT_RUNS) -> DataFrame:
    """The newest n runs; older history is left out of the list."""
    return run_states(events).orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)


def freshness(events: DataFrame, now: dt.datetime, source: Column, ttl: int = C.SNAPSHOT_TTL_SECONDS) -> DataFrame:
    """Fresh or stale by the age of the last sync of each source. Table or stream (update mode)."""
    age = F.timestamp_diff("SECOND", F.col("last_sync"), moment(now))
    return events.groupBy(source.alias("source")).agg(F.max("ts").alias("last_sync")).withColumns(
        {"age_seconds": age, "state": F.when(age < ttl, "fresh").otherwise("stale")})


def current_stages(events: DataFrame) -> DataFrame:
    """Latest status, start and duration of each stage of a run. Table or stream (update mode)."""
    latest = F.max_by(F.struct("status", "started_at", "duration_ms"), "seq")
    return (events.filter(F.col("event") == "stage").groupBy("run_id", "name").agg(latest.alias("s"))
            .select("run_id", "name", "s.status", "s.started_at", "s.duration_ms"))


def stage_board(events: DataFrame) -> DataFrame:
    """All eight stages of every run; a stage not yet seen is queued."""
    stages = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(s).alias("name"))
                       for i, s in enumerate(C.RUN_STAGES, 1)])
    runs = events.select("run_id").distinct().select("run_id", F.inline(stages))
    return runs.join(current_stages(events), ["run_id", "name"], "left").withColumn(
        "status", F.coalesce("status", F.lit("queued")))


def appended_events(events: DataFrame) -> DataFrame:
    """Tool and model calls, kept as they come. Table or stream."""
    return events.filter(F.col("event").isin("tool", "llm"))
