"""Site health from check events: history windows, failures, backoff, rates.

Checks hold ``site``, ``ts``, ``seq`` (order among equal times),
``response_time_ms`` and ``status_code`` (NULL when the check raised).  A site may
hold any share of the checks: positions come from hourly buckets and windows run
over chunks of a site.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagloom.operators.ordering import chunk_window, positions, running

# Fixed values.
BLOCKING = [403, 429, 503]
HISTORY, RECENT = 100, 10
FIRST_BACKOFF, TOP_BACKOFF = 60, 3600


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def healthy() -> Column:
    return F.coalesce(F.col("status_code").between(200, 399), F.lit(False))


def blocking() -> Column:
    return F.coalesce(F.col("status_code").isin(BLOCKING), F.lit(False))


def health_history(checks: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Every check with the site's state after it.

    ``failures``: consecutive failures; ``backoff_s``: current backoff or NULL;
    ``avg_ms``: average of the last 100 response times; ``recent_blocks``: blocking
    statuses among the last 10.  A healthy check clears the backoff; a blocking or
    raising one starts or doubles it; other failures only count.
    """
    placed = positions(checks, ["site"], [F.col("ts"), F.col("seq")], F.date_trunc("hour", "ts"))
    applied = (blocking() | F.col("status_code").isNull()).cast("long")
    counted = running(placed, ["site"], "idx", {"_applied": (applied, "sum")}, chunk)
    since = running(counted, ["site"], "idx", {
        "_last_ok": (F.when(healthy(), F.col("idx")), "max"),
        "_applied_ok": (F.when(healthy(), F.col("_applied")), "max")}, chunk)
    step = F.col("_applied") - F.coalesce("_applied_ok", F.lit(0))
    state = since.select(
        *checks.columns, "idx", healthy().alias("is_healthy"),
        (F.col("idx") - F.coalesce("_last_ok", F.lit(0))).alias("failures"), backoff_seconds(step).alias("backoff_s"))
    haloed = chunk_window(state, ["site"], "idx", HISTORY - 1, chunk)
    w = Window.partitionBy("site", "chunk").orderBy("idx")
    windowed = haloed.select(
        "*", F.avg("response_time_ms").over(w.rowsBetween(-(HISTORY - 1), 0)).alias("avg_ms"),
        F.sum(blocking().cast("int")).over(w.rowsBetween(-(RECENT - 1), 0)).alias("recent_blocks"))
    return windowed.filter("not halo").drop("chunk", "halo")


def backoff_seconds(applications: Column) -> Column:
    """60 s, doubled per application, at most an hour; NULL without any."""
    return F.when(applications > 0, F.least(F.lit(TOP_BACKOFF), (
        FIRST_BACKOFF * F.pow(F.lit(2), F.least(applications, F.lit(10)) - 1)).cast("int")))


def is_blocked(backoff: Column, failures: Column, recent_blocks: Column) -> Column:
    """In backoff, at least five failures in a row, or three blocks in the last ten."""
    return backoff.isNotNull() | (failures >= 5) | (recent_blocks >= 3)


def backoff_remaining(now: Column, checked: Column, backoff: Column) -> Column:
    """Seconds until the site may be asked again; NULL when not in backoff."""
    end = micros(checked) / F.lit(1e6) + backoff
    return F.when(backoff.isNotNull(), F.greatest(F.lit(0.0), end - micros(now) / F.lit(1e6)))


def site_summary(checks: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Per site: checks, success rate, average of the last 100, current state."""
    history = health_history(checks, chunk)
    return history.groupBy("site").agg(
        F.count("*").alias("total_checks"), F.avg(F.col("is_healthy").cast("int")).alias("success_rate"),
        F.max_by(F.struct("ts", "avg_ms", "failures", "backoff_s", "recent_blocks"), "idx").alias("s")).select(
        "site", "total_checks", "success_rate", F.col("s.ts").alias("last_check"), "s.avg_ms", "s.failures",
        "s.backoff_s", is_blocked(F.col("s.backoff_s"), F.col("s.failures"), F.col("s.recent_blocks")).alias("blocked"))


def adjusted_delay(base: Column, avg_ms: Column, success_rate: Column) -> Column:
    """Request delay by latency and success.  A success rate of exactly 0 adds
    nothing, as in the source."""
    slow = F.when(avg_ms > 3000, 2.0).when(avg_ms > 1000, 1.5).otherwise(1.0)
    weak = F.when(F.coalesce(success_rate, F.lit(0.0)) == 0, 1.0).when(success_rate < 0.5, 2.0) \
        .when(success_rate < 0.8, 1.5).otherwise(1.0)
    return base * slow * weak


def trailing_rate(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Events in the trailing window per second with events.

    Events are counted per second, seconds go to the bucket of a window's length
    they fall in and to the next one, and the range frame runs inside a bucket, so
    there is no global sort and a bucket holds at most two windows of seconds.
    """
    per_second = events.groupBy(F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec")).agg(F.count("*").alias("n"))
    own = F.floor(F.col("sec") / seconds)
    homes = F.array(F.struct(own.alias("bucket"), F.lit(False).alias("halo")),
                    F.struct((own + 1).alias("bucket"), F.lit(True).alias("halo")))
    w = Window.partitionBy("bucket").orderBy("sec").rangeBetween(-seconds, 0)
    return per_second.select("*", F.inline(homes)).select("*", F.sum("n").over(w).alias("window_count")) \
        .filter("not halo").select(
        "sec", F.col("n").alias("events"), "window_count", (F.col("window_count") * 60 / F.lit(float(seconds))).alias("per_minute"))


def transfer_progress(events: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Percent, speed and remaining seconds of a transfer after each event.

    ``events``: transfer, ts, seq, bytes, total_size.  The first event starts the clock.
    """
    placed = positions(events, ["transfer"], [F.col("ts"), F.col("seq")], F.date_trunc("hour", "ts"))
    starts = events.groupBy("transfer").agg(F.min("ts").alias("_start"))
    summed = running(placed, ["transfer"], "idx", {"downloaded": (F.col("bytes"), "sum")}, chunk).join(starts, "transfer")
    elapsed = (micros(F.col("ts")) - micros(F.col("_start"))) / F.lit(1e6)
    speed = F.coalesce(F.try_divide("downloaded", elapsed), F.lit(0.0))
    return summed.select(
        *events.columns, "downloaded",
        F.coalesce(F.try_divide(F.col("downloaded") * 100, F.col("total_size")), F.lit(0.0)).alias("percent"),
        speed.alias("speed"),
        F.coalesce(F.try_divide(F.col("total_size") - F.col("downloaded"), speed), F.lit(0.0)).alias("eta"))
