"""Queries of site health, rates and streams."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.functions.text import split_tags
from tagloom.operators import assets as A, health as H
from tagloom.plans.registry import query
from tagloom.plans.views import VIEWS, cte, table, view
from tagloom.session import shared_dir
from tagloom.streaming import jobs
from tagloom.streaming.ordered_health import ordered_health_stream

CHECKS = cte("checks")
HISTORY = CHECKS + """, i AS (SELECT *, row_number() OVER w AS idx, coalesce(status_code BETWEEN 200 AND 399, false) AS ok, coalesce(status_code IN (403, 429, 503), false) AS blk FROM checks WINDOW w AS (PARTITION BY site ORDER BY ts, seq)),
a AS (SELECT *, sum(CASE WHEN blk OR status_code IS NULL THEN 1 ELSE 0 END) OVER w AS applied, max(CASE WHEN ok THEN idx END) OVER w AS last_ok, avg(response_time_ms) OVER (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS avg_ms,
 sum(blk::INT) OVER (PARTITION BY site ORDER BY ts, seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM i WINDOW w AS (PARTITION BY site ORDER BY ts, seq)),
b AS (SELECT *, applied - coalesce(max(CASE WHEN ok THEN applied END) OVER (PARTITION BY site ORDER BY ts, seq), 0) AS k FROM a),
h AS (SELECT site, ts, seq, idx, ok, idx - coalesce(last_ok, 0) AS failures, CASE WHEN k > 0 THEN least(60 * pow(2, least(k, 10) - 1), 3600)::INT END AS backoff_s, round(avg_ms, 4) AS avg_ms, recent::BIGINT AS recent_blocks FROM b)"""


def checks(spark, sf):
    return view(spark, sf, "checks")


@query("health_history", HISTORY + " SELECT site, seq, failures, backoff_s, avg_ms, recent_blocks FROM h")
def q_history(spark, sf):
    """W6, W7, W8 and W9; chunks far smaller than a site force the carry-over."""
    return H.health_history(checks(spark, sf), chunk=250).select(
        "site", "seq", "failures", "backoff_s", F.round("avg_ms", 4).alias("avg_ms"), "recent_blocks")


@query("site_summary", HISTORY + """, l AS (SELECT site, max(idx) AS n, avg(ok::INT) AS rate FROM h GROUP BY 1) SELECT h.site, l.n AS total_checks, round(rate, 6) AS success_rate, avg_ms, failures, backoff_s, backoff_s IS NOT NULL OR failures >= 5 OR recent_blocks >= 3 AS blocked FROM h JOIN l ON l.site = h.site AND h.idx = l.n""")
def q_summary(spark, sf):
    """A34 and T2."""
    return H.site_summary(checks(spark, sf)).select("site", "total_checks", F.round("success_rate", 6).alias("success_rate"), F.round("avg_ms", 4).alias("avg_ms"), "failures", "backoff_s", "blocked")


@query("access_gate", HISTORY + " SELECT site, seq, CASE WHEN backoff_s IS NOT NULL THEN greatest(backoff_s - 90, 0)::DOUBLE END AS remaining FROM h")
def q_gate(spark, sf):
    """Seconds left when asked 90 seconds after the check."""
    h = H.health_history(checks(spark, sf))
    now = F.col("ts") + F.expr("INTERVAL 90 SECONDS")
    return h.select("site", "seq", F.round(H.backoff_remaining(now, F.col("ts"), F.col("backoff_s")), 3).alias("remaining"))


@query("request_delay", "SELECT event_id, 2.0 * CASE WHEN value * 100 > 3000 THEN 2 WHEN value * 100 > 1000 THEN 1.5 ELSE 1 END * CASE WHEN user_id % 10 = 0 THEN 1 WHEN user_id % 10 < 5 THEN 2 WHEN user_id % 10 < 8 THEN 1.5 ELSE 1 END AS delay FROM events")
def q_delay(spark, sf):
    """F61."""
    return table(spark, sf, "events").select("event_id", H.adjusted_delay(F.lit(2.0), F.col("value") * 100, (F.col("user_id") % 10) / 10).alias("delay"))


@query("trailing_rate", "WITH s AS (SELECT epoch(ts)::BIGINT AS sec, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1) SELECT a.sec, a.n AS events, sum(b.n)::BIGINT AS window_count FROM s a JOIN s b ON b.sec BETWEEN a.sec - 600 AND a.sec GROUP BY ALL")
def q_rate(spark, sf):
    """W15 with a window of ten minutes."""
    return H.trailing_rate(table(spark, sf, "events"), 600).select("sec", "events", "window_count")


@query("transfer_progress", cte("transfers") + """, r AS (SELECT *, sum(bytes) OVER w AS d, min(ts) OVER (PARTITION BY transfer) AS t0 FROM transfers WINDOW w AS (PARTITION BY transfer ORDER BY ts, seq)), e AS (SELECT *, epoch_us(ts) - epoch_us(t0) AS us FROM r)
SELECT seq, d::BIGINT AS downloaded, round(CASE WHEN total_size = 0 THEN 0 ELSE d * 100 / total_size END, 4) AS percent, round(CASE WHEN us = 0 THEN 0 ELSE d / (us / 1e6) END, 4) AS speed FROM e""")
def q_progress(spark, sf):
    """T3b."""
    return H.transfer_progress(view(spark, sf, "transfers"), chunk=50).select("seq", "downloaded", F.round("percent", 4).alias("percent"), F.round("speed", 4).alias("speed"))


@query("kpi_status", CHECKS + ", r AS (SELECT site, avg(coalesce(status_code BETWEEN 200 AND 399, false)::INT) AS s FROM checks GROUP BY 1) SELECT site, round(s, 6) AS success_rate, CASE WHEN s > 0.8 AND 1 - s < 0.2 THEN 'met' ELSE 'missed' END AS status FROM r")
def q_kpi(spark, sf):
    """G4."""
    return A.kpi_status(checks(spark, sf).select("site", H.healthy().alias("ok")), 0.8, 0.2).select("site", F.round("success_rate", 6).alias("success_rate"), "status")


def _event_stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drained(spark, stream):
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    return jobs.run_once(stream, f"{root}/out", f"{root}/state")


@query("health_stream", HISTORY + " SELECT site, seq, failures, backoff_s, avg_ms, recent_blocks FROM h")
def q_health_stream(spark, sf):
    """The stream gives what the batch gives."""
    _, columns = VIEWS["checks"]
    stream = _event_stream(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in columns], "'check' AS kind")
    return _drained(spark, jobs.health_stream(stream)).select("site", "seq", "failures", "backoff_s", F.round("avg_ms", 4).alias("avg_ms"), "recent_blocks")


@query("ordered_health", HISTORY + " SELECT site, seq, failures, backoff_s, avg_ms, recent_blocks FROM h WHERE epoch_ms(ts) // 21600000 * 21600000 + 21600000 <= (SELECT max(epoch_ms(ts)) FROM h) - 3600000")
def q_ordered_health(spark, sf):
    """T1 and X3 from checks in any order: those of every six hours that the watermark, one hour behind, has passed."""
    _, columns = VIEWS["checks"]
    stream = _event_stream(spark, sf).selectExpr(*[f"{e} AS {c}" for c, e in columns], "'check' AS kind")
    return _drained(spark, ordered_health_stream(stream, slot_seconds=21600)).select("site", "seq", "failures", "backoff_s", F.round("avg_ms", 4).alias("avg_ms"), "recent_blocks")


WINDOWS = "WITH w AS (SELECT epoch(ts) AS e FROM events), s AS (SELECT unnest(range(0, 3)) AS k), x AS (SELECT (floor(e / 10) * 10 - k * 10)::BIGINT AS start FROM w, s WHERE e >= floor(e / 10) * 10 - k * 10 AND e < floor(e / 10) * 10 - k * 10 + 30) SELECT start, count(*) AS n FROM x GROUP BY 1"


@query("rate_windows", WINDOWS)
def q_windows(spark, sf):
    """Sliding windows, batch form."""
    return table(spark, sf, "events").groupBy(F.window("ts", "30 seconds", "10 seconds")).agg(F.count("*").alias("n")) \
        .select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("rate_stream", f"SELECT * FROM ({WINDOWS}) WHERE (start + 30) * 1000 <= (SELECT max(epoch_ms(ts)) FROM events) - 600000")
def q_rate_stream(spark, sf):
    """Windows closed by the watermark (the last ten minutes stay open)."""
    return _drained(spark, jobs.rate_stream(_event_stream(spark, sf))).select(F.unix_seconds("start").alias("start"), "n")


def _rounds(n: int) -> str:
    """The rounds as SQL, one after the other; a round without work repeats the last."""
    sql = cte("audit") + """, s0 AS (SELECT handle, final_tags AS tags, needs_manual_review AS flag, coalesce(ai_confidence, 0.0) AS sure FROM audit),
offered AS (SELECT handle, final_tags AS tags, coalesce(ai_review_confidence, 0.1) AS sure FROM audit)"""
    for k in range(1, n + 1):
        sql += f""", r{k} AS (SELECT avg((len(tags) > 0 AND NOT flag)::INT) AS rate FROM s{k - 1}), s{k} AS (SELECT s.handle,
 CASE WHEN b THEN o.tags ELSE s.tags END AS tags, s.flag AND NOT b AS flag, CASE WHEN b THEN o.sure ELSE s.sure END AS sure
 FROM (SELECT s.*, s.flag AND o.sure > s.sure AND (SELECT rate < 0.99 FROM r{k}) AS b FROM s{k - 1} s JOIN offered o USING (handle)) s JOIN offered o USING (handle))"""
    return sql + f" SELECT flag AS needs_manual_review, count(*) AS products FROM s{n} GROUP BY 1"


@query("improvement_loop", _rounds(3))
def q_improve(spark, sf):
    """Flagged rows take surer answers, round by round."""
    from tagloom.operators.improve import improve
    rows = view(spark, sf, "audit")
    base = rows.select("handle", F.col("final_tags").alias("tags"), "needs_manual_review", F.coalesce("ai_confidence", F.lit(0.0)).alias("ai_confidence"))
    answers = rows.select("handle", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("round"), F.col("final_tags").alias("tags"),
                          F.coalesce("ai_review_confidence", F.lit(0.1)).alias("confidence"), F.lit(False).alias("needs_manual_review"))
    return improve(base, answers, 0.99, 3).groupBy("needs_manual_review").agg(F.count("*").alias("products"))


@query("tag_use_stream", cte("audit") + ", t AS (SELECT unnest(final_tags) AS tag, processed_at FROM audit) SELECT tag, count(*) AS frequency, min(processed_at) AS first_used, max(processed_at) AS last_used FROM t GROUP BY tag")
def q_tag_use_stream(spark, sf):
    """T5 and A2: uses per tag kept by a stream, read back from its appended changes."""
    _, columns = VIEWS["audit"]
    parts = dict(columns)
    orders = spark.readStream.schema(table(spark, sf, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    rows = orders.select(F.expr(parts["processed_at"]).alias("processed_at"), split_tags(F.expr(parts["final_tags_list"])).alias("final_tags"))
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    jobs.upsert(jobs.tag_use_stream(rows), f"{root}/out", f"{root}/state")
    return jobs.read_upserts(spark, f"{root}/out", ["tag"])


@query("new_handles_stream", cte("variants") + " SELECT handle, min(variant_sku) AS variant_sku, 'seen' AS tags FROM variants GROUP BY handle")
def q_new_handles(spark, sf):
    """T4: one row of each handle that no batch had before."""
    parts = dict(VIEWS["variants"][1])
    lines = spark.readStream.schema(table(spark, sf, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    rows = lines.selectExpr(f"{parts['handle']} AS handle", f"{parts['variant_sku']} AS variant_sku")
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    jobs.tag_new(rows, lambda df: df.withColumn("tags", F.lit("seen")), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out").drop("epoch")
