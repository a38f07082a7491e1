"""Health from shuffled micro-batches equals the batch form."""
import datetime as dt
import random

from pyspark.sql import functions as F

from tagloom.operators import health as H
from tagloom.streaming import jobs
from tagloom.streaming.ordered_health import ordered_health_stream

CHECKS = "site string, ts timestamp, seq long, response_time_ms double, status_code int"
T0 = dt.datetime(2024, 1, 1)


def test_shuffled_micro_batches_equal_the_batch(spark, tmp_path):
    codes = [200, 503, 429, None, 404, 503, 200, 403, 503, 503, None, 503, 503, 503, 503, 200, 404]
    rows = [("a" if i % 3 else "hot", T0 + dt.timedelta(seconds=90 * (i // 2)), i, None if i % 29 == 0 else float(10 * i), codes[i % len(codes)]) for i in range(600)]
    last = [(site, T0 + dt.timedelta(days=2), 1000, 1.0, 200) for site in ("a", "hot")]
    rng = random.Random(3)
    shuffled = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 3000)))  # no event is passed by a later one by over 50 minutes
    for n in range(6):
        part = spark.createDataFrame(shuffled[n * 100:(n + 1) * 100] if n < 6 else last, CHECKS).withColumn("kind", F.lit("check"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(last, CHECKS).withColumn("kind", F.lit("check")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = jobs.run_once(ordered_health_stream(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = H.health_history(spark.createDataFrame(rows, CHECKS)).collect()
    seen = lambda found: sorted((r.site, r.seq, r.failures, r.backoff_s, None if r.avg_ms is None else round(r.avg_ms, 6), r.recent_blocks) for r in found)
    assert len(got) == 600 and seen(got) == seen(want)
    assert {r.seq: r.ts for r in got} == {r[2]: r[1] for r in rows}
