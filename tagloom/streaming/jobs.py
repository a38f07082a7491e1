"""Structured Streaming forms of the stateful operators."""
from __future__ import annotations

import datetime as dt
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tagloom.operators.health import BLOCKING, FIRST_BACKOFF, HISTORY, RECENT, TOP_BACKOFF

HEALTH_OUT = """site string, seq long, ts timestamp, failures long, backoff_s int, avg_ms double,
                recent_blocks long, total_checks long, late long"""
HEALTH_STATE = "body string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _start() -> dict:
    return {"times": [], "codes": [], "failures": 0, "backoff": None, "until": None,
            "total": 0, "late": 0, "last": None}


def _apply(state: dict, kind: str, ts: float, ms: float | None, code: int | None) -> None:
    """One event on a site's state.  An ``access`` clears an expired backoff."""
    if kind == "access":
        if state["until"] is not None and ts >= state["until"]:
            state["backoff"] = state["until"] = None
        return
    ok = code is not None and 200 <= code < 400
    state["times"] = (state["times"] + [ms])[-HISTORY:]
    state["codes"] = (state["codes"] + [code])[-RECENT:]
    state["total"] += 1
    state["failures"] = 0 if ok else state["failures"] + 1
    if ok:
        state["backoff"] = state["until"] = None
    elif code is None or code in BLOCKING:
        last = state["backoff"]
        state["backoff"] = FIRST_BACKOFF if last is None else min(last * 2, TOP_BACKOFF)
        state["until"] = ts + state["backoff"]


def _site_health(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    body = json.loads(state.get[0]) if state.exists else _start()
    frames = list(batches)  # one site's share of one micro-batch
    events = pd.concat(frames).sort_values(["ts", "seq"])
    out = []
    for row in events.itertuples(index=False):
        at = [row.ts.timestamp(), int(row.seq)]
        if body["last"] is not None and at <= body["last"]:
            body["late"] += 1
            continue
        body["last"] = at
        ms = None if pd.isna(row.response_time_ms) else float(row.response_time_ms)
        code = None if pd.isna(row.status_code) else int(row.status_code)
        _apply(body, row.kind, at[0], ms, code)
        if row.kind == "access":
            continue
        times = [t for t in body["times"] if t is not None]
        out.append((key[0], int(row.seq), row.ts, body["failures"], body["backoff"],
                    sum(times) / len(times) if times else None,
                    sum(c in BLOCKING for c in body["codes"]), body["total"], body["late"]))
    state.update((json.dumps(body),))
    names = [c.split()[0] for c in HEALTH_OUT.split(",")]
    frame = pd.DataFrame(out, columns=names)
    frame["backoff_s"] = frame["backoff_s"].astype("Int32")
    yield frame


def health_stream(checks: DataFrame) -> DataFrame:
    """Streaming twin of ``health_history``: the site's state after each check.

    ``checks`` has the batch columns plus ``kind`` (``check`` or ``access``).  Events
    are applied in order of ``ts`` and ``seq`` inside a micro-batch; an event not
    later than the last applied one is dropped and counted.  The state per site is
    the last 100 times and a few counters.
    """
    return checks.groupBy("site").applyInPandasWithState(
        _site_health, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.NoTimeout)


def rate_stream(events: DataFrame, window: str = "30 seconds", slide: str = "10 seconds",
                late: str = "10 minutes") -> DataFrame:
    """Events per sliding window, closed by the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window, slide)).agg(F.count("*").alias("n")) \
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain a stream into Parquet and read the result back."""
    query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def append_cache_batch(path: str):
    """``foreachBatch`` function: append a batch of cache rows as its epoch, in no more files than the batch has
    tasks; a repeated epoch overwrites itself."""
    def append(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return append


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The latest row per content hash over all epochs; of equal times, the later epoch's."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in ("content_hash", "epoch")]
    return rows.groupBy("content_hash").agg(F.max_by(F.struct(*others), F.struct("cached_at", "epoch")).alias("r")).select("content_hash", "r.*")


def compact_cache(spark: SparkSession, path: str, target: str) -> None:
    """The latest rows as one epoch of another folder, for readers to move to; ``path`` is left alone."""
    append_cache_batch(target)(read_cache(spark, path), 0)


def tag_use_stream(products: DataFrame, tags: str = "final_tags", ts: str = "processed_at") -> DataFrame:
    """Uses per tag with first and last use, kept up to date: run it in update mode, where a batch gives the tags it
    changed.  The state is one row per tag."""
    return products.select(F.explode(tags).alias("tag"), F.col(ts).alias("ts")).groupBy("tag").agg(
        F.count("*").alias("frequency"), F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))


def upsert(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Drain a stream in update mode: each batch's changed rows are appended as its epoch."""
    query = (changes.writeStream.foreachBatch(append_cache_batch(out)).option("checkpointLocation", checkpoint)
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()


def read_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of each key's last epoch."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("r")).select(*keys, "r.*")


_ROW = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}  # to the microsecond; doubles and decimals keep their digits


PAGES = 32  # a bucket's handles are kept in so many pages


class FirstSeen(StatefulProcessor):
    """Gives each handle's least row in the batch that first has it.

    A call to the state store costs about a millisecond, so handles are kept in pages by hash, and a batch reads and
    writes each page it meets once.  With expiry, which goes by entry, what stays is one flag a handle.
    """

    def __init__(self, forget_ms: int | None) -> None:
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.forget_ms is None:
            self.pages = handle.getMapState("pages", "page int", "handles array<string>")
        else:
            self.seen = handle.getMapState("seen", "handle string", "seen boolean", self.forget_ms)

    def _unseen(self, names: list[str]) -> list[str]:
        """The names that were not seen before, which are seen from now on."""
        if self.forget_ms is not None:
            new = [name for name in names if not self.seen.containsKey((name,))]
            for name in new:
                self.seen.updateValue((name,), (True,))
            return new
        by_page: dict[int, list[str]] = {}
        for name in names:
            by_page.setdefault(zlib.crc32(name.encode("utf-8", "surrogatepass")) % PAGES, []).append(name)
        new = []
        for page, there in by_page.items():
            value = self.pages.getValue((page,))
            before = list(value[0]) if value is not None else []
            known = set(before)
            fresh = [name for name in there if name not in known]
            if fresh:
                self.pages.updateValue((page,), (before + fresh,))
                new += fresh
        return new

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        least: dict[str, str] = {}
        for frame in rows:
            for name, body in frame.groupby("handle")["body"].min().items():
                least[name] = min(body, least.get(name, body))
        new = self._unseen(list(least))
        yield pd.DataFrame({"handle": new, "body": [least[name] for name in new]}, dtype=object)

    def close(self) -> None:
        pass


def new_handles(products: DataFrame, forget_after: dt.timedelta | None = None, buckets: int = 256) -> DataFrame:
    """One row for each handle that no batch had before (not for ``forget_after``, if given), in append mode.

    Old output is not read: handles are kept in the state store, by pages, of which a batch reads those its own
    handles fall into, and a repeated epoch starts from the same state and gives the same rows.  Of several rows of a handle in
    its first batch the least, as JSON text, is taken; rows without a handle are left out.  Handles go by hash to
    ``buckets``, which stay the same as long as the checkpoint is used; a task holds one row for each handle that a
    batch has in a bucket, so take more for large batches.  Needs the RocksDB state store, which is set for the session.
    With ``forget_after`` the engine looks for expired state again and again, so such a stream suits a query that
    runs on, not one that drains.
    """
    products.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    others = products.drop("handle")
    rows = products.filter("handle is not null").select(
        F.pmod(F.xxhash64("handle"), F.lit(buckets)).cast("int").alias("bucket"), "handle",
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in others.columns]), _ROW).alias("body"))
    first = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=FirstSeen(None if forget_after is None else int(forget_after.total_seconds() * 1000)),
        outputStructType="handle string, body string", outputMode="append",
        timeMode="None" if forget_after is None else "ProcessingTime")
    return first.select("handle", F.from_json("body", others.schema, _ROW).alias("r")).select("handle", "r.*")


def tagged_by_epoch(done_path: str, tag):
    """``foreachBatch`` function: tag a batch and write it as its epoch; a repeated epoch overwrites its own folder."""
    def process(batch: DataFrame, epoch: int) -> None:
        tag(batch).write.mode("overwrite").parquet(f"{done_path}/epoch={epoch}")
    return process


def tag_new(products: DataFrame, tag, done_path: str, checkpoint: str) -> None:
    """Drain a stream of products: tag the handles never processed and append the rows by epoch."""
    query = (new_handles(products).writeStream.foreachBatch(tagged_by_epoch(done_path, tag)).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
