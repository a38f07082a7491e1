"""Site health from checks in any order: events wait in state until the watermark has passed them.

A site's waiting events lie in a map by time slot, each slot with an event-time timer.  When the watermark
passes a slot, its events are applied in order of ``ts`` and ``seq`` and go; so micro-batches may come shuffled
within the delay, no list is longer than a site's slot (``slot_seconds``), and the state that stays is the last 100 times, the
last 10 statuses and a few numbers.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tagloom.operators.health import BLOCKING
from tagloom.streaming.jobs import PROVIDER, _apply, _start

OUT = "site string, seq long, ts timestamp, failures long, backoff_s int, avg_ms double, recent_blocks long, total_checks long"
STATE = "times array<double>, codes array<int>, failures long, backoff int, until double, total long"
WAITING = "us array<long>, seq array<long>, ms array<double>, code array<int>, kind array<string>"


def _plain(value, kind):
    return None if pd.isna(value) else kind(value)


class OrderedHealth(StatefulProcessor):
    def __init__(self, slot_ms: int) -> None:
        self.slot_ms = slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.body = handle.getValueState("health", STATE)
        self.waiting = handle.getMapState("waiting", "slot long", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame.assign(slot=frame["us"] // (1000 * self.slot_ms))
            for slot, part in frame.groupby("slot"):
                new = [part["us"].tolist(), part["seq"].tolist(), [_plain(v, float) for v in part["response_time_ms"]],
                       [_plain(v, int) for v in part["status_code"]], part["kind"].tolist()]
                at = (int(slot),)
                if self.waiting.containsKey(at):
                    new = [list(old) + more for old, more in zip(self.waiting.getValue(at), new)]
                else:
                    self.handle.registerTimer((int(slot) + 1) * self.slot_ms)
                self.waiting.updateValue(at, tuple(new))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slot = (expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1,)
        state = _start()
        if self.body.exists():
            state |= dict(zip(("times", "codes", "failures", "backoff", "until", "total"), self.body.get()))
            state["times"], state["codes"] = list(state["times"]), list(state["codes"])
        out = []
        for us, seq, ms, code, kind in sorted(zip(*self.waiting.getValue(slot)), key=lambda e: e[:2]):
            _apply(state, kind, us / 1e6, ms, code)
            if kind != "access":
                times = [t for t in state["times"] if t is not None]
                out.append((key[0], seq, pd.Timestamp(us, unit="us"), state["failures"], state["backoff"], sum(times) / len(times) if times else None,
                            sum(c in BLOCKING for c in state["codes"]), state["total"]))
        self.waiting.removeKey(slot)
        self.body.update((state["times"], state["codes"], state["failures"], state["backoff"], state["until"], state["total"]))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(",")])
        frame["backoff_s"] = frame["backoff_s"].astype("Int32")
        yield frame

    def close(self) -> None:
        pass


def ordered_health_stream(checks: DataFrame, delay: str = "1 hour", slot_seconds: int = 900) -> DataFrame:
    """The site's state after each check, as ``health_history`` has it, from checks that come in any order within ``delay``.

    ``checks`` has the batch columns plus ``kind`` (``check`` or ``access``).  A check is answered once the latest
    ``ts`` seen is ``delay`` and the rest of its slot later; one that comes later than ``delay`` is dropped by the watermark, as it could only change
    what was answered.  Short slots answer sooner; each costs a few calls to the state store.  Needs the RocksDB state store, which is set for the session.
    """
    checks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = checks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    rows = timed.select("site", "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), F.col("response_time_ms").cast("double").alias("response_time_ms"),
                        F.col("status_code").cast("int").alias("status_code"), "kind")
    return rows.groupBy("site").transformWithStateInPandas(statefulProcessor=OrderedHealth(1000 * slot_seconds), outputStructType=OUT, outputMode="append", timeMode="EventTime")
