"""Audit store: runs and tagged products as Parquet, without updates.

Runs are an event log (started, completed); a run's state is its latest event,
and the latest run is the one completed last.  Products are partitioned by run,
so reading a run prunes to its folder.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class AuditStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _runs(self) -> str:
        return f"{self.root}/runs"

    @property
    def _products(self) -> str:
        return f"{self.root}/products"

    def _event(self, run_id: str, event: str, config: dict[str, str] | None) -> None:
        row = self.spark.createDataFrame([(run_id, event, config)], "run_id string, event string, config map<string,string>")
        row.select("*", F.current_timestamp().alias("happened_at")).coalesce(1).write.mode("append").parquet(self._runs)

    def start_run(self, run_id: str, config: dict[str, str] | None = None) -> None:
        self._event(run_id, "started", config)

    def complete_run(self, run_id: str) -> None:
        self._event(run_id, "completed", None)

    def append(self, run_id: str, products: DataFrame) -> None:
        """Products of a run; rows of one run go to one folder whatever their number."""
        products.select("*", F.lit(run_id).alias("run_id")).write.mode("append").partitionBy("run_id").parquet(self._products)

    def append_runs(self, products: DataFrame) -> None:
        """Products of many runs, which their ``run_id`` names."""
        products.write.mode("append").partitionBy("run_id").parquet(self._products)

    def runs(self) -> DataFrame:
        return run_states(self.spark.read.parquet(self._runs))

    def products(self, run_id: str | None = None, all_runs: bool = False) -> DataFrame:
        """Products of a run, of the latest run, or of all; all if none completed."""
        every = self.spark.read.option("mergeSchema", True).parquet(self._products) \
            .withColumn("run_id", F.col("run_id").cast("string"))
        if run_id is not None:
            return every.filter(F.col("run_id") == run_id)
        return every if all_runs else latest_products(every, self.runs())

    def clear(self) -> None:
        """Empty the store, keeping its schema."""
        for path in (self._products, self._runs):
            schema = self.spark.read.parquet(path).schema
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def run_states(events: DataFrame) -> DataFrame:
    """One row per run: start, completion and state."""
    return events.groupBy("run_id").agg(
        F.min(F.when(F.col("event") == "started", F.col("happened_at"))).alias("started_at"),
        F.max(F.when(F.col("event") == "completed", F.col("happened_at"))).alias("completed_at"),
        F.first("config", ignorenulls=True).alias("config")) \
        .withColumn("status", F.when(F.col("completed_at").isNotNull(), "completed").otherwise("running"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run completed last, as one row (``run_id`` NULL if none)."""
    return runs.agg(F.max_by("run_id", F.when(F.col("completed_at").isNotNull(), F.struct("completed_at", "run_id"))).alias("run_id"))


def latest_products(products: DataFrame, runs: DataFrame) -> DataFrame:
    """Products of the latest run; all of them when no run completed.

    The latest run is a scalar subquery, so it prunes partitions at run time.
    """
    latest = latest_run(runs).scalar()
    return products.filter((F.col("run_id") == latest) | latest.isNull())
