"""First-row, top-k and running-position operators that hold up under skew.

``first_rows`` and ``top_rows`` rely on Spark's window group limit: the planner
trims every map task to the best *k* rows per key before the shuffle, so a hot
key costs k rows per task, not its whole group.  Operators that need positions
inside an arbitrarily large group (running windows, exact quotas, lists) go
through ``positions``: the group is cut into buckets along its order, bucket
sizes are summed up, and rows are numbered inside buckets only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_rows(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order`` (which must be total)."""
    return top_rows(df, keys, 1, *order).drop("rank")


def top_rows(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per key, with their ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= n)


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
              name: str = "idx") -> DataFrame:
    """Exact 1-based position of each row inside its key group.

    ``bucket`` must not decrease along ``order`` (a coarser form of it), so
    positions are bucket offset plus position inside the bucket.  The only
    sorts are per (key, bucket); offsets come from one small row per bucket.
    """
    cut = df.select("*", bucket.alias("_bucket"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
               .select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    numbered = cut.select("*", F.row_number().over(inside).cast("bigint").alias("_pos"))
    return (numbered.join(offsets, [*keys, "_bucket"])
            .select(*df.columns, (F.col("_before") + F.col("_pos")).alias(name)))


def chunk_window(df: DataFrame, keys: list[str], idx: str, lookback: int,
                 chunk: int = 100_000) -> DataFrame:
    """Rows tagged with a chunk number such that a window over (keys, ``chunk``)
    ordered by ``idx`` sees the last ``lookback`` rows of the chunk before.

    The carried-over rows have ``halo`` true; drop them after the window.
    """
    if lookback >= chunk:
        raise ValueError("lookback must be smaller than a chunk")
    own = F.floor((F.col(idx) - 1) / chunk)
    near_end = (F.col(idx) - 1) % chunk >= chunk - lookback
    homes = F.when(near_end, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")),
                                     F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")))) \
        .otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))
    return df.select("*", F.inline(homes))


def running(df: DataFrame, keys: list[str], idx: str, specs: dict[str, tuple[Column, str]],
            chunk: int = 100_000) -> DataFrame:
    """Running ``sum`` or ``max`` per key along ``idx`` (positions from 1).

    Chunks are totalled, the totals are carried forward, and only rows of one
    chunk are sorted together, so a key may hold any share of the data.
    """
    how = {"sum": F.sum, "max": F.max}
    cut = df.select("*", F.floor((F.col(idx) - 1) / chunk).alias("_chunk"),
                    *[value.alias(f"_v_{name}") for name, (value, _) in specs.items()])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_chunk").agg(
        *[how[kind](f"_v_{name}").alias(f"_t_{name}") for name, (_, kind) in specs.items()])
    carried = totals.select(*keys, "_chunk", *[how[kind](f"_t_{name}").over(before).alias(f"_c_{name}")
                                               for name, (_, kind) in specs.items()])
    local = cut.select("*", *[how[kind](f"_v_{name}").over(inside).alias(f"_r_{name}")
                              for name, (_, kind) in specs.items()])
    both = local.join(carried, [*keys, "_chunk"])

    def merged(name: str, kind: str) -> Column:
        here, carry = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        if kind == "max":
            return F.greatest(here, carry)
        return F.coalesce(here + carry, here, carry)

    return both.select(*df.columns, *[merged(n, k).alias(n) for n, (_, k) in specs.items()])


def bounded_lists(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                  element: Column, name: str, limit: int = 10_000) -> DataFrame:
    """Ordered arrays per key, split into parts of at most ``limit`` elements.

    A group within the limit is one row with ``part`` 0; larger groups continue
    in parts 1, 2, … so no task ever holds an unbounded group.
    """
    kept = df.select(*keys, *[o.alias(f"_o{i}") for i, o in enumerate(order)],
                     bucket.alias("_b"), element.alias("_e"))
    placed = positions(kept, keys, [F.col(f"_o{i}") for i in range(len(order))], F.col("_b"))
    part = F.floor((F.col("idx") - 1) / limit).alias("part")
    listed = placed.groupBy(*keys, part).agg(
        F.array_sort(F.collect_list(F.struct("idx", "_e"))).alias("_list"))
    return listed.select(*keys, "part", F.transform("_list", lambda x: x["_e"]).alias(name))


def hash_bucket(key: Column, salt: str, buckets: int = 1024) -> Column:
    """Leading bits of a row's hash rank; monotone along :func:`hash_rank`."""
    return F.floor(hash_rank(key, salt) / (2 ** 60 // buckets))


def hash_rank(key: Column, salt: str) -> Column:
    """Deterministic, partition-independent rank in [0, 2^60) from an md5."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 15), 16, 10).cast("bigint")
