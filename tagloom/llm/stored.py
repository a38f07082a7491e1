"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.session import shared_dir


def stored(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written as a table there and read again: no lineage, and any column can be read alone; with columns ``by``,
    rows with equal values of them lie in a folder of their own."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that more than one in so many rows have are few by arithmetic, whatever the data: their rows may be broadcast.
HEAVY = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``left`` joined (``how``: left or inner) to ``right``, which has one row for each value of ``key`` and, as ``count``, how many
    rows of ``left`` have it; ``count`` stays out.  The rows of a heavy key, of which there are ``HEAVY`` at most, meet
    their one partner by broadcast wherever they are; only the others are dealt by key.  Both are read twice, so
    both should be stored."""
    limit = left.count() / HEAVY
    heavy = F.broadcast(right.filter(F.col(count) > limit).drop(count))
    light = right.filter(F.col(count) <= limit).drop(count)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key, how))


#: Bits of the filter that :func:`likely_in` sends to all tasks, 8 MB at any input; a filter of more rows than bits lets more rows through.
FILTER_BITS, BUCKET_BITS = 1 << 26, 1 << 15


def likely_in(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """The rows of ``left`` whose key ``right`` may have, by a filter of fixed size over hashes: no row of a key that ``right``
    has is lost, and few others stay.  A join that moves what this keeps decides."""
    def bit(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))

    def part(key: Column) -> Column:
        return F.shiftright(bit(key), BUCKET_BITS.bit_length() - 1).cast("int")

    bits = (right.select(part(right_key).alias("filter_part"), bit(right_key).bitwiseAND(BUCKET_BITS - 1).alias("at"))
            .groupBy("filter_part").agg(F.bitmap_construct_agg("at").alias("filter_bits")))  # 2048 rows of 4 kB at most
    at = bit(left_key).bitwiseAND(BUCKET_BITS - 1)
    byte = F.conv(F.hex(F.substring("filter_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    with_bits = left.join(F.broadcast(bits), part(left_key) == F.col("filter_part"))
    return with_bits.filter(byte.cast("long").bitwiseAND(F.pow(F.lit(2), at.bitwiseAND(7)).cast("long")) != 0).drop("filter_part", "filter_bits")
