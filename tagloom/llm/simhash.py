"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint is the majority, bit by bit, of the XXH64 hashes of its word shingles.  For a radius r
every bit position gets a vector of r + 1 bits, and each of the 2**(r + 1) - 1 vectors v but zero gets a table,
whose mask keeps the positions whose vector has an odd product with v.  The vectors at the r or fewer
positions where two fingerprints differ span r dimensions at most, so some v is orthogonal to all of them:
its mask touches no differing bit, and the pair collides in its table.  No link within the radius is lost,
and none needs luck.

Copies are folded to distinct fingerprints before.  Buckets of two give their pair from the aggregate alone;
others are dealt in blocks, each pair of blocks once and to any task, and a task gives the spanning links it
finds, never lists of pairs.  So memory and rows stay small; a bucket of m distinct fingerprints still costs m**2 / 2
comparisons of one integer each, spread over m**2 / BLOCK**2 tiles.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.jaccard_join import components, groups, roots
from tagloom.llm.stored import join_counted, stored
from tagloom.llm.words import chunks

BITS, SEED = 64, 42
BLOCK = 2048
_STEP = 1 << 16  # shingles hashed together, so that a long text needs no more memory than a short one
_LANES = np.uint64(0x0101010101010101)


def masks(radius: int) -> list[int]:
    """The covering masks of ``radius``, as signed 64-bit integers.  Positions take the vectors in turn, so that
    each mask keeps half the bits."""
    size = 1 << (radius + 1)
    vector = [i % (size - 1) + 1 for i in range(BITS)]
    found = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() % 2)
        found.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return found


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: eight counters of a byte stand in one integer, for 255 hashes at most."""
    total = np.zeros(BITS, np.int64)
    if not len(hashes):
        return total
    begin = np.arange(0, len(hashes), 255)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, begin)
        total[k::8] = sums.view(np.uint8).reshape(-1, 8).sum(0)  # little-endian: byte b holds bit 8 b + k
    return total


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint of one text; zero where it has no word."""
    found = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for low in range(0, n, _STEP):
        part = found[low:low + _STEP + words - 1]
        joined = b" ".join(part)
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1, out=at[1:])
        many = min(words, len(part))
        one = xxhash.xxh64_intdigest
        counts += bit_counts(np.array([one(joined[a:b], SEED) for a, b in zip(at[:len(at) - many].tolist(), (at[many:] - 1).tolist())], np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f`` of every row, the fingerprint as a signed 64-bit integer.  A null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "text"):
                whole, at = data.tobytes(), offsets.tolist()
                found = np.array([fingerprint(whole[a:b], words) for a, b in zip(at, at[1:])], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found.view(np.int64))], ["id", "f"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(find, f"id {kind}, f long")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tile_links(tiles: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links that span what is near in each tile, of rows ``bucket, table, one, other, block, f``.  A tile of one
    block compares it with itself, one of two blocks the first with the second."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, ["bucket", "table", "one", "other"]):
            keys = np.stack([batch.column(k).to_numpy() for k in ("bucket", "table", "one", "other")])
            block, f = batch.column("block").to_numpy(), batch.column("f").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            left, right = [], []
            for low, high in zip(begin, [*begin[1:], len(f)]):
                here = f[low:high]
                cut = int((block[low:high] == keys[2, low]).sum())
                within = keys[2, low] == keys[3, low]
                first, second = (here, here) if within else (here[:cut], here[cut:])
                i, j = near_pairs(first.view(np.uint64), second.view(np.uint64), radius)
                j = j if within else j + cut
                root = roots(high - low, i, j)
                on = np.flatnonzero(root != np.arange(high - low))
                left.append(here[on])
                right.append(here[root[on]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return tiles.mapInArrow(compare, "a long, b long")


def near_pairs(first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs with ``radius`` or fewer differing bits, some hundred rows at a time."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 19) // max(1, len(second)))
    for low in range(0, len(first), step):
        i, j = np.nonzero(np.bitwise_count(first[low:low + step, None] ^ second[None, :]) <= radius)
        left.append(i + low)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def near_links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect exactly what the pairs of fingerprints ``f`` within ``radius`` connect."""
    tables = F.array(*[F.struct(F.lit(i).cast("long").alias("table"), F.lit(mask).alias("mask")) for i, mask in enumerate(masks(radius))])
    keyed = distinct.select("f", F.inline(tables)).select("f", "table", F.col("f").bitwiseAND(F.col("mask")).alias("bucket"))
    sizes = stored(keyed.groupBy("bucket", "table").agg(F.count("*").alias("c"), F.min("f").alias("a"), F.max("f").alias("b")).filter("c > 1"))
    twos = sizes.filter("c = 2").filter(differing(F.col("a"), F.col("b")) <= radius).select("a", "b")
    crowded = sizes.filter("c > 2").select(F.col("bucket").alias("in_bucket"), F.col("table").alias("in_table"), F.ceil(F.col("c") / block).cast("long").alias("blocks"))
    met = (keyed.join(crowded, (F.col("bucket") == F.col("in_bucket")) & (F.col("table") == F.col("in_table")))
           .withColumn("block", F.pmod(F.xxhash64("f", "table"), F.col("blocks")))
           .withColumn("peer", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .select("bucket", "table", F.least("block", "peer").alias("one"), F.greatest("block", "peer").alias("other"), "block", "f"))
    keys = ["bucket", "table", "one", "other"]
    return twos.unionByName(tile_links(met.repartition(*keys).sortWithinPartitions(*keys, "block"), radius)).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every row.

    Words are lower-cased (A-Z) runs of anything but ASCII white space; shingles of ``words`` words are hashed
    with their repeats, a text of fewer words as a whole, and a text without words, or a null one, has the
    fingerprint zero, which links like any other.  Rows link at ``radius`` or fewer differing bits;
    ``component_id`` is the least id that a row reaches, its own included.  Repeated rows and ids keep their
    rows and are each other's copies.  A null id stays null and counts for no component, whose id is null if
    it has no other.  Other columns are not read.
    """
    found = stored(fingerprints(docs, words, id_col, text_col))
    distinct = stored(found.groupBy("f").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    labels = components(near_links(distinct.select("f"), radius))
    named = distinct.join(labels, F.col("f") == F.col("v"), "left").select("f", "rows", "least", F.coalesce("label", "f").alias("label"))
    lowest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = stored(named.join(lowest, "label").select("f", "rows", "component_id"))
    return (join_counted(found, of, "f", "rows")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"))
