"""Near-duplicate media by Hamming distance of 64-bit hashes.

Copies are folded first: all work is on distinct hashes, each with its first
image and its number of copies, so a placeholder copied a million times is one
row.  Up to ``BANDED`` bits apart, candidates come from an equi-join on two bit
bands: a pair has a band with at most half the differing bits, and each side
joins on all values within half that radius of its band, which meets every such
pair.  Farther apart no band is selective, and the answer itself grows with the
square of the hashes; then hashes are dealt in tiles, each pair of tiles meets
once, and a task compares two tiles by popcount, whatever the number of
candidates.  Counts by distance are added up in the tasks and list no pair.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.session import cut

BITS = 64
THRESHOLD = 0.90   # fixed value: least similarity of duplicates
FLOOR = 0.70       # fixed value: least similarity worth reporting
BANDED = 9         # largest distance that bands find
TILE = 8192        # distinct hashes in a tile
BLOCK = 256        # images of one hash that are paired as one row


def sign_hash(vector: Column) -> Column:
    """64-bit hash of the signs of a 64-element vector, first element lowest bit."""
    bits = F.transform(vector, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
                       .otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))


def key_hash(key: Column) -> Column:
    """First 64 bits of a key's sha256 as a signed number."""
    hexed = F.substring(F.sha2(key, 256), 1, 16)
    high = F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(hexed, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / F.lit(float(BITS))


def max_distance(threshold: float) -> int:
    """Largest distance with at least this similarity, by the source's rounding."""
    return int(BITS * (1 - threshold))


def _bands(count: int) -> list[tuple[int, int]]:
    """(offset, width) of ``count`` bands that cover all bits."""
    base, extra = divmod(BITS, count)
    out, at = [], 0
    for i in range(count):
        width = base + (1 if i < extra else 0)
        out.append((at, width))
        at += width
    return out


def _flips(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits in ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def fold_copies(hashes: DataFrame) -> DataFrame:
    """Distinct hashes with their first image and their number of copies."""
    return hashes.groupBy("hash").agg(
        F.min("ord").alias("ord"), F.min_by("image", "ord").alias("image"),
        F.count("*").alias("copies"))


def _band_keys(number: int, at: int, width: int, radius: int) -> Column:
    value = F.shiftrightunsigned("hash", at).bitwiseAND(F.lit((1 << width) - 1))
    flips = F.from_json(F.lit(str(_flips(width, radius))), "array<bigint>")
    return F.transform(flips, lambda m: F.struct(F.lit(number).alias("band"), value.bitwiseXOR(m).alias("key")))


def _keyed(df: DataFrame, bands: list[tuple[int, int]], radius: int) -> DataFrame:
    keys = [_band_keys(number, at, width, radius) for number, (at, width) in enumerate(bands)]
    return df.select("hash", "ord", F.inline(F.concat(*keys)))


def banded_pairs(folded: DataFrame, within: int) -> DataFrame:
    """Pairs of distinct hashes within a distance: ``ord_1 < ord_2``, ``distance``."""
    layout = _bands(2)
    radius = within // 2
    left = _keyed(folded, layout, (radius + 1) // 2).select(
        "band", "key", F.col("hash").alias("h1"), F.col("ord").alias("ord_1"))
    right = _keyed(folded, layout, radius // 2).select(
        "band", "key", F.col("hash").alias("h2"), F.col("ord").alias("ord_2"))
    apart = F.col("h1").bitwiseXOR(F.col("h2"))
    near = left.join(right, ["band", "key"]).filter(
        (F.col("ord_1") < F.col("ord_2")) & (F.bit_count(apart) <= within))
    if radius == 0:
        # a pair equal in several bands is reported by the first of them only
        first = F
        for number, (at, width) in enumerate(layout):
            zero = F.shiftrightunsigned(apart, at).bitwiseAND(F.lit((1 << width) - 1)) == 0
            first = first.when(zero, F.lit(number))
        return near.filter(F.col("band") == first).select("ord_1", "ord_2", F.bit_count(apart).alias("distance"))
    return near.select("ord_1", "ord_2", F.bit_count(apart).alias("distance")).distinct()


def _tile_pairs(folded: DataFrame, tile: int):
    """Rows grouped by pair of tiles; a tile with itself is one."""
    blocks = max(1, math.ceil(folded.count() / tile))
    own = F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")
    met = folded.select("hash", "ord", "copies", own.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("peer"))
    return met.select("hash", "ord", "copies", F.least("block", "peer").alias("one"), F.greatest("block", "peer").alias("other"),
                      (F.col("block") > F.col("peer")).alias("second")).groupBy("one", "other")


def _near_in(tile: pa.Table, within: int):
    """Hashes near each other in a pair of tiles, some hundred rows at a time: row numbers and distance."""
    code = tile.column("hash").to_numpy().view(np.uint64)
    one, other = tile.column("one")[0].as_py(), tile.column("other")[0].as_py()
    second = tile.column("second").to_numpy()
    left, right = (np.arange(len(code)),) * 2 if one == other else (np.flatnonzero(~second), np.flatnonzero(second))
    step = max(1, (1 << 21) // max(1, len(right)))
    for low in range(0, len(left), step):
        apart = np.bitwise_count(code[left[low:low + step], None] ^ code[None, right])
        i, j = np.nonzero(apart <= within)
        if one == other:
            i, j = i[i + low < j], j[i + low < j]
        yield left[i + low], right[j], apart[i, j]


def tiled_pairs(folded: DataFrame, within: int, tile: int = TILE) -> DataFrame:
    """As :func:`banded_pairs`, at any distance."""
    def compare(rows: pa.Table) -> pa.Table:
        found = [np.concatenate(x) for x in zip(*_near_in(rows, within))] or [np.zeros(0, np.int64)] * 3
        order = rows.column("ord")
        a, b = (order.take(pa.array(x)).to_numpy() for x in found[:2])
        return pa.table([np.minimum(a, b), np.maximum(a, b), pa.array(found[2].astype(np.int32))], ["ord_1", "ord_2", "distance"])

    rows = folded.withColumn("ord", F.col("ord").cast("long"))
    return _tile_pairs(rows, tile).applyInArrow(compare, "ord_1 long, ord_2 long, distance int")


def distance_counts(folded: DataFrame, within: int, tile: int = TILE) -> DataFrame:
    """``distance, pairs``: how many image pairs of unlike hashes are so far apart, copies times copies, up to ``within``."""
    def count(rows: pa.Table) -> pa.Table:
        copies, total = rows.column("copies").to_numpy(), np.zeros(BITS + 1, np.int64)
        for i, j, apart in _near_in(rows, within):
            np.add.at(total, apart, copies[i] * copies[j])
        at = np.flatnonzero(total)
        return pa.table([pa.array(at.astype(np.int32)), pa.array(total[at])], ["distance", "pairs"])

    return _tile_pairs(folded, tile).applyInArrow(count, "distance int, pairs long").groupBy("distance").agg(F.sum("pairs").alias("pairs"))


def hash_pairs(folded: DataFrame, within: int) -> DataFrame:
    """Pairs of distinct hashes within a distance: ``ord_1 < ord_2``, ``distance``."""
    return banded_pairs(folded, within) if within <= BANDED else tiled_pairs(folded, within)


def similar_images(hashes: DataFrame, threshold: float = THRESHOLD, floor: float | None = None) -> DataFrame:
    """Pairs of distinct hashes at least ``floor`` similar, by default the duplicates (``threshold``).

    ``pairs`` is how many image pairs a row stands for (copies times copies);
    pairs among the copies of one hash are the ``copy_groups``.  A floor of 0.70, at which the source reports, is met by
    seven of 10,000 pairs of random hashes: its answer is quadratic.
    """
    folded = fold_copies(hashes)
    near = hash_pairs(folded, max_distance(threshold if floor is None else floor))

    def side(n: int) -> DataFrame:
        return folded.select(F.col("ord").alias(f"ord_{n}"), F.col("image").alias(f"image_{n}"),
                             F.col("copies").alias(f"copies_{n}"))

    score = 1 - F.col("distance") / F.lit(float(BITS))
    return near.join(side(1), "ord_1").join(side(2), "ord_2").select(
        "image_1", "image_2", "distance", score.alias("similarity"), (score >= threshold).alias("is_duplicate"),
        (F.col("copies_1") * F.col("copies_2")).alias("pairs"))


def image_pairs(hashes: DataFrame, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """Every pair of images at least ``floor`` similar, copies among them: image, source and ``ord`` of both, the smaller
    ``ord`` first, and their distance.

    The images of a hash are dealt in blocks of about ``block``, and a pair of near hashes, or a hash with itself, meets
    as pairs of blocks, so a hash with many copies is spread over tasks; the answer grows with the square of its copies.
    """
    folded = cut(fold_copies(hashes).select("hash", F.col("ord").cast("long").alias("ord"), "image", "copies",
                                            F.ceil(F.col("copies") / block).alias("blocks")))
    many = folded.filter("blocks > 1").select("ord", "blocks")
    own = folded.select("hash", F.col("ord").alias("lead"), "blocks")
    blocks = hashes.select("hash", F.struct("ord", "image", "source").alias("one")).join(own, "hash") \
        .groupBy("lead", F.pmod(F.xxhash64("one.ord"), F.col("blocks")).alias("block")).agg(F.collect_list("one").alias("images"))

    def numbers(name: str, start: Column) -> Column:
        return F.explode(F.sequence(start, F.col(name) - 1))

    met = hash_pairs(folded, max_distance(floor))
    for n in (1, 2):
        met = met.join(many.select(F.col("ord").alias(f"ord_{n}"), F.col("blocks").alias(f"blocks_{n}")), f"ord_{n}", "left") \
            .withColumn(f"blocks_{n}", F.coalesce(f"blocks_{n}", F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    unlike = met.select("ord_1", "ord_2", "distance", "blocks_2", numbers("blocks_1", zero).alias("block_1")) \
        .select("ord_1", "ord_2", "distance", "block_1", numbers("blocks_2", zero).alias("block_2"))
    alike = folded.filter("copies > 1").select(F.col("ord").alias("ord_1"), F.col("ord").alias("ord_2"), F.lit(0).alias("distance"), "blocks",
                                               numbers("blocks", zero).alias("block_1")) \
        .select("ord_1", "ord_2", "distance", "block_1", numbers("blocks", F.col("block_1")).alias("block_2"))
    pairs = unlike.unionByName(alike)
    for n in (1, 2):
        pairs = pairs.join(blocks.select(F.col("lead").alias(f"ord_{n}"), F.col("block").alias(f"block_{n}"), F.col("images").alias(f"images_{n}")),
                           [f"ord_{n}", f"block_{n}"])
    inside = (F.col("ord_1") == F.col("ord_2")) & (F.col("block_1") == F.col("block_2"))
    rows = pairs.select(inside.alias("inside"), "distance", "images_2", F.explode("images_1").alias("a")) \
        .select("inside", "distance", "a", F.explode("images_2").alias("b")).filter(~F.col("inside") | (F.col("a.ord") < F.col("b.ord")))
    swap = F.col("a.ord") > F.col("b.ord")
    sides = [F.when(swap, F.col(f"{two}.{name}")).otherwise(F.col(f"{one}.{name}")).alias(f"{name}_{n}")
             for name in ("image", "source", "ord") for n, one, two in ((1, "a", "b"), (2, "b", "a"))]
    return rows.select(*sides, "distance")


def copy_groups(hashes: DataFrame) -> DataFrame:
    """Hashes with copies: first image, copies, and the image pairs among them."""
    return fold_copies(hashes).filter("copies > 1").select(
        "image", "copies", F.expr("copies * (copies - 1) div 2").alias("pairs"))


def near_duplicates_across(hashes: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Near duplicates of different sources, per pair of hash and source.

    Copies are folded per hash and source; ``pairs`` counts the image pairs.
    Equal hashes in different sources are duplicates as well.
    """
    per_source = hashes.groupBy("hash", "source").agg(
        F.min("ord").alias("ord"), F.min_by("image", "ord").alias("image"), F.count("*").alias("copies"))
    folded = fold_copies(hashes)
    near = hash_pairs(folded, max_distance(threshold))
    code = folded.select("hash", "ord")
    linked = near.join(code.select(F.col("hash").alias("hash_1"), F.col("ord").alias("ord_1")), "ord_1") \
        .join(code.select(F.col("hash").alias("hash_2"), F.col("ord").alias("ord_2")), "ord_2") \
        .select("hash_1", "hash_2", "distance")
    same = folded.select(F.col("hash").alias("hash_1"), F.col("hash").alias("hash_2"), F.lit(0).alias("distance"))

    def side(n: int) -> DataFrame:
        return per_source.select(*[F.col(c).alias(f"{c}_{n}") for c in per_source.columns])

    cross = linked.unionByName(same).join(side(1), "hash_1").join(side(2), "hash_2").filter(
        (F.col("source_1") != F.col("source_2"))
        & ((F.col("hash_1") != F.col("hash_2")) | (F.col("source_1") < F.col("source_2"))))
    swap = F.col("ord_1") > F.col("ord_2")

    def pick(name: str, n: int) -> Column:
        other = 3 - n
        return F.when(swap, F.col(f"{name}_{other}")).otherwise(F.col(f"{name}_{n}")).alias(f"{name}_{n}")

    return cross.select(pick("image", 1), pick("image", 2), pick("source", 1), pick("source", 2), "distance",
                        (1 - F.col("distance") / F.lit(float(BITS))).alias("similarity"),
                        (F.col("copies_1") * F.col("copies_2")).alias("pairs"))


def similarity_report(hashes: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """Counts of image pairs by similarity, copies included by arithmetic; no pair is listed."""
    folded = cut(fold_copies(hashes))
    within = max_distance(floor)
    if within <= BANDED:
        near = similar_images(hashes, threshold, floor).groupBy("distance").agg(F.sum("pairs").alias("pairs"))
    else:
        near = distance_counts(folded, within)
    same = folded.filter("copies > 1").select(F.lit(0).alias("distance"), F.expr("copies * (copies - 1) div 2").alias("pairs"))
    s = 1 - F.col("distance") / F.lit(float(BITS))
    rows = near.unionByName(same).select(s.alias("similarity"), (s >= threshold).alias("is_duplicate"), "pairs")

    def total(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("pairs"))), F.lit(0)).alias(name)

    s, dup = F.col("similarity"), F.col("is_duplicate")
    return rows.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("total_matches"),
        total(dup & (s >= 0.99), "exact_duplicates"), total(dup, "near_duplicates"), total(~dup, "similar_images"),
        F.coalesce(F.round(F.sum(s * F.col("pairs")) / F.sum("pairs"), 3), F.lit(0.0)).alias("average_similarity"),
        total(s >= 0.95, "from_95"), total((s >= 0.90) & (s < 0.95), "from_90"),
        total((s >= 0.80) & (s < 0.90), "from_80"), total((s >= 0.70) & (s < 0.80), "from_70"))


def greedy_followers(edges: DataFrame, batch: int = 1 << 20) -> DataFrame:
    """``ord`` of every vertex with a smaller neighbour that leads, where a vertex leads exactly when no smaller neighbour does.

    ``edges`` are distinct, with ``ord_1 < ord_2``.  Each round settles the vertices without smaller neighbours and their
    neighbours, and with them a prefix of the order, as long as its inner edges are ``batch`` at most: what stands in the
    prefix depends on the prefix alone, so one task decides it in order, chains of any length included.  Edges of
    settled vertices go.  Under an order without long chains the edges left fall by a share each round; a last batch takes the rest.
    """
    edges = cut(edges.select("ord_1", "ord_2"))
    found = []

    def decide(batches):
        led: dict[int, bool] = {}
        for rows in batches:  # by ord_2, so the smaller end of each edge is decided before
            for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                led[b] = led.get(b, False) or not led.get(a, False)
        followers = np.array([v for v, f in led.items() if f], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(followers)], ["ord"])

    while total := edges.count():
        if total <= batch:
            prefix = edges
        else:
            last = edges.agg(F.percentile_approx("ord_2", batch / total / 2)).first()[0]
            prefix = edges.filter(F.col("ord_2") < last)
            prefix = prefix if prefix.count() <= batch else edges.limit(0)
        within = cut(prefix.repartition(1).sortWithinPartitions("ord_2", "ord_1").mapInArrow(decide, "ord long"))
        lower = edges.select(F.col("ord_1").alias("ord")).distinct()
        heads = lower.join(edges.select(F.col("ord_2").alias("ord")), "ord", "left_anti")
        inside = prefix.select(F.col("ord_1").alias("ord")).union(prefix.select("ord_2")).distinct()
        leaders = cut(heads.union(inside.join(within, "ord", "left_anti")).distinct())
        led = edges.join(leaders.select(F.col("ord").alias("ord_1")), "ord_1", "left_semi").select(F.col("ord_2").alias("ord"))
        followers = cut(led.union(within).distinct())
        found.append(followers)
        settled = leaders.union(followers)
        edges = cut(edges.join(settled.select(F.col("ord").alias("ord_1")), "ord_1", "left_anti")
                    .join(settled.select(F.col("ord").alias("ord_2")), "ord_2", "left_anti").select("ord_1", "ord_2"))
    out = edges.select(F.col("ord_1").alias("ord")).limit(0)
    for one in found:
        out = out.union(one)
    return out


def duplicate_groups(hashes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Greedy groups: the first ungrouped image leads, all ungrouped images within
    the distance follow.  ``leader`` and ``member`` rows; leaders of nothing are left out.

    Followers go to their smallest leader.  Copies share their hash's fate.  Connected components
    would be wrong: nearness is not transitive.
    """
    folded = fold_copies(hashes)
    edges = cut(hash_pairs(folded, max_distance(threshold)).select(F.col("ord_1").cast("long").alias("ord_1"), F.col("ord_2").cast("long").alias("ord_2")))
    following = cut(greedy_followers(edges))
    follows = edges.join(following.select(F.col("ord").alias("ord_1")), "ord_1", "left_anti") \
        .join(following.select(F.col("ord").alias("ord_2")), "ord_2", "left_semi") \
        .groupBy("ord_2").agg(F.min("ord_1").alias("lead"))
    lead_of = folded.join(follows.withColumnRenamed("ord_2", "ord"), "ord", "left") \
        .select("hash", F.coalesce("lead", "ord").alias("lead"))
    names = folded.select(F.col("ord").alias("lead"), F.col("image").alias("leader"))
    return hashes.join(lead_of, "hash").join(names, "lead") \
        .filter(F.col("image") != F.col("leader")).select("leader", F.col("image").alias("member"))
