"""Ratcliff–Obershelp similarity and an exact join on it.

The join is a metric partitioning.  A ratio of ``t`` between texts of m and n characters needs a common
subsequence, and so a common bag of characters, of t (m + n) / 2, which bounds the bag distance (the sum of
the differences of character counts) by (1 - t) (m + n).  Texts of one side go to the cell of their nearest
pivot; by the triangle inequality, one of the other side can only have partners in cells whose pivot is no
farther than that bound and the cell's radius together.  Cells are cut into blocks, so a task compares two
blocks of bounded size, whatever the texts: bags by a matrix product, then the longest common
subsequence of what is left, 64 steps of it in one machine word and many pairs at once.  Only pairs that pass
are measured one by one.  Every test is a necessary condition, so no pair is missed.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.session import cut


@F.pandas_udf(T.DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``SequenceMatcher.ratio`` per pair; no built-in measures the same."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


CLASSES = 96      # printable ASCII falls into classes of its own; texts alike stay alike in classes
CELL, MOST_PIVOTS = 512, 256
LEFT_BLOCK, RIGHT_BLOCK = 4096, 2048
_WORD = 64
_PAIRS = 1 << 17  # pairs whose subsequences are measured together


def char_classes(texts: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(t.encode("utf-32-le"), "<u4") % CLASSES for t in texts]


def bags(classes: list[np.ndarray]) -> np.ndarray:
    """Character counts, one row per text."""
    owner = np.repeat(np.arange(len(classes)), [len(c) for c in classes])
    flat = np.concatenate(classes) if classes else np.zeros(0, np.int64)
    return np.bincount(owner * CLASSES + flat, minlength=len(classes) * CLASSES).reshape(-1, CLASSES)


def bag_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x[:, None, :] - y[None, :, :]).sum(2)


def marks(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A one for each of the first, second, … occurrence of a class, up to ``most`` of it: products of such rows are common bags."""
    return np.concatenate([counts[:, [k]] > np.arange(most[k]) for k in np.flatnonzero(most)], 1).astype(np.float32) if most.any() else np.zeros((len(counts), 1), np.float32)


def common_subsequence(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of classes of each pair ``a[i], b[j]``; where a text of ``a`` has more than 64
    characters, the shorter length instead, which is never less."""
    size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
    places = np.zeros((len(a), CLASSES + 1), np.uint64)
    for row, classes in enumerate(a):
        if len(classes) <= _WORD:
            np.bitwise_or.at(places[row], classes, np.uint64(1) << np.arange(len(classes), dtype=np.uint64))
    steps = np.full((len(b), max(1, size_b.max(initial=0))), CLASSES)
    for row, classes in enumerate(b):
        steps[row, :len(classes)] = classes
    out = np.minimum(size_a[i], size_b[j])
    short = np.flatnonzero(size_a[i] <= _WORD)
    for low in range(0, len(short), _PAIRS):
        at = short[low:low + _PAIRS]
        x, y = i[at], j[at]
        rest = np.full(len(at), ~np.uint64(0))
        for step in range(size_b[y].max(initial=0)):
            met = rest & places[x, steps[y, step]]
            rest = (rest + met) | (rest - met)
        own = np.where(size_a[x] == _WORD, ~np.uint64(0), (np.uint64(1) << (size_a[x] % _WORD).astype(np.uint64)) - np.uint64(1))
        out[at] = np.bitwise_count(~rest & own)
    return out


def near_pairs(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``i, j, ratio`` of the pairs with a ratio of ``least`` or more."""
    a, b = char_classes(left), char_classes(right)
    size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
    bag_a, bag_b = bags(a), bags(b)
    most = np.minimum(bag_a.max(0), bag_b.max(0))
    common = marks(bag_a, most) @ marks(bag_b, most).T
    need = least * (size_a[:, None] + size_b[None, :]) / 2 - 1e-6
    i, j = np.nonzero(common >= need)
    long_enough = common_subsequence(a, b, i, j) >= need[i, j]
    i, j = i[long_enough], j[long_enough]
    ratio = np.array([SequenceMatcher(None, left[x], right[y]).ratio() for x, y in zip(i.tolist(), j.tolist())], np.float64)
    found = ratio >= least
    return i[found], j[found], ratio[found]


def ratio_join(left: DataFrame, right: DataFrame, least: float, cell: int = CELL, left_block: int = LEFT_BLOCK, right_block: int = RIGHT_BLOCK) -> DataFrame:
    """All pairs of strings whose ratio reaches ``least``, as ``a, b, ratio``.

    ``left`` and ``right`` hold one distinct string each in ``text``; empty and null ones have no partner.  Cells hold
    about ``cell`` texts while pivots do not pass ``MOST_PIVOTS``; no more than these pivots and their cells' sizes go
    through the driver.  Work grows with the pairs that the pivots cannot tell apart; memory does not.
    """
    left, right = (cut(df.filter("text <> ''").select("text")) for df in (left, right))
    n_left, n_right = left.count(), right.count()
    none = left.sparkSession.createDataFrame([], "a string, b string, ratio double")
    if not n_left or not n_right:
        return none
    few = min(MOST_PIVOTS, math.ceil(n_right / cell))
    pivots = bags(char_classes([r.text for r in right.orderBy(F.xxhash64("text"), "text").limit(few).collect()]))

    def to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(low, 256)
                counts = bags(char_classes(texts.to_pylist()))
                yield texts, counts.sum(1), bag_distances(counts, pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, size, far in to_pivots(batches):
            yield pa.RecordBatch.from_arrays([texts, pa.array(far.argmin(1)), pa.array(far.min(1)), pa.array(size)], ["text", "cell", "far", "size"])

    homes = cut(right.mapInArrow(home, "text string, cell long, far long, size long"))
    stats = homes.groupBy("cell").agg(F.max("far").alias("radius"), F.min("size").alias("shortest"), F.max("size").alias("longest"), F.count("*").alias("n")).collect()
    cells = [np.array([r[c] for r in stats]) for c in ("cell", "radius", "shortest", "longest")]
    blocks = {r.cell: math.ceil(r.n / right_block) for r in stats}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, radius, shortest, longest = cells
        for texts, size, far in to_pivots(batches):
            size = size[:, None]
            near = far[:, number] - radius <= (1 - least) * (size + longest) + 1e-6
            like = (np.minimum(size, longest) * (2 - least) >= np.maximum(size, shortest) * least - 1e-6)
            row, at = np.nonzero(near & like)
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(row)), pa.array(number[at])], ["text", "cell"])

    shares = math.ceil(n_left / left_block)
    count = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("cell"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = left.mapInArrow(route, "text string, cell long").select(
        "text", "cell", F.lit(0).alias("side"), F.pmod(F.xxhash64("text"), F.lit(shares)).cast("int").alias("share"), all_of(count).alias("block"))
    other = homes.select("text", "cell", F.lit(1).alias("side"), all_of(F.lit(shares)).alias("share"), F.pmod(F.xxhash64("text"), count).cast("int").alias("block"))

    def compare(tile: pa.Table) -> pa.Table:
        side, texts = tile.column("side").to_numpy(), tile.column("text")
        a, b = (texts.filter(pa.array(side == s)).to_pylist() for s in (0, 1))
        i, j, ratio = near_pairs(a, b, least) if a and b else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array([a[x] for x in i], pa.string()), pa.array([b[x] for x in j], pa.string()), pa.array(ratio, pa.float64())], ["a", "b", "ratio"])

    return one.unionByName(other).groupBy("cell", "share", "block").applyInArrow(compare, "a string, b string, ratio double")
