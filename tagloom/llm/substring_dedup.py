"""Removal of passages that repeat verbatim: every window of ``size`` words whose words also start elsewhere.

Windows are hashed by Rabin-Karp and counted in Spark, in two steps that give the counts of all windows
without moving one row per word.  Neighbouring windows whose least ``GRAM``-gram hash stands at the same
place form a run.  Equal windows have equal least grams, so a run whose gram no other run has holds no
repeated window, and runs with the same words are repeated as a whole.  Only runs that share a gram but not
all words have their windows counted one by one, runs with the same words once for all.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.llm.stored import join_counted, stored
from tagloom.llm.words import NOT_SPACE, Words, span_hashes, window_hashes, word_chunks

GRAM = 8
_BLOCK = 1 << 19
RUNS = "g long, r long, k1 long, k2 long, start int, n int"


def runs_of(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows: hash of the least gram, hash of all words, first window, number of windows."""
    gram = min(GRAM, size)
    h, n = words.hash, len(words.hash)
    end = words.first[words.doc + 1] if n else np.zeros(0, np.int64)
    valid = np.flatnonzero(np.arange(n) + size <= end)
    if not len(valid):
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = window_hashes(h, gram)
    width = size - gram + 1
    place = np.empty(n - size + 1, np.int64)
    low = np.uint64(2 * _BLOCK - 1)
    for a in range(0, len(place), _BLOCK):
        b = min(len(place), a + _BLOCK)
        least = (grams[a:b + width - 1] & ~low) | np.arange(b - a + width - 1, dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[:step - width], least[width - step:])
        place[a:b] = (least & low).astype(np.int64) + a
    place = place[valid]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    count = np.diff(new, append=len(place))
    start = valid[new]
    return grams[place[new]], span_hashes(h, start, start + count - 1 + size), start, count


def text_runs(docs: DataFrame, size: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in word_chunks(batches, "text", NOT_SPACE):
            g, r, start, count = runs_of(words, size)
            doc = words.doc[start] if len(start) else start
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(g.view(np.int64)), pa.array(r.view(np.int64)), part.column("k1").take(at), part.column("k2").take(at),
                 pa.array((start - words.first[doc]).astype(np.int32)), pa.array(count.astype(np.int32))],
                ["g", "r", "k1", "k2", "start", "n"])

    return docs.select("k1", "k2", "text").mapInArrow(find, RUNS)


def run_windows(docs: DataFrame, size: int) -> DataFrame:
    """Hash and place of every window of the runs in ``spans`` (first window, number, does the run occur again)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in word_chunks(batches, "text", NOT_SPACE):
            hashes = window_hashes(words.hash, size)
            spans = part.column("spans")
            flat = spans.flatten()
            doc = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
            low, n, again = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2))
            again = np.repeat(again > 0, n)
            doc, inside = np.repeat(doc, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(low, n) + inside
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[words.first[doc] + at].view(np.int64)), part.column("k1").take(which), part.column("k2").take(which),
                 pa.array(at.astype(np.int32)), pa.array(again)], ["w", "k1", "k2", "start", "again"])

    return docs.select("k1", "k2", "text", "spans").mapInArrow(find, "w long, k1 long, k2 long, start int, again boolean")


def cover(spans: list, n_words: int) -> bytearray:
    """1 for each word that stays, after maximal intervals of ``(start, end)`` spans go."""
    keep = bytearray(b"\1") * n_words
    for low, high in spans:
        keep[low:high] = bytes(high - low)
    return keep


def without_repeats(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    """Cuts the ``spans`` (word intervals) out of each text."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                total, gone, kept = [], [], []
                for text, spans in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("spans").to_pylist()):
                    words = (text or b"").split()
                    total.append(len(words))
                    if spans:
                        keep = cover([(s["start"], s["stop"]) for s in spans], len(words))
                        words = list(compress(words, keep))
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["id", "n_words", "n_removed", "kept"])

    return docs.select("id", "text", "spans").mapInArrow(apply, schema)


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept``: the words outside all repeated windows, joined by one space.

    Words are runs of anything but ASCII white space.  A null text has no words; texts shorter than a window
    stay whole.  Rows that repeat (same id and text) are each other's copies.  Null ids are allowed; other
    columns are not read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("k1"),
                        F.xxhash64(F.col(text_col)).alias("k2"))
    runs = stored(text_runs(keyed, size))
    shared = (runs.groupBy("g").agg(F.count("*").alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"))
              .filter("c > 1").select("g", "c", (F.col("lo") == F.col("hi")).alias("whole")))
    repeated = stored(join_counted(runs, stored(shared), "g", "c", "inner").select("r", "k1", "k2", "start", "n", "whole"))
    # of runs with the same words, one stands for all when windows are counted
    unsure = stored(repeated.filter(~F.col("whole")).groupBy("r").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "start", "n")).alias("one")))
    spans_of = unsure.select("one.*", (F.col("c") > 1).alias("again")).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "again")).alias("spans"))
    windows = stored(run_windows(keyed.join(spans_of, ["k1", "k2"]), size))
    twice = windows.groupBy("w").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("c")).filter("c > 1").select("w")
    found = windows.filter(~F.col("again")).join(twice, "w").select("k1", "k2", "start", F.lit(1).alias("n"))
    same = repeated.filter(~F.col("whole")).join(unsure.filter("c > 1").select("r"), "r", "left_semi")
    spans = (repeated.filter("whole").unionByName(same).select("k1", "k2", "start", "n").unionByName(found)
             .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n") + (size - 1)).alias("stop"))).alias("spans")))
    return (without_repeats(keyed.join(spans, ["k1", "k2"], "left"), docs.schema[id_col].dataType)
            .withColumnRenamed("id", id_col))
