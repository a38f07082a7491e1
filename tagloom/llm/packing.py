"""Best-fit packing of documents into sequences of a fixed capacity.

Documents become tokens and pieces in one pass.  Only the pieces' lengths are then dealt over tasks of a
bounded number of rows; each task packs its stream by bounded-space online best-fit: open sequences sit in
stacks by free space, a bitset has one bit per free space in use, so the tightest fit is one shift away.
When more than ``open_bins`` are open, the fullest is closed.  A task's stream comes longest first: with
room for its open sequences that wastes next to nothing, where a random order wastes about one percent.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tagloom.llm.stored import stored
from tagloom.llm.tokens import TEXTS, encoder

PLACED = ["sequence_id", "offset"]


def tokenise(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
             capacity: int = 2048, end_id: int = 0, keep_space: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, ``piece`` (from 0), ``start``, ``length``, ``ids`` (binary,
    little-endian unsigned 32 bit).

    A null or empty text has only the end id.  Nulls and repeats in the id column pass through; other
    columns are not read.  ``keep_space`` is for vocabularies whose tokens hold white space.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, False, keep_space)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, TEXTS):
                    part = batch.slice(at, TEXTS)
                    rows, number, starts, lengths, ids = [], [], [], [], []
                    texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                    for row, found in enumerate(encode.texts(texts)):
                        found += end
                        for piece, low in enumerate(range(0, len(found), 4 * capacity)):
                            body = found[low:low + 4 * capacity]
                            rows.append(row)
                            number.append(piece)
                            starts.append(low // 4)
                            lengths.append(len(body) // 4)
                            ids.append(body)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(rows, pa.int32())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()),
                         pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])
        finally:
            encode.forget()

    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)
    return got.withColumnRenamed("id", id_col)


class OpenBins:
    """Bounded-space best fit: :meth:`put` gives the sequence and the offset of a length."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.stacks, self.open, self.next = 0, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if length and fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.stacks[left].append(number)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def place_apart(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """As :func:`place`, for wide rows: only a number and the length of each go through the packing tasks, whose
    batches would else hold the rows' bodies several times over; places come back by a join."""
    number = "piece_number"
    while number in pieces.columns:
        number += "_"
    numbered = stored(pieces.withColumn(number, F.monotonically_increasing_id()))
    return numbered.join(stored(place(numbered.select(number, "length"), capacity)).drop("length"), number).drop(number)


def place(pieces: DataFrame, capacity: int = 2048, open_bins: int = 65_536, rows_per_task: int = 100_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    All other columns pass through, whatever their values; an empty table gives an empty one.  Rows are
    written to the shared folder first, so a lost executor repeats the same deal and the same placement.
    """
    pieces = stored(pieces)
    tasks = max(1, math.ceil(pieces.count() / rows_per_task))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns
    if set(names) & set(PLACED):
        raise ValueError(f"columns {PLACED} are added here; rename yours")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [bins.put(n) for n in batch.column(names.index("length")).to_pylist()]
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])], [*names, *PLACED])

    keys = [c for c in names if c != "ids"]
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.desc("length"), F.xxhash64(*keys), *keys)
    return dealt.mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = 2048, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """One row per piece with its place; ``ids`` is kept, or replaced by ``ids_crc32`` to move less."""
    pieces = tokenise(docs, vocabulary, id_col, text_col, capacity, end_id)
    if not keep_ids:
        return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)
    return place_apart(pieces, capacity)
