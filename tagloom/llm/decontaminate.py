"""Benchmark decontamination by training suffix arrays.

Every shard of the training texts gets a suffix array over words: suffixes as numbers, sorted by the words
that follow.  All suffixes of the benchmark are looked up in it by binary search; each answer is a range
of training suffixes with the longest verbatim match and its places.  A suffix that runs into a word
which no benchmark item has before a window is complete cannot hold a window, so it is left out of the array.

The benchmark is the stated query set: its words go to the tasks in blocks of at most ``BLOCK_WORDS``, one block
a pass, so no pass holds more of it however large it is.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.stored import stored
from tagloom.llm.words import LETTERS_DIGITS, LOWER, Words, buffers, word_chunks

BLOCK_WORDS = 1_000_000
HITS = "item long, low int, high int"


class Suffixes:
    """The suffixes of one block of items: a query for each window, ``need`` words long."""

    def __init__(self, texts: pa.Array, size: int) -> None:
        with np.errstate(over="ignore"):
            data, offsets = buffers(texts)
            words = Words(data, offsets, LETTERS_DIGITS, LOWER)
        self.hash, self.end = words.hash, words.first[words.doc + 1] if len(words.hash) else np.zeros(0, np.int64)
        n = np.diff(words.first)[words.doc] if len(words.hash) else np.zeros(0, np.int64)
        need = np.minimum(n, size)
        self.at = np.flatnonzero(np.arange(len(words.hash)) + need <= self.end)
        self.need, self.item = need[self.at], words.doc[self.at]
        self.words = np.unique(words.hash)
        self.least = int(self.need.min()) if len(self.at) else size


class SuffixArray:
    """Suffixes of one shard that can hold a window, in the order of their first ``depth`` words."""

    def __init__(self, words: Words, known: np.ndarray, least: int, depth: int) -> None:
        h, n = words.hash, len(words.hash)
        self.hash, self.end = h, words.first[words.doc + 1] if n else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        inside = known[place] == h if len(known) else np.zeros(n, bool)
        # where the stretch of known words from here ends
        stop = np.minimum.accumulate(np.where(inside, n, np.arange(n))[::-1])[::-1]
        self.at = np.flatnonzero(inside & (np.minimum(stop, self.end) - np.arange(n) >= least))
        keys = [self.words_at(self.at, k) for k in range(depth)]
        order = np.lexsort(keys[::-1]) if len(self.at) else np.zeros(0, np.int64)
        self.at, self.keys = self.at[order], [k[order] for k in keys]

    def words_at(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th word of suffixes; 0 past a text's end."""
        inside = at + k < self.end[at]
        return np.where(inside, self.hash[np.where(inside, at + k, at)], np.uint64(0))

    def search(self, queries: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the array whose suffixes begin with the ``need`` words of each query."""
        low, high = np.zeros(len(queries.at), np.int64), np.full(len(queries.at), len(self.at), np.int64)
        for k, column in enumerate(self.keys):
            on = np.flatnonzero((queries.need > k) & (low < high))
            if not len(on):
                break
            wanted = queries.hash[queries.at[on] + k]
            low[on], high[on] = (_bound(column, wanted, low[on], high[on], side) for side in ("left", "right"))
        return low, high


def _bound(column: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, side: str) -> np.ndarray:
    """Binary search of each value in its own range of the column, which is sorted there."""
    low, high = low.copy(), high.copy()
    while (on := np.flatnonzero(low < high)).size:
        middle = (low[on] + high[on]) // 2
        right = column[middle] < wanted[on] if side == "left" else column[middle] <= wanted[on]
        low[on[right]] = middle[right] + 1
        high[on[~right]] = middle[~right]
    return low


def _longest(array: SuffixArray, queries: Suffixes, query: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many words of item and text agree from each match on, in the item and the text."""
    length = length.copy()
    on = np.arange(len(at))
    while len(on):
        i, j = queries.at[query[on]] + length[on], at[on] + length[on]
        inside = (i < queries.end[queries.at[query[on]]]) & (j < array.end[at[on]])
        on, i, j = on[inside], i[inside], j[inside]
        same = queries.hash[i] == array.hash[j]
        on = on[same]
        length[on] += 1
    return length


def matches(docs: DataFrame, items: pa.Table, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per text: ``n_words``, ``n_hit``, the items with a window in it, and the longest verbatim match of
    each as ``spans`` (item, first word, words).  ``items`` has ``item_id`` and ``text``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, hits array<struct<low:int,high:int>>, spans array<struct<item:string,start:int,n:int>>"
    cache: dict = {}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if "q" not in cache:
            cache["q"] = Suffixes(table.column("text").combine_chunks(), size)
        queries, names = cache["q"], table.column("item_id")
        for part, words in word_chunks(batches, "text", LETTERS_DIGITS, LOWER):
            array = SuffixArray(words, queries.words, queries.least, size)
            low, high = array.search(queries)
            query = np.repeat(np.arange(len(low)), high - low)
            at = array.at[np.repeat(low, high - low) + _within(high - low)]
            need = queries.need[query]
            doc, item = words.doc[at], queries.item[query]
            # hit words: windows merged into intervals, text by text
            order = np.lexsort((at, doc))
            a, stop = at[order], (at + need)[order]
            reach = np.maximum.accumulate(stop) if len(stop) else stop  # windows never leave their text
            new = np.flatnonzero(a >= np.concatenate([[-1], reach[:-1]])) if len(a) else a
            begin, last = a[new], reach[np.append(new[1:] - 1, len(a) - 1)] if len(new) else reach
            at_doc = words.doc[begin] if len(begin) else begin
            hits = _lists(at_doc, len(part), begin - words.first[at_doc], last - words.first[at_doc], names=("low", "high"))
            # the longest match of each item in each text, the first of equals
            length = _longest(array, queries, query, at, need)
            order = np.lexsort((at, -length, item, doc))
            doc, item, at, length = doc[order], item[order], at[order], length[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else doc
            doc, item, at, length = doc[first], item[first], at[first], length[first]
            spans = _lists(doc, len(part), at - words.first[doc], length, item=names.take(pa.array(item)), names=("start", "n"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(words.first)), hits, spans], ["id", "n_words", "hits", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(search, schema)


def _lists(doc: np.ndarray, n: int, *columns: np.ndarray, names: tuple[str, str], item: pa.Array | None = None) -> pa.Array:
    """Rows in the order of ``doc`` as one list per text."""
    arrays, fields = [pa.array(c.astype(np.int32)) for c in columns], list(names)
    if item is not None:
        arrays, fields = [item.combine_chunks() if isinstance(item, pa.ChunkedArray) else item, *arrays], ["item", *fields]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(arrays, fields))


def item_blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[pa.Table]:
    """The query set in blocks of bounded size, so that no broadcast grows with the benchmark; one block without rows
    for an empty one.  Ids become strings and may be null; texts without words never match.
    """
    rows = items.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block, words, made = [], 0, False
    for row in rows.toLocalIterator():
        block.append(row)
        words += len(row.text) // 2 + 1
        if words >= BLOCK_WORDS:
            yield _block(block)
            block, words, made = [], 0, True
    if block or not made:
        yield _block(block)


def _block(rows: list) -> pa.Table:
    return pa.table({"item_id": pa.array([r.item_id for r in rows], pa.string()), "text": pa.array([r.text for r in rows], pa.string())})


def find_contamination(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, n_words, n_hit, n_items, items, spans`` for every row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.  A window is ``size``
    words of an item; an item with fewer words, but not none, is one window.  ``n_hit`` counts the words inside
    windows, ``items`` are the sorted ids (as strings) of items with a window in the text, ``spans`` the
    longest verbatim match of each.  Items that share an id count once.  Items with a null id are searched too: their
    words are hit, together they count as one in ``n_items``, and ``items`` leaves them out.  Null and empty texts
    have no words.  Repeated rows each get a row, and rows may share an id or have none: of several blocks the
    results are joined by row numbers that are written once.
    """
    blocks = item_blocks(items, item_col, item_text_col)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        joined = matches(docs, first, size, id_col, text_col)
    else:
        rows = stored(docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id()))
        # every row has its words from the first block; rows without a hit in another add nothing
        passes = [stored(matches(rows, first, size, "row", "text"))]
        passes += [stored(matches(rows, block, size, "row", "text").filter(F.size("hits") > 0)) for block in chain([second], blocks)]
        found = (reduce(DataFrame.unionByName, passes).groupBy(F.col("id").alias("row"))
                 .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("spans")).alias("spans")))
        joined = rows.select("row", F.col("of").alias("id")).join(found, "row").drop("row")
    covered = F.aggregate(F.array_sort("hits"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["high"] - F.greatest(acc["to"], x["low"]))).alias("n"), F.greatest(acc["to"], x["high"]).alias("to")))["n"]
    named = F.array_distinct(F.transform("spans", lambda s: s["item"]))
    return joined.select(F.col("id").alias(id_col), "n_words", covered.cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"),
                         F.array_sort(F.array_compact(named)).alias("items"), "spans")


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
                        item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no window of an item, ids null or not; columns as they are.  One pass over
    the texts for each block of items, without a join, so ids do not matter; what a pass keeps is written before the next."""
    blocks = item_blocks(items, item_col, item_text_col)
    docs = _without(docs, next(blocks), size, text_col)
    for block in blocks:
        docs = _without(stored(docs), block, size, text_col)
    return docs


def _without(docs: DataFrame, items: pa.Table, size: int, text_col: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Suffixes(sent.value.column("text").combine_chunks(), size)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            hit = np.zeros(batch.num_rows, bool)
            for part, words in word_chunks(iter([texts]), "text", LETTERS_DIGITS, LOWER):
                array = SuffixArray(words, queries.words, queries.least, size)
                low, high = array.search(queries)
                on = np.flatnonzero(high > low)
                found = array.at[np.repeat(low[on], (high - low)[on]) + _within((high - low)[on])]
                hit[part.column("row").to_numpy()[words.doc[found]]] = True
            yield batch.filter(pa.array(~hit))

    return docs.mapInArrow(keep, docs.schema)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of the counts in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
