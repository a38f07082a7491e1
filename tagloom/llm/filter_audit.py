"""Filter interaction audit: what each filter removes, repeats and costs, for every order of the filters.

One pass over the texts states which filters each document fails; the ids that fail a filter are stored as a
relation of their own, one for each filter.  Everything else is anti and semi joins of these narrow relations:

* the ids that fail a filter and survive a prefix of others: left anti with the prefix's relations,
* the ids that fail it, but were removed before: left semi with them,
* the labelled good or toxic among them: left semi with the labels.

What a filter removes after a prefix depends on which filters stand in it, not on their order, so the joins
run over the sets of filters (16 for each of five filters), and the orders, 120 of them, add counts up.
The relations are dealt by document before a row is repeated for each set, so only one row for each failure
is moved, and a document is never hot.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.stored import stored
from tagloom.llm.words import NOT_SPACE, byte_class, word_chunks

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "#$%&*|"
_CAPITAL = byte_class(lambda b: 0x41 <= b <= 0x5A)
_SYMBOL = byte_class(lambda b: chr(b) in SYMBOLS)
_FIRST_BYTE = byte_class(lambda b: b < 0x80 or b >= 0xC0)  # of a code point
DOCUMENT = ["id", "h"]  # names a document: its id, and a hash of id, text and part
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``id, h, part, digest`` and the verdicts ``A`` to ``D`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text, part).alias("h"), part.alias("part"),
                       F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_, words in word_chunks(batches, "text", NOT_SPACE):
            n, doc = np.diff(words.first), words.doc
            order = np.lexsort((words.hash, doc))
            new = np.ones(len(doc), bool)
            new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            distinct = np.bincount(doc[order][new], minlength=part_.num_rows)
            count = lambda member: np.diff(np.concatenate([[0], np.cumsum(member[words.data], dtype=np.int64)])[words.offsets])
            verdicts = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * count(_CAPITAL) > CAPITAL_PERCENT * count(_FIRST_BYTE), count(_SYMBOL) > 0]
            yield pa.RecordBatch.from_arrays([*(part_.column(c) for c in ("id", "h", "part", "digest")), *map(pa.array, verdicts)],
                                             ["id", "h", "part", "digest", *FILTERS[:4]])

    return rows.mapInArrow(measure, f"id {kind}, h long, part string, digest binary, " + ", ".join(f"{f} boolean" for f in FILTERS[:4]))


def failing_relations(rows: DataFrame) -> DataFrame:
    """``id, h, part, filter``: one row for each filter (its number) that a document fails, stored in a folder for each filter.

    The last filter rejects a text that a smaller id has as well.  The first of each text are found by an aggregate, and the
    others are what a left anti join with them leaves; its key holds the id too, so the copies of one text,
    however many, lie in all tasks.
    """
    numbers = F.array_compact(F.array(*[F.when(F.col(f), F.lit(i)) for i, f in enumerate(FILTERS[:4])]))
    single = rows.select(*DOCUMENT, "part", F.explode(numbers).alias("filter"))
    named = rows.filter("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id"))
    copies = named.join(first, ["id", "digest"], "left_anti").select(*DOCUMENT, "part", F.lit(4).alias("filter"))
    return stored(single.unionByName(copies), "filter")


def same_document(left: str, right: str):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in DOCUMENT])


def removals(failing: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part, filter, prefix, removed, redundant, good_lost, toxic_lost``: what a filter (its number) removes
    after the filters in the bits of ``prefix``, and how much of what fails it they had removed already."""
    kinds = [failing.withColumn("kind", F.lit("all"))]
    for kind, chosen in (("good", "quality = 1"), ("toxic", "toxic = 1")):
        ids = labels.filter(chosen).select(F.col(id_col).alias("id"))
        kinds.append(failing.join(ids, "id", "left_semi").withColumn("kind", F.lit(kind)))
    prefixes = [[p for p in range(1 << len(FILTERS)) if not p >> i & 1] for i in range(len(FILTERS))]
    sets = F.get(F.lit(prefixes), F.col("filter"))
    dealt = reduce(DataFrame.unionByName, kinds).repartition(*DOCUMENT).withColumn("prefix", F.explode(sets)).alias("f")
    bits = F.get(F.lit([1 << i for i in range(len(FILTERS))]), F.col("filter"))
    earlier = failing.select(*DOCUMENT, bits.alias("bit")).alias("e")
    in_prefix = same_document("f", "e") & (F.col("f.prefix").bitwiseAND(F.col("e.bit")) != 0)
    now = dealt.join(earlier, in_prefix, "left_anti").groupBy("part", "filter", "prefix").agg(
        F.count_if(F.col("kind") == "all").alias("removed"), F.lit(0).cast("long").alias("redundant"),
        F.count_if(F.col("kind") == "good").alias("good_lost"), F.count_if(F.col("kind") == "toxic").alias("toxic_lost"))
    before = dealt.filter("kind = 'all'").join(earlier, in_prefix, "left_semi").groupBy("part", "filter", "prefix").agg(
        F.lit(0).cast("long").alias("removed"), F.count("*").alias("redundant"), F.lit(0).cast("long").alias("good_lost"), F.lit(0).cast("long").alias("toxic_lost"))
    return now.unionByName(before).groupBy("part", "filter", "prefix").agg(*[F.sum(c).alias(c) for c in ("removed", "redundant", "good_lost", "toxic_lost")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the ``COUNTS`` for every part, order of the filters and step of it.

    A null text is empty: it has no words and fails filter A; a null part is the empty string.  Copies are told by
    text over the whole table, and only a smaller id makes a copy fail, so rows that repeat with id and all are not each
    other's copies, nor is a row with a null id, which has no smaller id and is none.  Repeated rows count as often as they
    stand there.  A document is good (toxic) if any of its labels says so; labels without a document do not
    count.  An empty table has no parts and no rows.  Other columns are not read.
    """
    rows = stored(measured(docs, id_col, text_col, part_col))
    found = stored(removals(failing_relations(rows), labels, id_col))
    spark = docs.sparkSession
    every = list(permutations(FILTERS))
    orders = F.broadcast(spark.createDataFrame(
        [(n, "".join(order), step + 1, FILTERS.index(f), sum(1 << FILTERS.index(e) for e in order[:step]))
         for n, order in enumerate(every) for step, f in enumerate(order)], "order int, filter_order string, step int, filter int, prefix int"))
    parts = rows.groupBy("part").agg(F.count("*").alias("documents"))
    others = F.get(F.lit([(1 << len(FILTERS)) - 1 - (1 << i) for i in range(len(FILTERS))]), F.col("filter"))
    alone = found.filter(F.col("prefix") == others).select("part", "filter", F.col("removed").alias("unique_fails"))
    share = (found.join(orders, ["filter", "prefix"]).groupBy("part", "filter").agg(F.sum("removed").alias("shapley")))
    # parts carry 600 rows each; a row of theirs is made once and takes its counts from 80 sums
    frame = parts.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1)))).join(orders, "order")
    steps = (frame.join(found, ["part", "filter", "prefix"], "left").join(alone, ["part", "filter"], "left").join(share, ["part", "filter"], "left")
             .fillna(0, ["removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]))
    gone = F.aggregate("removals", F.lit(0).cast("long"), lambda a, x: F.when(x["step"] <= F.col("one.step"), a + x["removed"]).otherwise(a))
    one = ["step", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return (steps.groupBy("part", "filter_order").agg(F.first("documents").alias("documents"), F.collect_list(F.struct(*one)).alias("removals"))  # five steps
            .select("part", "filter_order", "documents", "removals", F.explode("removals").alias("one"))
            .select("part", "filter_order", "one.step", (F.col("documents") - gone).alias("kept"), *[f"one.{c}" for c in one[1:]]))
