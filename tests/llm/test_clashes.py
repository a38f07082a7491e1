"""Operators that return the caller's columns, with columns named like their own, and joins split by weight."""
import random

from pyspark.sql import functions as F

from tagloom.llm import jaccard_join, packing, pii, quality
from tagloom.llm.stored import join_counted, likely_in, stored

CLASHING = ["gone", "again", "odd", "odd_id", "odd_h", "row", "row_key", "own_key", "bad_id", "bad_h", "bad_key", "pii", "rep", "label", "filter_part", "filter_bits", "id", "key", "h"]


def table(spark):
    text = "some words that are here for all to read and to keep in mind, as they may well come again one day or another"
    rows = [(i, t, "en", *map(str, range(len(CLASHING)))) for i, t in enumerate([text, text, "other text", "", None, "Write to some.body@example.org now"])]
    return spark.createDataFrame(rows + [rows[2], (None, text, None, *rows[0][3:])], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING))


def test_columns_of_any_name_pass(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [0, 2, 3, 4, 5, None]
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {0, 1, None}
    new = pii.with_surrogates(docs, "k")
    assert new.columns == [*docs.columns, "pii_"]
    rows = {r.doc_id: r for r in new.collect()}
    assert "some.body@" not in rows[5].text and rows[5].pii == CLASHING.index("pii").__str__() and len(rows[5].pii_) == 1 and rows[4].text is None


def test_join_counted_equals_a_join(spark):
    rng = random.Random(1)
    keys = [7] * 4000 + [rng.randint(100, 3000) for _ in range(4000)] + [None] * 5
    left = stored(spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "n int, k int"))
    right = stored(left.filter("k is not null and k % 3 <> 0").groupBy("k").agg(F.count("*").alias("c"), (F.first("k") * 2).alias("twice")))
    for how in ("left", "inner"):
        want = left.join(right.drop("c"), "k", how).select("k", "n", "twice")
        got = join_counted(left, right, "k", "c", how)
        assert got.columns == ["k", "n", "twice"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_the_filter_loses_nothing(spark):
    left = spark.range(20_000).select((F.col("id") * 3).alias("v")).union(spark.sql("select cast(null as long) as v"))
    right = spark.range(0, 60_000, 50).select(F.col("id").alias("w")).union(spark.sql("select cast(null as long) as w"))
    kept = likely_in(left, right, F.col("v"), F.col("w"))
    found = {r.v for r in kept.collect()}
    assert {v for v in range(0, 60_000, 150)} | {None} <= found and len(found) < 500
    assert likely_in(left, right.limit(0), F.col("v"), F.col("w")).count() == 0


def test_wide_pieces_are_placed_as_narrow_ones(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(1, 60), bytes(rng.randint(0, 50)), str(i)) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "id long, length long, ids binary, piece_number string").repartition(5)
    placed = packing.place_apart(pieces, 64)
    assert placed.columns == [*pieces.columns, "sequence_id", "offset"]
    found, filled = placed.collect(), {}
    assert sorted((r.id, r.length, bytes(r.ids), r.piece_number) for r in found) == rows
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 64
    assert len(filled) <= sum(r[1] for r in rows) / 64 * 1.02 + 1
    assert packing.place_apart(pieces.limit(0), 64).collect() == []
