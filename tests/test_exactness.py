"""Rewrites that must equal brute force, and results that must not depend on layout or skew."""
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions.similarity import char_classes, common_subsequence, ratio_join
from tagloom.operators import match as P, ordering as O, similar_images as S
from tagloom.operators.training import balanced_sample


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["smok", "novo", "xros", "vaporesso", "pod", "mini", "ring", "bolt", "zéta", "3", "5", "aa"]
    return sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(n)} | {"a" * 210 + "b"})


@pytest.mark.parametrize("least", [0.7, 0.556])
def test_ratio_join_misses_nothing(spark, least):
    left, right = texts(40, 1), texts(40, 2)
    want = {(a, b): r for a in left for b in right if (r := SequenceMatcher(None, a, b).ratio()) >= least}
    got = {(r.a, r.b): r.ratio for r in ratio_join(
        spark.createDataFrame([(t,) for t in left], "text string"),
        spark.createDataFrame([(t,) for t in right], "text string"), least).collect()}
    assert got == pytest.approx(want)


def test_ratio_join_in_small_cells_and_blocks(spark):
    rnd = random.Random(8)
    stems = ["pod kit mini", "long range bolt", "éclair zéta", "x" * 70 + " end", "q", "ring 5 amp with a name of more than sixty-four characters, all told"]
    vary = lambda s: "".join(c for c in s if rnd.random() > 0.12) + rnd.choice(["", " 2", "xx", "Ω"])
    left, right = (sorted({vary(rnd.choice(stems)) for _ in range(250)} - {""}) for _ in range(2))
    for least in (0.6, 0.7, 0.95):
        want = {(a, b): r for a in left for b in right if (r := SequenceMatcher(None, a, b).ratio()) >= least}
        got = ratio_join(*(spark.createDataFrame([(t,) for t in side] + [("",), (None,)], "text string") for side in (left, right)), least, cell=7, left_block=40, right_block=11)
        assert {(r.a, r.b): r.ratio for r in got.collect()} == pytest.approx(want)
    nothing = spark.createDataFrame([("",)], "text string")
    assert ratio_join(nothing, nothing, 0.7).collect() == []


def test_bounds_are_necessary():
    rnd = random.Random(3)
    a = ["".join(rnd.choices("abcde é", k=rnd.randint(1, 80))) for _ in range(60)]
    i, j = np.divmod(np.arange(3600), 60)
    bound = common_subsequence(char_classes(a), char_classes(a), i, j)
    for x, y, most in zip(i, j, bound):
        matched = sum(m.size for m in SequenceMatcher(None, a[x], a[y]).get_matching_blocks())
        assert matched <= most <= min(len(a[x]), len(a[y]))


def brute_match(left, right):
    def score(a, b):
        best, method = 0.0, None
        name = SequenceMatcher(None, a["n"], b["n"]).ratio() if a["n"] and b["n"] else 0
        brand = 0.0
        if a["b"] and b["b"]:
            br = SequenceMatcher(None, a["b"], b["b"]).ratio()
            brand = (br + SequenceMatcher(None, a["m"], b["m"]).ratio()) / 2 if a["m"] and b["m"] else br * 0.7
        image = 1.0 if a["i"] and a["i"] == b["i"] else 0.0
        common = set(a["s"]) & set(b["s"])
        spec = sum(a["s"][k] == b["s"][k] for k in common) / len(common) if common else 0
        for value, label, weight in ((name, "exact_name", 1.0), (brand, "brand_model", 0.9), (image, "image_hash", 0.8), (spec, "specifications", 0.7)):
            if value * weight > best:
                best, method = value * weight, label
        return best, method
    out = {}
    for a in left:
        top = (0.0, None, None)
        for b in right:
            s, m = score(a, b)
            if s > top[0]:
                top = (s, b["id"], m)
        if top[0] >= 0.70:
            out[a["id"]] = (round(top[0], 9), top[1], top[2])
    return out


def test_match_equals_brute_force(spark):
    rnd = random.Random(5)

    def rows(side, n):
        out = []
        for i in range(n):
            brand = rnd.choice(["SMOK", "Smoke", "Vaporesso", ""])
            title = rnd.choice(["Novo", "The Xros", "Xross kit", "Luxe", "Gen"]) + rnd.choice(["", " V5", " X3", " X4 mini", " pod"])
            out.append((f"{side}{i}", i, title, brand, rnd.choice(["", "u1", "u2"]), rnd.choice(["", "2ml", "2ml 20 w", "3ml"]), "c", "1", "u"))
        return out

    schema = "id string, ord long, title string, brand string, image_url string, description string, category string, price string, url string"
    none = F.create_map().cast("map<string,string>")
    l = spark.createDataFrame(rows("a", 40), schema).withColumn("specifications", none)
    r = spark.createDataFrame(rows("b", 30), schema).withColumn("specifications", none)

    def plain(df):
        cols = df.orderBy("ord").select("id", P.normalise_name(F.col("title")).alias("n"), P.normalise_name(F.col("brand")).alias("b"),
                                        P.model_number(F.col("title")).alias("m"), F.col("image_url").alias("i"),
                                        P.spec_map(F.col("specifications"), F.col("description")).alias("s"))
        return [x.asDict() for x in cols.collect()]

    want = brute_match(plain(l), plain(r))
    got = {x.left_id: (round(x.match_score, 9), x.right_id, x.match_method) for x in P.match_products(l, r).collect()}
    assert got == want


def images(spark, n=120, seed=3):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        h = rnd.choice(base)
        for _ in range(rnd.choice([0, 0, 2, 5, 8, 15])):
            h ^= 1 << rnd.randrange(64)
        rows.append((f"i{i}", f"s{i % 3}", i, h - (1 << 64) if h >= 1 << 63 else h))
    rows += [(f"copy{i}", f"s{i % 3}", n + i, rows[0][3]) for i in range(n // 2)]  # a third are copies
    return rows, spark.createDataFrame(rows, "image string, source string, ord long, hash long")


def apart(a, b):
    return bin((a ^ b) & (2 ** 64 - 1)).count("1")


@pytest.mark.parametrize("within", [0, 3, 6, 19])
def test_hash_pairs_miss_nothing(spark, within):
    rows, df = images(spark)
    first = {}
    for _, _, o, h in rows:
        first.setdefault(h, o)
    hs = sorted(first.items(), key=lambda x: x[1])
    want = {(o1, o2, apart(h1, h2)) for i, (h1, o1) in enumerate(hs) for h2, o2 in hs[i + 1:] if apart(h1, h2) <= within}
    got = [tuple(r) for r in S.hash_pairs(S.fold_copies(df), within).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_report_counts_every_pair(spark):
    rows, df = images(spark)
    want = sum(apart(a[3], b[3]) <= 19 for i, a in enumerate(rows) for b in rows[i + 1:])
    assert S.similarity_report(df).first().total_matches == want


def test_cross_source_counts(spark):
    rows, df = images(spark)
    want = sum(apart(a[3], b[3]) <= 6 and a[1] != b[1] for i, a in enumerate(rows) for b in rows[i + 1:])
    assert S.near_duplicates_across(df).agg(F.sum("pairs")).first()[0] == want


def test_every_image_pair_is_listed_with_copies(spark):
    rows, df = images(spark)
    at = {r[0]: r for r in rows}
    want = {(a[0], b[0], apart(a[3], b[3])) for i, a in enumerate(rows) for b in rows[i + 1:] if apart(a[3], b[3]) <= 19}
    assert any(d == 0 for _, _, d in want)
    for block in (2, S.BLOCK):
        got = [tuple(r) for r in S.image_pairs(df, block=block).select("image_1", "image_2", "distance", "source_1", "source_2").collect()]
        assert len(got) == len(want) and {r[:3] for r in got} == want
        assert all((s1, s2) == (at[a][1], at[b][1]) for a, b, _, s1, s2 in got)


def test_groups_equal_the_sequential_loop(spark):
    rows, df = images(spark)
    done, want = set(), set()
    for i, a in enumerate(rows):
        if a[0] in done:
            continue
        for b in rows[i + 1:]:
            if b[0] not in done and apart(a[3], b[3]) <= 6:
                want.add((a[0], b[0]))
                done.add(b[0])
        done.add(a[0])
    assert {tuple(r) for r in S.duplicate_groups(df).collect()} == want


def test_tiles_of_any_size_give_the_same(spark):
    _, df = images(spark)
    folded = S.cut(S.fold_copies(df))
    want = sorted(map(tuple, S.banded_pairs(folded, 9).collect()))
    for tile in (3, 50, 8192):
        assert sorted(map(tuple, S.tiled_pairs(folded, 9, tile).collect())) == want
        counted = {r.distance: r.pairs for r in S.distance_counts(folded, 9, tile).collect()}
        copies = {r.ord: r.copies for r in folded.collect()}
        by_distance = {}
        for a, b, d in want:
            by_distance[d] = by_distance.get(d, 0) + copies[a] * copies[b]
        assert counted == by_distance
    assert S.tiled_pairs(folded.limit(0), 19).collect() == [] and S.similarity_report(df.limit(0)).first().total_matches == 0


def greedy(edges):
    below, leads, follows = {}, set(), set()
    for a, b in edges:
        below.setdefault(b, []).append(a)
    for v in sorted({v for e in edges for v in e}):
        (follows if any(a in leads for a in below.get(v, [])) else leads).add(v)
    return follows


def test_followers_of_long_chains_and_any_batch(spark):
    chain = [(i, i + 1) for i in range(10_000)]
    rounds = []
    original, S.cut = S.cut, lambda df: rounds.append(1) or original(df)
    try:
        got = {r.ord for r in S.greedy_followers(spark.createDataFrame(chain, "ord_1 long, ord_2 long")).collect()}
    finally:
        S.cut = original
    assert got == greedy(chain) == set(range(1, 10_001, 2)) and len(rounds) <= 6
    rnd = random.Random(2)
    edges = sorted({tuple(sorted(rnd.sample(range(120), 2))) for _ in range(400)} | {(0, i) for i in range(1, 40)})
    frame = spark.createDataFrame(edges, "ord_1 long, ord_2 long")
    for batch in (30, 150):
        assert {r.ord for r in S.greedy_followers(frame, batch).collect()} == greedy(edges)


@pytest.mark.parametrize("parts", [1, 7, 32])
def test_positions_and_running_under_skew(spark, parts):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(parts)
    placed = O.positions(df, ["k"], [F.col("o")], F.floor(F.col("o") / 100))
    run = O.running(placed, ["k"], "idx", {"s": (F.col("v"), "sum"), "m": (F.when(F.col("v") == 6, F.col("idx")), "max")}, chunk=64)
    seen, sums, last = {}, {}, {}
    want = {}
    for k, o, v in rows:
        seen[k] = seen.get(k, 0) + 1
        sums[k] = sums.get(k, 0) + v
        last[k] = seen[k] if v == 6 else last.get(k)
        want[o] = (seen[k], sums[k], last[k])
    assert {r.o: (r.idx, r.s, r.m) for r in run.collect()} == want


def test_bounded_lists_split_hot_keys(spark):
    df = spark.createDataFrame([("hot", i) for i in range(25)] + [("cold", 1)], "k string, o long")
    got = O.bounded_lists(df, ["k"], [F.col("o")], F.floor(F.col("o") / 4), F.col("o"), "xs", limit=10).collect()
    assert {(r.k, r.part): r.xs for r in got} == {("hot", 0): list(range(10)), ("hot", 1): list(range(10, 20)), ("hot", 2): list(range(20, 25)), ("cold", 0): [1]}


def test_sample_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(f"h{i}", "big" if i % 4 else "small") for i in range(400)], "handle string, category string")
    picks = [sorted(r.handle for r in balanced_sample(df.repartition(n)).collect()) for n in (1, 5)]
    assert picks[0] == picks[1] and len(picks[0]) == 300


def test_first_rows_are_trimmed_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS o")
    plan = O.first_rows(df, ["k"], F.col("o"))._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
