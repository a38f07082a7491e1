"""Target names beside a loop that gives them one after another."""
import pathlib
import random

from tagloom.operators.assets import unique_names


def one_by_one(files, longest):
    taken, out = set(), []
    for category, name, order in sorted(files, key=lambda f: f[2]):
        if name is None:
            out.append((category, name, order, None))
            continue
        path, n = pathlib.PurePosixPath(name), 1
        while len(path.name) <= longest and (category, path.name) in taken:
            path, n = path.with_name(f"{path.stem}_{n}{path.suffix}"), n + 1
        target = path.name if len(path.name) <= longest else None
        if target:
            taken.add((category, target))
        out.append((category, name, order, target))
    return sorted(out, key=repr)


def check(spark, files, longest):
    got = unique_names(spark.createDataFrame(files, "category string, name string, ord long").repartition(3), longest)
    assert sorted(map(tuple, got.collect()), key=repr) == one_by_one(files, longest)


def test_names_that_look_like_tries(spark):
    rng = random.Random(3)
    ends = ["", "_1", "_1_2", "_1_1", "_1_2_3", "_1_1_1", "_1_1_2", "_2", "_01", "_1_2_1", "_1_2_3_4", "_1_2_1_2"]
    files, order = [], list(range(700))
    rng.shuffle(order)
    for i in order:
        category = rng.choice(["logo", "pack", None])
        files.append((category, rng.choice(["a", "b.c", ".d"]) + rng.choice(ends) + rng.choice([".png", ".png", ""]), i))
    files += [("pack", None, 900), ("pack", None, 901), ("pack", "_1.png", 902), ("pack", "_1.png", 903), ("pack", ".png", 904), ("pack", ".png", 905)]
    check(spark, files, 255)
    check(spark, files, 14)


def test_chains_copies_and_none(spark):
    chain = [("c", "a" + "_1" * n + ".png", 100 - n) for n in range(60)] + [("c", "a" + "_1" * n + ".png", 200 + n) for n in range(60)]
    check(spark, chain, 255)
    check(spark, [("c", "same.png", i) for i in range(300)], 255)
    check(spark, [("c", "a.png", 1), ("c", "a_1.png", 2), ("c", "a.png", 3)], 255)
    assert unique_names(spark.createDataFrame([], "category string, name string, ord long")).count() == 0
