"""SimHash near-duplicates against brute force."""
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius):
    """{row number: least id reachable} over rows (id, fingerprint)."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
            up[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(least.get(root(i), id_), id_)
    return [least.get(root(i)) for i in range(len(rows))]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Der", "éclair", "of", "blue.", "SEA", "x"]) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    base = prose(1, 2000).split()
    texts = [" ".join(base), " ".join(base), *[" ".join(base[:k] + ["changed"] + base[k + 1:]) for k in (10, 500, 900)], prose(2, 80),
             "", None, " \n\t", "one", "ONE", "two words", "a b c d", "A  b\nc\x0bd", "a b c d a b c d", "x " * 300, "x " * 3000, "İ ÄÖ wide space", prose(3, 70_000)]
    rows = [(i, t, "f", "block", "bucket", "label", 1.5) for i, t in enumerate(texts)]
    rows += [rows[5], (5, "another text with the same id", *rows[0][2:]), (None, texts[0], *rows[0][2:]), (None, "alone and without id", *rows[0][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, f string, block string, bucket string, label string, rows double")


def test_rows_equal_brute_force(spark, awkward):
    plain = [(r.doc_id, plain_fingerprint(r.text)) for r in awkward.collect()]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(plain, plain_components(plain, 4))), key=repr)
    out = simhash.near_duplicates(awkward)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert simhash.near_duplicates(awkward.limit(0)).collect() == []


def test_covering_masks_meet_every_pair_within_the_radius():
    for radius in (1, 2, 3, 4):
        found = simhash.masks(radius)
        assert len(found) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(5000):
            differing = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(mask & differing == 0 for mask in found)
    # exact for the radius in use: no set of four positions meets all masks
    bits = np.array([[m >> b & 1 for b in range(64)] for m in simhash.masks(4)], bool)
    for a, b in itertools.combinations(range(64), 2):
        rest = bits[~(bits[:, a] | bits[:, b])]
        assert (rest[:, :, None] | rest[:, None, :]).all(0).sum() == 0


def test_links_connect_what_pairs_connect_in_any_block_size(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(3)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for c in centre for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in values)
    frame = spark.createDataFrame([(v,) for v in values], "f long")
    want = plain_components([(v, v % 2**64) for v in values], 4)
    for block in (4, 32, 2048):
        links = [(r.a, r.b) for r in simhash.near_links(frame, 4, block).collect()]
        at = {v: i for i, v in enumerate(values)}
        root = simhash.roots(len(values), np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]))
        assert [values[r] for r in root] == want


def test_copies_in_another_case_or_spacing_share_a_component(spark):
    upper = str.maketrans({chr(i): chr(i - 32) for i in range(97, 123)})
    rows = []
    for i in range(20):
        words = prose(100 + i, 800).split()
        rows += [(10 * i, " ".join(words)), (10 * i + 1, "\n".join(words)), (10 * i + 2, " ".join(words).translate(upper))]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == i - i % 10 for i in out)
