"""Token alignment against a plain link-by-link version."""
import collections
import functools
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tagloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_level(first.get_vocab(with_added_tokens=True))


def plain_tokens(text):
    """Byte ranges and ids of both sides, or none."""
    first, second, table = libraries()
    want = b" " + text.encode()

    def ranges(ids, spell):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(spell(i)), i))
            at += len(spell(i))
        return out, b"".join(map(spell, ids))

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()
    a, said_a = ranges(first.encode(" " + text, add_special_tokens=False).ids, table.__getitem__)
    b, said_b = ranges(second.encode(text), piece)
    return (a, b) if said_a == said_b == want else ([], [])


def plain_rows(rows):
    tokens = [(i, *(plain_tokens(t) if t else ([], []))) for i, t in rows]
    links = [[(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] for _, a, b in tokens]
    counts = collections.Counter(pair for one in links for pair in one)
    best = {}
    for (_, b), c in counts.items():
        best[b] = max(best.get(b, 0), c)
    out = []
    for (i, a, b), own in zip(tokens, links):
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        text = ";".join(",".join(str(t) for _, e, t in a if low < e <= high) + "|" + ",".join(str(t) for _, e, t in b if low < e <= high)
                        for low, high in zip([0, *cuts], cuts))
        out.append((i, len(a), len(b), len(cuts), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def texts():
    rng = random.Random(4)
    words = ["Straße", "unbelievable", "naïve", "the", "of", "x" * 40, "東京", "😀", "\n\n", "  ", "<|endoftext|>", "<s>", "<0x41>", "don't", "3.14", "\t", "ﬁ", "é"]
    out = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return out + [out[0], out[0], "", None, " ", "a", "has ▁ in it", "tab\tand wide　space", "﻿mark", "nul \x00 byte", "<|endoftext|>", "long " * 700]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, 1, "s", 2.0) for i, t in enumerate(texts())]
    rows += [rows[3], (3, "another text", *rows[0][2:]), (None, "no id", *rows[0][2:]), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, scope int, slots string, n_a double").repartition(3)


@pytest.mark.parametrize("scope_bytes", [1, 1 << 25])
def test_rows_equal_the_plain_version(awkward, scope_bytes):
    out = alignment.align_tokens(awkward, A, B, scope_bytes=scope_bytes)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_rows([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty_table_and_tables_without_tokens(spark, awkward):
    assert alignment.align_tokens(awkward.limit(0), A, B).collect() == []
    none = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align_tokens(none, A, B).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_pointers_converge_on_long_chains():
    # tokens of two bytes, shifted by one: one chain of 20,000 tokens
    a = np.arange(2, 20_002, 2)
    b = np.concatenate([np.arange(1, 20_000, 2), [20_000]])
    to_a, to_b = alignment.terminals(a, b)
    assert set(to_a) == set(to_b) == {len(b) - 1}
    assert [x.tolist() for x in alignment.terminals(np.array([3, 5]), np.array([1, 3, 4, 5]))] == [[1, 3], [1, 1, 3, 3]]


def test_scopes_number_pairs_once():
    scope = alignment.Scope()
    assert scope.number(np.array([5, 9]), np.array([1, 2])).tolist() == [0, 1]
    assert scope.number(np.array([1, 5, 7, 12]), np.array([1, 1, 1, 1])).tolist() == [2, 0, 3, 4]
    (low, codes, links), = scope.rows()
    assert (low, codes.tolist(), links.tolist()) == (0, [5, 9, 1, 7, 12], [2, 2, 1, 1, 1])


def test_a_unit_is_encoded_once(monkeypatch):
    units, scope, said = alignment.Units(A, B), alignment.Scope(), []
    for side in units.sides:
        monkeypatch.setattr(side, "ids", lambda text, plain=side.ids: said.append(len(text)) or plain(text))
    rows = list(alignment.text_rows(units, [b"unbelievable words, words!"] * 500 + [b"words"], scope))
    assert sum(said) <= 2 * len(" unbelievable words,!")
    assert rows[0][0] > 0 and all(r == rows[0] for r in rows[:500])
    assert list(alignment.text_rows(units, [b"words words, unbelievable"], scope)) and sum(said) <= 2 * len(" unbelievable words,!")


@pytest.mark.parametrize("known_bytes, cuts", [(1, True), (alignment.KNOWN_BYTES, True), (1, False)])
def test_units_equal_whole_texts(monkeypatch, known_bytes, cuts):
    monkeypatch.setattr(alignment, "KNOWN_BYTES", known_bytes)
    rng = random.Random(6)
    atoms = [*"aZé9².,;:!?'()_|<>#$東ßﬁ", " ", "  ", "\n", "\n\n", "\t", "\r", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", "﻿", "▁", "\x00",
             "😀", "ख़", "'s", "<s>", "<0x0A>", "<|endoftext|>", "token", "});\r", "1,234.5", "x" * 5000 + "."]
    some = ["".join(rng.choices(atoms[:rng.choice([24, 28, len(atoms)])], k=rng.randint(1, 20))) for _ in range(600)]
    units, scope = alignment.Units(A, B), alignment.Scope()
    monkeypatch.setattr(units.sides[1], "cuts", cuts)
    rows = [r for at in range(0, 600, 50) for r in alignment.text_rows(units, [t.encode() for t in some[at:at + 50]], scope)]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(*p[1:5], p[7]) for p in (plain_rows([(0, t)])[0] for t in some)]
    assert known_bytes > 1 or len(units.known) < 1000
    none, whole = alignment.text_rows(units, [b"odd \xff byte", b"odd byte"], scope)
    assert none == (0, 0, 0, 0, "", 0, b"", b"") and whole[0] > 0
