"""The filter interaction audit against brute force on awkward tables."""
import itertools
import re

import pytest

from tagloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows, labels):
    """All rows by the definition: filter after filter, document after document."""
    lows = {}
    for id_, text, _ in rows:
        if id_ is not None:
            lows[text or ""] = min(lows.get(text or "", id_), id_)
    documents = []
    for id_, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": id_ is not None and id_ > lows[text]}
        marks = [(q, t) for i, q, t in labels if i == id_ and id_ is not None]
        documents.append((part or "", fails, any(q == 1 for q, _ in marks), any(t == 1 for _, t in marks)))
    out = {}
    for part in {d[0] for d in documents}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in documents if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = [d for d in documents if d[0] == part and d[1][f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    shapley = {}
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + row[1]
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items())


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{i}" for i in range(80))
    texts = [long, long, "short", "short", "", None, "  \n", long + " #", long.upper(), " ".join(["same"] * 200), "A B C $ A B", "ÀÉ " * 60, "x| " * 90, long + " tail",
             " ".join(f"w{i % 900}" for i in range(400_000))]
    rows = [(i, t, [None, "", "src", "other"][i % 4], 1, 2, "p", "h", True) for i, t in enumerate(texts)]
    rows += [rows[1], (1, "another text", *rows[1][2:]), (None, "short", *rows[2][2:]), (None, None, None, *rows[2][3:])]
    rows += [(100 + i, long, "copies", *rows[0][3:]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, filter int, prefix int, part string, h string, A boolean")


def test_rows_equal_brute_force(spark, awkward):
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (7, 1, 0), (9, 0, 1), (103, 1, 1), (None, 1, 1), (5000, 1, 0), (8, None, None)]
    frame = spark.createDataFrame([(*row, "x") for row in labels], "doc_id long, quality int, toxic int, part string")
    out = filter_audit.audit(awkward, frame)
    assert sorted(map(tuple, out.collect())) == plain_audit([(r.doc_id, r.text, r.source) for r in awkward.collect()], labels)
    assert out.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]


def test_without_labels_or_documents(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(awkward.limit(3), none).collect()
    assert out and all(r.good_lost == r.toxic_lost == 0 for r in out)
    assert filter_audit.audit(awkward.limit(0), none).collect() == []
