import re
from collections import Counter
from itertools import permutations

import numpy as np

from varcluster.llm.filter_audit import FILTERS, RESULT, audit, cells, filter_audit, survivors


def brute(docs, labels):
    """Applies every order document by document."""
    say = {}
    for i, q, t in labels:
        if i is not None:
            g = say.setdefault(i, [False, False])
            g[0] |= q == 1
            g[1] |= t == 1
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((source or "", {f for f in FILTERS if fails[f]}, *say.get(i, (False, False))))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations(FILTERS)):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(removed)
                out.append([part, order, step, len(left), len(removed), sum(f in r[1] for r in gone), sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in removed), sum(r[3] for r in removed)])
                gone += removed
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(*[c.split()[0] for c in RESULT.split(", ")]).collect())


def test_every_order_by_brute_force(spark, awkward, clash_columns):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [(i, t, ("a", "b", None, "")[i % 4]) for i, t in awkward]
    docs += [(60, long, "a"), (61, long, "b"), (61, long, "b"), (62, long + " #", "a"), (63, long.upper(), "a"), (64, long, None), (None, long, "a"), (None, None, None), (65, "w " * 300, "a"), (66, "w " * 300 + "#X" * 200, "b"), (67, long + " AB", "c")]
    labels = [(60, 1, 0), (61, 0, 1), (61, 1, 0), (62, 1, 1), (64, None, 1), (None, 1, 1), (999, 1, 1), (66, 0, None), (51, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for c in [*clash_columns, "part", "mask", "digest", "often", "least", "good", "toxic", "n", "cells"]:
        if c not in d.columns:
            d = d.withColumn(c, d.doc_id)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit(d, lab)) == brute(docs, labels)


def test_a_hot_text_and_an_empty_table(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}", f"s{i % 2}") for i in range(3000)]
    d, none = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit(d, none).collect()}
    first = got["s0", "EABCD", 1]
    assert (first["removed"], first["kept"], first["unique_fails"]) == (1000, 500, 0) and got["s1", "EABCD", 1]["removed"] == 999 and len(got) == 1200
    assert filter_audit(d.limit(0), none).count() == 0


def test_any_number_of_filters(spark):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, (2, 8))
    masks = np.arange(8)
    assert all((survivors(counts, 3)[..., s] == counts[:, (masks & s) == 0].sum(axis=1)).all() for s in range(8))
    rows = spark.createDataFrame([("p", 1, 5, 2, 0), ("p", 3, 7, 0, 1), ("p", 0, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit(rows, "XY").collect()}
    assert got == {("XY", 1): (1, 12, 0, 5, 2, 1, 17), ("XY", 2): (1, 0, 7, 0, 0, 0, 7), ("YX", 1): (6, 7, 0, 0, 0, 1, 7), ("YX", 2): (1, 5, 7, 5, 2, 0, 17)}
    assert cells(spark.createDataFrame([(1, "p", 2)], "id long, part string, mask int"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()[0][2:] == (1, 0, 0)
