import math

import numpy as np
from pyspark.sql import functions as F

from varcluster.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def test_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 700)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    x = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), F.col("id") % 20 == 0, shortlist=200).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit, y = 0, x.astype(float)
    for q in range(0, 3000, 20):
        s = y @ y[q]
        s[q] = -math.inf
        best = set(np.argsort(-s, kind="stable")[:20].tolist())
        rows = sorted(lists[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in rows)
        hit += len(best & {v for _, v, _ in rows})
    assert hit / (150 * 20) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [math.nan, 1.0]), (6, [None, 1.0]), (7, [math.inf, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", id int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_copies_take_one_place_of_the_shortlist(spark):
    rng = np.random.default_rng(3)
    hot = rng.normal(size=8)
    hot /= np.linalg.norm(hot)
    # the copies are nearest to query 0 but for three vectors that are nearer still
    near = [(2000 + i, (hot * (1.2 + i / 10)).tolist()) for i in range(3)]
    rows = [(i, hot.tolist()) for i in range(1000)] + near + [(3000 + i, (rng.normal(size=8) * 0.1).tolist()) for i in range(100)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "vec_id long, embedding array<double>").repartition(4)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(df, F.col("id").isin(0, 500, 3000), shortlist=30).collect())
    assert [v for q, _, v in got if q == 0] == [2002, 2001, 2000, *range(1, 18)]
    assert [v for q, _, v in got if q == 500] == [2002, 2001, 2000, *range(17)]
    assert len([v for q, _, v in got if q == 3000]) == 20


def test_structured_vectors_are_found_in_few_cells(spark, monkeypatch):
    """Clusters: a query reads a part of the lists. Random directions: nearly all."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    cells = ann.fit_cells(x, 32)
    assert cells.probes <= 8 and ann.fit_cells(rng.normal(size=(2000, 64)), 32).probes > 16
    assert ann.fit_cells(x[:1], 5).probes == 1
    monkeypatch.setattr(ann, "CODE_BLOCK", 125)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0, shortlist=60).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 4000, 100):
        s = x @ x[q]
        s[q] = -math.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (40 * 20) >= 0.9


def test_refitted_words_are_nearer():
    x = np.random.default_rng(4).normal(size=(800, 12))
    error = lambda m: ((x - m.decode(m.encode(x))) ** 2).sum()
    assert error(ann.fit(x, 4, 16, refits=2)) < error(ann.fit(x, 4, 16, refits=0))


def test_very_unequal_norms(spark, monkeypatch):
    """The nearest are the longest vectors, of which the codebooks have seen few."""
    monkeypatch.setattr(ann, "MAX_TRAINING", 1500)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12000, 48)) * np.exp(2 * rng.normal(size=(12000, 1)))
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("id") % 200 == 0, shortlist=60).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 12000, 200):
        s = x @ x[q]
        s[q] = -math.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (60 * 20) >= 0.97
