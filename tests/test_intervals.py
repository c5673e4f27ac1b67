import random

import pytest

from varcluster.operators.intervals import joined_intervals, nearest_intervals


def intervals(seed, keys=3, most=400, n=60):
    r = random.Random(seed)
    starts = [(r.choice("abc"[:keys]), r.randrange(-most, most)) for _ in range(n)]
    return [(k, s, s + r.choice([0, 1, 5, 40])) for k, s in starts]


@pytest.mark.parametrize("cell", [7, 64, 1 << 12])
def test_union(spark, cell):
    rows = intervals(cell) + [(None, 1, 2), (None, 3, 9)]
    rows += rows[:5]
    want = []
    for k, s, e in sorted(rows, key=lambda x: (x[0] or "", x[1], x[2])):
        if want and want[-1][0] == k and s <= want[-1][2] + 1:
            want[-1][2] = max(want[-1][2], e)
        else:
            want.append([k, s, e])
    got = joined_intervals(spark.createDataFrame(rows, "k string, s int, e int"), "k", cell).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, want))


@pytest.mark.parametrize("cell", [7, 64, 1 << 12])
def test_nearest(spark, cell):
    rows = intervals(cell, keys=2)
    places = sorted({(k, a) for k in "abc" for a in range(-500, 500, 3)})
    got = nearest_intervals(spark.createDataFrame(rows, "k string, s int, e int"), spark.createDataFrame(places + places[:9] + [(None, 1)], "k string, at int"), "k", cell).collect()
    gap = lambda a, s, e: 0 if s <= a <= e else min(abs(s - a), abs(e - a))
    want = [(k, a, *min((gap(a, s, e), s, e) for q, s, e in rows if q == k)) for k, a in places if any(q == k for q, _, _ in rows)]
    assert sorted(map(tuple, got)) == want


def test_nothing(spark):
    empty, some = spark.createDataFrame([], "k string, s int, e int"), spark.createDataFrame([("a", 1)], "k string, at int")
    assert joined_intervals(empty, "k").count() == 0 and nearest_intervals(empty, some, "k").count() == 0


def test_orders_without_a_date(spark, tmp_path):
    """They join their customer's last interval, or stand alone where it has none, as in the SQL; so do those of no customer."""
    import duckdb

    from varcluster.jobs.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    rows = [(1, "1995-01-01"), (1, None), (1, None), (1, "1995-03-30"), (1, "1995-01-12"), (2, None), (2, None), (3, None), (4, "1989-12-31"), (4, "1990-01-21"), (None, None), (None, "1996-02-29"), (None, "1996-03-22")]
    con.sql("create table orders (o_custkey bigint, o_orderdate timestamp)")
    con.executemany("insert into orders values (?, ?)", rows)
    con.sql(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    want = con.sql(ORACLE_SQL["interval_union"]).fetchall()
    got = QUERIES["interval_union"](spark, str(tmp_path)).select("o_custkey", "s", "e").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r for r in want if r[0] == 2] == [(2, None, None)] * 2 and sum(r[0] == 1 for r in want) == 2


def test_a_place_that_is_null_masks_nothing(spark):
    rows = [("a", 1, 4), ("a", None, None), ("a", 5, 6), ("b", None, None)]
    assert [tuple(r) for r in joined_intervals(spark.createDataFrame(rows, "k string, s int, e int"), "k").collect()] == [("a", 1, 6)]
