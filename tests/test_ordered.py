"""Looking back and ahead, against a plain loop, on rows where one key and one instant are hot."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import ordered
from fleetpulse.operators.ordered import CHUNK, Look, cut, look
from fleetpulse.operators.sizing import written

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for seq in range(600):
        key = "hot" if seq % 3 else f"k{seq % 8}"
        # A third of all rows share one instant.
        ts = START + timedelta(minutes=90 if rng.random() < 0.34 else rng.randrange(600))
        out.append((key, ts, seq, rng.choice([None, None, seq])))
    return out


def expected(rows, inclusive, ahead):
    found = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=ahead)
        last = None
        for _, _, seq, value in mine:
            here = value if value is not None else last
            found[seq] = here if inclusive else last
            last = here
    return found


# Beyond every key; above the hot key; above the hot hour.
@pytest.mark.parametrize("most, chunks", [(1000, 1), (250, 9), (40, 9)])
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("ahead", [True, False])
def test_nearest(spark, limits, rows, most, chunks, inclusive, ahead):
    limits(rowsPerTask=most)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int, v int").repartition(5)
    got = look(df, ["key"], ["ts", "seq"], Look("near", F.col("v"), inclusive, ahead))
    assert got.columns == ["key", "ts", "seq", "v", "near"]
    assert {r.seq: r.near for r in got.collect()} == expected(rows, inclusive, ahead)


def test_several_looks(spark, limits, rows):
    limits(rowsPerTask=40)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int, v int")
    got = look(df, ["key"], ["ts", "seq"], Look("a", F.col("v")), Look("b", F.col("v"), False, True)).collect()
    assert {r.seq: r.a for r in got} == expected(rows, True, False)
    assert {r.seq: r.b for r in got} == expected(rows, False, True)


def test_pieces_are_even_and_whole(spark, limits, rows):
    limits(rowsPerTask=40)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int, v int")
    found = cut(df, ["key"], ["ts", "seq"])
    sizes = [r["count"] for r in found.rows.groupBy(CHUNK, "key").count().collect()]
    assert found.chunked and not found.null_keys and sum(sizes) == len(rows) and max(sizes) <= 80


@pytest.mark.parametrize("most, hot_hour", [(40, True), (250, False)])
def test_only_what_is_hot_is_cut(spark, limits, rows, monkeypatch, most, hot_hour):
    """One hour of one key is above the limit: no other row is range-partitioned, and keys within the
    limit stay whole."""
    dealt = []

    def kept(df, name):
        out = written(df, name)
        if name == "ordered":
            dealt.append(out)
        return out

    monkeypatch.setattr(ordered, "written", kept)
    limits(rowsPerTask=most)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq int, v int").repartition(5)
    found = cut(df, ["key"], ["ts", "seq"]).rows
    per_hour = Counter((r[0], r[1].replace(minute=0)) for r in rows)
    heavy = {k for k, n in per_hour.items() if n > most}
    assert len(dealt) == hot_hour and bool(heavy) == hot_hour
    if hot_hour:
        moved = {(r.key, r.ts.replace(minute=0)) for r in dealt[0].collect()}
        assert moved == heavy and dealt[0].count() == sum(per_hour[k] for k in heavy) < len(rows)
    per_key = Counter(r[0] for r in rows)
    chunks = {r.key: r.n for r in found.groupBy("key").agg(F.countDistinct(CHUNK).alias("n")).collect()}
    assert all((chunks[k] == 1) == (n <= most) for k, n in per_key.items())
    assert found.count() == len(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "key string, ts timestamp_ntz, seq int, v int")
    assert look(df, ["key"], ["ts", "seq"], Look("near", F.col("v"))).count() == 0


@pytest.mark.parametrize("most", [1000, 250, 40])
def test_null_keys_are_a_key(spark, limits, rows, most):
    limits(rowsPerTask=most)
    df = spark.createDataFrame([(None if k == "hot" else k, *rest) for k, *rest in rows], "key string, ts timestamp_ntz, seq int, v int")
    got = look(df, ["key"], ["ts", "seq"], Look("near", F.col("v")))
    assert {r.seq: r.near for r in got.collect()} == expected(rows, True, False)
