"""Ordered operators against brute force, with chunks far smaller than a file."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import joins, ordered
from logweave.operators.joins import join_checked, stage
from logweave.operators.ordered import Running, first_rows, number_rows, running, with_distance


@pytest.fixture(scope="module")
def rows():
    """One key holds half of all rows; line numbers have gaps."""
    rng = random.Random(7)
    out = []
    for key, size in (("hot", 400), ("b", 150), ("c", 7), ("d", 1)):
        numbers = sorted(rng.sample(range(1, size * 3), size))
        out += [(key, n, rng.random() < 0.04, rng.randrange(100)) for n in numbers]
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, line_no bigint, sel boolean, v bigint")


def test_number_rows_over_ranges(spark, rows, frame):
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted(((r[3], r[1]) for r in rows if r[0] == key))
        expected |= {(key, *pair): i for i, pair in enumerate(mine, 1)}
    for limit in (20, 10**6):
        got = number_rows(frame, ["k"], ["v", "line_no"], "no", rows_per_range=limit).collect()
        assert {(r.k, r.v, r.line_no): r.no for r in got} == expected


def test_running(rows, frame):
    scans = [
        Running("total", "sum", F.col("v")),
        Running("high", "max", F.col("v"), inclusive=False),
        Running("low", "min", F.col("v"), backward=True),
        Running("later", "min", F.struct("line_no", "v"), backward=True, inclusive=False),
    ]
    got = running(frame, ["k"], scans, lines=16).collect()
    assert len(got) == len(rows)
    by_key = {}
    for r in sorted(rows):
        by_key.setdefault(r[0], []).append(r)
    for r in got:
        mine = by_key[r.k]
        i = [x[1] for x in mine].index(r.line_no)
        values = [x[3] for x in mine]
        assert r.total == sum(values[: i + 1])
        assert r.high == (max(values[:i]) if i else None)
        assert r.low == min(values[i:])
        assert (r.later and tuple(r.later)) == (mine[i + 1][1::2] if i + 1 < len(mine) else None)


@pytest.mark.parametrize("before, after", [(0, 0), (3, 0), (0, 5), (2, 4), (40, 40)])
def test_with_distance(rows, frame, before, after):
    got = {(r.k, r.line_no) for r in with_distance(frame, ["k"], "sel", before, after, lines=8).collect()}
    expected = set()
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        for i, r in enumerate(mine):
            if r[2]:
                expected |= {(key, x[1]) for x in mine[max(0, i - before) : i + after + 1]}
    assert got == expected


@pytest.mark.parametrize("n", [1, 5, 1500])
def test_first_rows(rows, frame, n, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK_LINES", 16)
    got = {(r.k, r.line_no) for r in first_rows(frame, ["k"], n).collect()}
    expected = set()
    for key in {r[0] for r in rows}:
        expected |= {(key, r[1]) for r in sorted(r for r in rows if r[0] == key)[:n]}
    assert got == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_beyond_the_broadcast_limit(spark, frame, how):
    """A hot key is split and rows without key are spread; the rows stay the same."""
    frame = frame.unionByName(frame.withColumn("k", F.lit(None).cast("string")).limit(50))
    right = spark.createDataFrame([("hot", 1), ("c", 2), ("zz", 3)], "k string, w int")
    small = join_checked(frame, right, ["k"], how)
    large = join_checked(frame, right, ["k"], how, broadcast_rows=1, hot_rows=30)
    assert large.columns == small.columns
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_hot_key_is_spread(frame):
    salted = frame.filter("k = 'hot'").select(F.pmod(joins.row_hash(frame, ["k"]), F.lit(8)).alias("s"))
    counts = [r["count"] for r in salted.groupBy("s").count().collect()]
    assert len(counts) == 8 and max(counts) < 120
    assert sorted(salted.collect()) == sorted(salted.collect())


def test_drop_stages(spark):
    import pathlib

    stage(spark.range(3)).count()
    folder = pathlib.Path(joins._stage_dir(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    joins.drop_stages(spark)
    assert not folder.exists()


def test_stage_keeps_types(spark):
    df = spark.sql("SELECT map('a', '1', 'b', null) AS m, timestamp_ntz '2024-01-01 00:00:00' AS t, array(1) AS a")
    assert stage(df).collect() == df.collect()
    assert stage(df).dtypes == df.dtypes


def test_cluster_without_shared_folder_is_refused(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        joins.checkpoint_dir(Session())
