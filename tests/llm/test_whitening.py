import numpy as np

from logweave.llm import whitening as W


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.selectExpr("*", "1 AS id", "'x' AS x", "2 AS part", "3 AS place", "4 AS block", "0D AS whitened", "'n' AS n").repartition(parts)


def brute(rows, k):
    """Of each row in order (id, deviation, whitened), the shares of variance, and n."""
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    apart = n * x - sums
    deviation = [int(sum(e * e for e in row)) for row in apart]
    centred = (apart / n).astype(float)
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = [i for i in np.argsort(-values)[:k] if values[i] > values.max() * 1e-12]
    return deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance), n


def check(spark, rows, valid, k=8, parts=3):
    got = W.whiten(frame(spark, rows, parts), k).collect()
    deviation, whitened, explained, n = brute(valid, k)
    assert len(got) == len(valid) * len(explained)
    assert {r.n for r in got} == {n}
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
        assert r.identity_error < 1e-6
    expected = {}
    for (id, _), d, w in zip(valid, deviation, whitened, strict=True):
        for c, value in enumerate(w, 1):
            expected.setdefault((id, d), {}).setdefault(c, []).append(value)
    assert by_row.keys() == expected.keys()
    for c in range(1, len(explained) + 1):
        pairs = [(a, b) for key in expected for a, b in zip(sorted(by_row[key][c], key=abs), sorted(expected[key][c], key=abs), strict=True)]
        a, b = map(np.array, zip(*pairs, strict=True))
        sign = np.sign(a[np.argmax(np.abs(a))] * b[np.argmax(np.abs(a))])
        assert np.allclose(a, sign * b, atol=1e-6)


def floats(x):
    return [float(v) for v in np.float32(x)]


def test_against_brute_force_over_several_blocks(spark):
    rng = np.random.default_rng(1)
    scale = np.array([5, 4, 3, 2.5, 2, 1.5, 1, 0.7, 0.5, 0.3])
    rows = [(i, floats(rng.normal(size=10) * scale)) for i in range(2500)]
    rows += [(10_000 + i, rows[7][1]) for i in range(1250)]  # a third is one vector
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1])]
    bad = [(20_000, None), (20_001, [1.0, None] + [0.0] * 8), (20_002, [float("nan")] * 10), (20_003, [float("inf")] * 10), (20_004, [1.0]), (20_005, []), (20_006, [1e30] + [0.0] * 9)]
    zero = [(30_000, [0.0] * 10)]
    check(spark, rows + bad + zero, rows + zero, parts=7)


def test_fewer_dimensions_and_a_constant_one(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [*floats(rng.normal(size=3) * [3, 2, 1]), 7.0]) for i in range(60)]
    check(spark, rows, rows)
    check(spark, rows, rows, k=2)


def test_more_columns_than_a_block_has(spark):
    rng = np.random.default_rng(3)
    rows = [(i, floats(rng.normal(size=1100) * np.linspace(3, 1, 1100))) for i in range(12)]
    check(spark, rows, rows, k=3, parts=1)


def test_large_entries_stay_exact(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [-(2.0**41), 2.0]), (2, [5.0, 3.0])]
    check(spark, rows, rows, k=1)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        found = W.whiten(frame(spark, rows))
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert found.count() == 0


def test_the_longer_of_equally_frequent_lengths(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [1.0, 5.0]), (3, [2.0, 3.0])]
    assert {r.vec_id for r in W.whiten(frame(spark, rows)).collect()} == {2, 3}


def test_the_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    check(spark, rows, rows)
