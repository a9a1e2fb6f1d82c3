import numpy as np
import pytest

from logweave.llm import neighbours as N


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)
        out[q] = near[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS list", "'x' AS score").repartition(4)


def run(spark, rows, queries, k=10, **more):
    found = N.search(frame(spark, rows), frame(spark, queries), k=k, **more).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def floats(x):
    return [float(v) for v in np.float32(x)]


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, floats(rng.normal(size=8))) for i in range(12)]
    rows += [(100, rows[3][1]), (101, rows[3][1])]  # ties
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] + [0.0] * 6), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, [1.0]), (206, []), (None, rows[0][1])]
    queries = [rows[0], rows[3], (100, rows[3][1]), *bad]
    index = N.Index(8, np.zeros((1, 8)), np.eye(8), 1, np.zeros((0, 8)), np.zeros(0, np.int64))
    assert run(spark, rows + bad, queries, k=20, index=index) == brute(rows, queries[:3], 20)
    assert run(spark, rows + bad, queries, k=20) == brute(rows, queries[:3], 20)
    assert run(spark, rows[:1], rows[:1]) == {}
    assert run(spark, [], []) == {}
    assert run(spark, bad, bad[:-1] + [rows[0]])== {}


def test_recall_with_a_common_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, floats(rng.normal(size=32))) for i in range(2500)]
    rows += [(10_000 + i, rows[7][1]) for i in range(1200)]  # a third of all rows
    queries = rows[:2500:100] + [rows[7]]
    got, want = run(spark, rows, queries), brute(rows, queries, 10)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    exact = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, v in got.items() for s, i in v if (q, i) in exact)
    assert [i for _, i in got[7]] == list(range(10_000, 10_010))


@pytest.mark.parametrize("count", [2, 5, 10, 12, 60, 100])
def test_the_default_index_is_exact_on_few_rows(spark, count):
    rng = np.random.default_rng(count)
    rows = [(i, floats(rng.normal(size=16))) for i in range(count)]
    assert run(spark, rows, rows) == brute(rows, rows, 10)


def test_rows_with_the_own_id_do_not_crowd_out_others(spark, monkeypatch):
    """All near rows have the query's id; the others are far away, in lists that are not probed at first."""
    monkeypatch.setattr(N, "LEAST_CANDIDATES", 50)
    rng = np.random.default_rng(4)
    rows = [(7, floats(rng.normal(size=8) * 0.01)) for _ in range(600)] + [(100 + i, floats(20 + rng.normal(size=8))) for i in range(15)]
    index = N.Index(8, np.array([np.zeros(8), np.full(8, 20.0)]), np.eye(8), 1, np.zeros((0, 8)), np.zeros(0, np.int64))
    least = (7, min(v for i, v in rows if i == 7))
    assert run(spark, rows, [least], index=index) == brute(rows, [least], 10)


def test_probes_are_measured():
    """Few lists for vectors in clusters, many for those without."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 32)) * 10
    clustered = centres[rng.integers(40, size=4000)] + rng.normal(size=(4000, 32))
    plain = rng.normal(size=(4000, 32))
    probes = []
    for found in (clustered, plain):
        index = N.Index(32, found[rng.permutation(4000)[:60]], np.eye(32), 1, found[:10], np.arange(10))
        probes.append(N._probes(index, found, 10, rng))
    assert probes[0] <= 6 < 20 < probes[1] <= 60


def test_bounds_are_never_too_small():
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(300, 8))
    index = N.Index(8, rows[:1], np.eye(8), 1, rows[:100], np.arange(100))
    bounds = index.bounds(np.arange(300), rows, 5)
    for i in range(300):
        exact = sorted(((rows - rows[i]) ** 2).sum(axis=1)[np.arange(300) != i])
        assert bounds[i] >= exact[4] - 1e-12
    assert np.isinf(index.bounds(np.arange(3), rows[:3], 200)).all()


def test_fewer_distances_with_a_bound():
    rng = np.random.default_rng(7)
    block = rng.normal(size=(512, 64))
    query = rng.normal(size=64)
    exact = np.sort(((block - query) ** 2).sum(axis=1))
    kept = len(N.scan(block, block, query, query, 11)[0])
    assert len(N.scan(block, block, query, query, 11, exact[3])[0]) < kept


def test_scan_gives_up_far_candidates():
    rng = np.random.default_rng(3)
    block = np.r_[rng.normal(size=(50, 64)) * 0.1, rng.normal(size=(500, 64)) * 3]
    rotation, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    query = np.zeros(64)
    kept, distance = N.scan(block, block @ rotation, query, query @ rotation, 10)
    assert len(kept) < 100 and np.allclose(distance, np.sqrt((block[kept] ** 2).sum(axis=1)))


def test_recall_on_the_driver_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    queries = [r for r in rows if r[0] % 100 == 0]
    got = {}
    for r in N.search(table, table.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, queries, 10)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) / 10 / len(want) >= 0.9
