import random

import duckdb

from logweave.llm import fixity as X
from logweave.llm.queries import ORACLES, QUERIES

SCHEMA = "file string, offset long, length long, digest string"


def found(spark, one, two, **sizes):
    a, b = (spark.createDataFrame(r, SCHEMA).selectExpr("*", "1 AS node", "'x' AS hash") for r in (one, two))
    return sorted((r.file, r.offset, r.kind) for r in X.audit(a, b, **sizes).collect())


def layout(files, n, seed=1):
    rnd = random.Random(seed)
    out = []
    for f in range(files):
        offset = 0
        for k in range(n):
            length = rnd.randint(1, 90)
            out.append((f"f{f}", offset, length, f"d{f}-{k}"))
            offset += length
    return out


def test_damage_is_found_where_it_is(spark):
    one = layout(3, 200)
    two = list(one)
    two[17] = (*one[17][:3], "rot")
    two[350] = (*one[350][:3], "rot")
    lost, stray, twice = one[120], ("f1", 1_000_003, 5, "stray"), one[333]
    two.remove(lost)
    two += [stray, twice]
    want = sorted([(*one[17][:2], "changed"), (*one[350][:2], "changed"), (*lost[:2], "missing"), ("f1", 1_000_003, "extra"), (*twice[:2], "repeated")])
    assert found(spark, one, two, range_bytes=100, fanout=3) == want
    assert found(spark, one, two) == want  # one leaf per file


def test_equal_empty_and_whole_files(spark):
    one = layout(2, 20)
    assert found(spark, one, one[::-1], range_bytes=64, fanout=2) == []
    assert found(spark, [], []) == []
    assert found(spark, one, [], range_bytes=64, fanout=2) == sorted((f, o, "missing") for f, o, _, _ in one)
    odd = [(None, 0, 1, "a"), ("f", None, 1, "b"), ("f", 0, None, "c"), ("f", 5, 1, None), ("f", 5, 1, None)]
    assert found(spark, odd, odd) == []
    assert found(spark, odd, odd[:-1]) == [("f", 5, "repeated")]
    assert found(spark, odd, odd[1:]) == [(None, 0, "missing")]


def test_only_differing_branches_are_read(spark):
    one = spark.createDataFrame(layout(4, 300), SCHEMA)
    levels = X.trees(one, 100, 4)
    counts = [t.count() for t in levels]
    assert counts[-1] == 4 and all(a > b for a, b in zip(counts, counts[1:]))


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    expected = con.execute(ORACLES["op8_merkle_fixity"])
    names = [c[0] for c in expected.description]
    got = QUERIES["op8_merkle_fixity"](spark, sf)
    assert sorted(tuple(str(r[n]) for n in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in expected.fetchall())
