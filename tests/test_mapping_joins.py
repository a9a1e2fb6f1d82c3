"""Values are looked up alike whether the names are broadcast or shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.regex import to_java
from logweave.operators import mapping
from logweave.operators.headers import parse_headers
from logweave.operators.rules import apply_rules
from logweave.packs import dovecot, sshd

APPS = [sshd.APP, dovecot.APP]


@pytest.fixture(scope="module")
def parsed(spark):
    rng = random.Random(1)
    rows = []
    for n in range(400):
        client = "10.0.0.1" if n % 3 == 0 else f"10.0.{n % 7}.{n % 11}"  # a third is one value
        fields = {"client": client, "user": rng.choice(["ann", "7", "42", None, "x 10.0.0.1"]), "uid": rng.choice(["7", "8", None]), "thread": str(n % 50)}
        rows.append((n // 2, n % 5 > 0, rng.choice(["h1", "h2", None]), str(n % 50), fields if n % 10 else {}, f"line {n}"))
    rows += [rows[3]] * 3  # equal lines stay apart
    schema = "line_no long, matched boolean, host string, thread string, fields map<string,string>, raw string"
    return spark.createDataFrame(rows, schema)


def as_rows(df):
    flat = df.withColumn("fields", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields")))))
    return sorted(map(str, flat.select(sorted(flat.columns)).collect()))


def test_masking_alike(parsed, monkeypatch):
    want = as_rows(mapping.mask_fields(parsed, APPS))
    assert len(want) == 403 and any("CLIENT_0001" in r for r in want)
    assert as_rows(mapping.mask_fields(parsed, APPS, broadcast_rows=0)) == want


@pytest.mark.parametrize("which", ["addresses", "users"])
def test_names_alike(spark, parsed, which):
    if which == "addresses":
        table = spark.createDataFrame([(f"10.0.{n % 7}.{n}", f"host-{n}") for n in range(9)] + [("10.0.0.1", "z"), ("10.0.0.1", "a")], "address string, name string")
        run = mapping.name_addresses
    else:
        table = spark.createDataFrame([(7, "seven"), (42, "b"), (42, "a")], "uid int, name string")
        run = mapping.name_uids
    want = as_rows(run(parsed, APPS, table))
    assert as_rows(run(parsed, APPS, table, broadcast_rows=0)) == want


def test_both_names_alike(spark, parsed, monkeypatch):
    addresses = spark.createDataFrame([("10.0.0.1", "gate")], "address string, name string")
    users = spark.createDataFrame([(7, "seven")], "uid int, name string")
    want = as_rows(mapping.map_fields(parsed, APPS, addresses=addresses, users=users))
    assert any("gate" in r and "uid=8" in r for r in want) and any("seven" in r for r in want)
    monkeypatch.setattr(mapping, "BROADCAST_ROWS", 0)
    assert as_rows(mapping.map_fields(parsed, APPS, addresses=addresses, users=users)) == want


def looked_up(parsed, table, names, hot_rows):
    keys = {n: mapping._Key("client", F.col("fields")["client"] if n == "a" else F.col("thread")) for n in names}
    return mapping._looked_up(parsed, keys, table, 10**9, 0, hot_rows)


def test_hot_values_are_split(spark, parsed):
    table = spark.createDataFrame([("client", "10.0.0.1", "one"), ("client", "3", "three")], "base string, value string, name string")
    got = looked_up(parsed, table, ["a", "b"], 20)
    want = parsed.filter("fields['client'] = '10.0.0.1'").count(), parsed.filter("thread = '3'").count()
    assert (got.filter("_v_a = 'one'").count(), got.filter("_v_b = 'three'").count()) == want
    assert got.count() == parsed.count() and got.filter("_v_a = 'three'").count() == 0


def test_two_shuffles_of_the_lines_for_any_number_of_fields(spark, parsed):
    """One to the names, one to put the lines together; the names themselves move once."""
    table = spark.createDataFrame([("client", "10.0.0.1", "one")], "base string, value string, name string").repartition(3)
    for names in (["a"], ["a", "b", "c", "d"]):
        text = looked_up(parsed, table, names, 10**6)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 3
        assert "NestedLoop" not in text and "Cartesian" not in text


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_large_field_moves_lines_once(spark, parsed, no_auto_broadcast):
    """Only clients are too many to be broadcast: one join for them, the other fields are looked up in place."""
    want = as_rows(mapping.mask_fields(parsed, [sshd.APP]))
    got = mapping.mask_fields(parsed, [sshd.APP], broadcast_rows=50)
    assert plan_of(got).count("Exchange hashpartitioning") == 2 and "collect_list" not in plan_of(got)
    assert as_rows(got) == want


def test_hot_values_and_missing_ones_of_a_joined_field_are_spread(spark, parsed, no_auto_broadcast):
    table = spark.createDataFrame([("client", "10.0.0.1", "one", 134), ("client", "10.0.1.1", "two", 3)], "base string, value string, name string, uses long")
    keys = {"a": mapping._Key("client", F.col("fields")["client"])}
    got = mapping._looked_up_by_size(parsed, keys, table, {"client": 10**9}, 0, hot_rows=20)
    assert "_salt" in plan_of(got) and got.count() == parsed.count()
    assert got.filter("_v_a = 'one'").count() == parsed.filter("fields['client'] = '10.0.0.1'").count()
    assert got.filter("_v_a = 'two'").count() == parsed.filter("fields['client'] = '10.0.1.1'").count()


def test_only_names_that_lines_hold_are_kept(spark, parsed, no_auto_broadcast):
    """Of many names few are used: those are broadcast, and lines are not shuffled."""
    users = spark.range(1, 1000).selectExpr("id AS uid", "concat('n', id) AS name")
    users = users.union(users.selectExpr("uid", "concat('z', uid)"))
    want = as_rows(mapping.name_uids(parsed, APPS, users))
    got = mapping.name_uids(parsed, APPS, users, broadcast_rows=50)
    assert "Exchange hashpartitioning" not in plan_of(got)
    assert as_rows(got) == want and any("n42" in r for r in want)


def test_masked_text_after_one_join(spark, no_auto_broadcast):
    """The text of a line moves once, to the one field that is looked up in a shuffle."""
    rows = [(n, f"Jan  5 10:00:{n % 60:02d} gate sshd[{n}]: Failed password for bob from 10.0.0.{n % 9} port 22 ssh2") for n in range(300)]
    lines = spark.createDataFrame([*rows, (300, "no header"), (301, "")], "line_no long, raw string")
    lines = lines.selectExpr("line_no", "raw", "'a' AS file", "timestamp '2024-01-31' AS file_mtime")
    parsed = apply_rules(parse_headers(lines), [sshd.APP])
    masked = [mapping.rewrite_raw(mapping.mask_fields(parsed, [sshd.APP], broadcast_rows=n), [sshd.APP]) for n in (100, 10**6)]
    got, want = (df.select("line_no", "raw") for df in masked)
    assert plan_of(got).count("Exchange hashpartitioning") == 2
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.filter("line_no = 0").first().raw.endswith("sshd[THREAD_0001]: Failed password for USER_0001 from CLIENT_0001 port 22 ssh2")


def sshd_lines(spark, texts):
    rows = [(n, f"Jan  5 10:00:{n % 60:02d} gate sshd[{n}]: {text}") for n, text in enumerate(texts)]
    lines = spark.createDataFrame(rows, "line_no long, raw string")
    return lines.selectExpr("line_no", "raw", "'a' AS file", "timestamp '2024-01-31' AS file_mtime")


def test_rules_run_once_when_masking(spark):
    """Masked lines come from the parsed ones that were kept: no pattern of a header or a rule runs again."""
    lines = sshd_lines(spark, ["Failed password for bob from 10.0.0.1 port 22 ssh2", "Connection closed by 10.0.0.2", "other"])
    parsed = apply_rules(parse_headers(lines), [sshd.APP])
    masked = mapping.mask_fields(parsed, [sshd.APP])
    assert "regexp_replace" in plan_of(parsed) and "Failed" in plan_of(parsed)
    assert "regexp_replace" not in plan_of(masked) and "Failed" not in plan_of(masked)
    assert [r.client for r in masked.orderBy("line_no").selectExpr("fields['client'] AS client").collect()] == ["CLIENT_0001", "CLIENT_0002", None]


def test_chains_of_rules_stay_out_of_generated_code(spark):
    """A method with all rules of an app in it is too long for the JVM to compile."""
    lines = sshd_lines(spark, ["Failed password for bob from 10.0.0.1 port 22 ssh2", "other"])
    parsed = apply_rules(parse_headers(lines), [sshd.APP])
    for df in (parsed, mapping.rewrite_raw(parsed, [sshd.APP])):
        steps = [line for line in plan_of(df).splitlines() if "Generate explode(" in line]
        # the header is parsed in generated code, by two patterns
        assert len(steps) > 1 and sum("*(" in line.split("Generate")[0] for line in steps) <= 1


def test_only_the_groups_that_change_are_cut_out():
    pattern = r"(?P<day>\d+) (?P<apptag>x-(?P<host>\w+)): (?:(?P<procid>\d+) )?(?P=apptag) (?P<message>.*)"
    regex = to_java(pattern, pieces=True, only=frozenset({"host", "message"}))
    assert [name for name, _ in regex.pieces] == [None, None, None, "host", None, "message", None]
    found = re.match(regex.cutting(anchored=True).replace("\\p{Nd}", "0-9").replace("\\p{L}\\p{N}", "0-9a-z").replace("\\z", "$"), "5 x-gate: 7 x-gate on")
    assert [found[number] for _, number in regex.pieces] == ["", "5 ", "x-", "gate", ": 7 x-gate ", "on", ""]


def test_unmatched_lines_stay_as_they_are(spark):
    lines = sshd_lines(spark, ["Failed password for bob from 10.0.0.1 port 22 ssh2", "bob came from 10.0.0.1 on gate"])
    parsed = apply_rules(parse_headers(lines), [sshd.APP])
    got = mapping.rewrite_raw(mapping.mask_fields(parsed, [sshd.APP]), [sshd.APP]).orderBy("line_no").collect()
    assert got[0].raw.startswith("Jan  5 10:00:00 HOST_0001 sshd[THREAD_0001]: Failed password for USER_0001")
    assert got[1].raw == lines.orderBy("line_no").collect()[1].raw and got[1].message.endswith("bob came from 10.0.0.1 on gate")
