"""Results that read the text once, and move no more of it than they must."""

import random

import pytest
from pyspark.sql import functions as F

from catalog import apps, views
from logweave import App, LogSearch, Patterns, Pick, Rule
from logweave.operators import joins, output, rules
from logweave.operators.joins import semi_join
from logweave.operators.reports import top_values
from logweave.packs import sshd

SF = "/root/testdata/sf0.001"
HEAD = "Jan  5 10:00:00 gate "


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "lines")
    views.lines(spark, SF).selectExpr("*", "event_id AS line_no").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("skip", [False, True])
def test_counts_and_statistics_read_the_text_once(stored, skip):
    run = LogSearch(patterns=Patterns.of("error"), apps=apps.ALL, skip_unknown_files=skip)
    assert plan(run.stats(stored)).count("FileScan parquet") == 1
    if not skip:
        assert plan(run.counts(stored)).count("FileScan parquet") == 1


@pytest.mark.parametrize("options", [{}, {"mode": "unparsed"}, {"mode": "unruled"}, {"hosts": ("web*",)}, {"skip_unknown_files": True}, {"filters": ({"user": "b.*"},)}])
def test_both_ways_of_counting_agree(lines_of, options, monkeypatch):
    rng = random.Random(1)
    texts = ["Accepted password for bob from 10.0.0.1 port 1", "Failed password for eve from 10.0.0.1 port 1", "nothing known"]
    heads = ["Jan  5 10:00:00 gate sshd[1]: ", "Feb  6 10:00:00 web1 sshd[2]: ", "Feb 31 10:00:00 gate sshd[1]: ", "no header "]
    files = {f"{n}.log": [rng.choice(heads) + rng.choice(texts) for _ in range(12)] for n in range(6)}
    run, lines = LogSearch(apps=(sshd.APP,), patterns=Patterns.of("password|known"), **options), lines_of(files)
    one = sorted(run.counts(lines).collect()), run.stats(lines).collect()
    monkeypatch.setattr(LogSearch, "by_line", False)
    assert (sorted(run.counts(lines).collect()), run.stats(lines).collect()) == one


def test_weights_by_row_array_and_stretch(spark):
    """However many notices there are, each adds to its line; without need no line moves."""
    rng = random.Random(2)
    lines = spark.createDataFrame([(f, n, f"{f}{n}") for f in "ab" for n in range(1, 400)], "file string, line_no long, raw string")
    times = {(f, n): rng.randrange(1, 9) for f in "ab" for n in rng.sample(range(1, 200), 60)}
    about = spark.createDataFrame([(f, n, t) for (f, n), t in times.items()], "file string, line_no long, _times int")
    want = {(f, n): 1 + times.get((f, n), 0) for f in "ab" for n in range(1, 400)}
    for limits in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "array_rows": 0}):
        got = rules.add_weights(lines, about, notice_lines=16, **limits)
        assert got.columns == [*lines.columns, "weight"]
        assert {(r.file, r.line_no): r.weight for r in got.collect()} == want and got.count() == len(want)
    arrays = plan(rules.add_weights(lines, about, broadcast_rows=0, notice_lines=16))
    assert "SortMergeJoin" not in arrays and arrays.count("Exchange hashpartitioning") == 1  # of the notices


def test_semi_join_thins_out_by_bits(spark, monkeypatch):
    left = spark.range(5000).selectExpr("id", "id % 700 AS k", "concat('f', id % 3) AS f").unionAll(spark.sql("SELECT 1L, NULL, 'f1'"))
    right = spark.range(0, 700, 9).selectExpr("id AS k", "concat('f', id % 3) AS f").distinct()
    want = sorted(left.join(right, ["k", "f"], "left_semi").select("id").collect())
    for bits in (8, 1 << 16):
        monkeypatch.setattr(joins, "BITMAP_BITS", bits)
        got = semi_join(left, right, ["k", "f"], broadcast_rows=0)
        assert got.columns == left.columns and sorted(got.select("id").collect()) == want


def test_only_threads_with_a_match_are_cut_into_chunks(spark):
    rows = [("f", n, "app", f"t{n % 40}", n % 40 == 3 and n < 50) for n in range(400)] + [("f", 900, "app", None, True), ("f", 901, "app", None, False)]
    lines = spark.createDataFrame(rows, "file string, line_no long, app string, thread string, hit boolean")
    got = {(r.line_no, r.kind) for r in output.thread_context(lines, F.col("hit"), 0, 1).collect()}
    assert got == {(3, "match"), (43, "match"), (83, "context"), (900, "match")}
    assert {r.line_no for r in output.whole_threads(lines, F.col("hit")).collect()} == {*range(3, 400, 40), 900}


def test_limits_hold_for_counters_and_tags(lines_of):
    """After the last line of the limit a file is not read on."""
    texts = [
        HEAD + "sshd[1]: strange", HEAD + "other[1]: a", HEAD + "sshd[1]: Accepted password for bob from 10.0.0.1 port 1",
        HEAD + "sshd[1]: Accepted password for eve from 10.0.0.1 port 1", HEAD + "sshd[1]: strange", HEAD + "other[1]: b",
    ]
    run, lines = LogSearch(apps=(sshd.APP,)), lines_of({"a": texts, "b": texts[:2]})
    counters = lambda r: r.app_counters(lines).select("matches", "unparsed").collect()
    tags = lambda r: r.extra_tags(lines).select("lines").collect()
    assert (counters(run), tags(run)) == ([(2, 3)], [(3,)])
    assert (counters(run.but(max_count=1)), tags(run.but(max_count=1))) == ([(1, 2)], [(2,)])
    assert (counters(run.but(max_count=2)), tags(run.but(max_count=2))) == ([(2, 2)], [(2,)])
    assert (counters(run.but(max_count=9)), tags(run.but(max_count=9))) == ([(2, 3)], [(3,)])


def test_only_shown_lines_are_mapped(lines_of):
    """Tokens are those of the shown lines; neighbours that no rule matched are withheld."""
    texts = [
        HEAD + "sshd[1]: Accepted password for ann from 10.0.0.1 port 1", HEAD + "sshd[2]: Accepted password for bob from 10.0.0.2 port 1",
        HEAD + "sshd[3]: Failed password for eve from 10.0.0.3 port 1", HEAD + "sshd[4]: strange to eve",
        HEAD + "sshd[5]: Accepted password for zoe from 10.0.0.5 port 1",
    ]
    run = LogSearch(apps=(sshd.APP,), patterns=Patterns.of("Failed"), mask=True)
    got = [(r.line_no, r.kind, r.raw) for r in run.context(lines_of(texts), 1, 1).orderBy("line_no").collect()]
    head = "Jan  5 10:00:00 HOST_0001 sshd"
    assert got == [
        (2, "context", f"{head}[THREAD_0001]: Accepted password for USER_0001 from CLIENT_0001 port 1"),
        (3, "match", f"{head}[THREAD_0002]: Failed password for USER_0002 from CLIENT_0002 port 1"),
        (4, "context", None),
    ]
    threads = run.threads_of(lines_of(texts)).collect()
    assert [r.raw for r in threads] == [f"{head}[THREAD_0001]: Failed password for USER_0001 from CLIENT_0001 port 1"]


def test_largest_values_are_distinct_keys(spark):
    """Against all keys sorted; lines of one key count once, equal values stand apart by their keys."""
    rng = random.Random(3)
    keys = [("r", f"h{rng.randrange(3)}", {"m": f"u{rng.randrange(6)}", "size": str(rng.randrange(40)), "q": str(n)}) for n in range(300)]
    keys += [("r", "h", {"m": "x", "size": s, "q": "z"}) for s in ("no", None, "99999999999999999999")]
    rows = [k for k in keys for _ in range(rng.randrange(1, 4))]
    lines = spark.createDataFrame(rows, "rule string, host string, fields map<string,string>").repartition(5)
    valid = [(int(f["size"]), f["m"]) for _, _, f in keys if f["size"] and f["size"].isdigit() and len(f["size"]) < 19]
    for size in (1, 7, 60, 5000):
        got = top_values(lines.withColumn("events", F.lit(1)), [(0, size, Pick("r", ("m",), value="size"))])
        assert [(r.total, r.value) for r in got.orderBy("rank").collect()] == sorted(valid, reverse=True)[:size]


def test_counters_stay_narrow_beside_largest_values(spark, lines_of):
    from logweave import Item, Section
    from logweave.operators.reports import largest_rules, needed_fields

    items = (
        Item("s", "Largest", "top", (Pick("sent", ("to",), value="size"),), ("To",), top=2),
        Item("s", "All", "total", (Pick("sent", ('"sent"',)), Pick("sent", ('"bytes"',), value="size"))),
    )
    app = App("m", "", ("m",), (Rule("sent", r"(?P<q>\w+): to=(?P<to>\w+) size=(?P<size>\d+)"),), items=items)
    sections = [Section("s", "S")]
    assert needed_fields([app], sections, largest=False) == {("m", "sent"): {"size"}} and list(largest_rules([app], sections)) == [("m", "sent")]
    texts = [HEAD + f"m[1]: q{n}: to=u{n % 3} size={n % 5}" for n in range(20)]
    got = LogSearch(apps=(app,)).report(lines_of(texts), sections).orderBy("item_no", "row_no").collect()
    rows = [(r.title, *r.cols) for r in got]
    assert [r for r in rows if r[0] == "All"] == [("All", "20", "sent"), ("All", "40", "bytes")]
    assert [r[1] for r in rows if r[0] == "Largest"] == ["4", "4"]


def test_values_that_no_rule_took_are_withheld(lines_of):
    message = "pam_unix(sshd:auth): authentication failure; logname=ann uid=0 euid=0 tty=ssh ruser=bobby rhost=10.0.0.1  user=eve"
    run = LogSearch(apps=(sshd.APP,), mask=True)
    (row,) = run.select(lines_of([HEAD + "sshd[7]: " + message])).collect()
    assert row.raw.endswith("; logname=? uid=? euid=? tty=ssh ruser=? rhost=CLIENT_0001  user=USER_0001")
    assert "bobby" not in row.message and "ann" not in row.message


def test_what_counts_as_a_named_value(spark):
    from logweave.operators.mapping import withhold_named

    cases = {
        "user=<bob>, x=1": "user=?, x=1", 'User="a b" to=<c@d>': "User=? to=?", "user=<USER_0001>, rip=CLIENT_12": "user=<USER_0001>, rip=CLIENT_12",
        "superuser=bob myuser=bob": "superuser=bob myuser=bob", "(uid=UID_0001) uid=0": "(uid=UID_0001) uid=?", "user= next": "user= next",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", withhold_named(F.col("t")).alias("got")).collect()
    assert {r.t: r.got for r in rows} == cases
