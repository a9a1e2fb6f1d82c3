"""Whole searches on invented lines: the facts the operators promise."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave import App, HeaderFormat, LogSearch, Patterns, Rule, TimeRange
from logweave.operators import mapping, output, reports, rules
from logweave.operators.headers import file_counts, known_lines, parse_headers
from logweave.operators.reports import Item, Pick, Section, Where, counted_cells, report, table_entries
from logweave.operators.scope import in_period, on_hosts, until_newer
from logweave.operators.search import select_lines
from logweave.packs import shipped, sshd


def log(tag, *messages, host="gate", start=0):
    return [
        f"Jan  5 10:{(start + i) // 60:02d}:{(start + i) % 60:02d} {host} {tag}: {m}" for i, m in enumerate(messages)
    ]


def numbers(df, *extra):
    return sorted(tuple(r) for r in df.select("file", "line_no", *extra).collect())


def plain(df):
    return [n for _, n in numbers(df)]


# -- headers -----------------------------------------------------------------


def test_event_times(lines_of):
    texts = [
        "Jan  5 10:00:00 h a: in the year of the file",
        "Dec 31 23:59:59 h a: in the year before",
        "Feb 29 10:00:00 h a: not a date in 2014",
        "Foo  5 10:00:00 h a: no such month",
        "Jan 05 25:00:00 h a: no such hour",
        "2014-07-08T09:10:11.123456+02:00 h a - - offset is not applied",
        "-09:10:11Z h a - - half a time",
        "2014-13-08T09:10:11Z h a - - no such month",
    ]
    got = parse_headers(lines_of(texts, "2015-01-10 00:00:00")).orderBy("line_no").collect()
    assert [r.event_ts and r.event_ts.isoformat(" ") for r in got] == [
        "2015-01-05 10:00:00", "2014-12-31 23:59:59", None, None, None, "2014-07-08 09:10:11", None, None,
    ]
    assert [r.format for r in got] == ["rfc3164"] * 3 + [None, None, "rfc5424", None, None]
    later = parse_headers(lines_of(texts[1:2], "2015-06-10 00:00:00")).first()
    assert later.event_ts == dt.datetime(2015, 12, 31, 23, 59, 59)
    utc = parse_headers(lines_of(texts[5:6]), use_offset=True).first()
    assert utc.event_ts == dt.datetime(2014, 7, 8, 7, 10, 11)


def test_nil_values_and_tag_length(lines_of):
    texts = [
        "2014-07-08T09:10:11Z - - - - text",
        f"Jan  5 10:00:00 h {'t' * 40}[1]: x",
        "Jan  5 10:00:00   h   tag(user): x",
        "2014-07-08T09:10:11Z h a p m ",
    ]
    a, b, c, d = parse_headers(lines_of(texts)).orderBy("line_no").collect()
    assert (a.host, a.apptag, a.procid, a.msgid, a.message) == (None, None, None, None, "text")
    assert b.apptag == "t" * 32 and b.message.startswith("t" * 40)
    assert c.format is None and d.message == ""


def test_unknown_files(lines_of):
    files = {
        "good": ["Jan  5 10:00:00 h a: x", "junk", "Jan  5 10:00:01 h a: y"],
        "bad": ["junk", "Jan  5 10:00:01 h a: y"],
        "worse": ["junk"] * 5,
    }
    parsed = parse_headers(lines_of(files))
    assert numbers(known_lines(parsed)) == [("good", 1), ("good", 3)]
    assert numbers(known_lines(parsed, skip_unknown_files=False)) == [("bad", 2), ("good", 1), ("good", 3)]
    counts = {r.file: (r.lines, r.unknown, r.skipped) for r in file_counts(parsed).collect()}
    assert counts == {"good": (3, 1, False), "bad": (1, 0, True), "worse": (1, 0, True)}


def test_header_format_checks():
    with pytest.raises(ValueError, match="lacks groups"):
        HeaderFormat("x", r"(?P<month>\d+) (?P<day>\d+)")
    with pytest.raises(ValueError, match="unknown groups"):
        HeaderFormat("x", r"(?P<month>.)(?P<day>.)(?P<ltime>.)(?P<message>.)(?P<colour>.)")


# -- scope -------------------------------------------------------------------


def test_stop_at_newer(lines_of):
    texts = [f"Jan {d:2d} 10:00:00 h a: x" for d in (5, 6, 9, 6, 7)]
    parsed = parse_headers(lines_of({"f": texts, "g": texts[:2]}))
    end = dt.datetime(2015, 1, 7)
    kept = in_period(until_newer(parsed, end), (None, end))
    assert numbers(kept) == [("f", 1), ("f", 2), ("g", 1), ("g", 2)]
    assert len(numbers(in_period(parsed, (None, end)))) == 5


def test_hosts(lines_of):
    names = ["gate", "floodgate", "gate.example.com", "web1", "-"]
    texts = [f"2015-01-05T10:00:00Z {h} a - - x" for h in names]
    parsed = parse_headers(lines_of(texts))
    assert plain(on_hosts(parsed, ["gate"])) == [1, 5]
    assert plain(on_hosts(parsed, ["gate.example.com"])) == [1, 3, 5]
    assert plain(on_hosts(parsed, ["*.example.com", "web?"])) == [3, 4, 5]
    assert plain(on_hosts(parsed, ["*"])) == [1, 2, 3, 4, 5]


# -- patterns ----------------------------------------------------------------


def test_patterns(lines_of):
    lines = lines_of(["Cat sat", "the cat", "concat", "dog", ""])

    def hits(*patterns, **options):
        return plain(select_lines(lines, Patterns.of(*patterns, **options)))

    assert hits("cat") == [2, 3]
    assert hits("cat", "dog") == [2, 3, 4]
    assert hits("cat", ignore_case=True) == [1, 2, 3]
    assert hits("cat|dog", word=True) == [2, 4]
    assert hits("cat", invert=True) == [1, 4, 5]
    assert hits() == hits("cat", "") == [1, 2, 3, 4, 5]
    assert hits(invert=True) == []
    parts = lines.select(Patterns.of("d.g", "[ct]a.").matching_part().alias("p")).collect()
    assert [r.p for r in parts] == [None, "cat", "cat", "dog", None]
    marked = lines.select(Patterns.of("a").highlight("[$", "]").alias("m")).first()
    assert marked.m == "C[$a]t s[$a]t"


# -- rules and modes ---------------------------------------------------------


@pytest.fixture
def packs():
    return (
        App("alpha", "", ("alpha", "both"), (Rule("num", r"n={number:number}"), Rule("any", "x {user}$")), priority=1),
        App("beta", "", ("beta", "both", "be-"), (Rule("word", r"w={word:word}"),), priority=2),
    )


def test_routing(lines_of, packs):
    texts = [
        *log("alpha", "n=1", "nothing"),
        *log("both", "w=a", "n=2", "neither"),
        *log("be-42", "w=b"),
        *log("gamma", "n=3"),
        *log("77", "w=c", "neither"),
        "2015-01-05T10:00:00Z h - - - n=4",
        "2015-01-05T10:00:00Z h - - - neither",
    ]
    parsed = rules.apply_rules(parse_headers(lines_of(texts)), packs)
    got = [(r.app, r.rule) for r in parsed.orderBy("line_no").collect()]
    assert got == [
        ("alpha", "num"), ("alpha", None),
        ("beta", "word"), ("alpha", "num"), ("alpha", None),
        ("beta", "word"),
        (None, None),
        ("beta", "word"), (None, None),
        ("alpha", "num"), (None, None),
    ]
    routed = rules.route(parse_headers(lines_of(texts)), packs)
    assert [r.app for r in routed.orderBy("line_no").collect()] == [app for app, _ in got]
    tags = rules.extra_tags(parse_headers(lines_of(texts)), packs).collect()
    assert [(r.apptag, r.lines) for r in tags] == [("gamma", 1)]


def test_modes(lines_of, packs):
    lines = lines_of([*log("alpha", "n=1", "nothing"), *log("gamma", "n=3")])
    run = LogSearch(apps=packs)
    assert plain(run.select(lines)) == [1]
    assert plain(run.but(mode="unparsed").select(lines)) == [2]
    assert plain(run.but(mode="unruled").select(lines)) == [1, 2]
    with pytest.raises(ValueError):
        run.but(mode="other").select(lines)


def test_filters(lines_of):
    texts = [
        "Jan  5 10:00:00 h sshd[1]: Accepted password for ann from 10.0.0.1 port 1",
        "Jan  5 10:00:00 h sshd[1]: Accepted password for bob from 10.0.0.2 port 1",
        "Jan  5 10:00:00 h sshd[1]: Accepted password for annabel from 10.0.0.1 port 1",
        "Jan  5 10:00:00 h sshd[2]: Connection closed by 10.0.0.2",
    ]
    run = LogSearch(apps=(sshd.APP,))
    lines = lines_of(texts)
    both = {"user": "ann", "client": r"10\.0\.0\.1"}
    assert plain(run.but(filters=({"user": "ann"},)).select(lines)) == [1]
    assert plain(run.but(filters=(both,)).select(lines)) == [1]
    assert plain(run.but(filters=({"user": "bob"}, {"client": r"10\.0\.0\.2"})).select(lines)) == [2, 4]
    assert plain(run.but(filters=({"mail": "x"},)).select(lines)) == []
    whole = run.but(filters=({"user": "ann"},)).threads_of(lines)
    assert plain(whole) == [1, 2, 3]


def test_repeats(lines_of):
    notice = "Jan  5 10:00:09 last message repeated {} times"
    texts = [
        *log("sshd[1]", "Connection closed by 10.0.0.1"),  # 1
        notice.format(3),
        notice.format(5),
        *log("sshd[1]", "Connection closed by 10.0.0.1"),  # 4
        "unknown",
        "unknown",
        notice.format(2),
        *log("kernel", "x"),  # 8
        notice.format(7),
        "unknown",
        *log("sshd[1]", "Connection closed by 10.0.0.2"),  # 11
    ]
    folded = rules.fold_repeats(parse_headers(lines_of({"f": texts, "g": [notice.format(4), *texts[:1]]})))
    assert numbers(folded, "weight") == [
        ("f", 1, 4), ("f", 4, 3), ("f", 8, 8), ("f", 11, 1), ("g", 2, 1),
    ]
    run = LogSearch(apps=(sshd.APP,), repeats=True)
    lines = lines_of(texts)
    assert run.counts(lines).first().matches == 8
    results = {r.fields["client"]: r.events for r in run.results(lines).collect()}
    assert results == {"10.0.0.1": 7, "10.0.0.2": 1}
    assert run.app_counters(lines).first().matches == 8


# -- output ------------------------------------------------------------------


def test_counts_and_files(lines_of):
    lines = lines_of({"f": ["a", "b", "a"], "g": ["b"], "h": ["a"]})
    hit = Patterns.of("a").selects()
    assert {r.file: r.matches for r in output.count_per_file(lines, hit).collect()} == {"f": 2, "g": 0, "h": 1}
    assert sorted(r.file for r in output.files_with_match(lines, hit).collect()) == ["f", "h"]
    assert [r.file for r in output.files_without_match(lines, hit).collect()] == ["g"]
    assert output.exists(lines, hit) and not output.exists(lines, Patterns.of("z").selects())
    assert numbers(output.max_count(lines.filter(hit), 1)) == [("f", 1), ("h", 1)]
    with pytest.raises(ValueError):
        output.max_count(lines, 0)


def grep_context(flags, before, after):
    shown = set()
    for i, hit in enumerate(flags):
        if hit:
            shown |= set(range(max(0, i - before), min(len(flags), i + after + 1)))
    return sorted(shown)


@pytest.mark.parametrize("before, after, around", [(1, 0, 0), (0, 2, 0), (1, 1, 2), (0, 0, 0)])
def test_context(lines_of, before, after, around):
    texts = [("x" if i in (0, 7, 9, 20, 29) else ".") for i in range(30)]
    shown = output.context(lines_of(texts), Patterns.of("x").selects(), before, after, around)
    expected = grep_context([t == "x" for t in texts], max(before, around), max(after, around))
    rows = output.context_groups(shown).orderBy("line_no").collect()
    assert [r.line_no - 1 for r in rows] == expected
    assert all((r.kind == "match") == (r.raw == "x") for r in rows)
    groups, separators, no = [], [], 0
    for i, n in enumerate(expected):
        new = i == 0 or n - expected[i - 1] > 1
        no += new
        groups.append(no)
        separators.append(new and i > 0)
    assert [r.group_no for r in rows] == groups
    assert [r.separator for r in rows] == separators


def test_context_groups_over_chunks(lines_of, monkeypatch):
    texts = [("x" if i % 17 in (0, 1, 5) else ".") for i in range(200)]
    lines = lines_of({"f": texts, "g": texts[:40]})
    whole = sorted(map(str, output.context_groups(output.context(lines, Patterns.of("x").selects(), 1, 1)).collect()))
    monkeypatch.setattr(output.chunk_of, "__defaults__", ("line_no", 8))
    cut = sorted(map(str, output.context_groups(output.context(lines, Patterns.of("x").selects(), 1, 1)).collect()))
    assert cut == whole


def test_format(lines_of):
    shown = output.context(lines_of(["a", "x", "b"]), Patterns.of("x").selects(), before=1)
    rows = output.format_lines(shown, line_number=True).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["a.log-1-a", "a.log:2:x"]
    assert output.format_lines(shown, with_filename=False).orderBy("line_no").first().text == "a"


def test_threads(lines_of):
    body = "Connection closed by 10.0.0.{}"
    texts = [
        *log("sshd[1]", body.format(1), body.format(2)),
        *log("sshd[2]", body.format(3)),
        *log("sshd[1]", body.format(4), body.format(5)),
        *log("sshd", "no thread here"),
    ]
    lines = lines_of({"f": texts, "g": texts[:1]})
    run = LogSearch(patterns=Patterns.of(r"10\.0\.0\.4"), apps=(sshd.APP,))
    assert numbers(run.threads_of(lines)) == [("f", 1), ("f", 2), ("f", 4), ("f", 5)]
    assert numbers(run.threads_of(lines, before=1, after=0)) == [("f", 2), ("f", 4)]


def test_stats(lines_of):
    lines = lines_of({"f": [*log("sshd[1]", "Connection closed by h", "x"), "junk"], "g": log("sshd[1]", "y", start=60)})
    run = LogSearch(apps=(sshd.APP,))
    parsed = rules.apply_rules(parse_headers(lines), [sshd.APP])
    s = output.run_stats(parsed, F.col("matched")).first()
    assert (s.files, s.lines, s.matches, s.unknown) == (2, 4, 1, 1)
    assert s.first_event == s.last_event == dt.datetime(2015, 1, 5, 10, 0, 0)
    none = run.but(patterns=Patterns.of("zzz")).stats(lines).first()
    assert none.matches == 0 and none.first_event is None


def test_time_and_period(lines_of):
    lines = lines_of([f"Jan  5 {h:02d}:30:00 h sshd[1]: Connection closed by h" for h in range(24)])
    run = LogSearch(apps=(sshd.APP,), time_range=TimeRange.parse("08:00,18:00"))
    assert plain(run.select(lines)) == list(range(9, 19))
    day = (dt.datetime(2015, 1, 5, 9, 30), dt.datetime(2015, 1, 5, 10, 30))
    assert plain(run.but(period=day).select(lines)) == [10, 11]
    assert plain(run.but(max_count=2).select(lines)) == [9, 10]


# -- mapping -----------------------------------------------------------------


def test_masking(lines_of):
    texts = [
        *log("sshd[7]", "Accepted password for bob from 10.0.0.2 port 1"),
        *log("sshd[7]", "Accepted password for ann from 10.0.0.2 port 1", host="web"),
        "Jan  5 10:00:00 h dovecot: imap-login: Login: user=<bob>, PID=7, TLS, rip=10.0.0.1, lip=10.0.0.9",
    ]
    run = LogSearch(mask=True)
    got = [r.raw for r in run.select(lines_of(texts)).orderBy("line_no").collect()]
    assert got == [
        "Jan  5 10:00:00 HOST_0001 sshd[THREAD_0001]: Accepted password for USER_0002 from CLIENT_0002 port 1",
        "Jan  5 10:00:00 HOST_0003 sshd[THREAD_0001]: Accepted password for USER_0001 from CLIENT_0002 port 1",
        "Jan  5 10:00:00 HOST_0002 dovecot: imap-login: Login: user=<USER_0002>, PID=THREAD_0001, TLS, "
        "rip=CLIENT_0001, lip=10.0.0.9",
    ]


def test_tokens_never_collide(spark):
    parsed = spark.range(150).selectExpr(
        "true AS matched", "CAST(id AS string) AS host", "map('user', CAST(id AS string)) AS fields"
    )
    tokens = mapping.token_table(parsed, [sshd.APP], width=2)
    assert tokens.select("token").distinct().count() == 300
    assert tokens.filter("base = 'user'").agg(F.max(F.length("token"))).first()[0] == len("USER_150")


def test_names(spark, lines_of):
    texts = [
        *log("sshd[7]", "Accepted password for bob from 10.0.0.2 port 1"),
        *log("sshd[7]", "pam_unix(x): session opened for user 42 by (uid=7)"),
        *log("sshd[7]", "pam_unix(x): session opened for user 43 by (uid=8)"),
    ]
    hosts = spark.createDataFrame([("10.0.0.2", "web.example.com")], "address string, name string")
    users = spark.createDataFrame([(42, "ann"), (7, "ops")], "uid int, name string")
    run = LogSearch(apps=(sshd.APP,), addresses=hosts, users=users)
    got = [r.raw.split("sshd[7]: ")[1] for r in run.select(lines_of(texts)).orderBy("line_no").collect()]
    assert got == [
        "Accepted password for bob from web.example.com port 1",
        "pam_unix(x): session opened for user 42 by (uid=ops)",  # user values belong to the address names
        "pam_unix(x): session opened for user 43 by (uid=uid=8)",
    ]
    only = run.but(addresses=None).select(lines_of(texts)).orderBy("line_no").collect()
    assert [r.fields["user"] for r in only] == ["bob", "ann", "uid=43"]


def test_address_inside_a_value(spark):
    parsed = spark.createDataFrame(
        [(True, "h", {"client": c, "user": "x"}) for c in ("gw[10.0.0.2]", "::ffff:10.0.0.2", "10.0.0.3", "web.example.com")],
        "matched boolean, host string, fields map<string,string>",
    )
    hosts = spark.createDataFrame([("10.0.0.2", "web.example.com")], "address string, name string")
    named = mapping.name_addresses(parsed, [sshd.APP], hosts)
    assert [r.fields["client"] for r in named.collect()] == [
        "gw[web.example.com]", "web.example.com", "10.0.0.3", "web.example.com",
    ]


# -- reports -----------------------------------------------------------------


@pytest.fixture
def counters(spark):
    rows = [("a", "r", "h1", {"u": u, "c": c, "n": n}, e) for u, c, n, e in [
        ("ann", "x", "5", 3), ("ann", "y", "7", 1), ("bob", "x", "9", 4), ("cat", "z", "1", 1), ("dan", "q", "2", 1),
    ]]
    return spark.createDataFrame(rows, "app string, rule string, host string, fields map<string,string>, events bigint")


def make(counters, *items, limit=5):
    app = App("a", "", ("a",), (Rule("r", "(?P<u>.)(?P<c>.)(?P<n>.)"),), items=items)
    rows = report(counters, [app], [Section("s", "Section")], limit).orderBy("item_no", "row_no").collect()
    return [(r.title, *r.cols) for r in rows]


def test_totals(counters):
    item = Item("s", "T", "total", (
        Pick("r", ('"all"',)),
        Pick("r", ('"with a"',), Where("u", "a")),
        Pick("r", ('"without a"',), Where("u", "a", negate=True)),
        Pick("r", ('"none"',), Where("u", "zz")),
        Pick("r", ('"sum"',), value="n"),
        Pick("r", ('"bytes"',), value="n", unit="KB"),
    ))
    assert make(counters, item) == [
        ("T", "10", "all"), ("T", "6", "with a"), ("T", "4", "without a"),
        ("T", "61", "sum"), ("T", "61 KB", "bytes"),
    ]


def test_tops(counters):
    events = Item("s", "E", "top", (Pick("r", ("u",)),), ("User",), 2)
    summed = Item("s", "S", "top", (Pick("r", ("u",), value="n", add=True),), ("User",), 1)
    largest = Item("s", "M", "top", (Pick("r", ("c",), value="n"),), ("C",), 3)
    limited = Item("s", "W", "top", (Pick("r", ("u",), Where("u", "^[cd]")),), ("User",), 5)
    assert make(counters, events, summed, largest, limited) == [
        ("E", "4", "ann"), ("E", "4", "bob"), ("E", "1", "cat"), ("E", "1", "dan"),
        ("S", "36", "bob"),
        ("M", "9", "x"), ("M", "7", "y"), ("M", "5", "x"),
        ("W", "1", "cat"), ("W", "1", "dan"),
    ]


def test_long_tops(counters):
    """Lists beyond the limit that a task can cut to are numbered instead."""
    for pick in (Pick("r", ("u",)), Pick("r", ("u",), value="n", add=True), Pick("r", ("c",), value="n")):
        short = Item("s", "L", "top", (pick,), ("H",), 100)
        long = Item("s", "L", "top", (pick,), ("H",), 5000)
        assert make(counters, long) == make(counters, short)


def test_tables(counters):
    two = Item("s", "T", "table", (Pick("r", ("host", '"svc"', "u", "c")),), ("Host", "Service", "User"))
    assert make(counters, two, limit=2) == [
        ("T", "h1", "svc", "bob::x(4), ann::x(3) [3 more skipped]"),
    ]
    merged = Item("s", "T", "table", (Pick("r", ("u", "c")),), ("U", "C"))
    assert make(counters, merged, merged)[:2] == [("T", "ann", "x(3), y(1)"), ("T", "ann", "x(3), y(1)")]


def test_counted_cells(spark):
    """Entries beyond the limit stay if they happened more than once; long cells go on."""
    def cell(counts, limit, per_row=1000):
        rows = [("k", [chr(97 + i)], n) for i, n in enumerate(counts)]
        df = spark.createDataFrame(rows, "key string, entry array<string>, events bigint")
        return [r.cell for r in counted_cells(df, ["key"], limit, per_row=per_row).orderBy("part").collect()]

    assert cell([3, 2, 1], 2) == ["a(3), b(2) [1 more skipped]"]
    assert cell([1, 1, 5, 2, 1], 1) == ["c(5), d(2) [3 more skipped]"]
    assert cell([1, 2, 1], 5) == ["b(2), a(1), c(1)"]
    assert cell([4, 3, 2, 1, 1], 4, per_row=2) == ["a(4), b(3)", "c(2), d(1) [1 more skipped]"]


def test_entries_of_a_hot_key(spark):
    """Counting is done before the shuffle, so rows per key do not matter."""
    rows = spark.range(3000).selectExpr(
        "'a' AS app", "'r' AS rule", "'hot' AS host", "map('u', CAST(id % 3 AS string)) AS fields", "1L AS events"
    )
    item = Item("s", "T", "table", (Pick("r", ("host", "u")),), ("H", "U"))
    got = table_entries(rows, [(0, item)])
    assert sorted((r.entry[0], r.events) for r in got.collect()) == [("0", 1000), ("1", 1000), ("2", 1000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_counters_of_a_report(lines_of):
    """A report counts only its rules, and only by the fields it shows."""
    texts = [
        f"Jan  5 10:00:{i:02d} h{i % 2} sshd[{i}]: {m}"
        for i in range(20)
        for m in ("Accepted password for bob from 10.0.0.1", "Connection closed by 10.0.0.1")
    ]
    run = LogSearch(apps=(sshd.APP,))
    from logweave.operators.reports import needed_fields

    needed = needed_fields(run.active_apps, [Section("login", "L")])
    assert needed[("sshd", "accepted")] == {"host", "user", "client", "method"}
    few = rules.rule_results(run.select(lines_of(texts)), needed).collect()
    assert sorted((r.host, r.events) for r in few) == [("h0", 10), ("h1", 10)]
    assert run.results(lines_of(texts)).count() == 40
    largest = Item("s", "M", "top", (Pick("r", ("c",), value="n"),), ("C",), 3)
    total = Item("s", "T", "total", (Pick("r", ('"x"',), Where("u", "a")),))
    app = App("a", "", ("a",), (Rule("r", "(?P<u>.)(?P<c>.)(?P<n>.)"),), items=(total, largest))
    assert needed_fields([app], [Section("s", "S")]) == {("a", "r"): None}


def test_report_order_and_activity(spark, lines_of):
    lines = lines_of([*log("sshd[1]", "Accepted password for bob from 10.0.0.1"), *log("CROND[1]", "(root) CMD (x)")])
    run = LogSearch()
    rows = run.report(lines, [Section("command", "Commands"), Section("login", "Logins")]).orderBy("item_no", "row_no")
    assert [(r.subreport, r.title, r.app) for r in rows.collect()] == [
        ("Commands", "Cron Commands", "crond"), ("Logins", "Logins of users", "sshd"),
    ]
    results = run.results(lines)
    active = {a.name: set() for a in shipped()} | {"crond": {"command"}}
    only = report(results, shipped(), [Section("command", "C"), Section("login", "L")], active=active)
    assert [r.title for r in only.collect()] == ["Cron Commands"]
    with pytest.raises(ValueError):
        report(results, shipped(), [Section("none", "N")])


# -- whole runs --------------------------------------------------------------


def test_mapped_context_and_threads(lines_of):
    """No value comes out as it was, in neighbours neither; lines without rule are withheld."""
    texts = [
        *log("sshd[7]", "Accepted password for bob from 10.0.0.2 port 1"),
        *log("sshd[8]", "no rule knows bob here"),
        *log("sshd[7]", "Failed password for ann from 10.0.0.3 port 1"),
        *log("sshd[7]", "Connection closed by 10.0.0.2"),
    ]
    run = LogSearch(apps=(sshd.APP,), patterns=Patterns.of("Failed"), mask=True)
    for shown in (run.context(lines_of(texts), around=3), run.threads_of(lines_of(texts)), run.select(lines_of(texts))):
        rows = shown.collect()
        assert rows and not any(w in str(r) for r in rows for w in ("bob", "ann", "10.0.0."))
    raws = [r.raw for r in run.context(lines_of(texts), around=3).orderBy("line_no").collect()]
    assert len(raws) == 4 and raws[1] is None
    assert raws[2].endswith("Failed password for USER_0001 from CLIENT_0002 port 1")
    with pytest.raises(ValueError, match="mapped"):
        run.but(mode="unruled")


def test_whole_statistics(lines_of):
    lines = lines_of({"f": [*log("sshd[1]", "Connection closed by h", "x"), "junk"], "g": ["junk", "junk"], "h": log("cron", "y")})
    run = LogSearch(apps=(sshd.APP,))
    s = run.stats(lines).first()
    assert (s.files, s.lines, s.matches, s.unknown) == (3, 6, 1, 3)
    s = run.but(skip_unknown_files=True).stats(lines).first()
    assert (s.files, s.lines, s.matches, s.unknown) == (3, 5, 1, 1)


def test_a_limit_holds_for_all_results(lines_of):
    closed = [f"Connection closed by h{i}" for i in range(4)]
    lines = lines_of({"f": log("sshd[1]", *closed), "g": log("sshd[2]", closed[0]), "h": log("x", "y")})
    run = LogSearch(apps=(sshd.APP,), max_count=2)
    assert sorted((r.file, r.matches) for r in run.counts(lines).collect()) == [("f", 2), ("g", 1), ("h", 0)]
    assert run.stats(lines).first().matches == 3
    shown = run.context(lines, after=1).filter("file = 'f'").orderBy("line_no").collect()
    assert [r.kind for r in shown] == ["match", "match", "context"]


def test_selected_lines_without_thread_are_shown(lines_of):
    lines = lines_of([*log("crond", "(root) CMD (x)"), *log("sshd[1]", "Connection closed by h"), *log("sshd[2]", "Connection closed by g")])
    run = LogSearch(patterns=Patterns.of("CMD|by h"))
    assert numbers(run.threads_of(lines)) == [("a.log", 1), ("a.log", 2)]


def test_inactive_items_are_left_out(lines_of):
    rules_ = (Rule("one", "a {user}"), Rule("two", "b {pid}"))
    both = Item("s", "Both", "total", (Pick("one", ('"x"',)), Pick("two", ('"y"',))))
    only = Item("s", "Only", "total", (Pick("one", ('"x"',)),))
    app = App("t", "", ("t",), rules_, items=(both, only))
    lines = lines_of([*log("t", "a bob"), *log("t", "b 7")])
    sections = [Section("s", "S")]
    assert sorted({r.title for r in LogSearch(apps=(app,)).report(lines, sections).collect()}) == ["Both", "Only"]
    run = LogSearch(apps=(app,), filters=({"user": "b.*"},))
    assert [r.title for r in run.report(lines, sections).collect()] == ["Only"]


def test_a_line_feed_is_no_header(lines_of):
    parsed = parse_headers(lines_of(["hello\nworld", "Jan  5 10:00:00 h a: x\ny", "Jan  5 10:00:00 h a: x"]))
    rows = parsed.orderBy("line_no").collect()
    assert [r.format for r in rows] == [None, None, "rfc3164"]
    assert all(r.host is None and r.message is None and r.event_ts is None for r in rows[:2])


def test_thousands_of_patterns(lines_of):
    patterns = Patterns.of(*[f"word{i}x" for i in range(5000)])
    found = lines_of(["a word4999x b", "word5000x", "word1 x"]).filter(patterns.selects())
    assert [r.line_no for r in found.collect()] == [1]


def test_names_of_repeated_keys(spark, lines_of):
    parsed = rules.apply_rules(parse_headers(lines_of(log("sshd[1]", "Accepted password for bob from 10.0.0.2"))), [sshd.APP])
    names = spark.createDataFrame([("10.0.0.2", "b"), ("10.0.0.2", "a"), (None, "c")], "address string, name string")
    got = mapping.name_addresses(parsed, [sshd.APP], names).collect()
    assert [r.fields["client"] for r in got] == ["a"]


def test_long_cells_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(reports, "CELL_ENTRIES", 3)
    rows = [("t", "r", "h", {"u": "k", "e": f"e{i:02d}"}, 2 + i % 3) for i in range(8)] + [("t", "r", "h", {"u": "k", "e": f"s{i}"}, 1) for i in range(4)]
    results = spark.createDataFrame(rows, "app string, rule string, host string, fields map<string,string>, events bigint")
    item = Item("s", "T", "table", (Pick("r", ("u", "e")),), ("U", "E"))
    app = App("t", "", ("t",), (Rule("r", "(?P<u>.)(?P<e>.)"),), items=(item,))
    got = report(results, [app], [Section("s", "S")]).orderBy("row_no").collect()
    assert [r.part for r in got] == [0, 1, 2]
    entries = [e for r in got for e in r.cols[1].split(" [")[0].split(", ")]
    assert entries == [f"e{i:02d}({2 + i % 3})" for i in sorted(range(8), key=lambda i: (-(i % 3), i))]
    assert got[-1].cols[1].endswith(" [4 more skipped]")
