"""Files, directories, encodings, streams and sinks."""

import datetime as dt
import gzip
import os
import uuid

import pytest
from pyspark.sql import functions as F

from logweave import LogSearch, Patterns, from_table, from_text_column, read_apps, read_lines, read_patterns, shipped
from logweave.functions.timespec import date_period
from logweave.operators import output
from logweave.operators.rules import App, Rule
from logweave.sources import sinks
from logweave.sources.files import file_included, find_files, read_globs
from logweave.streaming import read_line_stream, stream_to


def write(path, texts, mtime=None, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes("".join(t + "\n" for t in texts).encode(encoding))
    if mtime:
        stamp = dt.datetime.fromisoformat(mtime + "+00:00").timestamp()
        os.utime(path, (stamp, stamp))
    return path


def test_line_numbers_over_many_splits(spark, tmp_path):
    """A file cut into many blocks, lines crossing the cuts, next to small files."""
    big = [f"line {i} " + "x" * (i * 7 % 90) for i in range(1, 3001)]
    write(tmp_path / "big.log", big)
    for n in range(5):
        write(tmp_path / f"small{n}.log", [f"s{n}-{i}" for i in range(n)])
    (tmp_path / "open.log").write_bytes(b"one\ntwo without end")
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "8192")
    try:
        for limit in (10**6, 1):
            df = read_lines(spark, str(tmp_path), block_rows=limit)
            assert df.rdd.getNumPartitions() > 4
            got = {(os.path.basename(r.file), r.line_no): r.raw for r in df.collect()}
            expected = {("big.log", i): t for i, t in enumerate(big, 1)}
            for n in range(5):
                expected |= {(f"small{n}.log", i + 1): f"s{n}-{i}" for i in range(n)}
            expected |= {("open.log", 1): "one", ("open.log", 2): "two without end"}
            assert got == expected
    finally:
        spark.conf.unset(key)


def test_line_content(spark, tmp_path):
    """Only line feeds end lines; compressed files are read; names are plain paths."""
    (tmp_path / "a b+c%.log").write_bytes(b"one\r\ntwo\rmore\n\nlast\n")
    with gzip.open(tmp_path / "z.log.gz", "wt") as f:
        f.write("zip one\nzip two\n")
    got = {(r.file, r.line_no): r.raw for r in read_lines(spark, str(tmp_path)).collect()}
    name = str(tmp_path / "a b+c%.log")
    assert {k: v for k, v in got.items() if k[0] == name} == {
        (name, 1): "one\r", (name, 2): "two\rmore", (name, 3): "", (name, 4): "last",
    }
    assert got[(str(tmp_path / "z.log.gz"), 2)] == "zip two"


def test_encoding_is_decided_per_file(spark, tmp_path):
    write(tmp_path / "utf.log", ["été", "x"])
    write(tmp_path / "latin.log", ["plain", "été"], encoding="latin-1")
    got = {(os.path.basename(r.file), r.line_no): r.raw for r in read_lines(spark, str(tmp_path)).collect()}
    assert got[("utf.log", 1)] == "été" and got[("latin.log", 2)] == "été"


def test_selection(spark, tmp_path):
    for name in ("a.log", "b.log", "b.txt", "sub/c.log", "old/d.log"):
        write(tmp_path / name, [name], "2015-01-01 00:00:00" if name.startswith("old") else "2015-06-01 00:00:00")
    root = str(tmp_path)

    def names(*args, **options):
        return sorted(r.raw for r in read_lines(spark, *args, **options).collect())

    assert names(root, recursive=True) == ["a.log", "b.log", "b.txt", "old/d.log", "sub/c.log"]
    assert names([f"{root}/*.log", f"{root}/a.log", f"{root}/a*"]) == ["a.log", "b.log"]
    assert names(root, recursive=True, include=["*.log"], exclude=["a*"], exclude_dir=["*/old"]) == ["b.log", "sub/c.log"]
    write(tmp_path / "skip.lst", ["a*", "", "*.lst"])
    assert names(root, recursive=True, exclude=read_globs(spark, f"{root}/skip.lst")) == [
        "b.log", "b.txt", "old/d.log", "sub/c.log",
    ]
    late = dt.datetime(2015, 5, 1)
    assert names(root, recursive=True, include=["*.log"], modified_after=late) == ["a.log", "b.log", "sub/c.log"]
    assert find_files(spark, [f"{root}/a.log", f"{root}/none*"]) == ([f"{root}/a.log"], [f"{root}/none*"])


def test_pruned_files_are_not_planned(spark, tmp_path):
    """Conditions on names and times are evaluated when files are listed."""
    from logweave.sources.files import scan_files

    for n in range(6):
        write(tmp_path / f"f{n}.log", [str(n)], f"2015-0{n + 1}-01 00:00:00")
    df = scan_files(spark, str(tmp_path), exclude=["f5*"], modified_after=dt.datetime(2015, 3, 15))
    assert sorted(r.value for r in df.collect()) == ["3", "4"]
    scan = df._jdf.queryExecution().executedPlan().toString()
    assert "file_modification_time" in scan


def test_order_of_inclusion(spark):
    paths = ["/var/log/a.log", "/var/old/a.log", "/var/log/a.gz", "/var/log/b.log"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    keep = file_included(F.col("p"), include=["a*"], exclude=["*.gz"], exclude_dir=["*/old"])
    assert [r.p for r in df.filter(keep).collect()] == ["/var/log/a.log"]
    assert df.filter(file_included(F.col("p"))).count() == 4


def test_read_apps(spark, tmp_path):
    """Files come from the packs, filled with dates and hosts; a shared file is read once."""
    one = App("one", "", ("one",), (Rule("r", "x"),), ("${logdir}/${host}/%Y%m%d.log", "${logdir}/gone.log"), priority=2)
    two = App("two", "", ("two",), (Rule("r", "x"),), ("${logdir}/h1/20150601.log", "${logdir}/two*"), priority=5)
    for day in ("20150601", "20150602", "20150605"):
        write(tmp_path / "h1" / f"{day}.log", [day], "2015-06-06 00:00:00")
    write(tmp_path / "two.log", ["two"], "2015-06-06 00:00:00")
    write(tmp_path / "two.old", ["old"], "2015-01-06 00:00:00")
    lines, missing = read_apps(spark, [two, one], str(tmp_path), date_period("20150601,20150603"), ["h1", "h2"])
    assert sorted((r.source_app, r.raw) for r in lines.collect()) == [
        ("one", "20150601"), ("one", "20150602"), ("two", "two"),
    ]
    assert str(tmp_path / "gone.log") in missing and str(tmp_path / "h2/20150601.log") in missing
    with pytest.raises(ValueError):
        read_apps(spark, [one], str(tmp_path / "nowhere"))


def test_pattern_file(spark, tmp_path):
    write(tmp_path / "p.txt", ["b+", "a", "a"])
    assert sorted(read_patterns(spark, str(tmp_path / "p.txt"))) == ["a", "b+"]
    write(tmp_path / "blank.txt", ["a", ""])
    assert "" in read_patterns(spark, str(tmp_path / "blank.txt"))


def test_tables(spark):
    df = spark.createDataFrame([("f", 3, "c"), ("f", 1, "a"), ("g", 2, "b")], "k string, o int, t string")
    got = from_table(df, "k", "t", F.lit("2024-01-01"), order=["o"]).collect()
    assert sorted((r.file, r.line_no, r.raw) for r in got) == [("f", 1, "a"), ("f", 2, "c"), ("g", 1, "b")]
    text = spark.createDataFrame([(1, "x\ny\n")], "id int, t string")
    rows = from_text_column(text, "id", "t", F.lit("2024-01-01")).collect()
    assert [(r.line_no, r.raw) for r in sorted(rows, key=lambda r: r.line_no)] == [(1, "x"), (2, "y"), (3, "")]


LOG = [
    "Jan  5 10:00:01 gate sshd[100]: Accepted password for bob from 10.0.0.1 port 22 ssh2",
    "Jan  5 10:00:02 gate sshd[101]: Accepted password for eve from 10.0.0.2 port 22 ssh2",
    "Jan  5 10:00:03 gate sshd[101]: Connection closed by 10.0.0.2",
]


def test_stream(spark, tmp_path):
    """The same search on a stream, sent to two channels."""
    write(tmp_path / "in" / "a.log", LOG, "2015-01-06 00:00:00")
    stream = read_line_stream(spark, str(tmp_path / "in"))
    run = LogSearch(patterns=Patterns.of("password"), filters=({"user": "e.*"},))
    found = run.select(stream).select("rule", F.col("fields")["user"].alias("user"), "raw")
    assert found.isStreaming
    run_ = stream_to(
        found,
        [
            sinks.to_directory(str(tmp_path / "json"), "json", dt.date(2015, 1, 6)),
            sinks.to_directory(str(tmp_path / "raw"), "text", dt.date(2015, 1, 6), gzip=True),
        ],
        f"test-{uuid.uuid4().hex}",
    )
    run_.awaitTermination()
    assert spark.read.json(str(tmp_path / "json")).select("user", "rule").collect() == [("eve", "accepted")]
    assert [r.value for r in spark.read.text(str(tmp_path / "raw")).collect()] == [LOG[1]]
    (folder,) = (tmp_path / "raw" / "run_date=2015-01-06").glob("stream=*/batch=0")
    assert list(folder.glob("*.gz"))


def test_batches_sent_again(spark, tmp_path):
    """A batch is written once: passed over when it is complete, replaced on its first day when it is not."""
    path = str(tmp_path / "out")
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "raw string")
    first, later = sinks.to_directory(path, run_date=dt.date(2015, 1, 6)), sinks.to_directory(path, run_date=dt.date(2015, 1, 7))
    written = lambda: sorted((r.value, str(r.run_date), r.batch) for r in spark.read.text(path).collect())
    first(batch("a"), 0, "one")
    later(batch("a"), 0, "one")
    assert written() == [("a", "2015-01-06", 0)]
    log = sinks.CommitLog(spark, path, "one")
    assert log.open(1, "2015-01-06") == "2015-01-06"  # the writer was lost behind this
    later(batch("b", "c"), 1, "one")
    assert log.open(1, "2015-01-09") is None
    assert written() == [("a", "2015-01-06", 0), ("b", "2015-01-06", 1), ("c", "2015-01-06", 1)]
    later(batch("d"), 0, "two")  # another stream into the same folder
    later(batch("e"), 0, "t_wo/")
    assert [w for w in written() if w[0] in "de"] == [("d", "2015-01-07", 0), ("e", "2015-01-07", 0)]


def test_streams_into_one_folder_and_restarts(spark, tmp_path):
    """Nothing is lost or written twice, and no stage of a batch stays behind."""
    from logweave.operators.joins import _stage_dir

    write(tmp_path / "in" / "a.log", LOG)
    names = [f"s{n}-{uuid.uuid4().hex}" for n in range(2)]
    out = str(tmp_path / "out")
    stages = lambda: set(os.listdir(_stage_dir(spark).removeprefix("file:"))) if os.path.isdir(_stage_dir(spark).removeprefix("file:")) else set()
    before = stages()

    def run(name):
        found = read_line_stream(spark, str(tmp_path / "in")).select("raw")
        stream_to(found, [sinks.to_directory(out), sinks.to_directory(out + "-json", "json")], name).awaitTermination()

    run(names[0])
    run(names[1])
    write(tmp_path / "in" / "b.log", ["later"])
    run(names[0])  # taken up again: only the new file
    for back in (spark.read.text(out).toDF("raw", "run_date", "stream", "batch"), spark.read.json(out + "-json")):
        got = {}
        for r in back.collect():
            got.setdefault(r.stream, []).append(r.raw)
        assert sorted(map(sorted, got.values())) == sorted([sorted(LOG), sorted([*LOG, "later"])])
    assert stages() == before


@pytest.mark.parametrize(
    "step",
    [
        lambda run, s: run.context(s, 1, 1),
        lambda run, s: run.threads_of(s),
        lambda run, s: run.but(repeats=True).select(s),
        lambda run, s: run.but(max_count=1).select(s),
        lambda run, s: run.but(mask=True).select(s),
        lambda run, s: run.but(skip_unknown_files=True).select(s),
        lambda run, s: run.but(stop_at_newer=True, period=(None, dt.datetime(2015, 1, 1))).select(s),
    ],
)
def test_steps_that_need_a_batch(spark, tmp_path, step):
    write(tmp_path / "a.log", LOG)
    stream = read_line_stream(spark, str(tmp_path))
    with pytest.raises(ValueError, match="needs a batch"):
        step(LogSearch(), stream)


def test_sinks(spark, tmp_path, lines_of, capsys):
    run = LogSearch()
    lines = lines_of(LOG)
    found = run.select(lines)
    sinks.write_all(
        found.select("file", "raw"),
        [sinks.to_directory(str(tmp_path / "t"), run_date=dt.date(2024, 1, 1)), sinks.to_console()],
    )
    assert "Accepted password for bob" in capsys.readouterr().out
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == sorted(LOG)
    assert os.listdir(tmp_path / "t" / "run_date=2024-01-01")
    assert list(sinks.iterate(output.sorted_lines(found))) == LOG


def test_csv_tables(spark, tmp_path, lines_of):
    from logweave.packs import sshd

    report = LogSearch(apps=(sshd.APP,)).report(lines_of(LOG * 2))
    no = report.filter("title = 'Logins of users'").first().item_no
    item = next(i for i in sshd.APP.items if i.title == "Logins of users")
    (path,) = sinks.write_csv_tables(report, {no: item}, str(tmp_path / "csv"))
    texts = [r.value for r in spark.read.text(path).collect()]
    assert texts == [
        "User|Access|Server and client",
        "bob|password|gate::10.0.0.1(2)",
        "eve|password|gate::10.0.0.2(2)",
    ]


def test_shipped_packs_have_files():
    assert all(a.files for a in shipped())
