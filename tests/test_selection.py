"""Which files paths, globs and folders mean."""

import glob
import os
import random
import re
import time

from logweave import read_apps, read_lines
from logweave.functions.timespec import date_period
from logweave.operators.rules import App, Rule
from logweave.sources.files import find_files
from logweave.sources.selection import Selection, covering_globs, segment_to_java, without_braces


def make(root, *names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name + "\n")


def read(spark, *args, **options):
    return sorted(r.raw for r in read_lines(spark, *args, **options).collect())


def test_a_glob_stays_within_its_segment(spark, tmp_path):
    """A file in a folder below is not what ``*.log`` means: it is read, reported and attributed by itself."""
    make(tmp_path, "a.log", "sub/b.log", "sub/deep/c.log")
    root = str(tmp_path)
    assert read(spark, [f"{root}/*.log", f"{root}/sub/b.log"]) == ["a.log", "sub/b.log"]
    assert read(spark, [f"{root}/*.log", f"{root}/sub/b.log", f"{root}/sub/*/c.log"]) == ["a.log", "sub/b.log", "sub/deep/c.log"]
    asked = [f"{root}/*.log", f"{root}/sub/b.log", f"{root}/sub/none.log", f"{root}/none/*.log", f"{root}/s?b/*"]
    assert find_files(spark, asked) == ([asked[0], asked[1], asked[4]], [asked[2], asked[3]])


def test_files_of_apps_in_folders_below(spark, tmp_path):
    make(tmp_path, "a.log", "sub/b.log")
    rule = (Rule("r", "x"),)
    one = App("one", "", ("one",), rule, ("${logdir}/*.log",), priority=1)
    two = App("two", "", ("two",), rule, ("${logdir}/sub/b.log", "${logdir}/sub/none.log", "${logdir}/a.l*"), priority=2)
    lines, missing = read_apps(spark, [two, one], str(tmp_path), (None, None))
    got = {r.raw: list(r.source_apps) for r in lines.collect()}
    assert got == {"a.log": ["one", "two"], "sub/b.log": ["two"]}
    assert missing == [f"{tmp_path}/sub/none.log"]


def test_overlapping_requests_read_a_file_once(spark, tmp_path):
    make(tmp_path, "a/x.log", "a/y.log", "b/x.log", "b/y.log", "c/d/z.log", "c/w.log")
    root = str(tmp_path)
    assert read(spark, [f"{root}/*/x.log", f"{root}/a/*", f"{root}/a/y.log"]) == ["a/x.log", "a/y.log", "b/x.log"]
    assert read(spark, [f"{root}/c", f"{root}/c/w.log"]) == ["c/w.log"]  # a folder: files directly in it
    assert read(spark, [f"{root}/c", f"{root}/c/w.log"], recursive=True) == ["c/d/z.log", "c/w.log"]
    assert read(spark, [f"{root}/{{a,b}}/y.log", f"{root}/b//y.log", f"file:{root}/a/y.log"]) == ["a/y.log", "b/y.log"]


def test_names_with_special_letters(spark, tmp_path):
    names = ["a b+c%.log", "x[1].log", "x1.log", "c,d.log", "{e}.log", "ü.log"]
    make(tmp_path, *names)
    root = str(tmp_path)
    assert read(spark, [f"{root}/x\\[1\\].log", f"{root}/a b+c%.log", f"{root}/c,d.log"]) == ["a b+c%.log", "c,d.log", "x[1].log"]
    assert read(spark, [f"{root}/x[1].log", f"{root}/\\{{e\\}}.log", f"{root}/?.log"]) == ["x1.log", "{e}.log", "ü.log"]


def test_folders_named_like_columns(spark, tmp_path):
    make(tmp_path, "day=1/a.log", "day=x/b.log", "c.log")
    root = str(tmp_path)
    assert read(spark, [f"{root}/day=*", f"{root}/c.log"]) == ["c.log", "day=1/a.log", "day=x/b.log"]


def test_against_globs_of_the_shell(spark, tmp_path):
    """Random trees and requests, against Python's own globbing."""
    rng = random.Random(1)
    files = sorted({"/".join(rng.choice("abc") for _ in range(rng.randrange(0, 3))) + f"/{rng.choice('abcd')}{rng.randrange(3)}.log" for _ in range(60)})
    make(tmp_path, *[f.lstrip("/") for f in files])
    parts = ["a", "b", "c", "*", "?", "[ab]", "[!a]", "a0.log", "*.log", "b?.log", "[a-c]1*", "d2.log"]
    root = str(tmp_path)
    for _ in range(6):
        asked = [root + "/" + "/".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(12)]
        want, without = set(), []
        for path in dict.fromkeys(asked):
            hits = set()
            for hit in glob.glob(path):
                hits |= {hit} if os.path.isfile(hit) else {e.path for e in os.scandir(hit) if e.is_file()}
            want |= hits
            if not hits:
                without.append(path)
        selection = Selection(spark, asked)
        assert {re.sub(r"\Afile:/+", "/", r.path) for r in selection.matches.collect()} == want
        assert selection.missing == without
        if want:
            assert read(spark, asked) == sorted(os.path.relpath(p, root) for p in want)


def test_alike_branches_are_one_glob():
    paths = [("", "log", f"h{h}", f"{day}", name) for h in range(20) for day in range(30) for name in ("a.log", "b*")]
    (only,) = covering_globs(paths)
    assert only.startswith("/log/{h0,h1,") and only.endswith("/{a.log,b*}")
    assert len(covering_globs([("", "x", str(n)) for n in range(1000)])) == 1
    assert len(covering_globs([("", f"x{n}", "a") for n in range(130)])) == 3
    assert covering_globs([("", "x"), ("", "x", "below")]) == ["/x"]


def test_segments_and_braces():
    assert without_braces("a{b,c{d,e}}f{,g}") == ["abf", "abfg", "acdf", "acdfg", "acef", "acefg"]
    assert without_braces(r"a\{b,c\}") == [r"a\{b,c\}"]
    for segment, name, hit in (("*", "a/b", False), ("?", "/", False), ("[!x]", "/", False), ("[^x]", "y", True), (r"\*", "*", True), (r"\*", "a", False), ("a.b", "axb", False), ("[]", "[]", True)):
        assert bool(re.fullmatch(segment_to_java(segment), name)) is hit, segment


def test_a_hundred_thousand_paths(spark, tmp_path):
    """Planned in seconds, missing paths exact; some of the files exist."""
    make(tmp_path, *[f"h{h}/d{d}.log" for h in range(0, 100, 9) for d in range(0, 1000, 250)])
    asked = [f"{tmp_path}/h{h}/d{d}.log" for h in range(100) for d in range(1000)]
    begin = time.perf_counter()
    selection = Selection(spark, asked)
    there = {p for p in asked if os.path.exists(p)}
    assert len(selection.globs) <= 4
    assert set(selection.missing) == set(asked) - there
    assert len(selection.to_read()) <= len(there)
    assert time.perf_counter() - begin < 30


def test_nothing_found(spark, tmp_path):
    selection = Selection(spark, [f"{tmp_path}/a", f"{tmp_path}/b/*"])
    assert selection.matches.count() == 0 and selection.found == [] and len(selection.missing) == 2
    assert find_files(spark, []) == ([], [])


def test_dates_in_the_period(spark, tmp_path):
    make(tmp_path, "20240101/x.log", "20240102/x.log", "20240103/sub/x.log")
    app = App("one", "", ("one",), (Rule("r", "x"),), ("${logdir}/%Y%m%d/*.log", "${logdir}/%Y%m%d/*/x.log"))
    lines, missing = read_apps(spark, [app], str(tmp_path), date_period("20240101,20240104"), modified_after=None)
    assert sorted(r.raw for r in lines.collect()) == ["20240101/x.log", "20240102/x.log", "20240103/sub/x.log"]
    assert len(missing) == 5
