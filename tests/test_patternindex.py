"""Tables of patterns against searching each line with each pattern."""

import random
import re

import pytest
from pyspark.sql import functions as F

from logweave import LogSearch, Patterns
from logweave.functions.regex import required_texts, whole_word
from logweave.operators import patternindex
from logweave.operators.joins import spread
from logweave.operators.patternindex import PatternTable, read_pattern_table
from logweave.operators.search import select_lines

WORDS = "the error failed password accepted connection closed Été Straße ſmart kelvin İstanbul user-17 10.0.0.1 a b [x] (y) $5 zz".split()


def table(spark, patterns):
    return spark.createDataFrame([(p, 1) for p in patterns], "pattern string, id int")


def drawn(seed, count):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(count)] + ["", "x" * 5000 + "needle" + "y" * 300]


def hits(lines, patterns, flags=0, shape="{}"):
    found = [re.compile(shape.format(p), flags) for p in patterns]
    return [n for n, t in enumerate(lines, 1) if any(f.search(t) for f in found)]


PATTERNS = [
    "accepted connection", "user-1[0-9]", r"(error|failed) pass", r"10\.0\.0\.1 (the|a)\b", "needle", r"^the the", r"b$", r"\(y\) \[x\]",
    "(?:closed ){2}", "Straße", r"\$5 zz", "failed password accepted connection clos", "(?i)FAILED zz", r"[aeiou]{4}", "accepted connection",
]


@pytest.mark.parametrize("options", [{}, {"ignore_case": True}, {"word": True}, {"invert": True}])
def test_against_each_pattern(spark, lines_of, options):
    texts = drawn(1, 400) + ["SMART SMART", "KELVIN", "istanbul", "STRASSE", "straße", "FAILED ZZ", "failedK zz"]
    # flags of a whole pattern cannot stand inside a word
    patterns = [p for p in PATTERNS if not (options.get("word") and "(?i)" in p)] + (["smart smart", "kelvin zz", "istanbul"] if options.get("ignore_case") else [])
    lines = lines_of(texts)
    got = PatternTable(table(spark, [*patterns, None]), **options).select(lines)
    assert got.columns == lines.columns
    want = select_lines(lines, Patterns.of(*patterns, **options))
    assert sorted(r.line_no for r in got.collect()) == sorted(r.line_no for r in want.collect())
    if not options:
        assert sorted(r.line_no for r in want.collect()) == hits(texts, patterns)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_pieces_and_loose_patterns_by_join(spark, lines_of, monkeypatch, broadcast):
    """Beyond the bounds both go through joins that shuffle."""
    monkeypatch.setattr(patternindex, "BROADCAST_PIECES", broadcast)
    monkeypatch.setattr(patternindex, "LOOSE_PATTERNS", 1)
    texts = drawn(2, 200)
    patterns = [*PATTERNS, "[xz]{2}", "^a b"]
    got = PatternTable(table(spark, patterns)).select(lines_of(texts))
    assert sorted(r.line_no for r in got.collect()) == hits(texts, patterns)


def test_all_lines(spark, lines_of):
    lines = lines_of(["a", "b", ""])
    for patterns in ([], [None], ["zzz", ""]):
        assert PatternTable(table(spark, patterns)).select(lines).count() == 3
        assert PatternTable(table(spark, patterns), invert=True).select(lines).count() == 0


def test_invalid_patterns_are_named(spark, lines_of):
    with pytest.raises(ValueError, match=r"'\(open'"):
        PatternTable(table(spark, ["fine", "(open"])).select(lines_of(["x"]))


def test_a_hundred_thousand_patterns(spark, lines_of):
    """They are not collected, and no plan holds a nested loop."""
    texts = [f"request {n} for item-{n * 37 % 400_000:06d} done" for n in range(3000)] + ["nothing here"] * 100
    patterns = spark.range(100_000).select(F.format_string("item-%06d done$", F.col("id") * 3).alias("pattern"))
    found = PatternTable(patterns)
    kept = found.select(lines_of(texts))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = [n for n, t in enumerate(texts, 1) if t != "nothing here" and int(re.search(r"item-(\d+)", t)[1]) % 3 == 0 and int(re.search(r"item-(\d+)", t)[1]) < 300_000]
    assert sorted(r.line_no for r in kept.collect()) == want
    assert found.translated.count() == 100_000 and found.loose.count() == 0
    # a line is tested with a few patterns, though all are alike
    assert found.candidates(lines_of(texts)).count() < 10 * len(texts)


def test_as_part_of_a_run(spark, lines_of, tmp_path):
    log = [
        "Jan  5 10:00:01 gate sshd[100]: Accepted password for bob from 10.0.0.1 port 22 ssh2",
        "Jan  5 10:00:02 gate sshd[101]: Accepted password for eve from 10.0.0.2 port 22 ssh2",
        "Jan  5 10:00:03 gate sshd[101]: Connection closed by 10.0.0.2",
    ]
    (tmp_path / "p.txt").write_text("for eve\nnobody\nfor eve\n")
    patterns = read_pattern_table(spark, str(tmp_path / "p.txt"))
    assert patterns.count() == 2
    run, plain = LogSearch(patterns=PatternTable(patterns)), LogSearch(patterns=Patterns.of("for eve", "nobody"))
    lines = lines_of(log)
    for step in ("select", "counts", "app_counters", "extra_tags", "results"):
        one, two = getattr(run, step)(lines), getattr(plain, step)(lines)
        as_rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
        assert as_rows(one) == as_rows(two), step
    near = run.context(lines, 1, 1).select("line_no", "kind").orderBy("line_no").collect()
    assert [tuple(r) for r in near] == [(1, "context"), (2, "match"), (3, "context")]


def test_texts_that_matches_hold():
    cases = {
        "abc": ["abc"], "ab": None, "a.bcd": ["bcd"], "abc|defg": ["abc", "defg"], "fail|fatal": ["fail", "fatal"], "abc|x": None,
        "(abc)+x": ["abc"], "(abc)?xyz": ["xyz"], "(?i)abc": None, "(?i:abc)defg": ["defg"], "ab(?:cd)ef": ["abcdef"], "(a|b)cdef": ["cdef"],
        "[xy]": None, "(?=abc)": None, "abc(?!def)": ["abc"],
    }
    for pattern, texts in cases.items():
        assert required_texts(pattern) == texts, pattern
    assert required_texts("ÉTÉ Straße KIM", ignore_case=True) == ["e kim"]
    assert required_texts("ÉÉÉ", ignore_case=True) is None


def test_whole_words_take_no_pattern(spark, lines_of):
    """They meet the words of lines; only the other patterns are tested, and those by their text first."""
    texts = drawn(3, 300) + ["Été", "étéx", "x-Été-y", "a_b", "a b", "user_17", "x\U00010400y", "\U00010400"]
    words = ["Été", "password", "a", "a_b", "nowhere", "\U00010400"]
    plan = PatternTable(table(spark, words), word=True).select(lines_of(texts))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()
    for patterns, shape in ((words, r"\b(?:{})\b"), ([*words, r"10\.0\.0\.1", "use[r]-17"], r"\b(?:{})\b"), ([r"\bKelvin|kelvin\b", r"\bzz\b", "Straße"], "{}")):
        found = PatternTable(table(spark, patterns), word=shape != "{}")
        assert sorted(r.line_no for r in found.select(lines_of(texts)).collect()) == hits(texts, patterns, shape=shape)
        missed = PatternTable(table(spark, patterns), word=shape != "{}", invert=True).select(lines_of(texts))
        assert sorted(r.line_no for r in missed.collect()) == sorted(set(range(1, len(texts) + 1)) - set(hits(texts, patterns, shape=shape)))


def test_which_patterns_are_whole_words():
    cases = {r"\bab\b": "ab", r"\b(?:ab)\b": "ab", r"\b(?:a|b)\b": None, r"\b\b": None, r"ab\b": None, r"(?i)\bab\b": None, r"(?a)\bab\b": None, r"\bab+\b": None, r"\b(?i:a)b\b": None, r"\Bab\b": None}
    assert {p: whole_word(p) for p in cases} == cases


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file may have many splits and its rows in one of them."""
    rows = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        out = spread(spark.read.parquet(str(tmp_path / "t.parquet")))
        assert out.rdd.getNumPartitions() >= 8
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 50_000 / 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
