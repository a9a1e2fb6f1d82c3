"""Plans that would hold on a large cluster."""

import pytest

from catalog import QUERIES, apps, views
from logweave import LogSearch, Patterns
from logweave.operators import output

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def table(spark, tmp_path):
    """Lines as a stored table, as a user would keep them."""
    path = str(tmp_path / "lines")
    views.lines(spark, SF).selectExpr("*", "event_id AS line_no").write.parquet(path)
    return spark.read.parquet(path)


def test_search_is_one_stage(table):
    """No shuffle; the pattern is tried before the header is parsed; columns are pruned."""
    run = LogSearch(patterns=Patterns.of("error"), apps=apps.ALL)
    text = plan(run.select(table).select("raw", "rule"))
    assert "Exchange" not in text and "Python" not in text
    assert text.index("explode") < text.index("Contains(raw")
    assert "ReadSchema: struct<file_mtime:timestamp,raw:string>" in text
    assert "StringContains(raw,error)" in text


def test_filters_reach_the_scan(table):
    run = LogSearch(apps=apps.ALL)
    text = plan(run.select(table).filter("file = 'day-20240105'").select("rule"))
    assert "EqualTo(file,day-20240105)" in text


def test_regexes_run_once_per_line(table):
    """Filters on extracted columns do not bring the header pattern back."""
    run = LogSearch(apps=apps.ALL, app_names=("shop",))
    text = plan(run.select(table).filter("host = 'host1' AND rule = 'bought'").select("message"))
    assert text.count("rfc3164\n") == 1


def test_counts_are_partial(table):
    for df in (
        output.count_per_file(table, Patterns.of("error").selects()),
        LogSearch(apps=apps.ALL).results(table),
    ):
        text = plan(df)
        assert "partial_" in text and text.index("Exchange") < text.index("partial_")


def test_limits_are_cut_before_the_shuffle(table):
    text = plan(output.max_count(table, 3))
    assert text.count("WindowGroupLimit") == 4
    below = text[text.rindex("Exchange") :]
    assert "Partial" in below


def test_top_lists_read_the_lines_once(spark):
    df = QUERIES["report_top_events"](spark, SF)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
    assert final.count("FileScan parquet") == 1


@pytest.mark.parametrize(
    "name",
    ["whole_threads", "fold_repeat_notices", "context_groups", "stop_at_newer_line", "skip_unknown_files",
     "name_addresses_and_users", "report_missing_inputs", "search_pattern_file"],
)
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
