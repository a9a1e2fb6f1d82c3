"""Pattern search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from logweave.operators.joins import checkpoint_dir
from logweave.operators.patternindex import PatternTable
from logweave.operators.search import Patterns, read_patterns, select_lines

_LINE = "file, CAST(line_no AS BIGINT) AS line_no"


@query(
    f"""WITH {views.CORPUS} SELECT {_LINE}, raw FROM c
    WHERE regexp_matches(raw, 'th[a-z]+ing') OR regexp_matches(raw, '^[A-Z][a-z]+ the')"""
)
def search_patterns(spark, sf_dir):
    found = select_lines(views.corpus(spark, sf_dir), Patterns.of("th[a-z]+ing", "^[A-Z][a-z]+ the"))
    return found.select("file", "line_no", "raw")


@query(f"WITH {views.CORPUS} SELECT {_LINE} FROM c WHERE regexp_matches(raw, '(?i)THERE|ÇON')")
def search_ignoring_case(spark, sf_dir):
    found = select_lines(views.corpus(spark, sf_dir), Patterns.of("THERE", "ÇON", ignore_case=True))
    return found.select("file", "line_no")


@query(
    f"""WITH {views.CORPUS} SELECT {_LINE} FROM c
    WHERE regexp_matches(raw, '(^|[^\\pL\\pN_])(the|un)($|[^\\pL\\pN_])')"""
)
def search_whole_words(spark, sf_dir):
    found = select_lines(views.corpus(spark, sf_dir), Patterns.of("the|un", word=True))
    return found.select("file", "line_no")


@query(f"WITH {views.CORPUS} SELECT {_LINE} FROM c WHERE NOT regexp_matches(raw, '[aeiou]n')")
def search_inverted(spark, sf_dir):
    found = select_lines(views.corpus(spark, sf_dir), Patterns.of("[aeiou]n", invert=True))
    return found.select("file", "line_no")


@query(
    f"""WITH {views.CORPUS}, p AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS phrase FROM benchmark)
    SELECT {_LINE} FROM c
    WHERE EXISTS (SELECT 1 FROM p WHERE phrase <> '' AND contains(c.raw, p.phrase)) OR regexp_matches(raw, 'qu.n')"""
)
def search_pattern_file(spark, sf_dir):
    """Whole phrases from a file, one per line, next to a given pattern."""
    path = f"{checkpoint_dir(spark)}/patterns-{uuid.uuid4().hex}"
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    phrases = items.select(F.explode(F.split("text", "\n")).alias("phrase")).filter("phrase <> ''")
    # letters that mean something in patterns stand for themselves
    phrases.select(F.regexp_replace("phrase", r"([^\pL\pN ])", r"\\$1").alias("value")).distinct().write.text(path)
    patterns = Patterns.of("qu.n", *read_patterns(spark, path))
    return select_lines(views.corpus(spark, sf_dir), patterns).select("file", "line_no")


@query(
    f"""WITH {views.CORPUS}, words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\pL\\pN_]+')) AS word FROM benchmark)
    SELECT DISTINCT {_LINE}
    FROM (SELECT file, line_no, unnest(regexp_extract_all(raw, '[\\pL\\pN_]+')) AS word FROM c) JOIN words USING (word)
    WHERE length(word) > 5"""
)
def search_pattern_table(spark, sf_dir):
    """Whole words from a table of patterns that stays a table."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = items.select(F.explode(F.regexp_extract_all("text", F.lit(r"[\pL\pN_]+"), F.lit(0))).alias("pattern"))
    table = PatternTable(words.filter(F.length("pattern") > 5), word=True)
    return select_lines(views.corpus(spark, sf_dir), table).select("file", "line_no")


@query(
    f"""WITH {views.CORPUS} SELECT {_LINE},
        CASE WHEN regexp_matches(raw, 'th[a-z]+') THEN regexp_extract(raw, 'th[a-z]+')
             ELSE regexp_extract(raw, '[A-Z][a-z]+') END AS part
    FROM c WHERE regexp_matches(raw, 'th[a-z]+') OR regexp_matches(raw, '[A-Z][a-z]+')"""
)
def only_matching_part(spark, sf_dir):
    patterns = Patterns.of("th[a-z]+", "[A-Z][a-z]+")
    found = select_lines(views.corpus(spark, sf_dir), patterns)
    return found.select("file", "line_no", patterns.matching_part().alias("part"))


@query(
    f"""WITH {views.CORPUS} SELECT part, count(*) AS times
    FROM (SELECT unnest(regexp_extract_all(raw, 'qu[a-z]+')) AS part FROM c) GROUP BY part"""
)
def all_matching_parts(spark, sf_dir):
    patterns = Patterns.of("qu[a-z]+")
    found = select_lines(views.corpus(spark, sf_dir), patterns)
    parts = found.select(F.explode(patterns.all_parts()).alias("part"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("times"))


@query(
    f"""WITH {views.CORPUS} SELECT {_LINE}, regexp_replace(raw, '(eau|ing)', '<<\\1>>', 'g') AS marked
    FROM c WHERE regexp_matches(raw, 'eau|ing')"""
)
def highlight_matches(spark, sf_dir):
    patterns = Patterns.of("eau|ing")
    found = select_lines(views.corpus(spark, sf_dir), patterns)
    return found.select("file", "line_no", patterns.highlight("<<", ">>").alias("marked"))
