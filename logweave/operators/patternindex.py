"""Search for the patterns of a table, which may have hundreds of thousands.

A match of a pattern must hold some literal text.  The index keeps pieces of these texts, of a fixed size, by
their hash.  Lines are cut into pieces of the same size, every ``step``-th only, as one of any ``step``
neighbouring pieces of a literal is met then.  Equal hashes make a line a candidate for a pattern, and only
candidates are tested, first for the text and then with the pattern itself.  Patterns that are a whole word need
neither pieces nor tests: the words of lines meet them in an equi-join.  Patterns stay in tables all the way; those
without such a text are few, as a rule, and are tested on every line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.regex import FOLDED, required_texts, to_java, whole_word
from logweave.operators.joins import BROADCAST_ROWS, join_checked, stage

#: Sizes of pieces, and how many neighbours of a literal are indexed: a literal of ``size + step - 1`` letters or
#: more can be met in every ``step``-th piece of a line.  Literals take the first that they are long enough for.
SHAPES = ((12, 8), (6, 4), (4, 1), (3, 1))
#: Pieces whose hashes are broadcast, at some 32 bytes each.
BROADCAST_PIECES = 4_000_000
#: Patterns without text that become conditions of the plan; more are joined by testing each line with each.
LOOSE_PATTERNS = 200
#: Lines with candidates that are broadcast; each has its patterns with it.
BROADCAST_FOUND = BROADCAST_ROWS // 10

_TRANSLATED = "pattern string, java string, literals array<string>, word string, error string"


def read_pattern_table(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct patterns of pattern files, one per line, as a table with the column ``pattern``."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("value").alias("pattern")).distinct()


def _folded(text: Column) -> Column:
    return F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))


def _pieces(text: Column, size: int, step: int) -> Column:
    """Every ``step``-th piece of a text; the look-ahead leaves the letters to the pieces that follow."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))


@dataclass(frozen=True, eq=False)
class PatternTable:
    """Python patterns in the column ``pattern`` of a table; a line is hit when any of them is found in it.

    Nulls are no patterns, repeated ones count once.  No pattern, or an empty one, hits every line.  A pattern
    that is not valid is an error that names some of them.  Lines are told apart by ``key``.
    """

    table: DataFrame
    ignore_case: bool = False
    word: bool = False
    invert: bool = False
    key: tuple[str, ...] = ("file", "line_no")

    @cached_property
    def translated(self) -> DataFrame:
        """``id``, ``java``, ``literals``: texts of which each match holds at least one, null if none is long enough;
        and ``word``, null for patterns that are more than one whole word."""
        shape, fold = (r"\b(?:{})\b" if self.word else "{}"), self.ignore_case

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for pattern in batch.column("pattern").to_pylist():
                    try:
                        text = shape.format(pattern)
                        found, word = to_java(text, fold), None if fold else whole_word(text)
                        rows.append((pattern, found.pattern, required_texts(text, fold, SHAPES[-1][0]), word, None))
                    except (ValueError, OverflowError, RecursionError) as error:
                        rows.append((pattern, None, None, None, str(error)))
                columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
                kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
                names = ["pattern", "java", "literals", "word", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        patterns = self.table.select("pattern").filter("pattern is not null").distinct()
        # a word is one only if all of its letters are word characters to the engine that cuts the lines
        word = F.when(F.rlike("word", F.lit(to_java(r"\A\w+\Z").pattern)), F.col("word"))
        found = patterns.mapInArrow(run, _TRANSLATED).withColumns({"id": F.monotonically_increasing_id(), "word": word})
        found = stage(found)
        wrong = found.filter("error is not null").select("pattern", "error").limit(5).collect()
        if wrong:
            raise ValueError("; ".join(f"pattern {r.pattern!r}: {r.error}" for r in wrong))
        return found

    @cached_property
    def everything(self) -> bool:
        """Whether each line is hit."""
        return self.translated.isEmpty() or not self.translated.filter("pattern = ''").isEmpty()

    @cached_property
    def index(self) -> DataFrame:
        """``piece``, ``id`` and ``shape``: of each literal the neighbouring pieces that fewest literals share."""
        size = F.length("literal")
        which = F.coalesce(*(F.when(size >= s + step - 1, F.lit(k)) for k, (s, step) in enumerate(SHAPES)))
        parts = self.translated.filter("word is null")
        literals = parts.select("id", F.explode("literals").alias("literal"), which.alias("shape"))
        out = None
        for k, (size, step) in enumerate(SHAPES):
            pieces = F.posexplode(_pieces(F.col("literal"), size, 1)).alias("at", "text")
            pieces = literals.filter(F.col("shape") == k).select("id", "literal", pieces)
            pieces = pieces.withColumn("piece", F.xxhash64("text"))
            shared = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("shared"))
            of = W.partitionBy("id", "literal")  # the pieces of one literal
            row = of.orderBy("at").rowsBetween(0, step - 1)
            some = F.struct(F.max("shared").over(row).alias("shared"), F.col("at"))
            pieces = pieces.join(shared, "piece").withColumn("_row", F.when(F.count(F.lit(1)).over(row) == step, some))
            pieces = pieces.withColumn("_best", F.min("_row").over(of)["at"])
            kept = pieces.filter(F.col("at").between(F.col("_best"), F.col("_best") + step - 1))
            kept = kept.select("piece", "id", F.lit(k).alias("shape"))
            out = kept if out is None else out.unionAll(kept)
        return stage(out.distinct())

    @cached_property
    def shapes(self) -> list[int]:
        """The shapes that some literal of the index has."""
        return sorted(r["shape"] for r in self.index.select("shape").distinct().collect())

    @cached_property
    def loose(self) -> DataFrame:
        """Patterns without a text that is long enough."""
        return self.translated.filter("literals is null and word is null").select("id", "java")

    @cached_property
    def words(self) -> DataFrame:
        """The patterns that are whole words, as these."""
        return self.translated.filter("word is not null").select("word").distinct()

    @cached_property
    def shortest_word(self) -> int | None:
        """Letters of the shortest word, if there are any words."""
        return self.words.agg(F.min(F.length("word"))).first()[0]

    def with_words(self, lines: DataFrame) -> DataFrame:
        """``key`` of the lines that have one of the words; the lines' text does not move."""
        run = to_java(rf"\w{{{self.shortest_word},}}").pattern
        words = F.array_distinct(F.regexp_extract_all("raw", F.lit(run), F.lit(0)))
        cut = lines.select(*self.key, F.explode(words).alias("word"))
        return join_checked(cut, self.words, ["word"], "left_semi").select(*self.key).distinct()

    @property
    def _text(self) -> Column:
        return _folded(F.col("raw")) if self.ignore_case else F.col("raw")

    def candidates(self, lines: DataFrame) -> DataFrame:
        """``key`` of lines and the patterns (``java``, ``literals``) whose text they may hold; the lines' text does not move."""
        pieces = F.concat(*(F.transform(_pieces(self._text, *SHAPES[k]), lambda p: F.xxhash64(p)) for k in self.shapes))
        cut = lines.select(*self.key, F.explode(F.array_distinct(pieces)).alias("piece"))
        met = join_checked(cut, self.index.select("piece", "id"), ["piece"], "inner", staged=False, broadcast_rows=BROADCAST_PIECES)
        met = met.select(*self.key, "id")
        return join_checked(met, self.translated.select("id", "java", "literals"), ["id"], "inner", staged=False).drop("id")

    def flag(self, lines: DataFrame, name: str = "hit") -> DataFrame:
        """Lines with a column that tells whether they are hit (not hit, under ``invert``)."""
        columns = [F.col(c) for c in lines.columns]
        if self.everything:
            return lines.withColumn(name, F.lit(not self.invert))
        hit = F.lit(False)
        key, cut = list(self.key), lines
        # a key is one line, so no key is hot
        if self.shortest_word:
            found = self.with_words(cut).withColumn("_word", F.lit(True))
            lines = join_checked(lines, found, key, "left", hot_rows=None)
            hit = hit | F.coalesce("_word", F.lit(False))
        if self.shapes:
            found = self.candidates(cut).groupBy(*key).agg(F.collect_set(F.struct("java", "literals")).alias("_patterns"))
            lines = join_checked(lines, found, key, "left", broadcast_rows=BROADCAST_FOUND, hot_rows=None)

            def matches(p: Column) -> Column:
                # most candidates have a piece of the text only, and that takes no regular expression to see
                return F.exists(p["literals"], lambda t: F.contains(self._text, t)) & F.rlike("raw", p["java"])

            # a line has few candidates; those of none are null
            hit = hit | F.coalesce(F.exists("_patterns", matches), F.lit(False))
        count = self.loose.count()
        if 0 < count <= LOOSE_PATTERNS:
            for r in self.loose.collect():
                hit = hit | F.col("raw").rlike(r.java)
        elif count:
            hits = cut.select(*key, "raw").join(self.loose.select("java"), F.expr("rlike(raw, java)"), "left_semi")
            lines = join_checked(lines, hits.select(*key).distinct().withColumn("_loose", F.lit(True)), key, "left", hot_rows=None)
            hit = hit | F.coalesce("_loose", F.lit(False))
        hit = F.coalesce(hit, F.lit(False))
        return lines.select(*columns, (~hit if self.invert else hit).alias(name))

    def select(self, lines: DataFrame) -> DataFrame:
        """The lines that are hit."""
        return self.flag(lines, "_hit").filter("_hit").drop("_hit")
