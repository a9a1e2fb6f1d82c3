"""A corpus pipeline: documents of quality, in a known language, one of each group of near copies, packed.

Each stage works on all that the one before kept, and its result is written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import language, packing, quality
from logweave.llm.jaccard import jaccard_join
from logweave.operators.joins import join_checked, stage


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones of ``docs``, does not reject."""
    weights = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "_quality")
    scored = quality.score(docs, weights, name=score)
    return scored.filter(F.col(score) >= quality.KEPT_FROM).select(*docs.columns)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a letter and are near enough to a centroid of a language."""
    names = unused(docs, "_lang", "_cosine", "_rejected")
    found = language.predict(docs, language.fitted(docs), names=tuple(names))
    return found.filter(~F.col(names[2])).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies exactly one row: that with the smallest id, no id coming last.

    Rows are judged one by one, also if they repeat an id or a whole row; of one id's rows the one with the
    smallest hash of all columns comes first.  Rows without words are in no group and all stay.
    """
    columns = [F.col(c) for c in docs.columns]
    _order, _row = unused(docs, "_order", "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*columns, *(c.isNull() for c in columns)))
    # the number differs between equal rows and is read from the table from here on, never made again
    rows = stage(docs.select(*columns, order.alias(_order), F.monotonically_increasing_id().alias(_row)))
    # the join gets the number and the text alone: other columns cannot clash with its own
    grouped = jaccard_join(rows.select(F.col(_row).alias("row"), "text"), id="row", size=5, percent=75)
    grouped = grouped.filter("n_shingles > 0").select("row", "component_id")
    grouped = stage(grouped.join(rows.select(F.col(_row).alias("row"), F.col(_order).alias("order")), "row"))
    firsts = grouped.groupBy("component_id").agg(F.min(F.struct("order", "row"))["row"].alias("row"))
    others = grouped.select("row").join(firsts.select("row"), "row", "left_anti").withColumnRenamed("row", _row)
    return join_checked(rows, others, [_row], "left_anti", hot_rows=None).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality classifier", of_quality),
    ("language id", in_a_language),
    ("n-gram Jaccard join", without_near_copies),
    ("packing", packed),
]

#: SQL can express none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
