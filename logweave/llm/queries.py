"""Registered queries over the driver's tables; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, chat, fingerprints, fixity, language, lexical, licenses, neighbours, packing, quality, sentencepieces, whitening
from logweave.llm.jaccard import jaccard_join

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), size=5, percent=75)


@query()
def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query()
def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


@query()
def op6_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fitted(docs, table(spark, sf_dir, "labels")), kept=["doc_id"])
    return scored.select(
        "doc_id",
        F.expr(quality.HELD_OUT).alias("held_out"),
        "score",
        F.expr(f"int(score >= {quality.KEPT_FROM})").alias("predicted"),
    )


@query()
def op10_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fitted(docs), kept=["doc_id"])
    return found.select("doc_id", F.expr(language.HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


@query()
def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


@query()
def op7_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query()
def op1_schema_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], turns.schema)
    records = chat.records_of_turns(turns.union(own), "conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(records, "conv_id", "turn", "record"), "conv_id")


# A replica of the pages, 128 in a file, with bytes changed in place, records lost and stray ones.
_DAMAGED = "CASE WHEN page_id % 97 = 13 AND length(html) > 0 THEN concat(left(html, length(html) - 1), '~') ELSE html END"


@query(
    f"""
    WITH damaged AS (SELECT page_id, url, html, {_DAMAGED} AS html2 FROM pages),
    bodies AS (
        SELECT page_id, page_id // 128 AS file,
            coalesce('=' || url, '-') || chr(30) || coalesce('=' || html, '-') AS body,
            coalesce('=' || url, '-') || chr(30) || coalesce('=' || html2, '-') AS body2
        FROM damaged
    ),
    one AS (
        SELECT page_id, file, sha256(body) AS digest, sha256(body2) AS digest2, strlen(body) AS length, strlen(body2) AS length2,
            coalesce(sum(strlen(body)) OVER before, 0)::BIGINT AS "offset"
        FROM bodies WINDOW before AS (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
    SELECT file, "offset", 'changed' AS kind, length AS one_length, digest AS one_digest, length2 AS two_length, digest2 AS two_digest
    FROM one WHERE page_id % 193 != 7 AND digest != digest2
    UNION ALL SELECT file, "offset", 'missing', length, digest, NULL, NULL FROM one WHERE page_id % 193 = 7
    UNION ALL SELECT file, "offset" + 1, 'extra', NULL, NULL, length2, digest2 FROM one WHERE page_id % 211 = 5
    """
)
def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("file", F.expr("page_id div 128"))
    one = fixity.records_of(pages, "file", "page_id", ["url", "html"])
    two = fixity.records_of(pages.withColumn("html", F.expr(_DAMAGED)), "file", "page_id", ["url", "html"])
    stray = two.filter("place % 211 = 5").withColumn("offset", F.expr("offset + 1"))
    two = two.filter("place % 193 != 7").union(stray)
    return fixity.audit(one, two, range_bytes=1 << 14, fanout=8)


@query()
def op4_adaptive_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


@query()
def op11_blockmatrix_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query()
def op12_sentencepiece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    r"""
    WITH found AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents
    ),
    docs AS (SELECT row_number() OVER () AS d, doc_id, terms, len(terms)::BIGINT AS n FROM found WHERE len(terms) > 0),
    total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM docs),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    counts AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
    weights AS (
        SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
        FROM counts, total GROUP BY term
    ),
    scored AS (
        SELECT item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words))))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (d), total
        GROUP BY item_id, d, doc_id
    )
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
    FROM scored WHERE score > 0
    QUALIFY rank <= 50
    """
)
def op13_limited_accumulators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)
