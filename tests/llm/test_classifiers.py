import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import language as L
from logweave.llm import quality as Q
from logweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
ODD = [None, "", " ", "123", "a", "é", "\n\n", "!!!", "word " * 40_000]


def test_features_do_not_depend_on_the_batch():
    texts = [*ODD, "The The The end", "A B, c! c! 12"]
    found, at = Q.features(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own, _ = Q.features(pa.array([text], pa.string()))
        assert sorted(own.tolist()) == sorted(found[at[i] : at[i + 1]].tolist())
    vectors = L.counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert (L.counts(pa.array([text], pa.string()))[0] == vectors[i]).all()


def test_ftrl_against_a_plain_loop():
    rnd = random.Random(1)
    fast, z, n = Q.Ftrl(20), [0.0] * 20, [0.0] * 20
    for _ in range(200):
        at = np.array(sorted(rnd.sample(range(20), 5)))
        values = np.array([rnd.random() for _ in at])
        label = rnd.randint(0, 1)
        fast.update(at, values, label)
        w = {i: 0.0 if abs(z[i]) <= Q.L1 else ((1 if z[i] > 0 else -1) * Q.L1 - z[i]) / ((Q.BETA + n[i] ** 0.5) / Q.ALPHA + Q.L2) for i in at}
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, values))))
        for i, v in zip(at, values):
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / Q.ALPHA * w[i]
            n[i] += g * g
    assert np.allclose(fast.z, z) and np.allclose(fast.n, n)


def test_quality_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op6_ftrl_quality"](spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [r for r in labels if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_language_query_on_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op10_centroid_language"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.97
    assert np.mean([r.rejected for r in got.values()]) < 0.002


def test_odd_rows(spark, table):
    prose = [(i, "der die das und " * 5, "de") if i % 2 else (i, "the and of with " * 5, "en") for i in range(40)]
    known = spark.createDataFrame([*prose, (50, None, "en"), (51, "no language", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (7, None), (None, 1), (999, 0)], "doc_id long, quality int")
    rows = [*enumerate(ODD), (3, "the of the and"), (3, "the of the and"), (None, "und das die")]
    weights = Q.fitted(known, labels)
    scored = Q.score(table(rows), weights)
    assert scored.columns == ["doc_id", "text", "id", "sid", "n", "key", "place", "score"] and scored.count() == len(rows)
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    found = L.predict(table(rows), L.fitted(known), kept=["doc_id", "text"]).collect()
    assert len(found) == len(rows)
    by_text = {r.text: r for r in found}
    assert by_text["the of the and"].lang_pred == "en" and by_text["und das die"].lang_pred == "de"
    for text in (None, "", " ", "123", "\n\n", "!!!"):
        assert (by_text[text].lang_pred, by_text[text].score, by_text[text].rejected) == ("und", 0.0, True)


def test_nothing_to_learn(spark, table):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    weights, model = Q.fitted(none, labels), L.fitted(none)
    assert [r.score for r in Q.score(table([(1, "a b")]), weights).collect()] == [pytest.approx(0.5)]
    assert [(r.lang_pred, r.rejected) for r in L.predict(table([(1, "a b")]), model).collect()] == [("und", True)]
    assert Q.score(table([]), weights).count() == L.predict(table([]), model).count() == 0
