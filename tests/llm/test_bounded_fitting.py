"""What models are fitted on is bounded whatever repeats, and their parts agree with plain versions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweave.llm import language as L
from logweave.llm import quality as Q
from logweave.llm.sampling import at_most


def test_at_most(spark):
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 7, id) AS id", "concat('t', id % 50000) AS text")
    some = at_most(rows, 500)
    assert 400 <= some.count() <= 500 and sorted(some.collect()) == sorted(some.collect())
    assert some.distinct().count() == some.count() and some.filter("id = 7").count() < 250
    equal = rows.withColumn("text", F.lit("x"))
    assert at_most(equal.filter("id = 7"), 500).count() <= 1
    few = rows.limit(5)
    assert at_most(few, 500).count() == few.distinct().count()
    by = at_most(rows.withColumn("lang", F.expr("if(id = 7, 'a', 'b')")), 300, ["lang"]).groupBy("lang").count().collect()
    assert {r.lang for r in by} == {"a", "b"} and all(200 <= r["count"] <= 300 for r in by)
    assert at_most(rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("hot", range(1, 60, 9))
def test_a_hot_id_stays_within_the_bound(spark, hot):
    """A third of all rows has one id, chosen by its hash or not."""
    docs = spark.range(9000).selectExpr(f"if(id % 3 = 0, {hot}L, id + 100) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(9200).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    assert Q.sample(docs, labels, "doc_id", "quality", "false", max_rows=600).count() <= 600


def test_contradicting_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0), (3, 1), (3, None)], "doc_id long, quality int")
    got = Q.sample(docs, labels, "doc_id", "quality", "false")
    assert sorted((r.doc_id, r.text, r.quality) for r in got.collect()) == [(1, "a", 1), (2, "b", 0), (2, "c", 0)]


def test_a_common_text_is_fitted_once(spark):
    rows = [(i, "the same text again and again", "en") for i in range(400)] + [(1000 + i, f"other words {i} of the tongue", "en") for i in range(40)]
    rows += [(2000 + i, f"andere worte {i} der sprache", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    texts = pa.array(["other words 7 of the tongue", "andere worte 8 der sprache"])
    assert L.nearest(texts, model)[0] == ["en", "de"]


def plain_features(text):
    """Feature counts by plain loops over tokens and their shapes."""
    tokens = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", text)
    shapes = []
    for i, token in enumerate(tokens):
        mark = re.match(r"[0-9A-Za-z\x80-\U0010ffff]", token) is None
        if mark:
            shapes.append(token)
            continue
        upper = sum("A" <= c <= "Z" for c in token)
        size = len(token.encode())
        shape = 4 if re.search("[0-9]", token) else 0 if not upper else 1 if upper == size else 2 if upper == 1 and "A" <= token[0] <= "Z" else 3
        if i > 1 and tokens[i - 2] == token:
            shape = "two before"
        if i > 0 and tokens[i - 1] == token:
            shape = "one before"
        shapes.append(shape)
    found = Counter()
    for kind, (sequence, sizes) in enumerate(((tokens, (1, 2)), (shapes, (1, 2, 3)))):
        for size in sizes:
            for i in range(len(sequence) - size + 1):
                found[kind, size, tuple(sequence[i : i + size])] += 1
    found["length", int(2 * np.log2(len(tokens) + 1))] = max(1, sum(found.values()) // 8)
    return found


TEXTS = [
    "", "a", "The the the cat, cat! A1 b2 USA McDonald's (x) -- éÉ", "one, two, one, two, ONE", "... ... x ...", "a b a b a b a", "İstanbul 42 42 42",
    "Anat with by of nteres atre are.\nThnt eringing onheed, with erenenst thaner ing: 'A' \"B\"",
]


def test_features_against_plain_ngrams():
    found, at = Q.features(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        got, want = Counter(found[at[i] : at[i + 1]].tolist()), plain_features(text)
        assert sorted(got.values()) == sorted(want.values()), text
    # the same feature has the same number in all texts, another one another
    numbers = {}
    for i, text in enumerate(TEXTS):
        want = plain_features(text)
        got = Counter(found[at[i] : at[i + 1]].tolist())
        assert sum(got.values()) == sum(want.values())
        for feature in want:
            numbers.setdefault(feature, set()).update(k for k, n in got.items() if n == want[feature])
    assert all(numbers.values())


def plain_prediction(text, model):
    """Cosines to all centroids by loops over n-grams."""
    plain = [int(L._PLAIN[b]) for b in text.encode()]
    kept = [b for k, b in enumerate(plain) if not (k and b == 0x20 and plain[k - 1] == 0x20)]
    tf = Counter()
    for size in (1, 2, 3):
        for i in range(len(kept) - size + 1):
            code = size
            for b in kept[i : i + size]:
                code = (code * 257 + b) % 2**32
            tf[(code * 2654435761) % 2**32 >> (32 - L.BITS)] += 1
    vector = {k: n**0.5 * float(model.idf[k]) for k, n in tf.items()}
    length = sum(v * v for v in vector.values()) ** 0.5 or 1.0
    return [sum(v * float(c[k]) for k, v in vector.items()) / length for c in model.centroids]


def test_predictions_against_plain_cosines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fitted(docs)
    texts = [r.text for r in docs.filter("length(text) < 600").orderBy("doc_id").limit(60).collect()] + ["x  y", "éé  ee", "12"]
    languages, value, rejected = L.nearest(pa.array(texts, pa.string()), model)
    for text, language, score, out in zip(texts, languages, value, rejected, strict=True):
        cosines = plain_prediction(text, model)
        best = int(np.argmax(cosines))
        if any(c.isalpha() for c in text):
            assert language == model.languages[model.owner[best]] and abs(score - max(0.0, cosines[best])) < 1e-4
            below = score < model.least[best][min(int(np.log2(max(1, (L.counts(pa.array([text]))[0] > 0).sum()))), L.CLASSES - 1)]
            assert out == below
        else:
            assert (language, score, out) == ("und", 0.0, True)
