import random

import numpy as np

from logweave.llm import language as L

SF = "/root/testdata/sf0.1"
SIZES = (200, 500, 1000, 3000, 10_000, 40_000)
FINNISH = "talo auto kissa koira järvi metsä yö päivä hyvää huomenta kiitos suomi kieli mutta myös joka tämä olla minä kanssa ilman vesi".split()
CODE = "for (int i = 0; i < n; i++) { a[i] = b[i] * c; }\nimport numpy as np\nwhile (true) { break; }\n"


def strange():
    """Random letters with and without spaces, Base64, an unlearned language, Cyrillic and code."""
    rnd = random.Random(3)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n in SIZES:
        for letters in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz     ", base64):
            yield "".join(rnd.choice(letters) for _ in range(n))
        yield " ".join(rnd.choice(FINNISH) for _ in range(n // 5))
        yield " ".join(rnd.choice("дом машина кошка собака озеро лес ночь".split()) for _ in range(n // 6))
        yield CODE * (n // len(CODE) + 1)


def test_strange_texts_are_rejected_and_held_out_ones_stay(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fitted(docs)
    found = L.predict(table(list(enumerate(strange()))), model, kept=["doc_id", "text"]).collect()
    assert [r.text[:60] for r in found if not r.rejected] == []
    held = L.predict(docs.filter(L.HELD_OUT), model, kept=["doc_id"]).collect()
    assert np.mean([r.rejected for r in held]) < 0.004


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 500")
    model = L.fitted(docs.filter("lang != 'de'"))
    assert L.predict(docs.filter("lang = 'de'"), model).selectExpr("avg(int(rejected))").first()[0] > 0.95


def test_thresholds_by_class():
    found = np.zeros((3, L.CLASSES, L.BINS), np.int64)
    found[0, 5, [50, 200]] = 1, 5000  # enough members of its own; one in 5001 may be below
    found[1, 5, 100] = 10  # few, so with those of the language
    found[2, 7, 150] = 10
    least = L.thresholds(found, np.array([0, 0, 1])) / L.REJECT_PART * L.BINS
    assert np.allclose(least[:, 5], [200, 100, 100])
    assert np.allclose(least[:, 6], least[:, 5]) and np.allclose(least[:, 7], 150) and np.allclose(least[:, 8], 150)
    assert np.allclose(least[:, 3], least[:, 5] / 2)
    assert not L.thresholds(found * 0, np.array([0, 0, 1])).any()
