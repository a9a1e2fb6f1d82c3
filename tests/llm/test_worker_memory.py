"""Python workers serve all stages of a run: what a stage takes for a moment is bounded, and it leaves nothing behind."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from logweave.llm import language as L
from logweave.llm import packing
from logweave.llm import quality as Q
from logweave.llm import text as T
from logweave.llm.jaccard import jaccard_join

MB = 1e6


def texts_of(count: int, words: int, seed: int = 5) -> list[str]:
    draw = random.Random(seed)
    known = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9))) for _ in range(3000)]
    return [" ".join(draw.choices(known, k=words)) for _ in range(count)]


def peak_of(make) -> float:
    tracemalloc.start()
    try:
        make()
        return tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def test_training_takes_texts_by_small_slices():
    texts = texts_of(400, 800)
    rows = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % 2 for i in range(len(texts))])], ["text", "label"])
    assert rows.nbytes > 2 * MB
    assert peak_of(lambda: list(Q._trained(iter([rows])))) < 100


def test_clustering_holds_rows_as_sparse_ones():
    texts = [f"{t} {'abc' if i % 3 else 'xyz ' * 20}" for i, t in enumerate(texts_of(600, 30))]
    idf = np.linspace(0.5, 2, 1 << L.BITS).astype(np.float32)
    every = np.concatenate([L.vectors(pa.array(texts[i : i + 50]), idf) for i in range(0, len(texts), 50)])
    cut = [every[:64], every[64:128], every[128:130], *np.array_split(every[130:], 8)]
    parts = [L.Sparse(p) for p in cut]
    assert all((p.rows() == c).all() for p, c in zip(parts, cut, strict=True))

    # spherical k-means over all rows at once
    order = np.argsort(every @ L.unit(every.mean(axis=0, keepdims=True))[0], kind="stable")
    centres = every[order[((np.arange(3) + 0.5) / 3 * len(every)).astype(int)]]
    for _ in range(L.ROUNDS):
        nearest = np.argmax(every @ centres.T, axis=1)
        centres = L.unit(np.array([every[nearest == c].sum(axis=0) for c in range(len(centres)) if (nearest == c).sum() >= len(every) / 100]))
    found = []
    assert peak_of(lambda: found.append(L.cluster(parts, 3))) < every.nbytes / MB
    assert found[0].shape == centres.shape
    assert np.abs(found[0] - centres).max() < 1e-4


def test_memory_is_given_back_when_a_task_has_ended():
    T.kept("mine", lambda: "kept")
    T.kept("other", lambda: "gone")
    assert list(T.releasing(iter([1, 2]), "mine")) == [1, 2]
    assert T.kept("mine", lambda: "new") == "kept"
    assert T.kept("other", lambda: "new") == "new"
    T.release()
    assert not T._cache


def test_stages_leave_nothing_in_workers(spark, monkeypatch):
    # workers of their own, which no other test has used
    monkeypatch.setitem(spark.sparkContext.environment, "WORKERS_OF", "test_worker_memory")
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts_of(60, 40))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")

    def held(rows):
        for _ in rows:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([len(T._cache)])], ["n"])

    def left() -> int:
        return max(r.n for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect())

    Q.score(docs, Q.fitted(docs, labels)).collect()
    assert left() == 0
    L.predict(docs, L.fitted(docs)).collect()
    assert left() == 0
    jaccard_join(docs).collect()
    assert left() == 0
    packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert left() == 1  # the words, for further tasks of packing
