import numpy as np

import corpus_pipeline
from logweave.llm import language, quality
from logweave.operators.joins import stage
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    docs = stage(docs.unionByName(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", "s", 0)], docs.schema)))
    steps = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    good = stage(steps["quality classifier"](spark, docs, SF))
    assert good.columns == docs.columns
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fitted(docs, labels)).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores.items() if s >= 0.3}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    wrong = [i for i in scores if i in marked and marked[i] != (scores[i] >= 0.3)]
    assert len(wrong) <= 0.02 * len(scores)

    known = stage(steps["language id"](spark, good, SF))
    rejected = {r.doc_id for r in language.predict(good, language.fitted(good)).filter("rejected").collect()}
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in good.collect()} - rejected

    single = stage(steps["n-gram Jaccard join"](spark, known, SF))
    assert single.columns == docs.columns
    want = {i for i, _, c, _ in brute([(r.doc_id, r.text) for r in known.collect()]) if i == c}
    assert {r.doc_id for r in single.collect()} == want

    pieces = steps["packing"](spark, single, SF).collect()
    assert check_pieces([(r.doc_id, r.text) for r in single.collect()], pieces, 2048) == 0


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.all([callable(f) for _, f in corpus_pipeline.STAGES])
