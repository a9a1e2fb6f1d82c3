import random
from collections import Counter

import corpus_pipeline


def text(seed, n=40):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def near(seed):
    """A near copy: the last word differs."""
    return text(seed).rsplit(" ", 1)[0] + " other"


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.without_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_near_copies_are_judged_by_row(spark):
    rows = [
        *[(5, text(1), "en")] * 4,  # a repeated row
        (6, text(2), "en"), (6, text(2), "de"),  # an id with equal texts
        (3, text(3), "en"), (7, near(3), "en"), (7, text(4), "en"),  # an id with a near copy and a text of its own
        *[(None, text(5), "en")] * 2, (None, near(5), "en"),  # copies without id
        (None, text(6), "en"), (9, near(6), "en"),  # no id comes last
        (10, None, "en"), (10, None, "en"), (11, "", "en"), (None, " ", "en"),  # no words: in no group
    ]
    got = kept(spark, rows)
    of_five = got.keys() & {(None, text(5)), (None, near(5))}
    assert len(of_five) == 1
    want = Counter([(5, text(1)), (6, text(2)), (3, text(3)), (7, text(4)), (9, near(6)), (10, None), (10, None), (11, ""), (None, " ")])
    assert got == want + Counter(of_five)


def test_which_row_stays_does_not_depend_on_the_order(spark):
    rows = [(1, text(k % 5), str(k)) for k in range(30)]
    docs = [spark.createDataFrame(some, "doc_id long, text string, lang string") for some in (rows, rows[::-1])]
    one, two = (sorted(map(tuple, corpus_pipeline.without_near_copies(spark, d, "").collect())) for d in docs)
    assert one == two and len(one) == 5
