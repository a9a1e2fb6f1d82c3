import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import lexical as L

TERM = re.compile(L.TERM)


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    held = [(i, terms_of(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    count, words = len(held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms_of(text))
    out = {}
    for item, own in asked.items():
        scores = []
        for id, t in held:
            tf, m = Counter(t), 50 + 50 * len(t) * count // words
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 20 * m)) for x in own if tf[x])
            if score > 0:
                scores.append((-score, id is None, id or 0))
        if scores:
            out[item] = [(None if absent else id, -s) for s, absent, id in sorted(scores)[:k]]
    return out


def run(spark, docs, items, k, parts=3):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "'x' AS item", "0 AS score", "'t' AS terms").repartition(parts)
    items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS item", "4 AS term", "5 AS doc_id")
    out = {}
    for r in sorted(L.rank(docs, items, k).collect(), key=lambda r: (r.item_id, r.rank)):
        own = out.setdefault(r.item_id, [])
        assert r.rank == len(own) + 1
        own.append((r.doc_id, r.score))
    return out


def drawn(seed, count, vocabulary=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(vocabulary)] + ["É", "été", "中文", "A1", "a1", "_", "x_y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(count)]


@pytest.mark.parametrize("k", [1, 3, 50])
def test_against_brute_force(spark, k, monkeypatch):
    docs = list(enumerate(drawn(1, 250))) + [(500, None), (501, ""), (502, " ,. "), (None, "w3 w4"), (None, "w3 w4"), (7, "w1 w50 w50")]
    docs += [(600 + i, "w5 W5 w6.") for i in range(120)]  # copies: equal scores
    items = [(i, t) for i, t in enumerate(drawn(2, 12))] + [(90, None), (91, "nowhere"), (92, "w3 W3 w3"), (93, ""), (92, "w59"), (None, "w1"), (94, "w5"), (95, "AÉ中 a1")]
    want = brute(docs, items, k)
    assert run(spark, docs, items, k) == want
    monkeypatch.setattr(L, "SHARD_DOCS", 40)
    assert run(spark, docs, items, k, parts=2) == want


def test_passes_change_nothing(spark, monkeypatch):
    docs, items = list(enumerate(drawn(3, 80))), list(enumerate(drawn(4, 15)))
    monkeypatch.setattr(L, "PASS_TERMS", 40)
    assert run(spark, docs, items, 5) == brute(docs, items, 5)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == {}
    assert run(spark, [(1, "a")], [], 5) == {}
    assert run(spark, [(1, None)], [(1, "a")], 5) == {}


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("w%d" % rng.randrange(40) for _ in range(n)) for n in (5, 4000, 0, 300)] + ["x" * 3000 + " w1", "é" * 2000]
    asked = sorted({"w%d" % i for i in range(0, 40, 3)} | {"x" * 3000, "é" * 2000})
    monkeypatch.setattr(L.T, "TEXT_BYTES", 512, raising=False)
    monkeypatch.setattr(L, "TEXT_BYTES", 512)
    n, of, number, count = L.postings_of(pa.array(texts), L.Terms(asked))
    for i, text in enumerate(texts):
        tf = Counter(terms_of(text))
        assert n[i] == sum(tf.values())
        got = {asked[t]: c for d, t, c in zip(of, number, count, strict=True) if d == i}
        assert got == {t: tf[t] for t in asked if tf[t]}


def test_equal_hashes_are_not_taken_for_equal_words(monkeypatch):
    terms = L.Terms(["one", "three"])
    monkeypatch.setattr(L.T, "word_hashes", lambda raw, start, end: terms.hashes[np.arange(len(start)) % 2])
    raw = np.frombuffer(b"one three two seven one", np.uint8)
    words = L.T.words_of(raw, np.array([0, len(raw)]), L.T.ALPHANUMERIC)
    place, number = terms.find(raw, words.start, words.end)
    assert all(["one", "three"][t].encode() == raw[words.start[p] : words.end[p]].tobytes() for p, t in zip(place, number, strict=True))


def test_accumulators_are_limited_and_scores_exact():
    rng = np.random.default_rng(6)
    docs, weights = 5000, np.array([9000, 8000, 300, 200, 100], np.int64)
    of = [np.sort(rng.choice(docs, n, replace=False)) for n in (60, 80, 3000, 4000, 4800)]
    pairs = sorted((d, t) for t, own in enumerate(of) for d in own)
    size = np.bincount([d for d, _ in pairs], minlength=docs)
    ask = L.Ask([], weights, docs, docs * 10, 20)
    shard = L.Shard(pa.array(range(docs)), np.full(docs, 10), size, np.array([t for _, t in pairs]), np.ones(len(pairs), np.int64), ask)
    exact = np.zeros(docs, np.int64)
    np.add.at(exact, shard.doc, shard.adds)
    found, made = shard.search(np.arange(5), 20, 0)
    assert made < 200  # of nearly 5,000 documents that hold some term
    best = sorted(range(docs), key=lambda d: (-exact[d], d))[:20]
    assert set(best) <= set(found.tolist())
    assert (shard.scores[found] == exact[found]).all()
    floor = int(exact[best[0]])
    found, made = shard.search(np.arange(5), 20, floor)  # what other shards have limits it further
    assert made <= 140 and set(d for d in best if exact[d] >= floor) <= set(found.tolist())
