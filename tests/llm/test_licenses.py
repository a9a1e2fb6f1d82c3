import random
import re

import pyarrow as pa
import pytest

from logweave.llm import licenses as L


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels = ",".join(sorted({p[1] for p in places}))
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels


def texts(seed=3):
    rnd = random.Random(seed)
    parts = ["gnu", "GNU general public", "license", "apache", "License", "cc", "BY", "mit", ".", "\n", "-", "é", "x", "cc by", "CC-BY", "mit mit license", "3", "\x00"]
    out = [None, "", " ", "mit", "MIT License", "cc by cc by", "a" * 50_000, "mit license " * 5000]
    return out + [rnd.choice([" ", "-", ""]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]


def test_base_phrases_against_brute_force(table):
    rows = [(i, t) for i, t in enumerate(texts())]
    found = {r.doc_id: r for r in L.summary(L.scan(table(rows))).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels


def lengths(template, text):
    words = L.words_of_text(text)
    scanner = L.Scanner([L.Template("t", template)])
    _, [places] = scanner.scan(pa.array([text]))
    return [(at, n, len(words)) for at, n, _ in places]


def test_markup():
    optional = "one two <<beginOptional>>three <<beginOptional>>four<<endOptional>><<endOptional>> five"
    assert lengths(optional, "One, two five") == [(0, 3, 3)]
    assert lengths(optional, "x one two three five") == [(1, 4, 5)]
    assert lengths(optional, "one two three four five!") == [(0, 5, 5)]
    assert lengths(optional, "one two four five") == []
    assert lengths(optional, "one two three six five") == []
    replaced = "one two <<var;name=who;match=1-3>> end"
    assert lengths(replaced, "one two a end") == [(0, 4, 4)]
    assert lengths(replaced, "one two a b c end") == [(0, 6, 6)]
    assert lengths(replaced, "one two end") == []
    assert lengths(replaced, "one two a b c d end") == []
    assert lengths(replaced, "one two end end") == [(0, 4, 4)]
    assert lengths("one two", "one one two two one two") == [(1, 2, 6), (4, 2, 6)]


def test_whole_texts_with_changed_parts(table):
    mit = next(t for t in L.TEMPLATES if t.label == "mit-text").text
    good = mit.replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace("<<var;match=1-12>>", "Jane Roe")
    bad = good.replace("without restriction", "with restriction")
    got = {r.doc_id: r for r in L.summary(L.scan(table([(1, good), (2, bad), (2, bad), (3, None)]))).collect()}
    assert (got[1].labels, got[1].score) == ("mit-text", 1.0)
    assert (got[2].labels, got[2].score) == ("", 0.0)
    assert (got[3].n_words, got[3].labels) == (0, "")


def test_bad_templates():
    with pytest.raises(ValueError):
        L.Scanner([L.Template("t", "one <<beginOptional>>two<<endOptional>>")])


def test_empty_table(table):
    assert L.summary(L.scan(table([]))).count() == 0
