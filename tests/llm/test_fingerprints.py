import hashlib
import random

import numpy as np

from logweave.llm import fingerprints as P


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_distances_against_the_table():
    rnd = random.Random(1)
    pairs = [("", ""), ("", "abc"), ("abc", ""), ("A" * 64, "A" * 64), ("A" * 64, "B" * 64)]
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 64))) for _ in range(2))
        pairs.append((a, b))
    assert P.distances(pairs).tolist() == [edit_distance(a, b) for a, b in pairs]


def test_fingerprints():
    text = " ".join(str(hash((i, 7)) % 9973) for i in range(3000))
    same, other = P.fingerprint(text.encode()), P.fingerprint(text.encode())
    assert same == other
    assert P.fingerprint(b"") == "3::"
    changed = P.fingerprint((text[:6000] + "inserted " + text[6000:]).encode())
    cut = P.fingerprint(text[: len(text) * 2 // 3].encode())
    unlike = P.fingerprint(" ".join(str(hash((i, 8)) % 9973) for i in range(3000)).encode())
    near, shorter, far = P.likeness([(same, changed), (same, cut), (same, unlike)])
    assert near > 0.9 and shorter > 0.5 and far < 0.3
    assert P.likeness([("3::", "3::"), ("3:ab:a", "48:xy:zz:cd:c:b:a")]).tolist() == [1.0, 0.0]
    assert all(len(s) <= 64 for s in same.split(":")[1:])


def plain_fingerprint(data):
    """By loops over bytes and pieces."""
    if not data:
        return "3::"
    mixed = [(int(P.T.mix(np.array([b + 1], np.uint64))[0]) >> 32) for b in range(256)]
    rolled = []
    for i in range(len(data)):
        h = 0
        for b in [None] * (P.WINDOW - 1 - i) + list(data[max(0, i - P.WINDOW + 1) : i + 1]):
            h = (h * 0x01000193 + (0 if b is None else mixed[b])) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        rolled.append(h ^ (h >> 13))

    def character(piece):
        raw = np.frombuffer(piece, np.uint8)
        return chr(P._ALPHABET[int(P.T.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]) >> 58]), piece

    nominal = 3
    while nominal * 64 < len(data):
        nominal *= 2
    found, block = {}, 3
    while block <= 2 * nominal:
        cuts = [i + 1 for i, h in enumerate(rolled) if h % block == block - 1]
        bounds = sorted({0, *cuts, len(data)})
        pieces = [(a, data[a:b]) for a, b in zip(bounds, bounds[1:])]
        pieces = [p for k, p in enumerate(pieces) if not k or p[1] != pieces[k - 1][1]]
        if len(pieces) > 64:
            pieces = [*pieces[:63], (pieces[63][0], data[pieces[63][0] :])]
        found[block] = "".join(character(piece)[0] for _, piece in pieces)
        block *= 2
    own = max([b for b in found if b <= nominal and len(found[b]) >= 32], default=3)
    return ":".join([str(own), *(found[b] for b in sorted(found))])


def test_against_plain_loops():
    rnd = random.Random(9)
    texts = ["", "a", "abc" * 30, "line of a text\n" * 90, "x" * 700]
    texts += [" ".join(rnd.choice(["one", "two", "äö", "three", "😀"]) for _ in range(n)) for n in (3, 40, 300, 900)]
    texts.append(texts[-1][:1500] + "same line again\n" * 200)
    for text in texts:
        assert P.fingerprint(text.encode()) == plain_fingerprint(text.encode())


def test_half_of_a_text_is_enough_on_the_driver_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = [r for r in P.with_next(rows).collect() if r.n_chars > 200]
    near = np.array([r.near_edited for r in found])
    # of some, the half they share is one short line over and over
    assert len(found) > 900 and near.min() > 0 and (near > 0.3).mean() > 0.995
    assert np.mean([r.near_next for r in found]) < 0.2


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = (P.fingerprint(t.encode()) for t in (text, edited, after))
        near = P.likeness([(a, b), (a, c)])
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, *np.round(near, 12).tolist()))
    return sorted(out, key=str)


def run(df):
    rows = P.with_next(df).collect()
    return sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in rows], key=str)


def test_edited_and_next(table, monkeypatch):
    rnd = random.Random(2)
    words = ["äß", "one", "two", "three", "漢字", "x", "😀"]
    rows = [(i * 7 - 40, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 80, 900])))) for i in range(150)]
    rows += [(5_000, None), (5_001, ""), (5_001, ""), (5_001, "same id"), (5_001, "same id too"), (None, "no id"), (None, "no id")]
    rows += [(6_000, "long " * 20_000), (6_001, rows[3][1])]
    assert run(table(rows)) == expected(rows)


def test_small_tables(table):
    assert run(table([])) == []
    assert run(table([(4, "only one")])) == expected([(4, "only one")])
    assert run(table([(4, "a"), (2, None)])) == expected([(4, "a"), (2, None)])
    assert run(table([(None, "a"), (None, "b b b")])) == expected([(None, "a"), (None, "b b b")])


def test_fingerprint_per_row(table):
    found = {r.doc_id: r.fingerprint for r in P.fingerprints(table([(1, None), (2, "a b c")])).collect()}
    assert found == {1: "3::", 2: P.fingerprint(b"a b c")}
