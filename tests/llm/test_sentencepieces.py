import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from logweave.llm import sentencepieces as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "    ", "\n", "\t", "\r", "▁", "the", "a", "ing", "é", "ж", "中文", "字", "😀", "0", "17", ".", ",", "(){", "\0", "�", "<s>", "</s>", "<0x41>", "<unk>", "‍", "aaaa", "é", ""]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return S.Encoder(file.read())


def drawn(seed, count=1500, most=120):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randrange(most))) for _ in range(count)]


def test_agrees_with_the_library_on_drawn_texts(encoder):
    texts = drawn(1) + ["", " ", "\n", "▁", "x" * 5000, "日本語" * 3000, " " * 300, "a b " * 100_000]
    got = [ids.tolist() for ids, _ in encoder.encode_batch(texts)]
    assert got == encoder.library.encode(texts)
    assert not encoder.differing
    assert [encoder.decode(np.array(ids, np.int32)) for ids in got] == encoder.library.decode(got)


def test_stretches_join_to_the_whole_agenda(encoder):
    for text in drawn(2, 200, 40):
        whole = (" " + text).replace(" ", S.SPACE)
        parts = encoder.stretches(text)
        assert "".join(parts).replace(" ", S.SPACE) == (whole if text else "")
        if text:
            assert [x for part in parts for x in encoder.merged(part.replace(" ", S.SPACE))] == encoder.merged(whole)


def test_rows_and_heap_agree(encoder):
    words = sorted({w for text in drawn(3, 300, 30) + ["x" * 41, "ab" * 20, "internationalisation"] for w in encoder.stretches(text)})
    encoder.clear()
    encoder.merge_all(words)
    rows = dict(encoder)
    encoder.clear()
    assert rows == {w: encoder[w] for w in words}
    encoder.clear()
    encoder.merge_all([])
    assert not encoder


def small(scores):
    """An encoder of a few pieces; letters without a score are part of pieces only."""
    encoder = S.Encoder.__new__(S.Encoder)
    encoder.ids = {piece: k for k, piece in enumerate(scores)}
    encoder.order = {piece: place for piece, place in scores.items() if len(piece) > 1}
    encoder.byte_ids = {b: 100 + b for b in range(256)}
    encoder._number(400)
    return encoder


def test_best_score_first_then_leftmost():
    encoder = small({"ab": 2, "bc": 1, "abc": 5, "cd": 0, "aa": 3, "aaa": 3, "x": 0, "a": 0, "b": 0, "d": 0})
    want = {"abcx": ["abc", "x"], "abcd": ["ab", "cd"], "abab": ["ab", "ab"], "aaaaa": ["aaa", "aa"], "acx": ["a", "c", "x"]}
    for stretch, symbols in want.items():
        assert encoder.merged(stretch) == symbols
    encoder.merge_all(list(want))
    for stretch, symbols in want.items():
        ids = [i for s in symbols for i in ([encoder.ids[s]] if s in encoder.ids else [100 + b for b in s.encode()])]
        assert np.frombuffer(encoder[stretch], np.int32).tolist() == ids


def test_ids_of_any_kind_are_decoded_as_by_the_library(encoder):
    rng = random.Random(4)
    for _ in range(1000):
        ids = [rng.choice([0, 1, 2, 3, 72, 200, 232, 259, 300, 29871, 500]) for _ in range(rng.randrange(8))]
        assert encoder.decode(np.array(ids, np.int32)) == encoder.library.decode(ids)


def test_a_small_cache_changes_nothing(encoder, monkeypatch):
    texts = drawn(5, 300)
    want = encoder.library.encode(texts)
    monkeypatch.setattr(S, "KEPT_STRETCHES", 50)
    for k in range(0, 300, 20):
        assert [ids.tolist() for ids, _ in encoder.encode_batch(texts[k : k + 20])] == want[k : k + 20]


def test_a_difference_is_counted_and_the_library_holds(encoder, monkeypatch):
    encoder = S.Encoder(open(PATH, "rb").read())
    monkeypatch.setattr(S.Encoder, "merged", lambda self, stretch: list(stretch))
    monkeypatch.setattr(S, "ROW_LENGTHS", ())
    (ids, differing), (none, zero) = encoder.encode_batch(["the thing the", "q"])
    assert ids.tolist() == encoder.library.encode("the thing the") and differing == 3
    assert none.tolist() == encoder.library.encode("q") and zero in (0, 1)


def test_whole_tables(spark, table, encoder):
    rows = [(1, None), (2, ""), (3, " a  b\n"), (3, " a  b\n"), (None, "the"), (4, "long " * 60_000), (5, "中" * 30_000)]
    rows += list(enumerate(drawn(6, 100), 10))
    docs = table(rows)
    got = S.digests(docs, PATH).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "differing"}
    want = []
    for id, text in rows:
        ids = encoder.library.encode(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((id, len(ids), digest, hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest(), 0))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted([tuple(r) for r in got], key=order) == sorted(want, key=order)
    assert S.digests(table([]), PATH).count() == 0
    assert S.encode(table([]), PATH).count() == 0
    assert {(r.doc_id, len(r.ids)) for r in S.encode(docs, PATH).collect()} == {(r[0], r[1]) for r in want}
    decoded = {r.doc_id: r.decoded for r in S.decode(S.encode(docs, PATH), PATH).collect()}
    assert decoded[3] == " a  b\n" and decoded[1] == "" and decoded[4] == "long " * 60_000
    assert S.disagreements(docs, PATH).count() == 0


def test_the_driver_table_agrees_with_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert S.disagreements(docs, PATH).count() == 0
    assert S.encode(docs, PATH).filter("differing > 0").count() == 0


def test_other_models_are_refused(spark, table, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        S.encode(table([]), str(tmp_path / "other.model"))
