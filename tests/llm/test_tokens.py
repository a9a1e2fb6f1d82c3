"""Encoding and packing against the tokenizers library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logweave.llm import bpe, packing

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'LL", "12", "é", "İ", "ß", "漢字", "😀", ".", "!!", "<|endoftext|>", "<|startoftext|>", "\x00", "\x1c", "\x85", "\xa0", "ǅ", "é", " the", " token", "ization"]


def texts(seed, n):
    rnd = random.Random(seed)
    out = [None, "", " ", " " * 5000, "x" * 20_000, "The " * 3000, "\n" * 2000, "<|endoftext|>" * 30, "漢字" * 3000]
    prose = " ".join(rnd.choice(["plain", "words,", "of", "Text.", "über", "naïve"]) + rnd.choice(["", "s", "ed"]) for _ in range(4000))
    for _ in range(n):
        out.append("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 1500))))
        at = rnd.randrange(len(prose) - 6000)
        out.append(prose[at : at + rnd.randint(500, 6000)] + rnd.choice(PARTS) + prose[: rnd.randint(0, 3000)])
    return out


def expected(path, given):
    whole = Tokenizer.from_file(path)
    return [e.ids for e in whole.encode_batch([t or "" for t in given], add_special_tokens=False)]


@pytest.mark.parametrize("bits", [4, 10])
def test_chunks_join_to_the_same_ids(bits, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BITS", bits)
    monkeypatch.setattr(bpe, "CHUNK_LEAST", 4 if bits == 4 else 128)
    given = texts(bits, 40)
    encoder = bpe.Encoder(open(BYTES, encoding="utf-8").read())
    found = bpe.encode_texts(pa.array(given, pa.string()), encoder)
    assert [f.tolist() for f in found] == expected(BYTES, given)
    assert [encoder.decode(f) for f in found] == [t or "" for t in given]
    broken = np.array([i for i, b in enumerate(encoder.bytes_of) if len(b) == 1 and b[0] > 0x7F][:9], np.int32)
    assert encoder.decode(broken) == encoder.whole.decode(broken.tolist(), skip_special_tokens=False)


def test_chunks_are_shared():
    encoder = bpe.Encoder(open(BYTES, encoding="utf-8").read())
    text = texts(3, 5)[-1]
    bpe.encode_texts(pa.array([text]), encoder)
    kept = len(encoder.kept)
    bpe.encode_texts(pa.array([text, text, "Another start. " + text]), encoder)
    assert len(encoder.kept) <= kept + 8


def test_round_trip_on_spark(table):
    rows = list(enumerate(texts(5, 10)))
    rows += [rows[-1], (None, "no id")]
    encoded = bpe.encode(table(rows), BYTES)
    decoded = sorted(((r.doc_id, r.decoded, r.ids) for r in bpe.decode(encoded, BYTES).collect()), key=lambda r: (str(r[0]), r[1]))
    ids = expected(BYTES, [t for _, t in rows])
    assert decoded == sorted(((i, t or "", x) for (i, t), x in zip(rows, ids)), key=lambda r: (str(r[0]), r[1]))
    assert bpe.digests(bpe.encode(table([]), BYTES), BYTES).count() == 0


def test_word_ids():
    given = texts(6, 60)
    encoder = packing.WordEncoder(open(WORDS, encoding="utf-8").read())
    assert encoder.latin
    assert [encoder.encode(t).tolist() for t in given] == expected(WORDS, given)
    encoder.clear()
    encoder.latin = False
    assert [encoder.encode(t).tolist() for t in given[:40]] == expected(WORDS, given[:40])


def check_pieces(rows, pieces, capacity):
    ids = {i: [*x, 1] for (i, _), x in zip(rows, expected(WORDS, [t for _, t in rows]))}
    windows, documents = {}, {}
    for p in pieces:
        found = np.frombuffer(p.ids, "<u4").tolist()
        assert found == ids[p.doc_id][p.start : p.start + p.length] and len(found) == p.length > 0
        assert p.doc_tokens == len(ids[p.doc_id])
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        documents.setdefault(p.doc_id, []).append((p.start, p.length))
    for spans in [*windows.values(), *documents.values()]:
        spans.sort()
        assert [s for s, _ in spans] == np.r_[0, np.cumsum([n for _, n in spans])][:-1].tolist()
    assert {i: sum(n for _, n in d) for i, d in documents.items()} == {i: len(x) for i, x in ids.items()}
    sizes = [sum(n for _, n in w) for w in windows.values()]
    assert max(sizes) <= capacity
    return sum(capacity - s for s in sizes if s & (s - 1))


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(table, capacity):
    rows = list(enumerate(texts(8, 40)))
    pieces = packing.pack(table(rows), WORDS, capacity=capacity).collect()
    assert check_pieces(rows, pieces, capacity) == 0
    assert packing.pack(table([]), WORDS).count() == 0


def test_crc_of_ids(spark, table):
    piece = packing.pack(table([(1, None)]), WORDS).selectExpr("*", "crc32(ids) AS crc").first()
    assert (piece.length, piece.doc_tokens, piece.offset, piece.crc) == (1, 1, 0, zlib.crc32(b"\x01\0\0\0"))


def test_level_with_least_squares():
    rnd = random.Random(9)
    packer = packing.SumOfSquares(16)
    for row in range(400):
        counts = packer.counts.copy()
        size = rnd.randint(1, 15)

        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return int((after**2).sum())

        feasible = [h for h in range(17 - size) if h == 0 or counts[h]]
        chosen = packer.level_for(size)
        assert chosen in feasible and squares(chosen) == min(map(squares, feasible))
        packer.add(row, np.arange(size, dtype="<u4"))
    assert packer.open == packer.counts.sum() == sum(map(len, packer.windows))


def test_few_open_windows():
    packer = packing.SumOfSquares(100, open_windows=5)
    for row in range(200):
        packer.add(row, np.arange(60, dtype="<u4"))
        assert packer.open <= 6
    packer.close()
    assert sum(len(p[2]) for w in packer.closed for p in w) == 200 * 60
