import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm import text as T

CLASSES = {r"[^\x20\x09-\x0D]+": T.NOT_SPACE, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+": T.ALPHANUMERIC}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB1 \t\n\x0b\x1c.é漢😀\x00")), max_size=30)), max_size=8))
def test_words(texts):
    raw, offsets = T.buffer_of(pa.array(texts, pa.string()))
    seen = {}
    for pattern, kept in CLASSES.items():
        words = T.words_of(raw, offsets, kept)
        hashes = T.word_hashes(raw, words.start, words.end).tolist()
        for i, text in enumerate(texts):
            own = range(words.first[i], words.first[i + 1])
            found = [raw[words.start[k] : words.end[k]].tobytes().decode() for k in own]
            assert found == re.findall(pattern, text or "")
            for k, word in zip(own, found):
                assert seen.setdefault(word, hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_batches():
    rows = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "b" * 50, "", "c" * 5])], ["text"])
    parts = list(T.batches(rows, "text", 10))
    assert pa.Table.from_batches(parts).to_pylist() == rows.to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert list(T.batches(rows.slice(0, 0), "text")) == []
