"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A text is a row of tokens: words (ASCII letters and digits and all beyond ASCII) and runs of other
visible characters.  Its features are hashed n-grams of tokens, hashed n-grams of token shapes (case,
digits, punctuation as it is, same as the token before), and its length.  The score is the sigmoid of the
sparse dot product of weights and feature shares.

Training takes at most ``max_rows`` labelled rows, chosen by hashes, in one task; the weights are one vector of ``2 ** BITS`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as T
from logweave.llm.sampling import at_most, below

BITS = 18
#: Rows that training uses, at most.
MAX_ROWS = 8000
EPOCHS = 4
#: Learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.002, 0.002
#: Feature values are shares of all features of the text times this.
SCALE = 16.0
_MARK = np.array([not (T.ALPHANUMERIC[b] or b <= 0x20 or b == 0x7F) for b in range(256)])
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)], dtype=np.int32)
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)], dtype=np.int32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, one after the other, and where each text's begin."""
    raw, offsets = T.buffer_of(texts)
    n = len(offsets) - 1
    words, marks = T.words_of(raw, offsets, T.ALPHANUMERIC), T.words_of(raw, offsets, _MARK)
    start, end = np.r_[words.start, marks.start], np.r_[words.end, marks.end]
    order = np.argsort(start, kind="stable")
    mark = np.r_[np.zeros(len(words.start), bool), np.ones(len(marks.start), bool)][order]
    text = np.r_[words.text, marks.text][order]
    start, end = start[order], end[order]
    hashes = T.word_hashes(raw, start, end)
    uppers, digits = np.r_[0, np.cumsum(_UPPER[raw])], np.r_[0, np.cumsum(_DIGIT[raw])]
    upper, length = uppers[end] - uppers[start], end - start
    shape = np.where(upper == 0, 0, np.where(upper == length, 1, np.where(uppers[start + 1] - uppers[start] == upper, 2, 3)))
    shape = np.where(digits[end] - digits[start] > 0, 4, shape).astype(np.uint64)
    shape = np.where(mark, hashes, shape)
    # the token that stands where this one stood, one or two tokens before
    for back in (2, 1):
        same = np.zeros(len(hashes), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back]) & ~mark[back:]
        shape = np.where(same, np.uint64(10 + back), shape)
    shape = T.mix(shape + np.uint64(99))
    codes, owners = [], []
    for kind, sequence in enumerate((hashes, shape)):
        for size in (1, 2, 3) if kind else (1, 2):
            grams = T.shingle_hashes(sequence, size)
            own = text[: len(grams)]
            whole = own == text[size - 1 :] if len(grams) else np.empty(0, bool)
            codes.append(T.mix(grams[whole] + np.uint64(1000 * kind + size)))
            owners.append(own[whole])
    counts = np.bincount(text, minlength=n)
    lengths = np.floor(2 * np.log2(counts + 1)).astype(np.uint64)
    several = np.maximum(1, np.bincount(np.concatenate(owners), minlength=n) // 8)
    codes.append(np.repeat(T.mix(lengths + np.uint64(5000)), several))
    owners.append(np.repeat(np.arange(n), several))
    codes, owners = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (codes[order] >> np.uint64(64 - BITS)).astype(np.int32), np.r_[0, np.cumsum(np.bincount(owners, minlength=n))]


def scores(found: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sigmoid of the dot product of each text; weight 0 is the constant."""
    sums = np.add.reduceat(weights[found + 1].astype(np.float64), at[:-1])  # every text has a feature
    return 1 / (1 + np.exp(-(weights[0] + SCALE * sums / np.diff(at))))


class Ftrl:
    """Weights as follow-the-regularised-leader sums, updated one text at a time."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-float(w @ values))) - label) * values
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] += gradient**2


def train(rows: DataFrame, id: str, text: str, label: str, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from labelled rows; rows without label are left out.  Without rows all weights are 0."""
    rows = rows.selectExpr(f"xxhash64(`{id}`) AS place", f"`{text}` AS text", f"int(`{label}`) AS label").filter("label IS NOT NULL")
    one = rows.repartition(1).sortWithinPartitions("place", "text").mapInArrow(lambda rows: T.releasing(_trained(rows)), "weights binary")
    found = one.collect()
    return np.frombuffer(found[0].weights, np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def _trained(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, samples = Ftrl((1 << BITS) + 1), []
    for batch in rows:
        for part in T.batches(batch, "text", T.SLICE):
            found, at = features(part.column("text"))
            for i, label in enumerate(part.column("label").to_pylist()):
                own, counts = np.unique(found[at[i] : at[i + 1]], return_counts=True)
                values = np.r_[1.0, SCALE * counts / counts.sum()].astype(np.float32)
                samples.append((np.r_[0, own + 1].astype(np.int32), values, label))
    for _ in range(EPOCHS):
        for sample in samples:
            model.update(*sample)
    if samples:
        weights = model.weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])


def sample(docs: DataFrame, labels: DataFrame, id: str, label: str, held_out: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """Labelled rows that are not held out, at most ``max_rows`` of them.

    Ids are chosen by a hash, then rows of ``docs`` with those ids, of which one id may have any number.  Equal
    rows count once.  An id whose labels contradict each other teaches nothing and is left out.
    """
    known = labels.filter(f"`{label}` IS NOT NULL AND `{id}` IS NOT NULL").filter(f"NOT ({held_out})")
    known = known.groupBy(id).agg(F.min(label).alias(label), F.max(label).alias("_other")).filter(F.col(label) == F.col("_other")).drop("_other")
    rows = known.count()
    if rows > max_rows:
        known = known.filter(below(F.xxhash64(F.lit(7), id), F.lit(max_rows / rows)))
    # about max_rows small rows
    return at_most(docs.drop(label).join(F.broadcast(known), id), max_rows)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept``, or all, of ``docs`` and the score of each text in ``name``, from 0 to 1, higher for better.

    Null texts score as empty ones.  An existing column ``name`` is replaced.  Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop(name)
    kept = [c for c in docs.columns if kept is None or c in kept]
    schema = docs.select(*kept, F.lit(None).cast("double").alias(name)).schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in T.batches(batch, text, T.SLICE):
                found = scores(*features(part.column(text)), shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found)], [*kept, name])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(lambda rows: T.releasing(run(rows)), schema)


#: Rows whose labels are not learnt.
HELD_OUT = "coalesce(crc32(string(doc_id)) % 5 = 0, false)"
#: Texts that score less are rejected.
KEPT_FROM = 0.3


def fitted(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return train(sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), "doc_id", "quality", HELD_OUT), "doc_id", "text", "quality")
