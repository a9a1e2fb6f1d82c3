"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams of one to three bytes, square roots of counts times inverse
document frequency, of length 1.  Each language has a few centroids from spherical k-means.  A text gets the
language of the centroid with the largest cosine; it is rejected if that is less than the centroid's
threshold for texts with about as many distinct n-grams.

Centroids come from at most ``MAX_ROWS`` different texts of each language, chosen by a hash of the text, and have
``CENTROIDS * 2 ** BITS`` numbers per language.  Thresholds come from all texts to learn from: counts of
their cosines, at most ``CENTROIDS * CLASSES * BINS`` numbers per language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as T
from logweave.llm.sampling import at_most

#: A text of m distinct n-grams in random buckets has a cosine of about sqrt(m / 2 ** BITS) to dense centroids.
BITS = 14
CENTROIDS = 3
#: Texts of a language that centroids are fitted on, at most.
MAX_ROWS = 1500
ROUNDS = 8
#: A text is rejected below what all but this share of a centroid's members reach, less a tenth for texts unseen.
REJECT_SHARE, REJECT_PART = 0.001, 0.9
#: Members a share is taken of, at least; with fewer, those of the language count, then of all languages.
LEAST_MEMBERS = 1000
#: Thresholds are apart for 2, 4, 8... distinct n-grams; cosines are counted in so many bins.
CLASSES, BINS = BITS + 1, 250
#: Texts whose vectors are made together.
TEXTS = 64
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, bytes beyond ASCII as they are, all else a space.
_PLAIN = np.array(
    [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], dtype=np.uint32
)


@dataclass
class Model:
    languages: list[str]
    #: Of each centroid: language, vector, threshold of each class.
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray


def counts(texts: pa.Array) -> np.ndarray:
    """Hashed n-gram counts, a row per text.  An n-gram with two spaces in a row does not count."""
    raw, offsets = T.buffer_of(texts)
    n = len(offsets) - 1
    plain = _PLAIN[raw]
    if len(plain):
        spaces = (plain[1:] == 0x20) & (plain[:-1] == 0x20)
        kept = np.r_[True, ~spaces]
        kept[offsets[:-1][offsets[:-1] < len(plain)]] = True
        plain = plain[kept]
        offsets = np.r_[0, np.cumsum(kept)][offsets]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) << BITS
    out = np.zeros(n << BITS, np.int64)
    for size in (1, 2, 3):
        code = np.full(max(len(plain) - size + 1, 0), size, np.uint32)
        for k in range(size):
            code = code * np.uint32(257) + plain[k : len(plain) - size + 1 + k]
        code = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        whole = text[: len(code)] == text[size - 1 :] if len(code) else np.empty(0, bool)
        out += np.bincount(text[: len(code)][whole] + code[whole], minlength=n << BITS)
    return out.reshape(n, 1 << BITS)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1)


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(found.astype(np.float32)) * idf)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    return weighted(counts(texts), idf)


def classes(found: np.ndarray) -> np.ndarray:
    """Class of each row of n-gram counts: the logarithm of how many it has."""
    return np.log2(np.maximum((found > 0).sum(axis=1), 1)).astype(np.int64)


class Sparse:
    """Rows of few numbers other than 0, as their places and values."""

    def __init__(self, rows: np.ndarray):
        self.shape = rows.shape
        self.at = np.flatnonzero(rows).astype(np.int32)
        self.values = rows.ravel()[self.at]

    def rows(self) -> np.ndarray:
        out = np.zeros(self.shape, np.float32)
        out.ravel()[self.at] = self.values
        return out


def cluster(parts: list[Sparse], count: int) -> np.ndarray:
    """Spherical k-means from rows spread by their cosine to the mean; centroids of under a hundredth
    of the rows are dropped.  One part at a time is written out."""
    begins = np.cumsum([0, *(p.shape[0] for p in parts)])
    mean = unit(sum(p.rows().sum(axis=0, keepdims=True) for p in parts) / begins[-1])[0]
    order = np.argsort(np.concatenate([p.rows() @ mean for p in parts]), kind="stable")
    centres = []
    for row in order[((np.arange(count) + 0.5) / count * begins[-1]).astype(int)]:
        part = np.searchsorted(begins, row, "right") - 1
        centres.append(parts[part].rows()[row - begins[part]])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        size, sums = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.float32)
        for rows in (p.rows() for p in parts):
            members = np.arange(len(centres))[:, None] == np.argmax(rows @ centres.T, axis=1)
            size += members.sum(axis=1)
            sums += members.astype(np.float32) @ rows
        centres = unit(sums[(size > 0) & (size >= begins[-1] / 100)])
    return centres.astype(np.float32)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", learnt: str = "true", max_rows: int = MAX_ROWS) -> Model:
    """A model from rows with text and language for which ``learnt`` holds."""
    known = docs.filter(f"`{text}` IS NOT NULL AND `{lang}` IS NOT NULL").filter(learnt)
    every = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = at_most(every, max_rows, ["lang"])

    def seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in rows:
            for part in _parts(batch, "text"):
                total += (counts(part.column("text")) > 0).sum(axis=0)
                n += part.num_rows
        if n:
            both = np.r_[total, n]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], ["bucket", "n"])

    found = every.select("text").mapInArrow(lambda rows: T.releasing(seen(rows)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros((1 << BITS) + 1)
    for row in found.collect():
        frequency[row.bucket] = row.n
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 0.1).astype(np.float32)

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("text", key=lambda texts: texts.map(lambda t: hashlib.sha256(t.encode()).digest()))
        texts = pa.array(rows["text"], pa.string())
        found = [Sparse(vectors(part.column("text"), idf)) for part in _parts(pa.RecordBatch.from_arrays([texts], ["text"]), "text")]
        centres = cluster(found, CENTROIDS)
        lang = rows["lang"].iloc[0]
        del rows, texts, found
        T.release()
        return pd.DataFrame({"lang": lang, "centre": [c.tobytes() for c in centres]})

    rows = known.groupBy("lang").applyInPandas(clustered, "lang string, centre binary").collect()
    rows.sort(key=lambda r: (r.lang, r.centre))
    languages = sorted({r.lang for r in rows})
    model = Model(
        languages,
        np.array([languages.index(r.lang) for r in rows], np.int64),
        np.array([np.frombuffer(r.centre, np.float32) for r in rows], np.float32).reshape(-1, 1 << BITS),
        np.zeros((len(rows), CLASSES)),
        idf,
    )
    if rows:
        model.least = thresholds(reached(every, model), model.owner)
    return model


def reached(known: DataFrame, model: Model) -> np.ndarray:
    """How many texts have which cosine, by centroid and class; texts whose nearest centroid is of another
    language or that have no letter do not count."""
    shape = (len(model.owner), CLASSES, BINS)
    shared = known.sparkSession.sparkContext.broadcast(model)

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros(shape, np.int64)
        own = np.array(model.languages, object)
        for batch in rows:
            for part in _parts(batch, "text"):
                found = counts(part.column("text"))
                cosines = weighted(found, model.idf) @ model.centroids.T
                best, value = cosines.argmax(axis=1), cosines.max(axis=1)
                ok = (own[model.owner[best]] == np.array(part.column("lang").to_pylist(), object)) & lettered(part.column("text"))
                bins = np.clip((value * BINS).astype(np.int64), 0, BINS - 1)
                np.add.at(total, (best[ok], classes(found)[ok], bins[ok]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["place", "n"])

    found = known.mapInArrow(lambda rows: T.releasing(counted(rows)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    out = np.zeros(shape, np.int64)
    for row in found.collect():
        out.flat[row.place] = row.n
    return out


def thresholds(found: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Least cosine by centroid and class.

    The cosines of a centroid's members count together with ``LEAST_MEMBERS`` of its language's, and those with as
    many of all languages', so that a threshold moves from the pool's to its own as members come.  A class
    without members of any language takes the next smaller class's threshold, which is lower as a rule,
    or else what the next larger one's comes to when cosines shrink with the root of the number of n-grams.
    """
    out = np.full(found.shape[:2], np.nan)
    for c, k in np.ndindex(out.shape):
        pools = found[:, k].sum(axis=0), found[owner == owner[c], k].sum(axis=0), found[c, k]
        pool = pools[0].astype(float)
        if pool.any():
            for own in pools[1:]:
                pool = own + pool * (LEAST_MEMBERS / pool.sum())
            below = np.cumsum(pool)
            out[c, k] = np.searchsorted(below, REJECT_SHARE * below[-1], "right") / BINS * REJECT_PART
    some = np.flatnonzero(~np.isnan(out).any(axis=0))
    for k in range(out.shape[1]) if len(some) else ():
        smaller = some[some <= k]
        out[:, k] = out[:, smaller[-1]] if len(smaller) else out[:, some[0]] * 2.0 ** ((k - some[0]) / 2)
    return np.nan_to_num(out)


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    for part in T.batches(batch, text, T.SLICE):
        for i in range(0, part.num_rows, TEXTS):
            yield part.slice(i, TEXTS)


def lettered(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)


def nearest(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine, and whether the text is rejected."""
    letters = lettered(texts)
    if not len(model.owner):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    found = counts(texts)
    cosines = weighted(found, model.idf) @ model.centroids.T
    best = cosines.argmax(axis=1)
    value = np.clip(np.where(letters, cosines[np.arange(len(best)), best], 0.0), 0.0, 1.0).astype(np.float64)
    languages = [model.languages[model.owner[b]] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return languages, value, ~letters | (value < model.least[best, classes(found)])


NAMES = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, text: str = "text", kept: list[str] | None = None, names: tuple = NAMES) -> DataFrame:
    """The columns ``kept``, or all, of ``docs`` with ``names``: language, score, whether it is rejected.

    A null text or one without letter is ``und`` with score 0, and rejected; so are all texts if there
    was nothing to learn from.  Columns of these names are replaced.  Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    kept = [c for c in docs.columns if kept is None or c in kept]
    added = [F.lit(None).cast(t).alias(n) for n, t in zip(names, ("string", "double", "boolean"), strict=True)]
    schema = docs.select(*kept, *added).schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in _parts(batch, text):
                languages, value, rejected = nearest(part.column(text), shared.value)
                columns = [*(part.column(c) for c in kept), pa.array(languages, pa.string()), pa.array(value), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(lambda rows: T.releasing(run(rows)), schema)


#: Rows whose languages are not learnt.
HELD_OUT = "coalesce(crc32(string(doc_id)) % 4 = 2, false)"


def fitted(docs: DataFrame) -> Model:
    return fit(docs, learnt=f"doc_id IS NOT NULL AND NOT ({HELD_OUT})")
