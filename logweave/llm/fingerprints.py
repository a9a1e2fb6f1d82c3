"""Context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text into pieces; each piece gives one character of a
signature, of equal pieces in a row the first.  The block size, three times a power of two, grows with the
length and is halved until the signature has at least half of ``LENGTH`` characters.  A text has signatures
for all sizes up to twice the one of its length; a signature that is full ends in one character for all the
rest, so those of small sizes cost little.  Likeness is one minus the edit distance of two signatures of the
same block size over the longer one's length: the best of the sizes that both have, from the smaller one's
own on.  Sizes at which both have few characters count only if there is no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as T

WINDOW = 7
LEAST_BLOCK = 3
#: Characters of a signature that the block size aims at, and that it has at most.
LENGTH = 64
#: Characters from which on a signature says enough.
FEW = 8
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = (T.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def block_size(size: int) -> int:
    """Smallest three times a power of two at which about ``LENGTH`` pieces make up ``size`` bytes."""
    block = LEAST_BLOCK
    while block * LENGTH < size:
        block *= 2
    return block


def rolling(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes up to each byte; fewer at the start."""
    padded = np.r_[np.zeros(WINDOW - 1, np.uint32), _ROLL[raw]]
    h = np.zeros(len(raw), np.uint32)
    for k in range(WINDOW):
        h = h * np.uint32(0x01000193) + padded[k : k + len(raw)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def fingerprint(data: bytes) -> str:
    """``block:signature:signature...``: the own block size, and signatures from ``LEAST_BLOCK`` on; two of an empty text."""
    raw = np.frombuffer(data, np.uint8)
    nominal = block_size(len(raw))
    if not len(raw):
        return f"{nominal}::"
    h, sums = rolling(raw), T.prefix_sums(raw)
    sizes = [LEAST_BLOCK << k for k in range((2 * nominal // LEAST_BLOCK).bit_length())]
    found = [_signature(h, sums, block) for block in sizes]
    own = next((b for b, s in zip(sizes[-2::-1], found[-2::-1], strict=True) if len(s) >= LENGTH // 2), LEAST_BLOCK)
    return ":".join([str(own), *found])


def _signature(h: np.ndarray, sums, block: int) -> str:
    reach = 4 * LENGTH * block  # far enough as a rule, if the signature is full
    while True:
        bounds = np.r_[0, np.flatnonzero(h[:reach] % np.uint32(block) == block - 1) + 1]
        if reach >= len(h) and bounds[-1] < len(h):
            bounds = np.r_[bounds, len(h)]
        pieces = T.hashes_between(sums, bounds[:-1], bounds[1:])
        fresh = np.ones(len(pieces), bool)
        fresh[1:] = pieces[1:] != pieces[:-1]
        if reach >= len(h) or fresh.sum() > LENGTH:
            break
        reach *= 4
    pieces = pieces[fresh]
    if len(pieces) > LENGTH:  # the last piece takes the rest of the text
        begin = bounds[:-1][fresh][LENGTH - 1 : LENGTH]
        pieces = np.r_[pieces[: LENGTH - 1], T.hashes_between(sums, begin, np.array([len(h)]))]
    return _ALPHABET[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Edit distance of each pair of signatures, by bit vectors over all pairs at once."""
    n = len(pairs)
    lengths = np.array([len(a) for a, _ in pairs], np.int64)
    others = np.array([len(b) for _, b in pairs], np.int64)
    first, second = (
        np.frombuffer(b"".join(p[k].encode().ljust(LENGTH, b"\0") for p in pairs), np.uint8).reshape(n, LENGTH) for k in (0, 1)
    )
    table = np.zeros((n, 128), np.uint64)
    rows = np.arange(n)
    for i in range(LENGTH):
        some = lengths > i
        table[rows[some], first[some, i]] |= np.uint64(1) << np.uint64(i)
    one = np.uint64(1)
    plus, minus = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
    top = one << (np.maximum(lengths, 1) - 1).astype(np.uint64)
    score = lengths.copy()
    for j in range(int(others.max(initial=0))):
        some = others > j
        match = table[rows, second[:, j]]
        vertical = match | minus
        horizontal = (((match & plus) + plus) ^ plus) | match
        up, down = minus | ~(horizontal | plus), plus & horizontal
        score = np.where(some, score + ((up & top) != 0) - ((down & top) != 0), score)
        up, down = (up << one) | one, down << one
        plus, minus = np.where(some, down | ~(vertical | up), plus), np.where(some, up & vertical, minus)
    return np.where(lengths == 0, others, score)


def signatures(found: str) -> tuple[int, dict[int, str]]:
    """The own block size of a fingerprint, and its signatures by block size."""
    block, *parts = found.split(":")
    return int(block), {LEAST_BLOCK << k: part for k, part in enumerate(parts)}


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 for equal ones, 0 at block sizes that do not meet."""
    signed, owner, exact = [], [], []
    for i, (a, b) in enumerate(pairs):
        (of_a, one), (of_b, two) = signatures(a), signatures(b)
        exact.append(a == b)
        shared = sorted(block for block in one.keys() & two.keys() if block >= min(of_a, of_b))
        long = [block for block in shared if max(len(one[block]), len(two[block])) >= FEW]
        for block in long or shared[:1]:
            signed.append((one[block], two[block]))
            owner.append(i)
    out = np.zeros(len(pairs))
    if signed:
        longest = np.array([max(len(a), len(b), 1) for a, b in signed])
        np.maximum.at(out, np.array(owner), 1 - distances(signed) / longest)
    return np.where(exact, 1.0, np.clip(out, 0, 1))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Each row's id and fingerprint; null texts are empty ones.  Repeated rows stay."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in T.batches(batch, "text"):
                found = [fingerprint((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.string())], ["id", "found"])

    docs = docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")
    return docs.mapInArrow(run, "id long, found string").withColumnsRenamed({"id": id, "found": name})


#: Rows of a range of ids that one task goes through, about, and ranges at most.
RANGE_ROWS, RANGES = 4096, 10_000

_EDITED = (
    "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against its edited text and the next one, in ascending order of id.

    The edited text has its last half (code points, rounded down) replaced by as many code points from the
    start of the next text, or all of them; after the last text comes the first.  Rows without id come
    first and rows of one id are in order of their texts.  Null texts are empty.  A single row follows itself.

    Texts are moved once, into ranges of ids, and go through a task in order.  The first row of each range
    also goes to the range before.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = docs.select("id").count()
    ranges = max(1, min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))))
    parts = [k / ranges for k in range(1, ranges)]
    points = sorted(set(docs.approxQuantile("id", parts, 0.1 / ranges))) if parts and rows else []
    # the range of an id: how many of the points are not above it; ids are compared as numbers, not dealt by hash
    points = [int(p) for p in points]

    def placed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids = batch.column("id")
            at = np.searchsorted(np.array(points, np.int64), ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *batch.columns], ["place", *batch.schema.names])

    starts = docs.select("id").mapInArrow(placed, "place int, id long").groupBy("place")
    # at most a row per range; a missing id comes first
    starts = {r.place: None if r.missing else r.first for r in starts.agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("missing")).collect()}
    order = sorted(starts)
    before = {starts[p]: order[i - 1] for i, p in enumerate(order)}  # first id -> the range that also needs it

    def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in placed(found):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, bool))], ["place", "id", "text", "after"])
            extra = [i for i, x in enumerate(batch.column("id").to_pylist()) if x in before]
            if extra:
                some = batch.take(pa.array(extra))
                place = pa.array([before[x] for x in some.column("id").to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays([place, some.column("id"), some.column("text"), pa.array(np.ones(len(extra), bool))], ["place", "id", "text", "after"])

    moved = docs.mapInArrow(dealt, "place int, id long, text string, after boolean")
    moved = moved.repartition(ranges, "place").sortWithinPartitions("place", "after", "id", "text")
    return moved.mapInArrow(_followed, _EDITED).withColumnRenamed("id", id)


def _followed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the next; a row ``after`` the range only follows its last."""
    waiting: tuple | None = None  # place, id, text
    pairs: list[tuple] = []
    for batch in rows:
        for part in T.batches(batch, "text"):
            for place, id, text, after in zip(*(part.column(c).to_pylist() for c in ("place", "id", "text", "after")), strict=True):
                if waiting is not None and waiting[0] == place:
                    pairs.append((waiting[1], waiting[2], text))
                waiting = None if after else (place, id, text)
            if pairs:
                yield _compared(pairs)
                pairs = []


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    edited = []
    for _, text, after in pairs:
        half = len(text) // 2
        edited.append((text[: len(text) - half] + after[:half]).encode())
    own = [fingerprint(text.encode()) for _, text, _ in pairs]
    # the next text's is the next row's, but for the last
    following = [own[i + 1] if i + 1 < len(pairs) and pairs[i + 1][1] == p[2] else fingerprint(p[2].encode()) for i, p in enumerate(pairs)]
    changed = [fingerprint(e) for e in edited]
    columns = [
        pa.array([p[0] for p in pairs], pa.int64()),
        pa.array([len(p[1]) for p in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array(own),
        pa.array(changed),
        pa.array(likeness(list(zip(own, changed, strict=True)))),
        pa.array(likeness(list(zip(own, following, strict=True)))),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _EDITED.split(", ")])
