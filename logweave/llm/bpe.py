"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash cuts each text where its last 32 bytes say so, whatever stands before, so texts that
share passages share chunks.  A chunk is encoded once for all texts of a task and kept in a bounded
cache.  Then the joins are repaired: the stretch around each join is encoded again, from a token
boundary of the left chunk to one of the right, and is stretched further until its own first and last
words come out as they did in the chunks.

Why that is exact: the pre-tokenizer never lets a token hold a single space between two visible ASCII
characters except at its start, whatever comes before or after.  Such spaces are where stretches begin
and end; agreement there is checked all the same.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logweave.llm import text as T

#: A chunk has so many bytes on average, and at least.
CHUNK_BITS, CHUNK_LEAST = 10, 128
#: Bytes that decide on a cut.
WINDOW = 32
#: Bytes of chunks that a task keeps.
CACHE_BYTES = 48 << 20
_GEAR = (T.mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Places where a rolling hash of the ``WINDOW`` bytes before has ``CHUNK_BITS`` zero bits."""
    if len(raw) <= WINDOW:
        return np.empty(0, np.int64)
    h = _GEAR[raw]
    step = 1
    while step < WINDOW:
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
        step *= 2
    cuts = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint32(32 - CHUNK_BITS) == 0) + WINDOW
    return cuts[(raw[cuts] & 0xC0) != 0x80]  # before a character, not inside


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others
    from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with a byte-level BPE of the tokenizers library, given as its JSON."""

    def __init__(self, spec: str):
        import tiktoken
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), i) for k, i in self.special.items())]:
            self.bytes_of[i] = token
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.texts = [str(i) for i in range(len(self.bytes_of))]
        merged = [m if isinstance(m, str) else " ".join(m) for m in parsed["model"]["merges"]]
        ids = [parsed["model"]["vocab"][m.replace(" ", "")] for m in merged]
        plain = parsed["pre_tokenizer"]["type"] == "ByteLevel" and not parsed["pre_tokenizer"]["add_prefix_space"] and parsed["normalizer"] is None
        if not plain or parsed["pre_tokenizer"].get("use_regex") is False or ids != sorted(ids):
            raise ValueError("not a byte-level BPE whose ids follow its merges")
        # the words of the byte-level pre-tokenizer
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.kept_bytes = 0

    def _chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch without special tokens, and where each token ends."""
        found = self.kept.get(data)
        if found is None:
            # beyond Latin letters the two libraries may know different versions of Unicode
            if max(data, default=0) < 0xC9:
                ids = self.fast.encode_to_numpy(data.decode()).astype(np.int32)
            else:
                ids = np.array(self.whole.encode(data.decode(), add_special_tokens=False).ids, np.int32)
            found = ids, np.cumsum(self.lengths[ids])
            self.kept_bytes += len(data) + 12 * len(ids) + 200
            if self.kept_bytes > CACHE_BYTES:
                self.kept, self.kept_bytes = {}, 0
            self.kept[data] = found
        return found

    def encode(self, data: bytes, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Ids of a whole text, given its bytes and its cuts."""
        out, begin = [], 0
        for at, token in sorted((i, t) for t in self.special for i in _places(data, t.encode())):
            if at >= begin:
                out += self._segment(data, raw, cuts, begin, at)
                out.append(np.array([self.special[token]], np.int32))
                begin = at + len(token.encode())
        out += self._segment(data, raw, cuts, begin, len(data))
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def _segment(self, data: bytes, raw: np.ndarray, cuts: np.ndarray, begin: int, end: int) -> list[np.ndarray]:
        if begin == end:
            return []
        bounds = [begin]
        for c in cuts[np.searchsorted(cuts, begin) : np.searchsorted(cuts, end)].tolist():
            if c - bounds[-1] >= CHUNK_LEAST and end - c >= CHUNK_LEAST:
                bounds.append(c)
        bounds.append(end)
        if len(bounds) == 2:
            return [self._chunk(data[begin:end])[0]]
        own = raw[begin:end]
        visible = (own > 0x20) & (own < 0x7F)
        safe = np.flatnonzero((own[1:-1] == 0x20) & visible[:-2] & visible[2:]) + 1 + begin
        chunks = [self._chunk(data[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        out, done = [], begin  # exact up to here
        k = 0  # the chunk that goes on from here
        while k < len(bounds) - 1:
            last = k == len(bounds) - 2
            if last:
                out.append(self._between(chunks[k], bounds[k], done, end))
                break
            left, right, k = self._agreed(data, safe, chunks, bounds, k, done, end)
            if left > done:
                out.append(self._between(chunks_at(chunks, bounds, left), bounds_at(bounds, left), done, left))
            out.append(self._chunk(data[left:right])[0])
            done = right
            if done == end:
                break
        return out

    def _agreed(self, data, safe, chunks, bounds, k, done, end) -> tuple[int, int, int]:
        """The stretch around the join after chunk ``k`` that agrees with the chunks, and the chunk it ends in."""
        join = bounds[k + 1]
        i = int(safe.searchsorted(join)) - 1  # before the join
        j = int(safe.searchsorted(join, "right"))  # after it
        while True:
            while i >= 0 and safe[i] > done and not (safe[i] + 1 < join and self._ends(chunks[k], safe[i] - bounds[k])):
                i -= 1
            left = int(safe[i]) if i >= 0 and safe[i] > done else done
            if j >= len(safe):
                return left, end, len(bounds) - 1
            right = int(safe[j])
            into = bisect_right(bounds, right) - 1
            if right - 1 < bounds[into] or right + 1 >= bounds[into + 1] or not self._ends(chunks[into], right - bounds[into]):
                j += 1
                continue
            # one word more on either side comes out as in the chunks
            after = int(safe[j + 1]) if j + 1 < len(safe) and safe[j + 1] + 1 < bounds[into + 1] else right
            more = self._chunk(data[right:after])[0] if after > right else np.empty(0, np.int32)
            if np.array_equal(more, self._between(chunks[into], bounds[into], right, after)):
                return left, right, into
            j += 1

    @staticmethod
    def _ends(chunk, at: int) -> bool:
        place = int(chunk[1].searchsorted(at))
        return place < len(chunk[1]) and chunk[1][place] == at

    @staticmethod
    def _between(chunk, start: int, a: int, b: int) -> np.ndarray:
        """Ids of a chunk between two token boundaries."""
        ids, ends = chunk
        low = int(ends.searchsorted(a - start, "right")) if a > start else 0
        return ids[low : int(ends.searchsorted(b - start, "right"))]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self.whole.decode(ids.tolist(), skip_special_tokens=False)


def bounds_at(bounds: list[int], at: int) -> int:
    return bounds[bisect_left(bounds, at) - 1]


def chunks_at(chunks: list, bounds: list[int], at: int):
    return chunks[bisect_left(bounds, at) - 1]


def _places(data: bytes, part: bytes) -> Iterator[int]:
    at = data.find(part)
    while at >= 0:
        yield at
        at = data.find(part, at + len(part))


_encoders: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One for each worker, so that chunks are shared by all its tasks."""
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id and ``ids``: what the tokenizers library gives for the whole text.

    ``path`` names a tokenizer file that the driver can read; special tokens are not added, but found
    in the text.  Null and empty texts have no ids.  Repeated rows stay.  Other columns are not read.
    """
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")
    out = docs.mapInArrow(lambda rows: _encoded(rows, _encoder(spec.value)), "id long, ids array<int>")
    return out.withColumnRenamed("id", id)


def _encoded(rows: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for part in T.batches(batch, "text"):
            ids = encode_texts(part.column("text"), encoder)
            at = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(at, values)], ["id", "ids"])


def encode_texts(texts: pa.Array, encoder: Encoder) -> list[np.ndarray]:
    raw, offsets = T.buffer_of(texts)
    cuts = cuts_of(raw)
    data = raw.tobytes()
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = cuts[np.searchsorted(cuts, a + WINDOW) : np.searchsorted(cuts, b)] - a
        out.append(encoder.encode(data[a:b], raw[a:b], own))
    return out


def decode(encoded: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """Each row's id, ``ids`` and ``decoded`` text; no ids give an empty text, null ids too."""
    with open(path, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            decoded = [_encoder(spec.value).decode(x) for x in id_arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    rows = encoded.selectExpr(f"`{id}` AS id", "ids")
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id)


def id_arrays(ids: pa.ListArray) -> Iterable[np.ndarray]:
    values = ids.values.to_numpy(zero_copy_only=False)
    at = ids.offsets.to_numpy()
    null = pc.is_null(ids).to_numpy(zero_copy_only=False)
    return [values[a:b] if not n else values[:0] for a, b, n in zip(at[:-1], at[1:], null, strict=True)]


def digests(encoded: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """Digests of the ids and of the text decoded from them, without moving the text."""
    with open(path, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            encoder = _encoder(spec.value)
            n, of_ids, of_text = [], [], []
            for x in id_arrays(batch.column("ids")):
                n.append(len(x))
                of_ids.append(hashlib.sha256(",".join(map(encoder.texts.__getitem__, x.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(x).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = encoded.selectExpr(f"`{id}` AS id", "ids")
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
