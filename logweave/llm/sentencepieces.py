"""Encoding and decoding with SentencePiece vocabularies of the merge type, by an agenda of symbol pairs.

A text is a row of symbols, at first its characters.  Adjacent pairs that make a piece of the vocabulary
are on an agenda, ordered by the score of that piece, then by place.  The best is taken, its two symbols
become one, and the pairs with its new neighbours go on the agenda, until it is empty.

Only pairs that make a piece ever merge, so no symbol reaches over two characters that stand next to each
other in no piece.  Such places cut a text into stretches that can be encoded one by one: a worker encodes
a stretch once and keeps its ids in a cache of bounded size.  Within each Arrow batch, the stretches that
are new to the worker are checked against the sentencepiece library in one call.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm import text as T
from logweave.llm.bpe import id_arrays

#: Stretches whose ids a worker keeps, and the longest of them in characters.
KEPT_STRETCHES, KEPT_LENGTH = 800_000, 64
#: Symbols of stretches that are worked off together, as rows of a matrix; those of more have a heap each, which
#: gives the same.
ROW_LENGTHS = (1, 6, 8, 10, 12, 16, 24, 40)
#: The letter that vocabularies write a space with.
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # kinds of pieces in a model file


class Encoder(dict):
    """Encodes and decodes with a model file, given as its bytes.

    A mapping from stretches (with plain spaces) to the bytes of their ids, filled as stretches come.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        super().__init__()
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        kinds = {p.type for p in spec.pieces}
        rules, trained = spec.normalizer_spec, spec.trainer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        if trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("not a merge-type vocabulary with byte fallback whose texts stay as they are")
        self.library = SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == _NORMAL}
        #: Place of each piece of several characters in the order of scores, the best first; equal scores share one.
        longer = [p for p in spec.pieces if p.type == _NORMAL and len(p.piece) > 1]
        places = {score: k for k, score in enumerate(sorted({p.score for p in longer}, reverse=True))}
        self.order = {p.piece: places[p.score] for p in longer}
        self._number(len(spec.pieces))
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == _BYTE}
        self.special = {i for i, p in enumerate(spec.pieces) if p.type in (_UNKNOWN, _CONTROL)}
        self.bytes_of = [b"" if i in self.special else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(spec.pieces)]
        self.texts = [str(i) for i in range(len(spec.pieces))]
        self.starts = [p.type == _NORMAL and p.piece.startswith(SPACE) for p in spec.pieces]
        #: Neighbours in some piece; all other neighbours are in different stretches.
        self.inside = {piece[k : k + 2] for piece in self.order for k in range(len(piece) - 1)}
        self.cut = re.compile(self._pattern())
        self.differing: dict[str, bytes] = {}

    def _number(self, count: int) -> None:
        """Numbers of symbols: ids of pieces, ``pad``, then letters that are part of pieces only; and all pairs that make a piece."""
        self.pad = count
        number = dict(self.ids)
        for letter in sorted({c for piece in self.order for c in piece} - number.keys()):
            number[letter] = count + 1 + len(number) - len(self.ids)
        self.symbols = count + 2 + len(number) - len(self.ids)
        self.letters = np.full(0x110000, -1, np.int64)
        for symbol, k in number.items():
            if len(symbol) == 1:
                self.letters[ord(symbol)] = k
        made = sorted((number[piece[:k]] * self.symbols + number[piece[k:]], place, self.ids[piece]) for piece, place in self.order.items() for k in range(1, len(piece)) if piece[:k] in number and piece[k:] in number)
        never = (np.iinfo(np.int64).max, np.iinfo(np.int64).max, 0)
        self.pair_keys, self.place_of, self.made_of = (np.array(x, np.int64) for x in zip(*made, never, strict=True))

    def _pattern(self) -> str:
        """Stretches that a regular expression finds: cuts before spaces and around line feeds, where allowed."""
        if any(pair[0] != SPACE and pair[1] == SPACE for pair in self.inside):
            return r"(?s).+"
        if any("\n" in pair for pair in self.inside):
            return r" +[^ ]*|[^ ]+"
        return r" +[^ \n]*|[^ \n]+|\n"

    def stretches(self, text: str) -> list[str]:
        """All of a text with the space in front that the vocabulary asks for."""
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        found = self.cut.findall(text)
        if max(map(len, found)) <= KEPT_LENGTH:
            return found
        return [part for long in found for part in (self.cuts(long) if len(long) > KEPT_LENGTH else (long,))]

    def cuts(self, stretch: str) -> list[str]:
        """A long stretch, cut wherever its neighbours are in no piece."""
        own = stretch.replace(" ", SPACE)
        at = [0, *(k for k in range(1, len(own)) if own[k - 1 : k + 1] not in self.inside), len(own)]
        return [stretch[a:b] for a, b in zip(at, at[1:], strict=False)]

    def merge_all(self, stretches: list[str]) -> None:
        """Put the ids of new stretches into the mapping.

        Short ones of known letters are worked off together: each is a row of a matrix, the agenda of a row
        are the places of its pairs, and a step merges the best pair of every row that has one.
        """
        sizes = np.array([len(s) for s in stretches], np.int64)
        code = np.frombuffer("".join(stretches).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        letters, end = self.letters[code], np.cumsum(sizes)
        known = np.add.reduceat(letters < 0, end - sizes) == 0 if len(stretches) else np.empty(0, bool)
        least = 0
        for width in ROW_LENGTHS:
            rows = np.flatnonzero(known & (sizes > least) & (sizes <= width))
            least = width
            if len(rows):
                at = (end - sizes)[rows, None] + np.arange(width)
                inside = at < end[rows, None]
                matrix = np.where(inside, letters[np.where(inside, at, 0)], self.pad)
                for row, ids in self._by_rows(matrix.astype(np.int64)):
                    self[stretches[rows[row]]] = ids
        for stretch in stretches:
            self[stretch]  # the rest one by one

    def _by_rows(self, symbols: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Rows of symbols, with the bytes of their ids when no pair is left; not those that need bytes of letters."""
        of = np.arange(len(symbols))
        pairs = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(of):
            row = np.arange(len(of))
            best = self.place_of[pairs].argmin(axis=1) if pairs.shape[1] else None
            taken = pairs[row, best] if best is not None else np.full(len(of), len(self.place_of) - 1)
            done = taken == len(self.place_of) - 1
            if done.any():
                ready = symbols[done]
                count, plain = (ready != self.pad).sum(axis=1), ((ready < self.pad) | (ready == self.pad)).all(axis=1)
                data, width = ready.astype(np.int32).tobytes(), 4 * ready.shape[1]
                for k, (n, r) in enumerate(zip(count.tolist(), of[done].tolist(), strict=True)):
                    if plain[k]:
                        yield r, data[k * width : k * width + 4 * n]
                of, symbols, pairs = of[~done], symbols[~done], pairs[~done]
                if not len(of):
                    return
                row, best, taken = np.arange(len(of)), best[~done], taken[~done]
            width = symbols.shape[1]
            symbols[row, best] = self.made_of[taken]
            stay = np.ones(symbols.shape, bool)
            stay[row, best + 1] = False
            symbols = symbols[stay].reshape(len(of), width - 1)
            stay = np.ones(pairs.shape, bool)
            stay[row, best] = False
            pairs = pairs[stay].reshape(len(of), width - 2)
            right = np.flatnonzero(best < width - 2)
            pairs[right, best[right]] = self._pairs(symbols[right, best[right]], symbols[right, best[right] + 1])
            left = np.flatnonzero(best > 0)
            pairs[left, best[left] - 1] = self._pairs(symbols[left, best[left] - 1], symbols[left, best[left]])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that make a piece; the last number for those that make none."""
        key = left * self.symbols + right
        near = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[near] == key, near, len(self.pair_keys) - 1)

    def merged(self, stretch: str) -> list[str]:
        """The symbols of a stretch when its agenda, a heap, is empty; spaces are written as in the vocabulary."""
        symbols = list(stretch)
        order, last = self.order, len(symbols) - 1
        # of each symbol, the place in the order of the pair it makes with the next; an entry that says
        # otherwise is out of date
        pairs = [order.get(a + b) for a, b in zip(stretch, stretch[1:], strict=False)]
        agenda = [place << 32 | i for i, place in enumerate(pairs) if place is not None]
        heapify(agenda)
        before, after = list(range(-1, last)), list(range(1, last + 2))
        pairs.append(None)
        while agenda:
            entry = heappop(agenda)
            left = entry & 0xFFFFFFFF
            if pairs[left] != entry >> 32:
                continue
            right = after[left]
            symbol = symbols[left] = symbols[left] + symbols[right]
            symbols[right], pairs[right] = "", None
            right = after[left] = after[right]
            place = None
            if right <= last:
                before[right] = left
                place = order.get(symbol + symbols[right])
                if place is not None:
                    heappush(agenda, place << 32 | left)
            pairs[left] = place
            left = before[left]
            if left >= 0:
                place = pairs[left] = order.get(symbols[left] + symbol)
                if place is not None:
                    heappush(agenda, place << 32 | left)
        return [s for s in symbols if s]

    def __missing__(self, stretch: str) -> bytes:
        found: list[int] = []
        for symbol in self.merged(stretch.replace(" ", SPACE)):
            if symbol in self.ids:
                found.append(self.ids[symbol])
            else:
                found += [self.byte_ids[b] for b in symbol.encode()]
        out = self[stretch] = _packed(found)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """Of each text its ids, and the number of stretches in which the library gave others, which then hold."""
        parts = [self.stretches(text or "") for text in texts]
        if len(self) > KEPT_STRETCHES:
            self.clear()
        new = [s for s in set().union(*parts) if s not in self]
        self.merge_all(new)
        self._check(new)
        out = []
        for part in parts:
            ids = np.frombuffer(b"".join(map(self.__getitem__, part)), np.int32)
            out.append((ids, sum(s in self.differing for s in part) if self.differing else 0))
        for stretch in new:
            if len(stretch) > KEPT_LENGTH:
                del self[stretch]
        return out

    def _check(self, new: list[str]) -> None:
        """Hold new stretches against the library, which puts a space in front of each text itself."""
        # a stretch without a space in front is what comes behind a line feed
        asked = [s[1:] if s[0] == " " else "\n" + s for s in new]
        front = _packed(self.library.encode("\n"))
        for stretch, ids in zip(new, self.library.encode(asked, num_threads=1), strict=True):
            want = _packed(ids)
            if stretch[0] != " ":
                if not want.startswith(front):
                    continue  # this vocabulary merges over line feeds: nothing to hold it against
                want = want[len(front) :]
            elif stretch == " ":  # the library takes a text of no characters as none at all
                continue
            if self[stretch] != want:
                self[stretch] = self.differing[stretch] = want

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library gives it."""
        listed = ids.tolist()
        if not listed:
            return ""
        if self.starts[listed[0]] and not self.special.intersection(listed):
            try:
                return b"".join(map(self.bytes_of.__getitem__, listed))[1:].decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(listed)


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


_encoders: dict[str, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One for each worker, so that stretches are shared by all its tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as file:
        model = file.read()
    Encoder(model)  # refuse other kinds of models before any job
    return df.sparkSession.sparkContext.broadcast(model)


def encode(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, ``ids`` and ``differing``.

    ``ids`` are what the sentencepiece library gives for the whole text, without begin or end ids and without
    sampling.  ``path`` names a model file that the driver can read, of a merge-type vocabulary with byte
    fallback; others are refused.  Null and empty texts have no ids.  Repeated rows stay, each with its ids;
    null ids of rows stay null.  Other columns are not read.  ``differing`` counts a row's stretches in which
    the library disagreed with the agenda; its ids hold then.  A stretch without any place to cut takes some
    300 bytes a character while it is encoded.
    """
    model = _shared(docs, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id, found in _encoded(rows, _encoder(model.value)):
            at = np.r_[0, np.cumsum([len(ids) for ids, _ in found])].astype(np.int32)
            lists = pa.ListArray.from_arrays(at, np.concatenate([np.empty(0, np.int32), *(ids for ids, _ in found)]))
            yield pa.RecordBatch.from_arrays([id, lists, pa.array([n for _, n in found], pa.int64())], ["id", "ids", "differing"])

    return _texts(docs, id, text).mapInArrow(run, "id long, ids array<int>, differing long").withColumnRenamed("id", id)


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")


def _encoded(rows: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, int]]]]:
    for batch in rows:
        for part in T.batches(batch, "text"):
            yield part.column("id"), encoder.encode_batch(part.column("text").to_pylist())


def decode(encoded: DataFrame, path: str, id: str = "doc_id") -> DataFrame:
    """Each row's id, ``ids`` and ``decoded`` text, as the library's; no ids give an empty text, null ids too."""
    model = _shared(encoded, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in rows:
            decoded = [encoder.decode(x) for x in id_arrays(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("ids"), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    rows = encoded.selectExpr(f"`{id}` AS id", "ids")
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id)


def digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row's ids and of the text decoded from them the number and SHA-256 digests.

    Encodes and decodes in one pass, as ``encode`` and ``decode`` do, so that ids need not leave the task.
    """
    model = _shared(docs, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for id, found in _encoded(rows, encoder):
            n, of_ids, of_text = [], [], []
            for ids, _ in found:
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(encoder.texts.__getitem__, ids.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            columns = [id, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string()), pa.array([k for _, k in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", "differing"])

    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, differing long"
    return _texts(docs, id, text).mapInArrow(run, schema).withColumnRenamed("id", id)


def disagreements(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, ``ids``, ``library_ids``) whose whole text the library encodes otherwise than the agenda."""
    model = _shared(docs, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        for batch in rows:
            for part in T.batches(batch, "text"):
                texts = [x or "" for x in part.column("text").to_pylist()]
                own = [ids.tolist() for ids, _ in encoder.encode_batch(texts)]
                other = encoder.library.encode(texts, num_threads=1)
                apart = [k for k, (x, y) in enumerate(zip(own, other, strict=True)) if x != y]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(apart, pa.int64())), pa.array([own[k] for k in apart], pa.list_(pa.int32())), pa.array([other[k] for k in apart], pa.list_(pa.int32()))],
                    ["id", "ids", "library_ids"],
                )

    return _texts(docs, id, text).mapInArrow(run, "id long, ids array<int>, library_ids array<int>").withColumnRenamed("id", id)
