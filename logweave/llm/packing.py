"""Sum-of-squares online packing of documents into windows.

Each document goes to the fill level that makes the sum of squared counts of partially filled windows
least; the counts by level are an array.  A document longer than a window gives full windows first and
its rest is placed.  What is open at the end of a task is closed by cutting the emptiest windows up to
fill the others, and the one window that is left is cut at powers of two, which need no padding.

Every task packs its own part of the input: nothing is shuffled, and a task holds its open windows only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from logweave.llm import text as T
from logweave.llm.bpe import byte_of_letter

#: Windows a task keeps open; beyond, they are closed as at its end.
OPEN_WINDOWS = 4096
#: Words whose ids a worker keeps.
KEPT_WORDS = 600_000

Piece = tuple  # row number, start, ids


class SumOfSquares:
    """Places pieces; ``closed`` gets each window that is done as a list of pieces."""

    def __init__(self, capacity: int, open_windows: int = OPEN_WINDOWS):
        self.capacity, self.open_windows = capacity, open_windows
        self.counts = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.closed: list[list[Piece]] = []
        self.open = 0

    def level_for(self, size: int) -> int:
        """Level of the window to use; 0 is a new one.  Of equal levels the fullest."""
        last = self.capacity - size
        before = self.counts[: last + 1]
        change = 2 * (self.counts[size:] - before) + 2
        change[0] = 2 * self.counts[size] + 1  # nothing leaves level 0
        change[last] = 1 - 2 * before[last] if last else 0  # a full window is not counted
        change[1:][before[1:] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def add(self, row: int, ids: np.ndarray) -> None:
        full = len(ids) - len(ids) % self.capacity
        for start in range(0, full, self.capacity):
            self.closed.append([(row, start, ids[start : start + self.capacity])])
        if full < len(ids):
            # a copy: a view would keep the ids of the whole document while the window is open
            self._place((row, full, ids[full:].copy()))
        if self.open > self.open_windows:
            self.close()

    def _place(self, piece: Piece) -> None:
        size = len(piece[2])
        level = self.level_for(size)
        window = self._take(level) if level else []
        window.append(piece)
        level += size
        if level == self.capacity:
            self.closed.append(window)
        else:
            self.windows[level].append(window)
            self.counts[level] += 1
            self.open += 1

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def close(self) -> None:
        """Close all windows; pieces of the emptiest are cut to fill the fullest."""
        rest = [(level, w) for level, windows in enumerate(self.windows) for w in windows]
        rest.reverse()  # fullest first
        self.counts[:] = 0
        self.windows = [[] for _ in range(self.capacity + 1)]
        self.open = 0
        spare: list[Piece] = []
        while rest:
            level, window = rest.pop(0)
            while level < self.capacity:
                if not spare:
                    if not rest:
                        break
                    spare = rest.pop()[1]
                row, start, ids = spare.pop()
                room = self.capacity - level
                if len(ids) > room:
                    spare.append((row, start + room, ids[room:]))
                    ids = ids[:room]
                window.append((row, start, ids))
                level += len(ids)
            if level == self.capacity:
                self.closed.append(window)
            else:
                spare = window
        self._powers(spare)

    def _powers(self, pieces: list[Piece]) -> None:
        """The last pieces in windows of powers of two."""
        total = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while total:
            size = min(1 << (total.bit_length() - 1), self.capacity)
            total -= size
            window = []
            while size:
                row, start, ids = pieces.pop()
                if len(ids) > size:
                    pieces.append((row, start + size, ids[size:]))
                    ids = ids[:size]
                window.append((row, start, ids))
                size -= len(ids)
            self.closed.append(window)


class WordEncoder(dict):
    """Ids of texts by a tokenizer that drops white space, from the ids of their words.

    A mapping from words to the bytes of their ids, filled as words come.
    """

    def __init__(self, spec: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        parsed = json.loads(spec)
        model, steps = parsed["model"], parsed["pre_tokenizer"].get("pretokenizers") or [parsed["pre_tokenizer"]]
        if steps[0]["type"] != "Split" or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or model.get("dropout"):
            raise ValueError("the tokenizer does not drop white space")
        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        # Pieces of words of Latin letters: merged as ranked byte sequences, in which a byte that UTF-8
        # does not have stands for the end of a word.
        kinds = [n["type"] for n in (parsed["normalizer"] or {}).get("normalizers", [])]
        suffix = model["end_of_word_suffix"]
        special = {t["content"] for t in parsed["added_tokens"]}
        letters = byte_of_letter()
        ranks = {}
        for token, i in model["vocab"].items():
            if token not in special:
                plain = bytes(letters[c] for c in token.removesuffix(suffix))
                if b"\xff" not in plain:
                    ranks[plain + b"\xff" * token.endswith(suffix)] = i
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        self.latin = kinds == ["NFC", "Replace", "Lowercase"] and ids == sorted(ids)
        if self.latin:
            ranks[b"\xff"] = len(model["vocab"])  # never left over: it merges first with any byte
            first = [b for b in ranks if len(b) == 2 and b[1:] == b"\xff"]
            self.latin = len(first) == 255 and max(ranks[b] for b in first) < min(ids)
        if self.latin:
            self.core = tiktoken.Encoding("own", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = special
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\t-\r \x85\xa0"))

    def __missing__(self, word: str) -> bytes:
        if self.latin and (not word or max(word) < "\u0250") and not any(s in word for s in self.special):
            ids = []
            for piece in self.pieces.findall(word.lower()):
                ids += self.core.encode_single_piece(piece.encode() + b"\xff")
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = np.array(ids, "<u4").tobytes()
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids without added special tokens; those in a text are found.  Null texts have none."""
        # other white space stays inside words, which are encoded as they are
        words = (text or "").replace("\n", " ").split(" ")
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u4")


_PIECE = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end: int = 1, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all texts in windows of at most ``capacity`` ids, with little padding.

    One row per piece: the document's id, ``start`` among its ids, ``length``, ``ids`` (little-endian
    unsigned 32 bits), ``doc_tokens`` with the closing id ``end``, ``sequence_id`` of the window and the
    ``offset`` there.  ``path`` names a tokenizer file that the driver can read.  Null and empty texts
    have the closing id only.  Repeated rows are documents of their own.  Other columns are not read.
    """
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = "words", hash(spec.value)
        return T.releasing(_packed(rows, lambda: T.kept(key, lambda: WordEncoder(spec.value)), capacity, end), key)

    out = docs.mapInArrow(run, _PIECE)
    return out.withColumnRenamed("id", id)


def _packed(rows: Iterator[pa.RecordBatch], encoder: Callable[[], WordEncoder], capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder, packer = encoder(), SumOfSquares(capacity)
    sequence = TaskContext.get().partitionId() << 40
    ids, tokens = [], []  # of all documents of the task
    closing = np.array([end], "<u4")
    for batch in rows:
        for part in T.batches(batch, "text"):
            for one, found in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                found = np.concatenate([encoder.encode(found), closing])
                packer.add(len(ids), found)
                ids.append(one)
                tokens.append(len(found))
            yield _pieces(packer, ids, tokens, sequence)
            sequence += len(packer.closed)
            packer.closed = []
    packer.close()
    yield _pieces(packer, ids, tokens, sequence)


def _pieces(packer: SumOfSquares, ids: list, tokens: list, sequence: int) -> pa.RecordBatch:
    out = []
    for window in packer.closed:
        offset = 0
        for row, start, found in window:
            out.append((ids[row], start, len(found), found.tobytes(), tokens[row], sequence, offset))
            offset += len(found)
        sequence += 1
    columns = zip(*out, strict=True) if out else [[]] * 7
    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.binary() if "binary" in x else pa.int64() for x in _PIECE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
