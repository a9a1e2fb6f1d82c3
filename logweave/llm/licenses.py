"""License scans by template markup compiled into token automata.

A template is wording with optional regions, ``<<beginOptional>> ... <<endOptional>>``, and replaceable
ones, ``<<var;match=a-b>>`` for ``a`` to ``b`` words of any kind.  It compiles into an automaton over words,
and a text has the license where the automaton accepts: all mandatory words stand there in order, with
nothing between them but what the markup allows.  Words are runs of ASCII letters, digits and characters
beyond ASCII, with A-Z in lower case, so punctuation and white space do not matter.

Only places where a template's first two words stand start an automaton; they are found for a whole batch
of texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as T

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.DOTALL)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Whether it is a phrase that names a license rather than its wording.
    phrase: bool = False


#: Phrases that name a license.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

#: Notices and short license texts.  The wording is fixed by the licenses.
TEMPLATES = [
    Template(
        "gpl-notice",
        "licensed under the gnu general public license <<beginOptional>>gpl<<endOptional>> "
        "<<beginOptional>>version <<var;match=1-2>><<endOptional>> <<beginOptional>>or any later version<<endOptional>>",
    ),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2.0 <<beginOptional>>the license<<endOptional>>",
    ),
    Template("cc-by-nc-notice", "licensed under <<beginOptional>>a<<endOptional>> cc by nc <<beginOptional>>sa<<endOptional>> <<var;match=2-2>>"),
    Template("mit-notice", "released under the mit license <<beginOptional>><<var;match=1-1>> copyright<<endOptional>>"),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=1-12>> BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;match=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
]


@dataclass
class _State:
    words: dict[int, int] = field(default_factory=dict)  # word -> next state
    any: int = -1  # next state on any word
    free: list[int] = field(default_factory=list)  # next states without a word


def words_of_text(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """States of a template; the last state accepts."""

    def __init__(self, template: Template, numbers: dict[str, int]):
        self.template = template
        self.states = [_State()]
        opened: list[int] = []
        for i, part in enumerate(_MARKUP.split(template.text)):
            if i % 2 == 0:
                for word in words_of_text(part):
                    state = self.states[-1]
                    state.words[numbers.setdefault(word, len(numbers) + 1)] = self._new()
            elif part == "beginOptional":
                opened.append(len(self.states) - 1)
            elif part == "endOptional":
                self.states[opened.pop()].free.append(len(self.states) - 1)
            else:
                low, high = map(int, re.fullmatch(r"var;.*?match=(\d+)-(\d+)", part).groups())
                begin = len(self.states) - 1
                for _ in range(high):
                    state = self.states[-1]
                    state.any = self._new()
                for skip in range(low, high):
                    self.states[begin + skip].free.append(begin + high)
        self.last = len(self.states) - 1
        firsts = words_of_text(_MARKUP.split(template.text)[0])[:2]
        if len(firsts) < 2 or opened:
            raise ValueError("a template begins with two mandatory words and closes its regions")
        self.first = tuple(numbers[w] for w in firsts)

    def _new(self) -> int:
        self.states.append(_State())
        return len(self.states) - 1

    def accepts(self, words: np.ndarray) -> int:
        """Words from the start that the automaton accepts, as many as it can; 0 for none."""
        now, best = self._closed({0}), 0
        for i, word in enumerate(words.tolist(), 1):
            found = set()
            for s in now:
                state = self.states[s]
                if word in state.words:
                    found.add(state.words[word])
                if state.any >= 0:
                    found.add(state.any)
            if not found:
                break
            now = self._closed(found)
            if self.last in now:
                best = i
        return best

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.states[todo.pop()].free:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states


class Scanner:
    def __init__(self, templates: list[Template]):
        numbers: dict[str, int] = {}
        self.automata = [Automaton(t, numbers) for t in templates]
        joined = "".join(numbers).encode()
        ends = np.cumsum([len(w.encode()) for w in numbers])
        hashes = T.word_hashes(np.frombuffer(joined, np.uint8), np.r_[0, ends[:-1]], ends)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(numbers.values()), np.int64)[order]
        self.by_first: dict[int, list[int]] = {}
        for i, a in enumerate(self.automata):
            self.by_first.setdefault(a.first[0] << 32 | a.first[1], []).append(i)
        self.firsts = np.array(sorted(self.by_first), np.int64)

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        """Words of each text, and its places: first word, words, number of the template."""
        raw, offsets = T.buffer_of(texts)
        raw = T.lower(raw)
        words = T.words_of(raw, offsets, T.ALPHANUMERIC)
        hashes = T.word_hashes(raw, words.start, words.end)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = np.where(self.hashes[place] == hashes, self.numbers[place], 0)
        pairs = known[:-1] << 32 | known[1:]
        starts = np.flatnonzero(np.isin(pairs, self.firsts) & (words.text[:-1] == words.text[1:]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
        for at in starts.tolist():
            t = int(words.text[at])
            for i in self.by_first[int(pairs[at])]:
                # an automaton takes one word from each state at most
                length = self.automata[i].accepts(known[at : min(at + len(self.automata[i].states), words.first[t + 1])])
                if length:
                    out[t].append((at - int(words.first[t]), length, i))
        return np.diff(words.first), out


_SCHEMA = "n_words long, places array<struct<label: string, phrase: boolean, first_word: long, words: long>>"


def scan(docs: DataFrame, templates: list[Template] | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's id, ``n_words`` and all ``places`` where a template is accepted, in order.

    Where a template accepts several lengths from one word, the longest counts.  Null and empty texts have
    no words.  Repeated rows stay.  Other columns are not read.
    """
    templates = PHRASES + TEMPLATES if templates is None else templates

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in rows:
            for part in T.batches(batch, "text"):
                n, places = scanner.scan(part.column("text"))
                named = [
                    [
                        {"label": templates[i].label, "phrase": templates[i].phrase, "first_word": at, "words": length}
                        for at, length, i in found
                    ]
                    for found in places
                ]
                kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(named, kind)], ["id", "n_words", "places"])

    docs = docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")
    return docs.mapInArrow(run, f"id long, {_SCHEMA}").withColumnRenamed("id", id)


def summary(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """A row per text: places of phrases, first and last, labels, and a score.

    The score is 1 if a template with markup is accepted, 0.5 if only phrases are, else 0.
    """
    base = F.filter("places", lambda p: p.phrase)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label))), ",")
    return scanned.select(
        id,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p.first_word)).alias("first_word"),
        F.array_max(F.transform(base, lambda p: p.first_word)).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.when(F.exists("places", lambda p: ~p.phrase), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )
