"""Ranked lexical search, term at a time with limited accumulators.

One pass over the texts keeps, of each document, its number of terms and the counts of those terms that some
item asks for.  Shards of these postings are searched one after the other, item by item: the lists of an
item's terms are read rarest first, and every list adds to the accumulators of its documents.  Once the
bounds of the lists that are left cannot lift a new document to the kth partial score, no more accumulators
are made; those there are go on being updated, so their scores are exact.  A task carries the kth score of
each item from shard to shard, and the best of all tasks are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.llm import text as T
from logweave.operators.joins import stage

#: Terms of items, with repeats over items, that one pass over the documents asks for.
PASS_TERMS = 200_000
#: Documents and postings that are searched together.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Bytes of one text that are cut into words at once.
TEXT_BYTES = 4 << 20
#: Runs of letters, digits and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Terms:
    """Terms by number; finds them among the words of a buffer of bytes."""

    def __init__(self, terms: list[str]):
        self.count = len(terms)
        data = [t.encode() for t in terms]
        raw = np.frombuffer(b"".join(data), np.uint8)
        end = np.cumsum([len(d) for d in data], dtype=np.int64)
        hashes = T.word_hashes(raw, np.r_[0, end[:-1]].astype(np.int64), end) if terms else np.empty(0, np.uint64)
        self.number = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.number]
        if len(np.unique(hashes)) < self.count:
            raise ValueError("two terms of the items have the same 64-bit hash")
        self.raw, self.end, self.size = raw, end, np.diff(np.r_[0, end]).astype(np.int64)

    def find(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words that are terms, their places among the words and the numbers of the terms."""
        if not self.count or not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = T.word_hashes(raw, start, end)
        near = np.minimum(np.searchsorted(self.hashes, hashes), self.count - 1)
        place = np.flatnonzero(self.hashes[near] == hashes)
        number = self.number[near[place]]
        # equal hashes are not enough: compare the bytes
        same = self.size[number] == (end - start)[place]
        place, number = place[same], number[same]
        begin, size, own = start[place], self.size[number], self.end[number] - self.size[number]
        same = np.ones(len(place), bool)
        for k in range(int(size.max(initial=0))):
            longer = np.flatnonzero(size > k)
            same[longer] &= raw[begin[longer] + k] == self.raw[own[longer] + k]
        return place[same], number[same]


def _spans(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a buffer that no word goes across, of about ``TEXT_BYTES`` each."""
    begin = 0
    while len(raw) - begin > TEXT_BYTES:
        rest = T.ALPHANUMERIC[raw[begin + TEXT_BYTES :]]
        inside = int(np.argmin(rest)) if not rest.all() else len(rest)
        yield begin, begin + TEXT_BYTES + inside
        begin += TEXT_BYTES + inside
    if begin < len(raw):
        yield begin, len(raw)


def postings_of(texts: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; and by text and term number: text, term, occurrences."""
    raw, offsets = T.buffer_of(texts)
    raw = T.lower(raw)
    total, keys, counts = np.zeros(len(texts), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for begin, end in _spans(raw):
        words = T.words_of(raw[begin:end], np.clip(offsets - begin, 0, end - begin), T.ALPHANUMERIC)
        total += np.diff(words.first)
        place, number = terms.find(raw[begin:end], words.start, words.end)
        key, count = np.unique(words.text[place] * max(terms.count, 1) + number, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, back, np.concatenate(counts))
    return total, key // max(terms.count, 1), key % max(terms.count, 1), count


@dataclass
class Ask:
    """What a pass asks for: items with their terms, rarest first, and the weights of the terms."""

    items: list[tuple[int, np.ndarray]]
    weights: np.ndarray
    docs: int
    words: int
    k: int


class Shard:
    """Inverted lists of some documents: of each term, its documents in order and what it adds to their scores."""

    def __init__(self, ids: pa.Array, n: np.ndarray, size: np.ndarray, terms: np.ndarray, tf: np.ndarray, ask: Ask):
        self.absent = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        # Python's integers, as 50 * n * N may go beyond 64 bits
        m = np.array([50 + 50 * x * ask.docs // ask.words for x in n.tolist()], np.int64)
        doc = np.repeat(np.arange(len(n)), size)
        adds = ask.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        by_term = np.argsort(terms, kind="stable")
        self.doc, self.adds = doc[by_term], adds[by_term]
        self.first = np.searchsorted(terms[by_term], np.arange(len(ask.weights) + 1))
        self.bound = np.zeros(len(ask.weights), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            self.bound[some] = np.maximum.reduceat(self.adds, self.first[some])
        self.scores = np.zeros(len(n), np.int64)

    def search(self, order: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, int]:
        """Documents among the ``k`` best, and some more; and how many accumulators were made.

        ``order`` are the terms, rarest first.  ``floor`` is a score that ``k`` documents elsewhere have.
        """
        scores = self.scores
        scores[:] = 0
        rest = np.cumsum(self.bound[order][::-1])[::-1]
        reached = 0  # no partial score is higher
        held = None
        for j, term in enumerate(order.tolist()):
            a, b = self.first[term], self.first[term + 1]
            if a == b:
                continue
            doc, adds = self.doc[a:b], self.adds[a:b]
            if held is None and (rest[j] < floor or (rest[j] < reached and rest[j] < _kth(scores, k))):
                held = np.flatnonzero(scores)
            if held is None:
                scores[doc] += adds
                reached += int(self.bound[term])
            elif len(held) * 16 < len(doc):
                at = np.searchsorted(doc, held)
                at[at == len(doc)] = 0
                hit = doc[at] == held
                scores[held[hit]] += adds[at[hit]]
            else:
                there = scores[doc] > 0
                scores[doc[there]] += adds[there]
        made = np.flatnonzero(scores) if held is None else held
        least = max(_kth(scores, k), floor, 1)
        return made[scores[made] >= least], len(made)


def _kth(scores: np.ndarray, k: int) -> int:
    """The kth highest, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best of (score, absent, id): highest first, then by id, absent ids last."""
    score, absent, id = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.lexsort((id, absent, -score))[:k]
    return score[first], absent[first], id[first]


def _searched(batches: Iterator[pa.RecordBatch], ask: Ask) -> Iterator[pa.RecordBatch]:
    """The best documents of a task for each item."""
    best: list[tuple[np.ndarray, ...] | None] = [None] * len(ask.items)

    def search(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = {c: _flat(rows.column(c)) for c in ("terms", "counts")}
        size = rows.column("terms").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        ids = rows.column("id").combine_chunks()
        shard = Shard(ids, rows.column("n").to_numpy(), size, lists["terms"], lists["counts"].astype(np.int64), ask)
        for i, (_, order) in enumerate(ask.items):
            floor = int(best[i][0][-1]) if best[i] is not None and len(best[i][0]) == ask.k else 0
            found, _ = shard.search(order, ask.k, floor)
            if len(found):
                some = (shard.scores[found], shard.absent[found], shard.ids[found])
                best[i] = _best([some] if best[i] is None else [best[i], some], ask.k)

    held, docs, postings = [], 0, 0
    for batch in batches:
        for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
            held.append(part)
            docs += part.num_rows
            postings += len(part.column("terms").flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search(held)
                held, docs, postings = [], 0, 0
    if held:
        search(held)
    for (item, _), found in zip(ask.items, best, strict=True):
        if found is not None:
            score, absent, id = found
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), item)), pa.array(id, mask=absent), pa.array(score)], ["item", "id", "score"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's distinct terms (``item``, ``term``); items without id take no part."""
    lowered = F.translate(F.col(text), _UPPER, _LOWER)
    terms = F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")
    return items.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("item"), terms).distinct()


def postings(docs: DataFrame, terms: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document with at least one term: ``id``, ``n``, and numbers and counts of the given terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(Terms(terms))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in T.batches(batch, "text"):
                n, of, number, count = postings_of(part.column("text"), shared.value)
                at = pa.array(np.searchsorted(of, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(kind))) for x, kind in ((number, np.int32), (count, np.int64))]
                made = pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *lists], ["id", "n", "terms", "counts"])
                yield made.filter(pa.array(n > 0))

    docs = docs.selectExpr(f"cast(`{id}` AS bigint) AS id", f"`{text}` AS text")
    return docs.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Each item's ``k`` highest-scoring documents: ``item``, ``rank`` from 1, ``id`` and ``score``.

    Terms are the longest runs of letters, digits and characters beyond ASCII in whole texts, with A-Z
    lower-cased.  A document's score is the sum over the item's distinct terms of
    ``w * ((1000000000 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``
    and ``m = 50 + (50 * n * N) div L``; ``N`` counts documents with terms, ``L`` their terms.  Scores of 0 are
    left out, so null and empty texts never come up, and an item without terms has no rows.  Equal scores are
    ranked by id, rows without id last.  Rows that repeat an id are documents of their own; rows that repeat an
    item's id are one item.  Other columns are not read.

    Items are asked in passes of about ``PASS_TERMS`` terms, each against all documents.
    """
    spark = docs.sparkSession
    asked = stage(item_terms(items, item, item_text))
    passes = -(-asked.count() // PASS_TERMS)
    found = [_pass(docs, asked.filter(F.expr(f"pmod(xxhash64(item), {passes}) = {p}")).collect(), k, id, text) for p in range(passes)]
    if not found:
        return spark.createDataFrame([], f"`{item}` long, rank int, `{id}` long, score long")
    found = reduce(DataFrame.unionAll, found)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def _pass(docs: DataFrame, asked: list[Row], k: int, id: str, text: str) -> DataFrame:
    """The best documents of each task for the items of one pass."""
    terms = sorted({r.term for r in asked})
    number = {term: i for i, term in enumerate(terms)}
    lists = stage(postings(docs, terms, id, text))
    total = lists.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    # at most a row per term
    df = {r.term: r["count"] for r in lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.zeros(len(terms), np.int64)
    for i, count in df.items():
        weights[i] = math.floor(1000 * math.log((2 * total.docs + 2) / (2 * count + 1)))
    of_item: dict[int, list[int]] = {}
    for r in asked:
        if number[r.term] in df:
            of_item.setdefault(r.item, []).append(number[r.term])
    ordered = [(i, np.array(sorted(own, key=lambda t: (df[t], t)), np.int64)) for i, own in sorted(of_item.items())]
    ask = docs.sparkSession.sparkContext.broadcast(Ask(ordered, weights, total.docs, total.words or 1, k))
    shards = lists.coalesce(max(1, -(-total.docs // SHARD_DOCS)))
    return shards.mapInArrow(lambda rows: _searched(rows, ask.value), "item long, id long, score long")
