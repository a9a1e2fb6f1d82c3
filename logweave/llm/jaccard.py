"""N-gram Jaccard join by T-occurrence search.

Two texts link when the Jaccard similarity of their sets of word shingles reaches a threshold.  The
search is DivideSkip over inverted lists: short lists are merged with a heap, candidates are probed
in long lists by binary search, and those that reach the required overlap remain.

How the work is spread:

* equal sets are one class, found by a signature, so copies are never compared;
* inverted lists are built in shards of hash values.  Hashes that stand in one list only are dropped
  there, and a set with fewer than the required overlap left cannot link at all;
* hashes in more than a thousandth of the sets are known before.  There are at most a thousand times
  the mean set size of them, so they are broadcast, and their lists are never gathered in a shard;
* sets that share a list of the prefix filter, directly or by others, are a cluster, and searched as one
  block while that is of bounded size.  A larger cluster is cut into parts, near copies together, and every
  two parts of which members share a list are a block, with those members alone.  A set goes to as many
  blocks as there are such parts, however many lists it is in.  Only links that connect
  something new are written, so a group of copies gives as many rows as it has members.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm import text as T
from logweave.llm.components import connected
from logweave.operators.joins import stage

#: Sets of a part of a cluster, about; a block has two parts.
BLOCK = 2048
#: Hash values in a shard, about, and values a task gathers before it deals them out.
SHARD_VALUES = 4_000_000
#: A hash is common if it is in this share of sets, and in so many at least.
COMMON_SHARE, COMMON_LEAST = 0.001, 64
#: Hash values of sets that are searched together because lists tie them, about.
CLUSTER_VALUES = 1_000_000
#: Bytes of rows that tasks deal out in one Arrow batch, about; each shard or bucket has a row in it.
BATCH_BYTES = 4_000_000
#: Entries of short lists up to which they are merged with a heap.
HEAP_ENTRIES = 4096
#: How much a binary probe costs against a step of the merge, and against an entry that is counted.
PROBE_COST, PROBE_ENTRIES = 0.01, 8
_COMMON = np.uint32(0xFFFFFFFF)


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-n * percent // 100)


def links(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, one text after the other, and where each begins.

    A text with fewer words than ``size`` has its whole sequence as the only one; without words the
    set is empty.  Only A-Z are lower-cased, and words end at white space.
    """
    raw, offsets = T.buffer_of(texts)
    raw = T.lower(raw)
    words = T.words_of(raw, offsets, T.NOT_SPACE)
    hashes = T.word_hashes(raw, words.start, words.end)
    counts = np.diff(words.first)
    kept = np.zeros(len(hashes), bool)
    full = T.shingle_hashes(hashes, size)
    kept[: len(full)] = words.text[: len(full)] == words.text[size - 1 :] if len(full) else False
    values = np.zeros(len(hashes), np.uint64)
    values[: len(full)] = full
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        at = words.first[t]
        kept[at] = True
        values[at] = T.shingle_hashes(hashes[at : at + counts[t]], int(counts[t]))[0]
    values = values[kept]
    text = words.text[kept]
    at = np.searchsorted(text, np.arange(len(counts) + 1))
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[begin:end].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.r_[0, np.cumsum(fresh)][at]


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 63-bit signatures of each set; 0 of an empty one."""
    n = np.diff(at)
    out = []
    for mixed in (T.mix(values), T.mix(values ^ np.uint64(0x5851F42D4C957F2D))):
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mixed)]
        total = T.mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)) >> np.uint64(1)
        out.append(np.where(n > 0, total, np.uint64(0)).astype(np.int64))
    return tuple(out)


def divide_skip(lists: list[np.ndarray], least: int, probe_cost: float = PROBE_COST) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least ``least`` of the sorted lists, and each one's number of lists.

    The longest lists, ``least / (probe_cost * log2(longest) + 1)`` of them, are put aside.  The rest
    are merged with a heap that skips members which cannot reach ``least`` less the lists put aside;
    what remains is probed in the long lists by binary search; those that are short against the number
    of probes are gone through once instead.
    """
    none = np.empty(0, np.int64)
    lists = sorted((x for x in lists if len(x)), key=len, reverse=True)
    if least < 1 or len(lists) < least:
        return none, none
    aside = min(least - 1, int(least / (probe_cost * math.log2(len(lists[0]) + 1) + 1)))
    short, needed = lists[aside:], least - aside
    if sum(map(len, short)) <= HEAP_ENTRIES:
        merged = list(_merge_skip([x.tolist() for x in short], needed))
        members = np.array([m for m, _ in merged], np.int64)
        counts = np.array([n for _, n in merged], np.int64)
    else:  # the same merge as one counting pass, for lists too long for a loop
        counts = np.bincount(np.concatenate(short))
        members = np.flatnonzero(counts >= needed)
        counts = counts[members]
    scanned = [x for x in lists[:aside] if len(x) < PROBE_ENTRIES * len(members)]
    if scanned:
        counts = counts + np.bincount(np.concatenate(scanned), minlength=members[-1] + 1)[members]
    for one in lists[: aside - len(scanned)]:
        if not len(members):
            break
        place = np.minimum(np.searchsorted(one, members), len(one) - 1)
        counts = counts + (one[place] == members)
    kept = counts >= least
    return members[kept], counts[kept]


def _merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    heap = [(x[0], i) for i, x in enumerate(lists)]
    heapify(heap)
    place = [0] * len(lists)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            yield top, len(popped)
            for i in popped:
                place[i] += 1
                if place[i] < len(lists[i]):
                    heappush(heap, (lists[i][place[i]], i))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heappop(heap)[1])
        if not heap:
            return
        ahead = heap[0][0]
        for i in popped:
            place[i] = bisect_left(lists[i], ahead, place[i])
            if place[i] < len(lists[i]):
                heappush(heap, (lists[i][place[i]], i))


def all_links(sets: list[np.ndarray], sizes: list[int], percent: int, sides: list[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Each set of a block with the sets before it that it links with; with ``sides`` only with those of side 0.

    Each set in turn searches the inverted lists of the block.
    """
    order = sorted(range(len(sets)), key=lambda i: sides[i] if sides else 0)
    values = np.concatenate([sets[i] for i in order])
    at = np.cumsum([0, *(len(sets[i]) for i in order)])
    owner = np.repeat(np.arange(len(order)), np.diff(at))
    by = np.argsort(values, kind="stable")
    values, owner = values[by], owner[by]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    lengths = np.diff(np.r_[begins, len(values)])
    first = np.repeat(begins, lengths)  # of the list that each entry is in
    place = np.empty(len(by), np.int64)  # of each set's hashes one after the other
    place[by] = np.arange(len(by))
    numbers, n = np.array(order), np.array([sizes[i] for i in order], np.int64)
    if sides:
        ahead = sum(1 for i in order if sides[i] == 0)
        ends = np.repeat(begins + np.add.reduceat(owner < ahead, begins, dtype=np.int64), lengths)
    for k, i in enumerate(order):
        if sides and not sides[i]:
            continue
        own, least = place[at[k] : at[k + 1]], required(sizes[i], percent)
        begin, end = first[own], ends[own] if sides else own
        some = begin < end
        if np.count_nonzero(some) < least:
            continue
        lists = [owner[a:b] for a, b in zip(begin[some].tolist(), end[some].tolist(), strict=True)]
        j, overlap = divide_skip(lists, least)
        linked = j[links(overlap, sizes[i], n[j], percent)]
        if len(linked):
            yield i, numbers[linked]


def jaccard_join(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Each row's id, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``n_links``.

    ``n_links`` is the number of other rows that a row links with.  Null or empty texts have no shingles and
    link with nothing; their component is their own id.  Equal sets link.  Repeated rows are rows of their own, with the same result.  Other columns of
    ``docs`` are not read.  An empty table gives an empty result.
    """
    rows, classes, found = class_links(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), size, percent)
    tied = connected(found.filter("b IS NOT NULL").select("a", "b")).selectExpr("node AS sid", "root")
    others = found.filter("b IS NULL").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("others"))
    classes = classes.join(tied, "sid", "left").join(others, "sid", "left")
    n_links = F.col("size") - 1 + F.coalesce("others", F.lit(0))
    classes = stage(classes.select("sid", F.coalesce("root", "sid").alias("root"), "least", n_links.alias("n_links")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select("sid", "component_id", "n_links")
    out = rows.withColumn("sid", F.expr("if(n = 0, null, sid)")).join(classes, "sid", "left")
    return out.select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def class_links(docs: DataFrame, size: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What links, for ``docs`` with ``id`` and ``text``.

    Rows (``id``, ``n``, ``sid``: the set they have); classes of rows with equal sets (``sid``, ``least`` id, ``size``);
    and, with ``b``, links that connect all classes that others connect, or, without, how many rows (``n``) of other
    classes the class ``a`` links with, which is summed up over blocks.  A group of many different texts would
    have links as the square of its size, so they are counted where they are found and not given out.
    """
    spark = docs.sparkSession
    seen = stage(docs.mapInArrow(lambda rows: T.releasing(_summaries(rows, size)), _SUMMARY))
    rows = seen.filter("kind = 0")
    classes = rows.filter("n > 0").groupBy("sid").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.min("other").alias("one"), F.max("other").alias("two"), F.min("n").alias("n"), F.max("n").alias("m")
    )
    totals = classes.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("int(one != two or n != m)")), F.lit(0))
    ).first()
    if totals[2]:
        raise ArithmeticError("two different sets have the same 63-bit signature")
    common_at = max(COMMON_LEAST, math.ceil(COMMON_SHARE * totals[0]))
    common = seen.filter("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") >= common_at)
    # copies count once for each task, so there may be more than the share allows; which ones are taken only matters for speed
    most = math.ceil(totals[1] / max(totals[0], 1) / COMMON_SHARE)
    common = common.orderBy(F.desc("n"), "sid").limit(most)
    common = np.array([r.sid for r in common.select("sid").collect()], np.int64).astype(np.uint64)
    common = spark.sparkContext.broadcast(np.sort(common))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = max(parts, math.ceil(totals[1] / SHARD_VALUES))
    dealt = docs.select("text").mapInArrow(lambda rows: T.releasing(_postings(rows, size, shards, common.value)), _POSTING)
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    repeated = dealt.mapInArrow(lambda rows: T.releasing(_repeated(rows, shards)), _ENTRY)
    repeated = repeated.repartition(parts, "bucket").sortWithinPartitions("bucket")
    live = stage(repeated.mapInArrow(lambda rows: T.releasing(_live(rows, percent)), _LIVE))

    # two sets that link share a hash of their prefixes
    routed = live.selectExpr("sid", "explode(routed) AS key")
    classes = stage(classes.select("sid", "least", "size"))
    live = live.select("sid", "n", "tokens").join(classes.select("sid", "size"), "sid")
    found = stage(_search(live, _clusters(stage(_tied(routed)), live), percent, parts))
    return rows, classes, found


def _lists(members: DataFrame) -> DataFrame:
    """Lists of several sets; of lists with the same members one."""
    lists = members.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("sid")).alias("x"),
        F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"),
    )
    return stage(lists.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"))


def _tied(members: DataFrame) -> DataFrame:
    """Members of lists of several sets."""
    return members.join(_lists(members), "key")


def _cuts(values: str, sets: str) -> Column:
    """In how many parts a group of so many ``values`` and ``sets`` goes."""
    return F.greatest(F.ceil(F.col(values) * 2 / CLUSTER_VALUES), F.ceil(F.col(sets) / BLOCK))


def _clusters(tied: DataFrame, live: DataFrame) -> DataFrame:
    """Blocks in which every two members of a list meet once.

    Sets that lists tie together, directly or by others, are a block if they have at most
    ``CLUSTER_VALUES`` hashes and are no more than twice ``BLOCK``.  Else they are cut into parts.
    """
    least = tied.groupBy("key").agg(F.min("sid").alias("b"))
    bound = connected(tied.select("key", F.col("sid").alias("a")).join(least, "key"))
    bound = bound.select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    bound = bound.union(bound.selectExpr("cluster AS sid", "cluster").distinct()).join(live.select("sid", "n"), "sid")
    weights = bound.groupBy("cluster").agg(F.sum("n").alias("weight"), F.count("*").alias("sets"))
    cuts = F.when(_cuts("weight", "sets") > 2, _cuts("weight", "sets")).otherwise(1)
    bound = stage(bound.join(weights.select("cluster", cuts.alias("cuts")), "cluster"))
    small = bound.filter("cuts = 1").select("sid", F.xxhash64("cluster").alias("block"), F.lit(-1).alias("side"))
    return small.union(_part_blocks(tied, bound.filter("cuts > 1")))


def _part_blocks(tied: DataFrame, sets: DataFrame) -> DataFrame:
    """Blocks of clusters that are cut: of each part, and of every two parts, the members that share a list there.

    Sets with the same least key, as near copies tend to have, are in one part, or in as many of their own
    as they need.  Two sets are in one block together, as it is that of their parts.
    """
    tied = tied.join(sets, "sid")
    near = tied.groupBy("sid", "n", "cluster", "cuts").agg(F.min("key").alias("near"))
    own = near.groupBy("near").agg(F.sum("n").alias("weight"), F.count("*").alias("sets"))
    own = own.select("near", _cuts("weight", "sets").alias("own"))
    pooled = F.xxhash64("cluster", F.pmod(F.xxhash64("near"), "cuts"))
    part = F.when(F.col("own") > 1, F.xxhash64("near", F.pmod(F.xxhash64("sid", F.lit(2)), "own"))).otherwise(pooled)
    placed = stage(near.join(own, "near").select("sid", part.alias("part")))
    tied = stage(tied.select("sid", "key").join(placed, "sid"))
    # most lists of a set are in the same parts, so they are made one before each part gets a row
    others = tied.groupBy("key").agg(F.sort_array(F.collect_set("part")).alias("others"))
    others = tied.join(others, "key").groupBy("sid", "part").agg(F.collect_set("others").alias("others"))
    met = others.select("sid", "part", F.explode(F.array_distinct(F.flatten("others"))).alias("other"))
    side = F.when(F.col("part") == F.col("other"), -1).otherwise(F.expr("int(part > other)"))
    return met.select("sid", F.xxhash64(F.least("part", "other"), F.greatest("part", "other")).alias("block"), side.alias("side"))


def _search(live: DataFrame, blocks: DataFrame, percent: int, parts: int) -> DataFrame:
    """What ``class_links`` says of links, from blocks."""
    met = blocks.join(live, "sid").repartition(parts, "block").sortWithinPartitions("block", "sid")
    return met.mapInArrow(lambda rows: T.releasing(_linked(rows, percent)), _FOUND)


_SUMMARY = "kind int, id long, n long, sid long, other long"
_POSTING = "shard int, docs binary, values binary"
_ENTRY = "bucket int, docs binary, tokens binary, sets binary"
_LIVE = "sid long, n int, tokens binary, routed array<long>"
_FOUND = "a long, b long, n long"
_DOC = np.dtype([("sid", "<i8"), ("n", "<i4"), ("count", "<i4")])


def _sets(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    """Slices of the rows with their sets, signatures, and which sets the task sees first."""
    seen: set[int] = set()
    for batch in rows:
        for part in T.batches(batch, "text", T.SLICE):
            values, at = shingle_sets(part.column("text"), size)
            signed = signatures(values, at)
            fresh = np.zeros(part.num_rows, bool)
            for i, one in enumerate(signed[0].tolist()):
                if one and one not in seen:
                    seen.add(one)
                    fresh[i] = True
            yield part, values, at, signed, fresh


def _summaries(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row per text, and hashes that many sets of this task share (``sid``: hash, ``n``: sets)."""
    gathered, total, count = [], 0, 0

    def shared():
        values = np.sort(np.concatenate(gathered))
        begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        counts = np.diff(np.r_[begins, len(values)])
        kept = counts >= max(4, COMMON_SHARE * count)
        values, counts = values[begins[kept]].astype(np.int64), counts[kept].astype(np.int64)
        none = np.zeros(len(values), np.int64)
        return _batch(_SUMMARY, none.astype(np.int32) + 1, none, counts, values, none)

    for part, values, at, (sid, other), fresh in _sets(rows, size):
        n = np.diff(at)
        yield _batch(_SUMMARY, np.zeros(len(n), np.int32), part.column("id"), n, sid, other)
        if fresh.any():
            gathered.append(values[np.repeat(fresh, n)])
            total, count = total + len(gathered[-1]), count + int(fresh.sum())
        if total >= SHARD_VALUES:
            yield shared()
            gathered, total, count = [], 0, 0
    if gathered:
        yield shared()


def _postings(rows: Iterator[pa.RecordBatch], size: int, shards: int, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Hashes of each set by shard; equal sets of a task once.  Common hashes have negative shards."""
    docs, gathered, total = [], [], 0

    def dealt():
        heads = np.concatenate(docs)
        values = np.concatenate(gathered)
        owner = np.repeat(np.arange(len(heads)), heads["count"])
        at = (T.mix(values) % np.uint64(shards)).astype(np.int32)
        if len(common):
            place = np.minimum(np.searchsorted(common, values), len(common) - 1)
            at[common[place] == values] = -1
        order = np.argsort(at.astype(np.int16) if shards < 30_000 else at, kind="stable")
        at, owner, values = at[order], owner[order], values[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, o, v in zip(at[np.r_[0, cuts]], np.split(owner, cuts), np.split(values, cuts), strict=True):
            begins = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            own = heads[o[begins]]
            own["count"] = np.diff(np.r_[begins, len(o)])
            if a < 0:  # not looked up in lists, so it goes anywhere
                a = -1 - own["sid"][0] % (1 << 31)
            yield int(a), own.tobytes(), v.tobytes()

    for _, values, at, (sid, _), fresh in _sets(rows, size):
        n = np.diff(at)
        if fresh.any():
            own = np.zeros(int(fresh.sum()), _DOC)
            own["sid"], own["n"], own["count"] = sid[fresh], n[fresh], n[fresh]
            docs.append(own)
            gathered.append(values[np.repeat(fresh, n)])
            total += len(gathered[-1])
        if total >= SHARD_VALUES // 2:
            yield from _dealt(_POSTING, dealt())
            docs, gathered, total = [], [], 0
    if gathered:
        yield from _dealt(_POSTING, dealt())


def _runs(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of one key together, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in rows:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[0].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _repeated(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    yield from _dealt(_ENTRY, _entries(rows, buckets))


def _entries(rows: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple]:
    """Of each shard's lists, those of two or more sets, dealt out by set with the lists' lengths."""
    for table in _runs(rows, "shard"):
        heads = np.concatenate([np.frombuffer(x, _DOC) for x in table.column("docs").to_pylist()])
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()])
        doc = np.repeat(np.arange(len(heads)), heads["count"])
        if table.column("shard")[0].as_py() < 0:
            sets = np.full(len(values), _COMMON)
        else:
            sid = heads["sid"][doc]
            order = np.lexsort((sid, values))
            values, sid, doc = values[order], sid[order], doc[order]
            fresh = np.ones(len(values), bool)  # else the same set in another task
            fresh[1:] = (values[1:] != values[:-1]) | (sid[1:] != sid[:-1])
            values, doc = values[fresh], doc[fresh]
            begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            length = np.diff(np.r_[begins, len(values)])
            sets = np.repeat(length, length).astype(np.uint32)
            kept = sets > 1
            values, doc, sets = values[kept], doc[kept], sets[kept]
            if not len(doc):
                continue
        bucket = (T.mix(heads["sid"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)[doc]
        order = np.lexsort((doc, bucket))
        values, doc, sets, bucket = values[order], doc[order], sets[order], bucket[order]
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=True):
            firsts = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
            own = heads[doc[a:b][firsts]]
            own["count"] = np.diff(np.r_[firsts, b - a])
            yield int(bucket[a]), own.tobytes(), values[a:b].tobytes(), sets[a:b].tobytes()


def _live(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Sets that can link: those with the required overlap in lists of two or more.

    ``tokens`` are the hashes in such lists, ``routed`` those of the prefix: after leaving out as
    many of the rarest as a linked set may lack, two linked sets still share one of them.
    """
    out: list = []
    for table in _runs(rows, "bucket"):
        heads = np.concatenate([np.frombuffer(x, _DOC) for x in table.column("docs").to_pylist()])
        values = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        sets = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("sets").to_pylist()])
        sid, n = (np.repeat(heads[c], heads["count"]) for c in ("sid", "n"))
        order = np.lexsort((values, sid))
        values, sets, sid, n = values[order], sets[order], sid[order], n[order]
        fresh = np.ones(len(values), bool)  # a common hash comes once for each task
        fresh[1:] = (values[1:] != values[:-1]) | (sid[1:] != sid[:-1])
        values, sets, sid, n = values[fresh], sets[fresh], sid[fresh], n[fresh]
        begins = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]])
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(sid)], strict=True):
            least = required(int(n[a]), percent)
            if b - a >= least:
                own = values[a:b]
                routed = own[np.lexsort((own, sets[a:b]))[: b - a - least + 1]]
                out.append((int(sid[a]), int(n[a]), own.tobytes(), routed.astype(np.int64)))
            if len(out) >= 256:
                yield _live_batch(out)
                out = []
    if out:
        yield _live_batch(out)


def _live_batch(rows: list) -> pa.RecordBatch:
    sid, n, tokens, routed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(tokens, pa.binary()), pa.array(routed, pa.list_(pa.int64()))],
        ["sid", "n", "tokens", "routed"],
    )


def _linked(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each block, links that connect what its links connect, and each set's number of linked rows."""
    for table in _runs(rows, "block"):
        sid, weight = (table.column(c).to_numpy() for c in ("sid", "size"))
        sides = table.column("side").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        group, count, ties = np.arange(len(sets)), np.zeros(len(sets), np.int64), []
        for i, others in all_links(sets, table.column("n").to_pylist(), percent, None if sides[0] < 0 else sides):
            count[i] += weight[others].sum()
            count[others] += weight[i]
            apart, first = np.unique(group[others], return_index=True)
            for k, j in zip(apart.tolist(), others[first].tolist(), strict=True):
                if k != group[i]:
                    ties.append((int(sid[i]), int(sid[j])))
                    group[group == k] = group[i]
        some = np.flatnonzero(count)
        a, b = [x for x, _ in ties], [x for _, x in ties]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*a, *sid[some].tolist()], pa.int64()), pa.array([*b, *[None] * len(some)], pa.int64()), pa.array([*[None] * len(a), *count[some].tolist()], pa.int64())],
            ["a", "b", "n"],
        )


def _dealt(schema: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a number and binaries, in batches of ``BATCH_BYTES``: a batch a row would cost more than its row."""
    held, size = [], 0

    def batch():
        number, *blobs = zip(*held, strict=True)
        return _batch(schema, np.array(number, np.int32), *(pa.array(x, pa.binary()) for x in blobs))

    for row in rows:
        held.append(row)
        size += sum(map(len, row[1:]))
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
