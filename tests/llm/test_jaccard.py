import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from logweave.llm import jaccard as J


def brute(rows, size=5, percent=75):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    groups = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            groups.setdefault(find(i), []).append(doc)
    return sorted(((doc, len(s), (min(groups.get(find(i), [0])) if find(i) in groups else None) if s else doc, links[i]) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def run(df, **more):
    return sorted((tuple(r) for r in J.jaccard_join(df, **more).collect()), key=str)


def copies(rnd, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, most)):
            words[rnd.randrange(len(words))] = rnd.choice("abcdefgh") + str(rnd.randrange(50))
        out.append(" ".join(words))
    return out


def corpus(seed, group):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four", "One Two three four", "one two three four five", "a " * 30_000, "é\x0bÉ x y z"]
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))]
        texts += copies(rnd, base, rnd.randint(1, 4), 4)
    texts += copies(rnd, [rnd.choice(vocabulary) for _ in range(90)], group, 7)
    texts += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 40))]) for _ in range(60)]
    texts += ["exact copy of this text " * 4] * 40
    rnd.shuffle(texts)
    return [(rnd.randrange(10**9), t) for t in texts]


def test_against_brute_force(table):
    rows = corpus(1, 30)
    rows += [rows[5], (None, "one two"), (None, None)]
    assert run(table(rows)) == brute(rows)


def test_a_hot_group_in_parts(table, monkeypatch):
    """Groups beyond a block, by clusters and by lists; common hashes apart."""
    rows = corpus(2, 150)
    want = brute(rows)
    monkeypatch.setattr(J, "BLOCK", 16)
    assert run(table(rows)) == want
    monkeypatch.setattr(J, "CLUSTER_VALUES", 100)
    monkeypatch.setattr(J, "COMMON_LEAST", 8)
    monkeypatch.setattr(J, "HEAP_ENTRIES", 0)
    assert run(table(rows)) == want


def test_other_sizes(table):
    rows = corpus(3, 5)[:60]
    assert run(table(rows), size=2, percent=40) == brute(rows, 2, 40)


def test_empty_table(table):
    assert run(table([])) == []
    assert run(table([(3, None), (4, "")])) == [(3, 0, 3, 0), (4, 0, 4, 0)]


@pytest.mark.parametrize("heap", [0, 10**9])
def test_divide_skip(heap, monkeypatch):
    monkeypatch.setattr(J, "HEAP_ENTRIES", heap)
    rnd = random.Random(7)
    for _ in range(200):
        lists = [np.array(sorted(rnd.sample(range(40), rnd.randint(0, 30))), np.int64) for _ in range(rnd.randint(1, 12))]
        least = rnd.randint(1, 8)
        counts = Counter(x for one in lists for x in one.tolist())
        members, found = J.divide_skip(lists, least, rnd.choice([0.01, 1, 100]))
        assert dict(zip(members.tolist(), found.tolist())) == {m: c for m, c in counts.items() if c >= least}


def test_all_links_of_a_block():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(30, size=rng.integers(3, 20)).astype(np.uint64)) for _ in range(60)]
    sizes = [len(x) for x in sets]
    for sides in (None, [int(x) for x in rng.integers(2, size=60)]):
        got = {(min(i, j), max(i, j)) for i, others in J.all_links(sets, sizes, 30, sides) for j in others.tolist()}
        pairs = ((i, j) for i in range(60) for j in range(i + 1, 60) if sides is None or sides[i] != sides[j])
        want = {(i, j) for i, j in pairs if (o := len(set(sets[i].tolist()) & set(sets[j].tolist()))) and J.links(o, sizes[i], sizes[j], 30)}
        assert got == want and want


def test_components_of_a_node_with_many_links(spark, monkeypatch):
    """Its links are spread over tasks where they are not broadcast."""
    from logweave.llm.components import connected
    from logweave.operators import joins

    links = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(30)] + [(399, 1000), (None, 3), (5000, 5000), (6001, 6000)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = {**{i: 0 for i in range(1, 400)}, **{1000 + i: 0 for i in range(31)}, 6001: 6000}
    assert {r.node: r.root for r in connected(frame).collect()} == want
    found = joins._join_salted(frame, spark.createDataFrame([(0, 7), (1000, 8)], "a long, least long"), ["a"], "inner", 50)
    assert found.filter("a = 0").count() == 399 and found.count() == 400


def test_a_set_goes_to_a_block_for_each_part_not_for_each_list(spark, monkeypatch):
    """Two sets that share a list meet in one block; many lists make no more blocks."""
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "CLUSTER_VALUES", 400)
    rnd = random.Random(11)
    keys = {sid: rnd.sample(range(36), 28) for sid in range(40)} | {100: [90, 91], 101: [90, 91], 102: [35, 90]}
    live = spark.createDataFrame([(sid, 40) for sid in keys], "sid long, n int")
    routed = spark.createDataFrame([(sid, key) for sid, own in keys.items() for key in own], "sid long, key long")
    blocks = {}
    for r in J._clusters(J._tied(routed), live).collect():
        blocks.setdefault(r.block, []).append((r.sid, r.side))
    met = Counter()
    for own in blocks.values():
        assert len({side < 0 for _, side in own}) == 1
        met.update((min(a, b), max(a, b)) for i, (a, x) in enumerate(own) for b, y in own[:i] if x < 0 or x != y)
    assert set(met.values()) == {1}
    assert all(met[a, b] for a in keys for b in keys if a < b and set(keys[a]) & set(keys[b]))
    parts = sum(own[0][1] < 0 for own in blocks.values())
    assert 3 < parts < 28 and sum(map(len, blocks.values())) <= parts * len(keys)


def test_shards_and_buckets_share_batches():
    """A batch for each of them would make their number the cost of dealing."""
    texts = [" ".join(f"w{(i + k) % 300}" for k in range(200)) for i in range(20)]
    dealt = list(J._postings(iter([pa.record_batch({"text": texts})]), 5, 50, np.empty(0, np.uint64)))
    assert len(dealt) == 1 and len(set(dealt[0].column("shard").to_pylist())) == dealt[0].num_rows > 40
    entries = list(J._repeated(iter([dealt[0].sort_by("shard")]), 7))
    assert len(entries) == 1 and set(entries[0].column("bucket").to_pylist()) == set(range(7))


@pytest.mark.parametrize("sided", [False, True])
def test_a_dense_block_is_counted_not_probed(sided, monkeypatch):
    """Where most sets are candidates, no list is searched for each of them."""
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.choice(130, 120, replace=False)).astype(np.uint64) for _ in range(80)]
    probes, search = [], np.searchsorted
    monkeypatch.setattr(J, "HEAP_ENTRIES", 0)
    monkeypatch.setattr(np, "searchsorted", lambda *a, **b: probes.append(1) or search(*a, **b))
    sides = [i % 2 for i in range(80)] if sided else None
    got = {(min(i, j), max(i, j)) for i, others in J.all_links(sets, [120] * 80, 75, sides) for j in others.tolist()}
    monkeypatch.undo()
    want = {(i, j) for j in range(80) for i in range(j) if not sided or i % 2 != j % 2}
    assert got == {(i, j) for i, j in want if J.links(len(np.intersect1d(sets[i], sets[j])), 120, 120, 75)} and got
    assert len(probes) < 80
