import random

import numpy as np
import pytest
import xxhash

from taktwerk.llm import simhash
from taktwerk.llm.components import connected_components


def brute_components(pairs, distance=3):
    """Fingerprints by definition and components by comparing all with all."""
    fps = []
    for _, text in pairs:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for (doc_id, _), f in zip(pairs, fps):
        if doc_id is not None:
            least[find(f)] = min(doc_id, least.get(find(f), doc_id))
    return sorted((-1 if i is None else i, f"{f:016x}", least.get(find(f), -1)) for (i, _), f in zip(pairs, fps))


def rows(df):
    return sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in df.collect())


def test_documents_against_brute_force(docs, odd, empty):
    assert rows(simhash.near_duplicates(docs)) == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(simhash.near_duplicates(odd)) == brute_components([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("together", [4096, 8])
def test_links_connect_all_near_fingerprints(spark, together):
    """Clusters with many close fingerprints, among them negative numbers, and values too full for one go."""
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    table = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = [(r.a, r.b) for r in simhash.near_links(table, most_together=together).collect()]
    assert all((np.uint64(a % 2**64) ^ np.uint64(b % 2**64)).item().bit_count() <= 3 for a, b in links)

    def groups(edges):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for x in signed:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    assert groups(links) == groups(every)


def test_unequal_thresholds(spark):
    """A partition in which all agree is left out, and another gets a threshold of one."""
    cost, thresholds = simhash.allocate(1000, [16] * 4, [1e9, 1000, 1000, 1000], 3)
    assert thresholds[0] == -1 and sum(thresholds) == 0 and cost > 0
    rng = random.Random(3)
    fps = [rng.getrandbits(47) << 16 for _ in range(300)]
    fps += [x ^ (1 << rng.randrange(16, 63)) ^ (1 << rng.randrange(16, 63)) for x in fps[:100]]
    table = spark.createDataFrame([(x,) for x in set(fps)], "fp long")
    links = {frozenset((r.a, r.b)) for r in simhash.near_links(table).collect()}
    want = {frozenset((a, b)) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 3}
    assert links <= want
    tree = {r.node: r.root for r in connected_components(simhash.near_links(table)).collect()}
    assert all(tree.get(a, a) == tree.get(b, b) for a, b in map(tuple, want))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (102, 100)]
    tree = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert tree == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


@pytest.mark.parametrize("distance", [1, 5, 8])
def test_wider_distances(spark, distance):
    rng = random.Random(distance)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64) - (1 << 63)
        for _ in range(5):
            x = base
            for b in rng.sample(range(63), rng.randint(0, 7)):
                x ^= 1 << b
            fps.add(x)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    tree = {r.node: r.root for r in connected_components(simhash.near_links(table, distance)).collect()}
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % 2**64).bit_count() <= distance]
    assert all(tree.get(a, a) == tree.get(b, b) for a, b in near)
    assert len(tree) == len(fps) - len(brute_groups(fps, near))


def brute_groups(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {find(x) for x in nodes}


def test_one_of_each_group_of_similar_texts(spark, odd):
    """Texts with shingle similarities just above and below the limit, exact copies and strangers."""
    rng = random.Random(2)
    words = [f"word{k}" for k in range(3000)]
    rows, want = [], []
    for group in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for copy in range(4):
            text = list(base)
            # Each edit takes five shingles away and puts five others: similarity (296 - 5e) / (296 + 5e).
            for at in rng.sample(range(10, 290, 10), [0, 2, 5, 14][copy]):
                text[at] = f"edit{group}x{copy}x{at}"
            rows.append((group * 10 + copy, " ".join(text)))
        rows.append((group * 10 + 5, " ".join(base)))
        want += [group * 10, group * 10 + 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string")
    got = simhash.one_of_each(df)
    assert sorted(r.doc_id for r in got.collect()) == want and got.columns == df.columns
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 3, 4, 7, 7, 9)] + [(True, 0)]


def test_copies_of_one_base_that_are_not_alike(spark):
    """Groups of 30 and 1000 copies, each alike to the base and few to each other."""
    rng = random.Random(5)
    words = [f"word{k}" for k in range(3000)]
    rows, want = [], []
    for group, many in ((0, 30), (1, 1000)):
        base = [rng.choice(words) for _ in range(100)]
        rows.append((group * 10000, " ".join(base)))
        for copy in range(1, many + 1):
            text = list(base)
            # Two edits: similarity 86/106 to the base, and of most copies to each other less than 0.8.
            for at in rng.sample(range(5, 95, 5), 2):
                text[at] = f"edit{group}x{copy}x{at}"
            rows.append((group * 10000 + copy, " ".join(text)))
        want.append(group * 10000)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == want


def test_truncated_extended_and_block_edited_copies(spark):
    """Copies of similarity 0.8 and more whose sets of words differ much are found, all of them."""
    rng = random.Random(11)
    words = [f"word{k}" for k in range(20000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for group in range(60):
        base = some(rng.randint(150, 400))
        n = len(base)
        at, block = rng.randrange(n // 2), n * 8 // 100
        copies = [base, base[: n * 82 // 100], base + some(n * 23 // 100), base[:at] + some(block) + base[at + block :]]
        rows += [(group * 10 + k, " ".join(text)) for k, text in enumerate(copies)]
    grams = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    near = [(a, b) for a in grams for b in grams if a < b and a // 10 == b // 10 and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert len(near) >= 150
    groups = {(r.hash): r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hashes = {r.doc_id: r.hash for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(text) as hash").collect()}
    apart = [(a, b) for a, b in near if groups[hashes[a]] != groups[hashes[b]]]
    assert apart == []
