import random

import numpy as np

from taktwerk.llm import suffixes
from taktwerk.llm.wordhash import Words


def brute(pairs, length):
    """Passages by comparing every window of every document with every other."""
    first = {}
    docs = sorted({(i, t) for i, t in pairs if i is not None and t is not None})
    split = {(i, t): [w for w in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] for i, t in docs}
    for (i, _), words in split.items():
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), words in split.items():
        end, kept = None, set()
        for s in range(len(words) - length + 1):
            k = first[tuple(words[s : s + length])]
            if k < i:
                if end is not None and s > end:
                    out.append((i, start, end - start))
                    end = None
                if end is None:
                    start = s
                end = s + length
        if end is not None:
            out.append((i, start, end - start))
    return sorted(out)


def rows(df, pairs=(), length=suffixes.LENGTH):
    """Passages; every kept document is an earlier one that has a window of the passage."""
    texts = {i: " ".join((t or "").split()) for i, t in pairs}
    for r in df.collect():
        assert r.kept_doc_id == r.kept_doc_ids[0] and r.kept_doc_ids == sorted(set(r.kept_doc_ids))
        own = texts[r[0]].split()[r.first_word : r.first_word + r.n_words]
        windows = [" ".join(own[s : s + length]) for s in range(len(own) - length + 1)]
        assert all(k < r[0] and any(f" {w} " in f" {texts[k]} " for w in windows) for k in r.kept_doc_ids)
    return sorted((r[0], r.first_word, r.n_words) for r in df.collect())


def shared_texts(n, seed):
    """Documents that share passages of many lengths, whole or cut, also within themselves."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(20, 160))] for _ in range(8)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            b = rng.choice([len(p), len(p), rng.randint(a, len(p))])
            words += p[a:b]
        out.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return out


def test_against_brute_force(spark):
    pairs = shared_texts(120, 5)
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = brute(pairs, suffixes.LENGTH)
    assert len(want) > 50
    assert rows(suffixes.repeated_passages(df), pairs) == want
    assert rows(suffixes.repeated_passages(df, length=12, gram=5), pairs, 12) == brute(pairs, 12)
    # Beginnings with more contexts than one task compares are dealt again by their windows.
    assert rows(suffixes.repeated_passages(df, length=12, gram=5, most_together=3), pairs, 12) == brute(pairs, 12)


def test_documents_and_odd_rows(docs, odd, empty):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows(suffixes.repeated_passages(docs), pairs) == brute(pairs, suffixes.LENGTH)
    assert rows(suffixes.repeated_passages(odd)) == []
    assert suffixes.repeated_passages(empty).count() == 0
    assert suffixes.without_repeats(odd).count() == odd.count()
    assert suffixes.without_repeats(odd).columns == odd.columns


def test_cutting(spark):
    pairs = shared_texts(60, 9)
    df = spark.createDataFrame([(i, t, "x") for i, t in pairs], "doc_id long, text string, words string")
    cut = {}
    for i, first, n in brute(pairs, suffixes.LENGTH):
        cut.setdefault(i, set()).update(range(first, first + n))
    want = {i: [w for k, w in enumerate(t.split()) if k not in cut.get(i, ())] for i, t in pairs}
    got = {r.doc_id: r.text.split() for r in suffixes.without_repeats(df).collect()}
    assert got == {i: w for i, w in want.items() if w or i not in cut}


def test_minimisers_of_long_texts():
    """Places are right however long the text is: short stretches give what one long stretch gives, also among ties."""
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 50, 5000).astype(np.uint64)
    want = [at + int(np.argmin(suffixes.mix(hashes[at : at + 31] ^ np.uint64(0x9E3779B97F4A7C15)))) for at in range(5000 - 30)]
    for stretch in (7, 64, 1 << 20):
        assert suffixes.minimisers(hashes, 31, stretch).tolist() == want
    passage = b" ".join(b"p%d" % k for k in range(80))
    near, far = passage, b"a " * 3000 + passage
    for stretch in (256, 1 << 20):
        leads = [set(suffixes.retained(Words([t]), stretch=stretch)[1].tolist()) for t in (near, far)]
        assert leads[0] and leads[0] <= leads[1]


def test_equal_leading_hashes_do_not_make_a_repeat():
    """Suffixes of one lead whose words differ are told apart by their words."""
    import pyarrow as pa

    words = pa.array([" ".join(f"a{k}" for k in range(12)), " ".join(f"b{k}" for k in range(12)), " ".join(f"a{k}" for k in range(12))])
    lead, ids, at = np.array([9, 9, 9]), np.array([1, 2, 3]), np.zeros(3, np.int64)
    row, first, last, kept = suffixes.compare(lead, ids, at, at, at, words, 12, 5)
    assert (row.tolist(), first.tolist(), last.tolist(), kept.tolist()) == ([2], [0], [0], [1])
