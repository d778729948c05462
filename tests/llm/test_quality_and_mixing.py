import hashlib
import re
from collections import Counter

import pytest

from taktwerk.llm import mixing, quality, simhash
from tests_llm_helpers import WORD, shown

import corpus_pipeline


def brute_counts(text):
    """Words, their characters, symbols, repeated lines, and words in repeated windows of eight."""
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute_quality(rows, min_docs, max_percent, min_kept):
    """(id, counts, base_failed, kept, words kept) by definition."""
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if re.search(WORD, x)]
    holders, hosts = {}, {}
    for _, text, host in rows:
        hosts.setdefault(host, set()).add(text)
        for x in lines(text):
            holders.setdefault((host, normal(x)), set()).add(text)
    out = []
    for doc_id, text, host in rows:
        counts = brute_counts(text)
        gone = sum(len(re.findall(WORD, x)) for x in lines(text) if len(h := holders[host, normal(x)]) > min_docs and (len(h) * 100 > len(hosts[host]) * max_percent or len(h) > quality.LINE_MANY_DOCS))
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        kept = counts[0] - gone
        out.append((doc_id, *counts, failed, not failed and 100 * kept >= min_kept * counts[0], kept))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def lined(spark):
    """Hosts with a line in most documents, documents of little else, copies, and repeated stretches."""
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    note = "Read  our terms and our notes about all the things you may want to know today or on another day"
    rows = [(i, f"{note}\n{body(i, 30)}\nown {i}", "a") for i in range(30)]
    rows += [(100 + i, f"{note}\n{note.upper()}\n{body(i, 4)} tail", "a") for i in range(5)]
    rows += [(200 + i, f"same text of a copy {body(7, 25)}", "b") for i in range(40)]
    rows += [(300 + i, f"{note}\n{body(i, 30)}", None) for i in range(3)]
    rows += [(400, " ".join([body(1, 9)] * 4), "b"), (401, f"{body(2, 60)} {body(2, 10)}", "b"), (402, "a b c d e f g h " * 2 + body(3, 40), "b")]
    return rows


def test_quality_against_brute_force(spark, lined, docs, odd, empty):
    df = spark.createDataFrame(lined, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in quality.judge(df).collect()), key=repr)
    want = brute_quality(lined, quality.LINE_MIN_DOCS, quality.LINE_MAX_PERCENT, quality.MIN_KEPT_PERCENT)
    assert got == want
    assert {r[0] for r in want if not r[-2]} == {100, 101, 102, 103, 104, 400}
    for table in (docs, odd):
        rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
        assert sorted((tuple(r) for r in quality.judge(table).collect()), key=repr) == brute_quality(rows, quality.LINE_MIN_DOCS, quality.LINE_MAX_PERCENT, quality.MIN_KEPT_PERCENT)
    assert quality.judge(empty).count() == 0


def test_quality_stage_cuts_frequent_lines(spark, lined):
    df = spark.createDataFrame([(*r, len(r[1]), 7) for r in lined], "doc_id long, text string, source string, n_chars long, _text int")
    got = {r.doc_id: r for r in quality.filter_documents(df).collect()}
    assert set(got) == {r[0] for r in lined} - {100, 101, 102, 103, 104, 400}
    assert got[3].text == lined[3][1].split("\n", 1)[1] and got[3].n_chars == len(got[3].text) and got[3]["_text"] == 7
    assert got[300].text == next(r[1] for r in lined if r[0] == 300)


def test_line_limit_stops_growing_with_the_host(spark):
    """Of 3000 texts of one host, 100 hold one line and 40 another; only few words of those are left."""
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    often, seldom = "A notice that many of the texts of this host hold", "A sentence that some of the texts of this host hold"
    rows = [(i, f"{often}\n{body(i, 30)}" if i < 100 else f"{seldom}\n{body(i, 30)}" if i < 140 else body(i, 30), "a") for i in range(3000)]
    rows += [(5000, f"{often}\n{often} \n{often}\n{body(5000, 8)}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in quality.judge(df).where("not kept").collect()} == {5000}
    got = {r.doc_id: r.text for r in quality.filter_documents(df).collect()}
    assert all(got[i] == body(i, 30) for i in range(100)) and all(got[i] == rows[i][1] for i in range(100, 3000)) and len(got) == 3000


def brute_targets(rows, weights=(5, 2, 1)):
    """Targets by sharing again and again what the capped sources cannot take."""
    sizes = {}
    for _, size, source in rows:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return sizes, target


def check_mix(table):
    rows = [(r.doc_id, len(re.findall(WORD, r.text or "")), r.source) for r in table.collect()]
    sizes, target = brute_targets(rows)
    got = mixing.mix_report(table).collect()
    source = {}
    for i, _, s in rows:
        source.setdefault(i, set()).add(s)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, n, _ in rows)
    taken = Counter()
    for r in got:
        (s,) = source[r.doc_id] if len(source[r.doc_id]) == 1 else {x for x in source[r.doc_id] if sizes[x] == r.source_size}
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 1.5 * mixing.BLOCK
    return got


def test_mix(docs, odd, empty):
    first = check_mix(docs)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.mix_report(docs).collect()))
    check_mix(odd)
    assert mixing.mix_report(empty).count() == 0


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 7, 8, 100, 1000):
        df = mixing.permute(spark.range(n).selectExpr("id as x", f"{n}L as n", "5L as seed"), "x", "n", "seed")
        got = [r.x for r in df.collect()]
        assert sorted(got) == list(range(n)) and (n < 100 or got != sorted(got))


def test_multinomial_counts(docs, monkeypatch):
    """Every shard but the last ones holds as many draws as it has slots; every slot of a source stands in one shard; seeds differ."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "GROUP_SUMS", 4)
    monkeypatch.setattr(mixing, "CELLS", 8)
    goal = mixing.targets(mixing.sized(docs))
    want = {r["rank"]: r["slots"] for r in goal.collect() if r["slots"]}
    drawn = Counter()
    for r in mixing.drawn_counts(goal).collect():
        drawn[r["shard"]] += r["n"]
    assert set(drawn.values()) == {16} and len(drawn) == sum(want.values()) // 16
    # By definition: each slot's number falls into the share of one source.
    ends, total = [], 0
    for rank in sorted(want):
        total += want[rank]
        ends.append((total, rank))
    brute = Counter()
    for shard in range(total // 16):
        for j in range(16):
            u = int(hashlib.md5(f"0|{shard}|{j}".encode()).hexdigest()[:15], 16) % total
            brute[shard, next(rank for end, rank in ends if u < end)] += 1
    assert brute == {(r["shard"], r["rank"]): r["n"] for r in mixing.drawn_counts(goal).collect()}
    counts = mixing.source_counts(goal).collect()
    for rank, slots in want.items():
        assert sorted(k for r in counts if r["rank"] == rank for k in range(r["base"], r["base"] + r["n"])) == list(range(slots))
    other = mixing.source_counts(goal, seed=1).collect()
    assert {(r["shard"], r["rank"], r["n"]) for r in counts} != {(r["shard"], r["rank"], r["n"]) for r in other}
    reports = [{r["doc_id"]: (r["taken"], r["first_shard"]) for r in mixing.mix_report(docs, seed=seed).collect()} for seed in (0, 1)]
    assert all(any(reports[0][i][k] != reports[1][i][k] for i in reports[0]) for k in (0, 1))


def test_mixed_texts_have_the_taken_words(docs):
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words, copies, texts = Counter(), Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in mixed.collect():
        own = re.findall(WORD, r.text)
        words[r.doc_id] += len(own)
        copies[r.doc_id] += 1
        assert r.n_chars == len(r.text) and set(own) <= set(re.findall(WORD, texts[r.doc_id]))
        assert len(own) < report[r.doc_id].size or r.text.split() == texts[r.doc_id].split()
    assert words == {i: r.taken for i, r in report.items() if r.taken} and max(copies.values()) == 2


def test_pipeline_against_plain_python(spark, sf_dir):
    """Each stage on what its predecessor kept, held against its definition."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    before = shown(docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "sequence_packing":
            pieces = out.collect()
            assert {r.doc_id for r in pieces} == {r["doc_id"] for r in before}
            assert all(r.length <= 2048 for r in pieces)
            break
        assert out.columns == names
        docs = out.cache()
        after = shown(docs)
        if name == "quality_rules":
            rows = [(r["doc_id"], r["text"], r["source"]) for r in before]
            keep = {r[0] for r in brute_quality(rows, quality.LINE_MIN_DOCS, quality.LINE_MAX_PERCENT, quality.MIN_KEPT_PERCENT) if r[-2]}
            assert {r["doc_id"] for r in after} == keep
        elif name == "near_dedup":
            grams = {r["doc_id"]: set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in before}
            kept = {r["doc_id"] for r in after}
            near = lambda a, b: len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])
            group = {i: i for i in grams}

            def find(x, group=group):
                while group[x] != x:
                    x = group[x]
                return x

            for a in grams:
                for b in grams:
                    if a < b and near(a, b):
                        group[find(b)] = find(a)
            assert kept == {min(j for j in grams if find(j) == find(i)) for i in grams}
        elif name == "repeat_removal":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        else:
            old = {r["doc_id"]: Counter(r["text"].split()) for r in before}
            assert all(not Counter(r["text"].split()) - old[r["doc_id"]] for r in after)
        before = after
