"""The prefix tree and the repair of conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from taktwerk.llm import repair, trie
from taktwerk.llm.common import table
from tests_llm_helpers import WORD

SCHEMA = "conv_id long, turn long, role string, text string, conv string, key string, words string, part int, place long"


def make(spark, rows):
    return spark.createDataFrame([(*r, "c", "k", "w", 1, 2) for r in rows], SCHEMA)


def tree_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    name = lambda t: hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()[:32]
    old = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, name(t)))] for c, v in convs.items()}
    new = {}
    for c, turns in old.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(old.get(c - c % 20, [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    below, out = {}, []
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, k[-1][1])) if k else 0
        below[k] = (sum(below[x][0] for x in kids[k]) or 1, (len(members[k]) - 1) * words + sum(below[x][1] for x in kids[k]))
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(new[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tree(df, **how):
    out = trie.prefix_tree(trie.branched(trie.turn_sequences(df)), **how)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


ODD = [
    (0, 0, "system", "Be brief. Thanks."), (0, 1, "user", "hello there"), (0, 2, None, None), (1, None, "user", "first"), (1, None, "user", "first"), (1, 3, "user", ""),
    (2, 5, "a", "bc"), (3, 5, "ab", "c"), (None, 1, "user", "nobody"), (None, None, None, None), (20, 0, "user", "x" * 70_000 + " y"), (-7, 0, "user", "minus"),
    (40, 1, "u", "t"), (40, 1, "t", "u"), (41, 0, None, "q"), (2**40, 0, "user", "far"), (21, 9, "user", "z"),
]


@pytest.mark.parametrize("how", [{}, {"part_keys": 7, "part_ranges": 2}, {"part_keys": 1, "part_ranges": 64}])
def test_prefix_tree(spark, sf_dir, how):
    df = table(spark, sf_dir, "conversations")
    assert tree(df, **how) == tree_of(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))


@pytest.mark.parametrize("how", [{}, {"part_keys": 2, "part_ranges": 3}])
def test_prefix_tree_of_odd_rows(spark, how):
    assert tree(make(spark, ODD + ODD[:3]), **how) == tree_of(ODD + ODD[:3])
    assert tree(make(spark, []), **how) == []


def test_copies_and_long_common_beginnings(spark, monkeypatch):
    """Hundreds of copies of one conversation, and beginnings of every length of one long dialogue."""
    monkeypatch.setattr(trie, "CHUNK_BITS", 4)
    long = [(turn, ("user", "assistant")[turn % 2], f"turn {turn % 9}") for turn in range(60)]
    rows = [(1000 + c, *t) for c in range(60) for t in long[: c + 1]]
    rows += [(5000 + c, *t) for c in range(300) for t in long[:4]]
    for how in ({}, {"part_keys": 10, "part_ranges": 3}):
        assert tree(make(spark, rows), **how) == tree_of(rows)


def test_radix_tree_layouts_grow():
    tree_, keys = trie.Tree(), [bytes([i, j]) * 8 for i in range(256) for j in (0, 3 * i % 256)]
    seen = set()
    for i, key in enumerate(sorted(set(keys), key=lambda k: hashlib.sha256(k).digest())):
        tree_.insert(key, trie.Value(n=1, least=i, words=[1]))
        kids = tree_.root.kids
        seen.add((type(kids).__name__, getattr(kids, "room", 0)))
    assert seen >= {("Sorted", 4), ("Sorted", 16), ("Indexed", 0), ("Full", 0)}
    given = []
    trie.walk(tree_, lambda row: given.append(row) or len(given) - 1, lambda *a: None, None)
    assert len(given) == len(set(keys)) + 1 and given[-1][1:4] == (0, len(set(keys)), len(set(keys)))


def damage(rows):
    shown = lambda x: " " if x is None else str(x)
    out = defaultdict(list)
    for c, turn, role, text in rows:
        lot, role, text, held = zlib.crc32(f"{shown(c)}:{shown(turn)}".encode()) % 20, shown(role), shown(text), out[c]
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        held.extend([(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, letters), over all ways written out as strings, with the repaired rows."""
    lead = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    role_of = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                to = turn[state]
                new = (cost + 5, letters + "I", (*out, (role_of[to], "")))
                best[to] = min(best.get(to, new), new, key=lambda x: x[:2])
        return best

    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        new = {}
        for state, (cost, letters, out) in with_inserts(best).items():
            ways = [(state, (cost + 2, letters + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                if (state, role[:1]) in lead:
                    ways.append((lead[state, role[:1]], (more, letters + "K", (*out, (role, text)))))
                ways.append((turn[state], (more + 1, letters + "R", (*out, (role_of[turn[state]], text)))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=lambda x: x[:2])
        best = new
    best = with_inserts(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def report_of(convs):
    out = []
    for c, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, found = [r[0] for r in rows if r[0] is not None], faults(rows)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, letters, kept = cheapest(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((c, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, letters, digest))
    return sorted(out, key=repr)


def report(df, damage=True):
    out = repair.repair_report(df, damage=damage)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_cheapest_by_trying_everything():
    """The plain programme of this test against all sequences of edits of short conversations."""
    lot = random.Random(3)
    for _ in range(60):
        rows = [(i, lot.choice(["user", "assistant", "system", "x", ""]), lot.choice(["a.", "b", "", "a."])) for i in range(lot.randrange(4))]
        found, best = faults(rows), None
        for letters in (p for n in range(len(rows), len(rows) + 4) for p in itertools.product("KRDI", repeat=n)):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            cost, roles, at, ok = 0, [], 0, True
            for x in letters:
                if x == "I":
                    roles.append("?")
                    cost += 5
                    continue
                fault, role = found[at], rows[at][1]
                at += 1
                cost += {"K": 0, "R": 1, "D": 2}[x] + 5 * (x != "D" and fault == "truncated")
                ok = ok and (x == "D" or fault not in ("blank", "duplicate"))
                if x != "D":
                    roles.append(role[:1] or "-" if x == "K" else "?")
            fits = any(len(roles) == len(w) and all(r == v or r == "?" and v != "s" for r, v in zip(roles, w, strict=True)) for w in ("", *["s" * s + "ua" * n for s in (0, 1) for n in range(1, 5)]))
            if ok and fits:
                best = min(best or (cost, "".join(letters)), (cost, "".join(letters)))
        assert cheapest(rows)[:2] == best


def test_repair(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert report(df) == report_of(damage(map(tuple, df.select("conv_id", "turn", "role", "text").collect())))


def test_repair_of_odd_rows(spark):
    assert report(make(spark, ODD + ODD[:3])) == report_of(damage(ODD + ODD[:3]))
    assert report(make(spark, [])) == []
    lost = next(t for t in range(200) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert report(make(spark, [(9, lost, "user", "gone.")])) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("every", [1, 3, 4096])
def test_long_conversations_settle_as_they_pass(spark, monkeypatch, every):
    monkeypatch.setattr(repair, "SETTLE_ROWS", every)
    lot = random.Random(every)
    for n in (0, 1, 5, 40, 300):
        rows = [(i, lot.choice(["user", "assistant", "user", "assistant", "system", "tool"]), lot.choice(["yes.", "no", f"{i}.", f"{i}!", "", f"{i}?"])) for i in range(n)]
        once, edits = repair.Repair(), []
        for row in rows:
            edits += once.row(*row)
        cost, rest = once.end()
        edits += rest
        want = cheapest(rows)
        assert (cost, "".join(e.letter for e in edits)) == want[:2]
        assert tuple((e.role, e.text) for e in edits if e.role is not None) == want[2]


def test_what_is_settled_leaves_the_memory():
    lot, once, most = random.Random(9), repair.Repair(), 0
    for i in range(40_000):
        once.row(i, lot.choice(["user", "assistant", "system", "user", "assistant"]), f"text {i if i % 7 else 3}{'.' if i % 5 else ''}")
        most = max(most, len(once.held))
    assert most <= repair.SETTLE_ROWS + 100


def test_order_of_chains_with_equal_hashes(monkeypatch):
    """With a rolling hash that is always the same, the letters themselves decide."""
    for modulus in (repair._MODULUS, 1):
        monkeypatch.setattr(repair, "_MODULUS", modulus)
        root, lot = repair.Node(None), random.Random(5)
        for _ in range(200):
            words = ["".join(lot.choice("DK") for _ in range(lot.randrange(1, 9))) for _ in range(2)]
            ends = []
            for word in words:
                at = root
                for letter in word:
                    at = repair.Node(at, letter)
                ends.append(at)
            assert repair.comes_first(*ends) == (words[0] < words[1])


def test_repaired_turns(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    edits = defaultdict(list)
    for r in repair.repaired_turns(df).orderBy("place").collect():
        edits[r.conv_id].append(r)
    for c, *_, letters, digest in report(df, damage=False):
        assert [r.place for r in edits[c]] == list(range(len(letters))) and "".join(r.edit for r in edits[c]) == letters
        lines = "\n".join(f"{r.role}:{r.text}" for r in edits[c] if r.edit != "D")
        assert hashlib.sha256(lines.encode()).hexdigest() == digest
