import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from taktwerk.llm import fingerprints as fp


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab.!\n é", max_size=400), st.text(alphabet="xy.\n", max_size=60))
def test_sums_do_not_depend_on_order(text, other):
    pieces = fp.paragraphs(text)
    assert "".join(pieces) == text and all(0 < len(p) for p in pieces)
    a = fp.insert(np.zeros(fp.WIDTH, dtype=np.int64), pieces)
    b = fp.insert(np.zeros(fp.WIDTH, dtype=np.int64), pieces[::-1])
    assert np.array_equal(a, b) and np.array_equal(fp.from_hex(fp.to_hex(a)), a)
    more = fp.insert(a, fp.paragraphs(other))
    assert np.array_equal(fp.delete(more, fp.paragraphs(other)), a)
    assert fp.likeness(a, b) == 1.0 and 0.0 <= fp.likeness(a, more) <= 1.0


def brute(pairs):
    """Rows by a plain walk over all documents in order."""
    order = sorted(((i, t or "") for i, t in pairs if i is not None))
    chain = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    chain += [(None, t or "", t or "") for i, t in pairs if i is None]
    out = []
    for i, t, nxt in chain:
        half = len(t) // 2
        new = t[: len(t) - half] + nxt[:half]
        a, b, c = (fp.digest_sum(fp.paragraphs(x)) for x in (t, new, nxt))
        out.append((-1 if i is None else i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.to_hex(a), fp.to_hex(b), round(fp.likeness(a, b), 9), round(fp.likeness(a, c), 9)))
    return sorted(out)


def rows(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:5], round(r[5], 9), round(r[6], 9)) for r in df.collect())


def test_documents_against_brute_force(docs, odd, empty, monkeypatch):
    monkeypatch.setattr(fp, "GROUP_DOCS", 7)
    assert rows(fp.fingerprint_documents(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(fp.fingerprint_documents(odd)) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert fp.fingerprint_documents(empty).count() == 0
    one = odd.where("doc_id = 9")
    assert rows(fp.fingerprint_documents(one)) == brute([(r.doc_id, r.text) for r in one.collect()])


def test_sums_of_very_many_like_paragraphs_do_not_wrap():
    """The fingerprint of 65536 like paragraphs is not that of an empty text, and likeness does not depend on the size."""
    one = fp.digest_sum(fp.paragraphs("a b.\n" * 65536))
    assert fp.to_hex(one) != fp.to_hex(fp.digest_sum([]))
    near = []
    for n in (400, 40000):
        text = "a b.\n" * n
        new = fp.edited(text, "c d.\n" * n)
        near.append(fp.likeness(*(fp.from_hex(fp.to_hex(fp.digest_sum(fp.paragraphs(t)))) for t in (text, new))))
    assert abs(near[0] - near[1]) < 0.01 and near[0] > 0.5
