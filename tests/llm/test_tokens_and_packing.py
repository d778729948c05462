import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taktwerk.llm import elias_fano, packing
from taktwerk.llm.tokens import BatchEncoder, default_tokenizer_path


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(default_tokenizer_path())
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.'\n\t é1", max_size=30), max_size=6))
def test_encoder_equals_library(texts):
    encoder = BatchEncoder(default_tokenizer_path(), cache_pieces=3)
    flat, n = encoder.encode(texts)
    want = [e.ids for e in Tokenizer.from_file(default_tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(steps)
    ef = elias_fano.EliasFano.encode(values)
    ef = elias_fano.EliasFano(len(values), ef.low_bits, *ef.parts)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def check_spans(rows, pairs, whole):
    """rows from the files against the library, in ascending order of ids."""
    got = sorted((r.start, r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in rows)
    assert [g[1] for g in got] == sorted(g[1] for g in got)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    want = sorted((-1 if i is None else i, len(x := whole(t)), crc(x)) for i, t in pairs)
    assert sorted(g[1:] for g in got) == want


def test_token_spans_on_documents(docs, whole):
    check_spans(elias_fano.token_spans(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], whole)


def test_token_spans_with_odd_rows(odd, empty, whole, spark, tmp_path):
    check_spans(elias_fano.token_spans(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], whole)
    assert elias_fano.token_spans(empty).count() == 0
    elias_fano.write_blocks(odd, str(tmp_path / "t"), block_ids=5)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 4
    check_spans(elias_fano.read_spans(spark, str(tmp_path / "t")).collect(), [(r.doc_id, r.text) for r in odd.collect()], whole)


def check_packed(rows, pairs, whole):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    want = []
    for i, t in pairs:
        ids = whole(t)
        want += [(i, k, s, m, crc(ids[s : s + m])) for k, (s, m) in enumerate(packing.cut(len(ids)))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by_seq)


def test_packing(docs, odd, empty, whole):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    n = check_packed(packing.pack_documents(docs).collect(), pairs, whole)
    assert n <= 1.02 * -(-sum(len(whole(t)) for _, t in pairs) // packing.LENGTH) + 2
    check_packed(packing.pack_documents(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], whole)
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3]), st.sampled_from([None, 900]))
def test_every_capacity_holds(lengths, rule, documents, attention):
    bins = packing.vector_best_fit(np.array(lengths, dtype=np.int64), 50, documents, attention, rule=rule)
    for b in set(bins.tolist()):
        own = [n for n, x in zip(lengths, bins.tolist()) if x == b]
        assert sum(own) <= 50 and len(own) <= (documents or 50)
        assert len(own) == 1 or sum(n * n for n in own) <= (attention or 2500)


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def test_small_chunks_give_the_same_ids_in_less_memory():
    import tracemalloc

    from taktwerk.llm import tokens

    texts = [" ".join(f"w{(i * 31 + k) % 997}" for k in range(400)) for i in range(800)]
    path, peaks, made = tokens.default_tokenizer_path(), [], []
    for chunk in (tokens.CHUNK_CHARS, 100_000):
        encoder = tokens.BatchEncoder(path, 100_000, chunk)
        tracemalloc.start()
        ids, sizes = encoder.encode(texts)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        made.append((ids.tolist(), sizes.tolist()))
    assert made[0] == made[1] and peaks[1] < peaks[0] / 2
