import zlib

import numpy as np
import pytest

from taktwerk.llm import langid


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = langid.new_model(["a", "b", "c"], rng)
    data, labels = rng.integers(0, 256, (7, 5)), rng.integers(0, 3, 5)
    _, grad = langid._gradients(model, data, labels)
    for name in ("embedding", "w", "b", "out", "out_b"):
        weights = getattr(model, name)
        for at in np.argsort(-np.abs(grad[name]).ravel())[:4]:
            ix = np.unravel_index(at, weights.shape)
            old = weights[ix]
            sides = []
            for step in (0.01, -0.01):
                weights[ix] = old + step
                sides.append(langid._gradients(model, data, labels)[0])
            weights[ix] = old
            assert grad[name][ix] == pytest.approx((sides[0] - sides[1]) / 0.02, rel=0.03, abs=2e-4)


def test_every_byte_counts_once():
    model = langid.new_model(["a", "b"], np.random.default_rng(1))
    texts = [b"x" * n for n in (0, 1, langid.WINDOW, langid.WINDOW + 1, 1000)]
    got = langid.document_probabilities(model, texts)
    assert got[0].tolist() == [0, 0]
    assert np.allclose(got[1:].sum(axis=1), 1, atol=1e-5)
    # One window by itself, position after position.
    part = np.frombuffer(texts[3], np.uint8)
    a = langid.position_probabilities(model, part[: langid.WINDOW, None], np.array([langid.WINDOW]))
    b = langid.position_probabilities(model, part[langid.WINDOW :, None], np.array([1]))
    assert np.allclose(got[3], (a.sum(axis=(1, 2)) + b.sum(axis=(1, 2))) / len(part), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert rows.keys() == truth.keys()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.97


def test_odd_rows(odd, empty, spark):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (5, 1, 2))
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert langid.identify(empty).count() == 0
    bare = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(bare).collect()] == [("und", 0.0)]


def test_numbers_of_other_kinds_are_no_letters():
    assert not any(langid.has_letter(t) for t in ("", "12 _ ?", "² ½ Ⅷ ①", "x".replace("x", "_9³")))
    assert all(langid.has_letter(t) for t in ("1 a", "²½א", "é"))
