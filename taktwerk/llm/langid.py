"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of ``WINDOW`` bytes, one after the other until its
end.  In each window two gated recurrent layers run over the bytes, one from each side; from
both states together every position gets a probability per language.  A document's
probabilities are the means over all its positions.  Gates and candidates use x / (1 + |x|),
which takes a fraction of a hyperbolic tangent's time.

The network is trained in numpy by backpropagation through time on a bounded sample:
at most ``TRAIN_DOCS`` documents of each language, chosen by a hash of
the id, and ``TRAIN_PIECES`` pieces of each.  Prediction covers every byte of every document.

Defined results: a null text or one without a letter is ``und`` with score 0; without a labelled
document to learn from, every document is ``und``; a document whose id is null is not learned
from and not held out; repeated rows get a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taktwerk.llm.common import sliced, with_text

UNKNOWN = "und"
WINDOW = 128
EMBEDDING, HIDDEN = 8, 12
LANES = 2048
TRAIN_DOCS, TRAIN_PIECES = 300, 4
TRAIN_WINDOW, TRAIN_LANES, TRAIN_STEPS, RATE, SEED = 48, 256, 240, 0.02, 11
#: Bytes that go through the network together.
CHUNK_BYTES = 4_000_000

#: What may be a letter: digits and other numbers count as word characters too.
_WORD_CHARS = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; raised or enclosed digits, fractions and Roman numerals are none."""
    return any(c.isalpha() for m in _WORD_CHARS.finditer(text) for c in m[0])


@dataclass
class Model:
    """Weights; ``w[d]`` maps bytes' vectors and the state of direction ``d`` to the two gates, the
    candidate's input part and its state part, each of ``HIDDEN`` rows."""

    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    w: np.ndarray  # (2, 4 * HIDDEN, EMBEDDING + HIDDEN)
    b: np.ndarray  # (2, 4 * HIDDEN, 1)
    out: np.ndarray  # (languages, 2 * HIDDEN)
    out_b: np.ndarray  # (languages, 1)


#: The candidate's input part does not see the state, nor its state part the input.
def _pattern() -> np.ndarray:
    keep = np.ones((4 * HIDDEN, EMBEDDING + HIDDEN), dtype=np.float32)
    keep[2 * HIDDEN : 3 * HIDDEN, EMBEDDING:] = 0
    keep[3 * HIDDEN :, :EMBEDDING] = 0
    return keep


def new_model(languages: list[str], rng: np.random.Generator) -> Model:
    w = rng.normal(0, 0.3, (2, 4 * HIDDEN, EMBEDDING + HIDDEN)).astype(np.float32) * _pattern()
    return Model(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), w, np.zeros((2, 4 * HIDDEN, 1), np.float32),
        rng.normal(0, 0.2, (len(languages), 2 * HIDDEN)).astype(np.float32), np.zeros((len(languages), 1), np.float32),
    )


def _squash(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1.0
    x /= spare


def _states(model: Model, data: np.ndarray, lengths: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (position, direction, unit, lane) of the windows ``data`` (position, lane).

    A window shorter than the others is padded at its end; there the state stays zero.  ``trace``
    takes what the backward pass needs.
    """
    steps, lanes = data.shape
    h_n = HIDDEN
    w, b = model.w, model.b
    vectors = np.ascontiguousarray(model.embedding.T)[:, data]  # (EMBEDDING, position, lane)
    ragged = bool((lengths < steps).any())
    x = np.zeros((2, EMBEDDING + h_n, lanes), np.float32)
    out = np.empty((steps, 2, h_n, lanes), np.float32)
    g = np.empty((2, 4 * h_n, lanes), np.float32)
    spare = np.empty((2, 2 * h_n, lanes), np.float32)
    for t in range(steps):
        back = steps - 1 - t
        x[0, :EMBEDDING], x[1, :EMBEDDING] = vectors[:, t], vectors[:, back]
        np.matmul(w, x, out=g)
        g += b
        gates = g[:, : 2 * h_n]
        _squash(gates, spare)
        gates += 1.0
        gates *= 0.5
        z, r = gates[:, :h_n], gates[:, h_n:]
        n = r * g[:, 3 * h_n :]
        n += g[:, 2 * h_n : 3 * h_n]
        _squash(n, spare[:, :h_n])
        h = x[:, EMBEDDING:]
        if trace is not None:
            trace.append((x.copy(), z.copy(), r.copy(), n.copy(), g[:, 3 * h_n :].copy()))
        new = h - n
        new *= z
        new += n
        if ragged:
            new[0] *= t < lengths
            new[1] *= back < lengths
        x[:, EMBEDDING:] = new
        out[t, 0], out[back, 1] = new[0], new[1]
    return out


def position_probabilities(model: Model, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probabilities (language, position, lane) of the windows ``data`` (position, lane)."""
    states = _states(model, data, lengths)
    steps, lanes = data.shape
    logits = np.matmul(model.out, states.reshape(steps, 2 * HIDDEN, lanes)) + model.out_b
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.transpose(1, 0, 2)


def _gradients(model: Model, data: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over all positions, and gradients by backpropagation through time."""
    steps, lanes = data.shape
    h_n, trace = HIDDEN, []
    states = _states(model, data, np.full(lanes, steps), trace).reshape(steps, 2 * h_n, lanes)
    logits = np.matmul(model.out, states) + model.out_b
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(np.maximum(p[:, labels, np.arange(lanes)], 1e-9)).mean())
    p[:, labels, np.arange(lanes)] -= 1
    p /= steps * lanes
    grad = {"out": np.einsum("tcl,tsl->cs", p, states), "out_b": p.sum(axis=(0, 2))[:, None]}
    d_states = np.matmul(model.out.T, p).reshape(steps, 2, h_n, lanes)
    d_w, d_b = np.zeros_like(model.w), np.zeros_like(model.b)
    d_emb = np.zeros_like(model.embedding)
    d_h = np.zeros((2, h_n, lanes), np.float32)
    d_g = np.empty((2, 4 * h_n, lanes), np.float32)
    w_t = model.w.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        back = steps - 1 - t
        x, z, r, n, s = trace[t]
        d_h[0] += d_states[t, 0]
        d_h[1] += d_states[back, 1]
        h = x[:, EMBEDDING:]
        d_n = d_h * (1 - z) * (1 - np.abs(n)) ** 2
        d_g[:, :h_n] = d_h * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_g[:, h_n : 2 * h_n] = d_n * s * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_g[:, 2 * h_n : 3 * h_n] = d_n
        d_g[:, 3 * h_n :] = d_n * r
        d_w += np.matmul(d_g, x.transpose(0, 2, 1))
        d_b += d_g.sum(axis=2, keepdims=True)
        d_x = np.matmul(w_t, d_g)
        np.add.at(d_emb, data[t], d_x[0, :EMBEDDING].T)
        np.add.at(d_emb, data[back], d_x[1, :EMBEDDING].T)
        d_h = d_h * z + d_x[:, EMBEDDING:]
    grad |= {"w": d_w * _pattern(), "b": d_b, "embedding": d_emb}
    return loss, grad


def train(pieces: list[tuple[str, bytes]], steps: int = TRAIN_STEPS, seed: int = SEED) -> Model | None:
    """Fit the network to labelled pieces of text; None if there are none."""
    pieces = [(lang, raw) for lang, raw in pieces if raw]
    if not pieces:
        return None
    languages = sorted({lang for lang, _ in pieces})
    rng = np.random.default_rng(seed)
    model = new_model(languages, rng)
    # A piece that is too short is repeated to fill the window.
    rows = np.stack([np.resize(np.frombuffer(raw, np.uint8), TRAIN_WINDOW) for _, raw in pieces])
    by_language = [np.flatnonzero([lang == x for x, _ in pieces]) for lang in languages]
    moments = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in ("embedding", "w", "b", "out", "out_b")}
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=TRAIN_LANES)
        chosen = np.array([rng.choice(by_language[k]) for k in labels])
        _, grad = _gradients(model, np.ascontiguousarray(rows[chosen].T), labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments[k]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            getattr(model, k)[...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def document_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities (document, language) over all bytes of each text; zeros for an empty one."""
    total = np.zeros((len(texts), len(model.languages)))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    n_windows = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n_windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    begin = starts[owner] + within * WINDOW
    lengths = np.minimum(WINDOW, sizes[owner] - within * WINDOW)
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), LANES):
        own = order[at : at + LANES]
        n = lengths[own]
        steps = int(n.max())
        where = begin[own] + np.arange(steps)[:, None]
        data = flat[np.minimum(where, len(flat) - 1)]
        p = position_probabilities(model, data, n)
        if (n < steps).any():
            p = p * (np.arange(steps)[:, None] < n)
        np.add.at(total, owner[own], p.sum(axis=1, dtype=np.float64).T)
    return total / np.maximum(sizes, 1)[:, None]


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
            at = 0
            while at < len(known):
                end, held = at, []
                size = 0
                while end < len(known) and (not held or size + len(held[-1]) <= CHUNK_BYTES):
                    held.append(texts[known[end]].encode("utf-8", "surrogatepass"))
                    size += len(held[-1])
                    end += 1
                p = document_probabilities(model, held)
                best = p.argmax(axis=1)
                for k, i in enumerate(known[at:end]):
                    labels[i], scores[i] = model.languages[best[k]], min(1.0, float(p[k, best[k]]))
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(labels), pa.array(scores)], names=["id", "lang_pred", "score"])

    return run


def held_out(id_col: str):
    """The documents that are never learned from: the id's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """A bounded sample of labelled pieces: at most ``TRAIN_DOCS * TRAIN_PIECES`` of every language.

    The documents of a language are those with the smallest hashes of their ids, found without
    reading texts (every task sends on no more than it may keep); pieces stand at places that follow from the hash.
    An id that is no whole number is taken for null.
    """
    own = with_text(docs, {"id": id_col, "lang": lang_col}).withColumn("id", F.col("id").try_cast("long")).where(F.col("id").isNotNull() & F.col("lang").isNotNull())
    own = own.where(~held_out("id")).distinct().withColumn("draw", F.xxhash64("id"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))
    chosen = [r["id"] for r in own.withColumn("place", place).where(F.col("place") <= TRAIN_DOCS).select("id").collect()]
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(chosen))], "chosen long")
    full = with_text(docs, {"id": id_col, "text": text_col, "lang": lang_col}).withColumn("id", F.col("id").try_cast("long")).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    full = full.join(F.broadcast(picked), F.col("id") == F.col("chosen"))
    room = F.greatest(F.length("text") - TRAIN_WINDOW + 1, F.lit(1))
    places = [F.substring("text", (F.pmod(F.xxhash64("id", F.lit(k)), room) + 1).cast("int"), F.lit(TRAIN_WINDOW)) for k in range(TRAIN_PIECES)]
    rows = full.select("id", "lang", F.array(*places).alias("pieces")).collect()
    rows.sort(key=lambda r: (r["id"], r["lang"], r["pieces"]))
    return [(r["lang"], p.encode("utf-8", "surrogatepass")) for r in rows for p in r["pieces"]]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred`` and ``score``."""
    model = train(training_pieces(docs, id_col, text_col, lang_col))
    own = with_text(docs, {"id": id_col, "text": text_col})
    own = own.withColumn("id", F.col("id").try_cast("long"))
    out = own.mapInArrow(_predicted(model), "id long, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
