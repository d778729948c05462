"""Batch tokenisation with a vocabulary file of the ``tokenizers`` library.

``BatchEncoder.encode`` gives the same ids as calling the library on every whole
text.  Natural text repeats its words, so the encoder cuts each text at the places
where the byte-level pre-tokeniser always cuts (a single blank or newline between
two visible characters), finds the distinct pieces of a batch with Arrow's
dictionary encoding, and asks the library only for pieces it has not met yet.
Texts in which white space is irregular go to the library whole.
"""

from __future__ import annotations

import functools
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept between batches of one task; the memory this needs is about 150 MB.
CACHE_PIECES = 700_000
#: Characters handled at once, so that a batch of very long texts stays small.
CHUNK_CHARS = 6_000_000

#: White space other than a blank or newline, as Python sees it, and the mark used for cutting.
_ODD_CHARS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"] + ["\x00"]


def _irregular(text: str) -> bool:
    """Whether white space stands twice in a row, at an end, or in another form than blank or newline."""
    return (
        text[0] in " \n"
        or text[-1] in " \n"
        or any(pair in text for pair in ("  ", "\n\n", " \n", "\n "))
        or any(c in text for c in _ODD_CHARS)
    )


def default_tokenizer_path() -> str:
    """Where the 50k byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str) -> BatchEncoder:
    """The encoder of this worker process: it and the pieces it knows serve one task after the other."""
    return BatchEncoder(path)


class BatchEncoder:
    """Encodes lists of texts."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, chunk_chars: int = CHUNK_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self._blank_first = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self._blank_first[i] = token.startswith("Ġ")
        self._limit, self._chunk = cache_pieces, chunk_chars
        # Added tokens are matched before pre-tokenisation, so texts that name one go whole.
        self._added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """No piece is known: their numbers, the ids of all of them in a row, and each one's place and count there."""
        self._numbers: dict[str, int] = {}
        self._pool = np.zeros(0, dtype=np.uint32)
        self._at = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._uses = np.zeros(0, dtype=np.int64)

    def _tidy(self) -> None:
        """Keep the half of the known pieces that came in most batches."""
        keep = np.sort(np.argsort(-self._uses, kind="stable")[: self._limit // 2])
        pieces = np.array(list(self._numbers), dtype=object)[keep].tolist()
        ids, sizes = self._ids_of(keep)
        uses = self._uses[keep] // 2
        self._forget()
        self._add(pieces, ids, sizes)
        self._uses = uses

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces (in another order), their ids in a row and the number of ids of each; those with a
        leading blank are encoded in one go and told apart by it."""
        blank = [p for p in pieces if p[0] == " "]
        other = [p for p in pieces if p[0] != " "]
        ids, sizes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if blank:
            ids = self._whole(["".join(blank)])[0]
            starts = np.flatnonzero(self._blank_first[ids])
            if len(starts) == len(blank):
                sizes = np.diff(np.append(starts, len(ids)))
            else:
                ids, blank, other = ids[:0], [], other + blank
        if other:
            rest = self._whole(other)
            ids = np.concatenate((ids, *rest))
            sizes = np.concatenate((sizes, np.array([len(r) for r in rest], dtype=np.int64)))
        return blank + other, ids, sizes

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._numbers.update(zip(pieces, range(len(self._size), len(self._size) + len(pieces)), strict=True))
        self._at = np.concatenate((self._at, len(self._pool) + np.cumsum(sizes) - sizes))
        self._pool = np.concatenate((self._pool, ids))
        self._size = np.concatenate((self._size, sizes))
        self._uses = np.concatenate((self._uses, np.zeros(len(pieces), dtype=np.int64)))

    def _find(self, pieces: list[str] | np.ndarray) -> np.ndarray:
        """Each piece's number among the known ones, -1 if it is not known."""
        return np.fromiter(map(self._numbers.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))

    def _ids_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces in a row, and the number of ids of each."""
        n = self._size[which]
        ends = np.cumsum(n)
        return self._pool[np.repeat(self._at[which] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], n

    def _known(self, pieces: np.ndarray) -> np.ndarray:
        """Each piece's number among the known ones, after learning those that were not."""
        if len(self._numbers) > self._limit:
            self._tidy()
        found = self._find(pieces)
        unknown = np.flatnonzero(found < 0)
        # A batch names each piece once.
        self._uses[found[found >= 0]] += 1
        if not len(unknown):
            return found
        new = pieces[unknown].tolist()
        # "word," is "word" and then ",": the pre-tokeniser never joins them.
        tailed = [p for p in new if p[-1] in ".," and p[-2:-1].isalpha()]
        needed = {p[:-1] for p in tailed} | set(".,") | {p for p in new if not (p[-1] in ".," and p[-2:-1].isalpha())}
        lost = sorted(p for p in needed if p not in self._numbers)
        if lost:
            self._add(*self._encoded(lost))
        if tailed:
            ids, n = self._ids_of(self._find([x for p in tailed for x in (p[:-1], p[-1])]))
            self._add(tailed, ids, n[::2] + n[1::2])
        found[unknown] = self._find(new)
        return found

    def _regular(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        col = pa.array(texts, type=pa.large_string())
        col = pc.replace_substring(col, "\n", "\x00\n\x00")
        col = pc.replace_substring(col, " ", "\x00 ")
        parts = pc.split_pattern(col, "\x00")
        per_text = np.diff(np.asarray(parts.offsets))
        words = parts.flatten().dictionary_encode()
        ids, n = self._ids_of(self._known(words.dictionary.to_numpy(zero_copy_only=False))[np.asarray(words.indices)])
        ends = np.cumsum(n)
        text_ends = np.concatenate(([0], ends))[np.cumsum(per_text)]
        return ids, np.diff(np.concatenate(([0], text_ends)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row (uint32) and the number of ids of each text; null counts as empty."""
        texts = [t or "" for t in texts]
        counts = np.zeros(len(texts), dtype=np.int64)
        pieces: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= self._chunk):
                chars += len(texts[end])
                end += 1
            part = texts[at:end]
            odd = [i for i, t in enumerate(part) if not t or _irregular(t) or any(a in t for a in self._added)]
            odd_set = set(odd)
            plain = [i for i in range(len(part)) if i not in odd_set]
            flat, n = self._regular([part[i] for i in plain]) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
            if odd:
                rows: list[np.ndarray] = [None] * len(part)  # type: ignore[list-item]
                for i, ids in zip(plain, np.split(flat, np.cumsum(n)[:-1]) if len(n) else [], strict=True):
                    rows[i] = ids
                for i, ids in zip(odd, self._whole([part[i] for i in odd]), strict=True):
                    rows[i] = ids
                counts[at:end] = [len(r) for r in rows]
                pieces += rows
            else:
                counts[at:end] = n
                pieces.append(flat)
            at = end
        return (np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)), counts
