"""Whole texts to token ids with a ``tokenizers`` file, each distinct word encoded once.

The tokenizer splits at white space before it merges, so the ids of a text are
the ids of its words in order. A batch is split at ASCII white space by Arrow,
its distinct words are found by Arrow, and only those go to the library. Words
of plain Latin letters, digits and signs are cut into pieces first and the
pieces are cached; all other words, and those that may hold a special token,
go through the unchanged tokenizer whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from churnforge.llm.common import ragged

# Words of printable characters for which lower-casing and splitting agree in Arrow and in the library;
# an apostrophe may start a contraction and "<|" a special token, so words with either are not plain.
PLAIN = r"^[!-&(-;=-~¡-įı-ɏ]*$"
# The tokenizer makes each number and each run of signs a piece of its own.
SIGNS = r"(\pN)|([^\pL\pN]+)"
MOST_CACHED = 250_000


class Encoder:
    """Encodes batches of texts; keeps at most ``MOST_CACHED`` pieces (plus one batch's) between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.lean = Tokenizer.from_file(path)
        self.lean.normalizer = normalizers.Sequence([])
        self.lean.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.size = [np.empty(0, np.int32)], [np.empty(0, np.int64)]

    def _store(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all cached pieces, number of ids of each)."""
        if len(self.flat) > 1:
            self.flat, self.size = [np.concatenate(self.flat)], [np.concatenate(self.size)]
        return self.flat[0], self.size[0]

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of lower-case pieces; the library sees only those not in the cache."""
        if len(self.row) > MOST_CACHED:
            self._clear()
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.row]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        for a in range(0, len(new), 20_000):
            ids, n = self._new_pieces(new[a:a + 20_000])
            self.flat.append(ids)
            self.size.append(n)
        flat, size = self._store()
        at = np.array([self.row[p] for p in distinct], dtype=np.int64)[coded.indices.to_numpy()]
        return flat[ragged((np.cumsum(size) - size)[at], size[at])], size[at]

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct pieces."""
        e = self.lean.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        return np.array(e.ids, dtype=np.int32), np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(pieces))

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of plain words without apostrophes."""
        apart = pc.replace_substring_regex(pc.utf8_lower(words), SIGNS, r" \1\2 ")
        pieces = pc.ascii_split_whitespace(apart)
        ids, n = self._pieces(pieces.flatten())
        ends = np.r_[0, np.cumsum(n)][np.asarray(pieces.offsets)]
        return ids, np.diff(ends)

    def _odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words that go whole through the unchanged tokenizer."""
        ids = [e.ids for a in range(0, len(words), 20_000)
               for e in self.full.encode_batch_fast(words[a:a + 20_000], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        words = pc.ascii_split_whitespace(texts)
        per_text = np.diff(np.asarray(words.offsets))
        coded = words.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(distinct, PLAIN)
        some, n_some = self._plain(distinct.filter(plain))
        rest, n_rest = self._odd(distinct.filter(pc.invert(plain)).to_pylist())
        mask = plain.to_numpy(zero_copy_only=False)
        flat = np.concatenate([some, rest])
        size, start = np.empty(len(mask), np.int64), np.empty(len(mask), np.int64)
        size[mask], size[~mask] = n_some, n_rest
        start[mask], start[~mask] = np.cumsum(n_some) - n_some, len(some) + np.cumsum(n_rest) - n_rest
        ids = flat[ragged(start[codes], size[codes])]
        ends = np.r_[0, np.cumsum(size[codes])][np.r_[0, np.cumsum(per_text)]]
        return ids, np.diff(ends)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker for one tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def word_bpe() -> str:
    """Place of the public word tokenizer; the library that holds it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
