"""BPE by a tokenization automaton: merges compiled gadget by gadget, encoding by transitions, decoding by labels.

The automaton reads tokens and accepts exactly the sequences that BPE makes. It
begins as one state with a loop for every base symbol. The merges are applied
in their order, each by one gadget for ``u v -> uv``: the state ``q`` behind
``u`` is copied without its arc ``v``, all arcs ``u`` go to the copy, and every
state that has an arc ``u`` gets an arc ``uv`` to where ``v`` led. All arcs of
one token lead to one state, so a state is named by the token before it, and
each gadget is one entry (u, v) -> time. A whole table of states and tokens
would hold 7e8 arcs; an arc is instead looked up in the table of gadgets: state
``x`` lacks arc ``y`` if a gadget (x, y) took it, and otherwise has it if the
state it was copied from has what ``y`` was made of at that time.

Every prefix of a word has exactly one accepted path, so encoding goes from
left to right with one state per place: of the tokens that a trie of arc labels
finds at a place, the arcs that exist give the states of later places.

Results on odd rows: a null or empty text has no ids and decodes to the empty
string; a long word takes time in proportion to its length; rows are
independent, so repeated rows, ties and null ids simply stay; an empty table
gives an empty table; columns of the input other than ``keep`` are not looked
at, so their names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from churnforge.llm.common import give_back, ragged, slices, texts_of
from churnforge.llm.tokens import Encoder

# Words of more symbols are walked one by one instead of side by side.
LONG_WORD = 400
# Words are encoded side by side in groups of about so many symbols.
SIDE_BY_SIDE = 400_000
FINAL = 256  # a symbol that ends its word is its byte plus this
START = -1
NEVER = np.iinfo(np.int32).max


class Table:
    """Integer pairs to integers in an open-addressed table; lookups of whole arrays."""

    def __init__(self, first: np.ndarray, second: np.ndarray, value: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(value)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NEVER, np.int32)
        todo, keys = np.arange(len(value)), self._key(first, second)
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several keys one stays in the slot
            done = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[done]]] = value[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (np.asarray(first, np.int64) << 32) | np.asarray(second, np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The value of every pair, ``NEVER`` where there is none."""
        keys = self._key(first, second)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NEVER)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The compiled automaton of one vocabulary and its merges."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>", special: dict[str, int] | None = None):
        self.end, size = end, max([*vocab.values(), *(special or {}).values()], default=-1) + 1
        self.labels = np.full(size, "", object)
        for token, i in [*vocab.items(), *(special or {}).items()]:
            self.labels[i] = token
        self.made = np.zeros(size, np.int32)  # the merge that made a token, 0 for base symbols
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        self.gadget: dict[tuple[int, int], int] = {}
        # symbols of each token, from the base symbols upwards
        spelled: dict[int, tuple[int, ...]] = {}
        for byte, letter in enumerate(byte_letters()):
            for symbol, token in ((byte, letter), (byte + FINAL, letter + end)):
                if token in vocab:
                    spelled.setdefault(vocab[token], (symbol,) if end else (byte,))
        for time, (u, v) in enumerate(merges, 1):
            self._gadget(vocab[u], vocab[v], vocab[u + v], time, spelled)
        pairs = np.array([(u, v, k) for (u, v), k in self.gadget.items()], np.int64).reshape(-1, 3)
        self.table = Table(pairs[:, 0], pairs[:, 1], pairs[:, 2])
        self._trie(spelled)

    def _gadget(self, u: int, v: int, uv: int, time: int, spelled: dict[int, tuple[int, ...]]) -> None:
        """Apply one merge. Where the state behind ``u`` has no arc ``v``, the merge never happens."""
        if not (u in spelled or self.made[u]) or not (v in spelled or self.made[v]) or uv in spelled or self.made[uv]:
            raise ValueError("merges must build each token once and from tokens made before")
        self.made[uv] = time
        if u in spelled and v in spelled and self.has_arc(u, v):
            self.gadget[u, v] = time
            self.left[uv], self.right[uv] = u, v
            spelled[uv] = spelled[u] + spelled[v]

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state behind one token has an arc of another; one pair at a time."""
        if state == START:
            return True
        before = NEVER
        while True:
            if self.gadget.get((state, token), NEVER) < before:
                return False
            if self.made[token] > self.made[state]:
                # the arc was added with its merge, from the arc of its left part
                before, token = min(before, int(self.made[token]) + 1), int(self.left[token])
            elif self.made[state]:
                # the state was, until its merge, the one behind its right part
                before, state = int(self.made[state]), int(self.right[state])
            else:
                return True

    def has_arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``has_arc`` for whole arrays."""
        ok = np.ones(len(state), bool)
        at = np.flatnonzero(state != START)
        x, y = state[at], token[at]
        before = np.full(len(at), NEVER, np.int64)
        while len(at):
            gone = self.table.get(x, y) < before
            ok[at[gone]] = False
            made_x, made_y = self.made[x], self.made[y]
            stay = ~gone & ((made_x > 0) | (made_y > 0))
            at, x, y, made_x, made_y = at[stay], x[stay], y[stay], made_x[stay], made_y[stay]
            by_token = made_y > made_x
            before = np.minimum(before[stay], np.where(by_token, made_y.astype(np.int64) + 1, made_x))
            x, y = np.where(by_token, x, self.right[x]), np.where(by_token, self.left[y], y)
        return ok

    def _trie(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """Trie of the symbols of all tokens; node 0 is the root."""
        self.child: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for token, symbols in spelled.items():
            node = 0
            for s in symbols:
                node = self.child.setdefault((node, s), len(self.child) + 1)
            ends[node] = token
        self.token_at = np.full(len(self.child) + 1, -1, np.int32)
        for node, token in ends.items():
            self.token_at[node] = token
        arcs = np.array([(a, s, b) for (a, s), b in self.child.items()], np.int64).reshape(-1, 3)
        self.steps = Table(arcs[:, 0], arcs[:, 1], arcs[:, 2])

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, length of each)."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        if self.end and len(flat):
            flat[np.cumsum(size)[size > 0] - 1] += FINAL
        return flat, size

    def encode_word(self, symbols: list[int]) -> list[int]:
        """Ids of one word, place by place."""
        n = len(symbols)
        last, back = [START] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, j = 0, i
            while j < n and (node := self.child.get((node, symbols[j]), -1)) >= 0:
                j += 1
                token = int(self.token_at[node])
                if token >= 0 and self.has_arc(last[i], token):
                    last[j], back[j] = token, i
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each)."""
        ids, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        size = np.array([len(w) for w in words], np.int64)
        group = np.cumsum(size) // SIDE_BY_SIDE
        for a, b in zip(*_runs(group)):
            part = words[a:b]
            short = size[a:b] <= LONG_WORD
            some, n_some = self._side_by_side(*self.symbols([w for w, s in zip(part, short) if s]))
            n = np.zeros(b - a, np.int64)
            n[short] = n_some
            if not short.all():
                long = {i: self.encode_word(self.symbols([part[i]])[0].tolist()) for i in np.flatnonzero(~short).tolist()}
                n[list(long)] = [len(x) for x in long.values()]
                ends = np.cumsum(n)
                merged = np.empty(int(n.sum()), np.int32)
                merged[np.repeat(short, n)] = some
                for i, x in long.items():
                    merged[ends[i] - n[i]:ends[i]] = x
                some = merged
            ids.append(some)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def _side_by_side(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Walk all words at once, one place after the other.

        Places are numbered over all words, with one more at the end of each word.
        """
        word = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        offset = np.arange(len(flat)) - first[word]
        stop = (first + size)[word]
        # every token that begins at a place
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0
        while len(at):
            node = self.steps.get(node, flat[at + depth])
            hit = node != NEVER
            at, node, depth = at[hit], node[hit].astype(np.int64), depth + 1
            token = self.token_at[node]
            some = token >= 0
            found.append((at[some], np.full(int(some.sum()), depth, np.int64), token[some]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        begin, length, token = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        order = np.argsort(offset[begin], kind="stable")
        begin, length, token = begin[order], length[order], token[order]
        bounds = np.searchsorted(offset[begin], np.arange(int(size.max(initial=0)) + 1))
        last = np.full(len(flat) + len(size), START, np.int32)
        back = np.zeros(len(flat) + len(size), np.int64)
        here = begin + word[begin]
        for a, b in zip(bounds[:-1], bounds[1:]):
            ok = self.has_arcs(last[here[a:b]], token[a:b])
            to = here[a:b][ok] + length[a:b][ok]
            last[to], back[to] = token[a:b][ok], here[a:b][ok]
        # the places on each word's path, from its end to its beginning
        on_path = np.zeros(len(last), bool)
        begins = first + np.arange(len(size))
        cur, begins = (begins + size)[size > 0], begins[size > 0]
        while len(cur):
            on_path[cur] = True
            cur = back[cur]
            cur, begins = cur[cur > begins], begins[cur > begins]
        places = np.flatnonzero(on_path)
        of_word = np.repeat(np.arange(len(size)), size + 1)[places]
        return last[places], np.bincount(of_word, minlength=len(size)).astype(np.int64)


def _runs(group: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(np.diff(group)) + 1).tolist()
    return ([0, *cuts], [*cuts, len(group)]) if len(group) else ([], [])


class AutomatonEncoder(Encoder):
    """Splits texts like the library's tokenizer; all ids come from the automaton."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model.get("end_of_word_suffix") or "", self.special)
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}

    def _new_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.automaton.encode_words([p.encode() for p in pieces])

    def _odd(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that hold a special token, or that Arrow and the library may lower-case or split in different ways."""
        pieces: list[bytes] = []
        owner: list[int] = []
        marked: list[tuple[int, int]] = []  # (place among the pieces, id) of special tokens
        for k, w in enumerate(words):
            ends = 0
            for m in [*self.marks.finditer(w), None]:
                part = w[ends:m.start() if m else len(w)]
                if part:
                    for letters, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(part)):
                        pieces.append(bytes(self.byte_of[c] for c in letters))
                        owner.append(k)
                if m:
                    marked.append((len(pieces), self.special[m.group()]))
                    pieces.append(b"")
                    owner.append(k)
                    ends = m.end()
        ids, n = self.automaton.encode_words(pieces)
        if marked:
            at = np.array([p for p, _ in marked])
            ids = np.insert(ids, (np.cumsum(n) - n)[at], [i for _, i in marked])
            n[at] = 1
        return ids, np.bincount(np.array(owner, np.int64), weights=n, minlength=len(words)).astype(np.int64)


_encoders: dict[str, AutomatonEncoder] = {}


def encoder(path: str) -> AutomatonEncoder:
    """The compiled automaton of this Python worker for one tokenizer file."""
    if path not in _encoders:
        _encoders[path] = AutomatonEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids``: the token ids of every whole text as little-endian unsigned 32-bit integers."""
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, n = encoder(path).encode(texts_of(part))
                ends = np.r_[0, np.cumsum(n) * 4]
                flat = pa.py_buffer(ids.astype("<u4").tobytes())
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), flat])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column.cast(pa.binary())], [*part.schema.names[:-1], "ids"])

    return chosen.mapInArrow(run, schema).toDF(*keep, "ids")


def decode(coded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` and ``decoded``: the labels of all arcs, joined as the tokenizer file's decoder does."""
    chosen = coded.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("ids").alias("ids"))
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file without a decoder: labels with a space between
        own = encoder(path)
        if own.full.decoder is not None:
            raise ValueError("only tokenizer files without a decoder of their own are known")
        labels = [f"{label} ".encode() for label in own.automaton.labels]
        size = np.array([len(x) for x in labels], np.int64)
        flat, start = np.frombuffer(b"".join(labels), np.uint8), np.cumsum(size) - size
        for batch in batches:
            for part in slices(batch, "ids"):
                column = part.column(part.num_columns - 1).fill_null(b"").cast(pa.large_binary())
                ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
                data = column.buffers()[2]
                ids = np.frombuffer(data, "<u4", (ends[-1] - ends[0]) // 4, ends[0]).astype(np.int64) if data is not None else np.empty(0, np.int64)
                text = flat[ragged(start[ids], size[ids])]
                n = np.diff(ends) // 4
                out = np.r_[0, np.cumsum(size[ids])][np.r_[0, np.cumsum(n)]]
                # the space behind the last label of each text goes
                stay = np.ones(len(text), bool)
                stay[out[1:][n > 0] - 1] = False
                out = out - np.r_[0, np.cumsum(n > 0)]
                strings = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(out.astype(np.int64)), pa.py_buffer(text[stay].tobytes()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], strings.cast(pa.string())], [*part.schema.names[:-1], "decoded"])
        give_back()

    return chosen.mapInArrow(run, schema).toDF(*keep, "decoded")
