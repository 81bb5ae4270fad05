"""Language identification with a linear-chain conditional random field.

Every word is a position of the chain and its language the label. A word's
score is the mean weight of its byte n-grams with word boundaries (those at
a boundary are its affixes) plus a lexicon weight of the whole word; transitions
between neighbouring words are learned with them. Forward-backward gives each
word its label probabilities, so code-switched text is labelled word by word; a
document's language is the one with the largest mean probability.

Training uses a bounded sample of labelled rows (``per_language`` texts of at most
``SAMPLE_BYTES``, chosen by a hash of doc_id). Of each text at most ``pieces`` runs of 3 to ``STRIDE`` words, at seeded
places all over it, are joined with those of other languages to sequences, so switches are seen. The gradient of the
transitions is that of the likelihood: pair probabilities come from the forward and backward messages. The model is a table of fixed size
and goes to the tasks inside the function. Scoring reads whole texts; long ones are cut into
blocks whose transfer matrices are multiplied through, which is exact.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with
no labelled row everything is ``und``; ties go to the language first in order;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from churnforge.llm.common import ragged, slices, texts_of

ORDERS = (2, 3, 4)
BUCKETS = 1 << 16
BLOCK = 64
STRIDE = 24  # a text is cut into stretches of so many words; a piece is a run at the head of one
SAMPLE_BYTES = 65_536
UNKNOWN = "und"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct lower-case words, their numbers in text order, words of each text); only words with letters."""
    raw = pc.ascii_split_whitespace(texts)
    coded = raw.flatten().dictionary_encode()
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\pL\pM]+", " "))
    clean = pc.if_else(pc.match_substring_regex(clean, r"\pL"), clean, "")
    again = clean.dictionary_encode()
    codes = again.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    real = pc.not_equal(again.dictionary, "").to_numpy(zero_copy_only=False) if len(again) else np.empty(0, bool)
    kept = real[codes]
    ends = np.r_[0, np.cumsum(kept)][np.asarray(raw.offsets)]
    return again.dictionary, codes[kept], np.diff(ends)


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed n-gram features of all words, number per word, lexicon feature per word)."""
    text = pc.binary_join_element_wise("", words, "", " ").cast(pa.large_binary()) if len(words) else pa.array([], pa.large_binary())
    ends = np.asarray(pa.Array.from_buffers(pa.int64(), len(text) + 1, [None, text.buffers()[1]])) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8)[:ends[-1]].astype(np.uint64) if len(words) else np.empty(0, np.uint64)
    start, length = ends[:-1], np.diff(ends)
    found, of = [], []
    rolled = data + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + data[n - 1:] + np.uint64(1) if len(rolled) else rolled
        if n in ORDERS:
            many = np.maximum(length - n + 1, 0)
            h = rolled[ragged(start, many)] * np.uint64(0x9E3779B97F4A7C15)
            found.append((h >> np.uint64(48)).astype(np.int64) + BUCKETS * ORDERS.index(n))
            of.append(np.repeat(np.arange(len(words)), many))
    each = np.concatenate(of) if of else np.empty(0, np.int64)
    by_word = np.argsort(each, kind="stable")
    # whole word: a polynomial over its bytes
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(length.max()) if len(length) else 0, 1_000_003, np.uint64)])
    inside = np.arange(len(data)) - np.repeat(start, length)
    whole = np.add.reduceat((data + np.uint64(1)) * power[inside], start) if len(words) else np.empty(0, np.uint64)
    lexicon = ((whole * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)
    return np.concatenate(found)[by_word] if len(each) else each, np.bincount(each, minlength=len(words)), lexicon


class Model:
    """Weights of n-grams, words and transitions for the labels in ``languages``."""

    def __init__(self, languages: list[str]):
        k = len(languages)
        self.languages = languages
        self.gram = np.zeros((BUCKETS * len(ORDERS), k), np.float32)
        self.word = np.zeros((BUCKETS, k), np.float32)
        self.move = np.zeros((k, k), np.float32)

    def emissions(self, feats: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Scores of every distinct word for every label."""
        grams, n, lexicon = feats
        out = self.word[lexicon].astype(np.float64)
        has = np.flatnonzero(n)
        if len(has):
            out[has] += np.add.reduceat(self.gram[grams], (np.cumsum(n) - n)[has]) / n[has, None]
        return out

    def messages(self, emissions: np.ndarray, codes: np.ndarray, lens: np.ndarray, joined: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(forward, backward) message of every word, each up to a factor, text after text (exact over block borders).

        With ``joined`` both are one array that holds their products, which saves half of the memory.
        """
        k, n = len(self.languages), len(codes)
        blocks = -(-lens // BLOCK)
        total = int(blocks.sum())
        first = np.cumsum(blocks) - blocks
        rank = np.arange(total) - np.repeat(first, blocks)
        start = np.repeat(np.cumsum(lens) - lens, blocks) + rank * BLOCK
        size = np.minimum(np.repeat(lens, blocks) - rank * BLOCK, BLOCK)
        e = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else emissions
        a = np.exp(self.move.astype(np.float64))
        most = int(size.max()) if total else 0
        steps = [np.flatnonzero(size > t) for t in range(most)]
        transfer = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t, live in enumerate(steps):
            m = (transfer[live].reshape(-1, k) @ a).reshape(-1, k, k) * e[codes[start[live] + t]][:, None, :]
            transfer[live] = m / m.sum((1, 2), keepdims=True)
        ahead, behind = np.full((total, k), 1 / k), np.ones((total, k))
        for r in range(1, int(blocks.max()) if total else 0):
            at = np.flatnonzero(blocks > r)
            here = first[at] + r
            v = np.einsum("bi,bij->bj", ahead[here - 1], transfer[here - 1])
            ahead[here] = v / v.sum(1, keepdims=True)
            here = first[at] + blocks[at] - 1 - r
            v = np.einsum("bij,bj->bi", transfer[here + 1], behind[here + 1])
            behind[here] = v / v.sum(1, keepdims=True)
        forward = np.empty((n, k))
        backward = forward if joined else np.empty((n, k))
        for t, live in enumerate(steps):
            v = (ahead[live] @ a) * e[codes[start[live] + t]]
            ahead[live] = v = v / v.sum(1, keepdims=True)
            forward[start[live] + t] = v
        for t in range(most - 1, -1, -1):
            live = steps[t]
            at = start[live] + t
            backward[at] = forward[at] * behind[live] if joined else behind[live]
            v = (e[codes[start[live] + t]] * behind[live]) @ a.T
            behind[live] = v / v.sum(1, keepdims=True)
        return forward, backward

    def marginals(self, emissions: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Label probabilities of every word."""
        out, _ = self.messages(emissions, codes, lens, joined=True)
        out /= np.maximum(out.sum(1, keepdims=True), 1e-300)
        return out

    def gradient(self, emissions: np.ndarray, codes: np.ndarray, lens: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the labels' log-likelihood: by the emission of every word, and by the transitions."""
        k = len(self.languages)
        forward, backward = self.messages(emissions, codes, lens)
        p = forward * backward
        by_word = np.eye(k)[gold] - p / np.maximum(p.sum(1, keepdims=True), 1e-300)
        a = np.exp(self.move.astype(np.float64))
        first = (np.cumsum(lens) - lens)[lens > 0]
        later = np.ones(len(codes), bool)
        later[first] = False
        later = np.flatnonzero(later)
        e = np.exp(emissions - emissions.max(1, keepdims=True)) if len(emissions) else emissions
        ahead, behind = forward[later - 1], e[codes[later]] * backward[later]
        # a pair has the share ahead(i) a(i, j) behind(j) / ahead a behind
        total = np.maximum(np.einsum("ni,ij,nj->n", ahead, a, behind, optimize=True), 1e-300)
        expected = a * ((ahead / total[:, None]).T @ behind)
        seen = np.bincount(gold[later - 1] * k + gold[later], minlength=k * k).reshape(k, k)
        # before the first word stands a uniform state
        return by_word, seen - expected + a / a.sum(0) * by_word[first].sum(0)


def held_out(doc_id: Column | str) -> Column:
    """The quarter of documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def usable(docs: DataFrame, label: str) -> DataFrame:
    """The labelled rows that a model may learn from."""
    return docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id") & (F.octet_length("text") <= SAMPLE_BYTES))


def labelled_sample(docs: DataFrame, label: str, per_label: int) -> list[tuple[str, str]]:
    """At most ``per_label`` (label, text) rows of each label that are not held out."""
    docs = usable(docs, label)
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.select("doc_id", label).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label)
    ids = [r.doc_id for r in chosen.select("doc_id").collect()]  # per_label for each label at most
    rows = docs.where(F.col("doc_id").isin(ids)).select(label, "text").collect() if ids else []
    return sorted((r[label], r["text"]) for r in rows)


def train(sample: list[tuple[str, str]], rounds: int = 30, words: int = 128, rate: float = 0.5, pieces_of_text: int = 12) -> Model | None:
    """Fit the field by Adagrad on sequences of pieces of the sampled texts: from each ``pieces_of_text`` at most, at seeded places all over it."""
    languages = sorted({label for label, _ in sample})
    if not languages:
        return None
    model, k = Model(languages), len(languages)
    rng = np.random.default_rng(0)
    distinct, codes, lens = words_of(pa.array([t for _, t in sample]))
    starts = np.cumsum(lens) - lens
    pieces = []
    for i, (label, _) in enumerate(sample):
        stretches = -(-int(lens[i]) // STRIDE)
        for at in STRIDE * np.sort(rng.choice(stretches, min(stretches, pieces_of_text), replace=False)):
            n = int(rng.integers(3, STRIDE + 1))
            own = codes[starts[i] + at:min(starts[i] + at + n, starts[i] + lens[i])]
            pieces.append((own, np.full(len(own), languages.index(label))))
    order = rng.permutation(len(pieces))
    if not len(order):
        return None
    seq, gold = (np.concatenate([pieces[i][j] for i in order]) for j in (0, 1))
    lens = np.full(-(-len(seq) // words), words)
    lens[-1] = len(seq) - words * (len(lens) - 1)
    feats = features(distinct)
    grams, n, lexicon = feats
    per_gram = np.repeat(np.arange(len(n)), n)
    share = np.bincount(gold, minlength=k)
    weight = (len(gold) / (k * np.maximum(share, 1)))[gold]
    squares = [np.full_like(w, 1e-6) for w in (model.gram, model.word, model.move)]
    for _ in range(rounds):
        by_place, moves = model.gradient(model.emissions(feats), seq, lens, gold)
        diff = by_place * weight[:, None]
        by_word = np.stack([np.bincount(seq, diff[:, j], len(distinct)) for j in range(k)], 1) / len(seq)
        gradients = [np.stack([np.bincount(grams, (by_word[:, j] / np.maximum(n, 1))[per_gram], len(model.gram)) for j in range(k)], 1),
                     np.stack([np.bincount(lexicon, by_word[:, j], BUCKETS) for j in range(k)], 1),
                     moves / len(seq)]
        for w, s, g in zip((model.gram, model.word, model.move), squares, gradients):
            s += g * g
            w += rate * g / np.sqrt(s) - 1e-4 * w
    return model


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words, shares (by language), and the columns in ``keep``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", (2 << 20) * 16 // max(4, len(model.languages) if model else 0) ** 2 + 1):
                rows = part.num_rows
                pred, best, n_words, shares = np.full(rows, -1), np.zeros(rows), np.zeros(rows, np.int64), [None] * rows
                if model:
                    distinct, codes, n_words = words_of(texts_of(part))
                    p = model.marginals(model.emissions(features(distinct)), codes, n_words)
                    has = np.flatnonzero(n_words)
                    if len(has):
                        mean = np.add.reduceat(p, (np.cumsum(n_words) - n_words)[has]) / n_words[has, None]
                        pred[has], best[has] = mean.argmax(1), np.clip(mean.max(1), 0, 1)
                        for i, m in zip(has.tolist(), mean.tolist()):
                            shares[i] = m
                names = pa.array([*(model.languages if model else []), UNKNOWN])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, names.take(pa.array(pred % len(names))), pa.array(best), pa.array(n_words, pa.int64()), pa.array(shares, pa.list_(pa.float64()))],
                    names=[*part.schema.names, "lang_pred", "score", "n_words", "shares"])

    own = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", lang_pred string, score double, n_words long, shares array<double>"
    scored = own.mapInArrow(score, schema).withColumn("held_out", held_out("doc_id"))
    return scored if "text" in keep else scored.drop("text")


def identify(docs: DataFrame, per_language: int = 120, keep: tuple[str, ...] = ()) -> DataFrame:
    """Train on a bounded labelled sample of ``docs`` (text, lang) and predict every whole text."""
    return predict(docs, train(labelled_sample(docs, "lang", per_language)), keep)
