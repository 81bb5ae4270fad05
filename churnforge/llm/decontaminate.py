"""Benchmark decontamination: BM25 over the test items with block-max bounds, then verification.

The items are the indexed documents and every passage of a training document is a
query. A passage is a window of twice the longest item's words, moved by
half of it, so an item's text lies whole in one passage. A score is divided by the
item's score for its own text; all items with a share of at least ``least_score``
are retrieved. As in block-max WAND, items are kept in blocks (ordered by length,
so that weights in a block are alike), each term has its largest weight per block, and a
block is scored only where the sum of these bounds over the passage's distinct terms reaches the
threshold; bounds are summed for many passages at once. A retrieved item counts as leaked where its
question (all sentences but the last) and its answer (the last) both have ``least_overlap``
of their five-word shingles in the passage.

The index of up to ``ITEMS`` items goes to every task; more are indexed in such
parts, one pass over the documents each. Number of items, mean and greatest length and the items that
hold a term are counted by Spark over all items first, so scores, passages and results are the
same in any number of parts. The driver holds one part at a time.

Defined results: null texts have no words; items without a word are never
leaked; a part of fewer than five words is one shingle; an item of one sentence
is question and answer at once; rows that share a doc_id are judged apart; equal
items are reported each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.common import ragged, slices, stored, texts_of

K1, B = 1.2, 0.75
BLOCK = 4
BLOCKS = 64  # more items make larger blocks, so the table of bounds stays this wide
CHUNK = 5_000  # passages whose bounds are summed at a time
ITEMS = 50_000
WIDTH = 5
# Runs of other characters stand between words.
BETWEEN = r"[^\pL\pM\pN_]+"


def words_of(text: str) -> list[str]:
    return pc.replace_substring_regex(pa.array([text]).cast(pa.string()), BETWEEN, " ")[0].as_py().lower().split(" ")


def clean_words(text: str) -> list[str]:
    return [w for w in words_of(text) if w]


def halves(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := clean_words(s))]
    if len(sentences) < 2:
        return (sentences or [[]])[0], (sentences or [[]])[0]
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def shingles(words: list) -> set[tuple]:
    return set(zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else {tuple(words)} if words else set()


class Totals(NamedTuple):
    """What BM25 and the passages need of all items, whatever part they are in."""
    items: int  # with a word
    mean: float  # words of an item
    longest: int


def totals_of(items: list[tuple[int, str]]) -> tuple[Totals, dict[str, int]]:
    """(totals, items that hold each word) of items that are all there are."""
    words = [w for _, t in items if t and (w := clean_words(t))]
    sizes = [len(w) for w in words]
    return Totals(len(words), sum(sizes) / max(1, len(words)), max(sizes, default=0)), Counter(w for own in words for w in set(own))


class Index:
    """BM25 weights of a part of the items, as shares of each item's own score, by term and by block."""

    def __init__(self, items: list[tuple[int, str]], totals: Totals, holds: dict[str, int]):
        kept = sorted(((i, clean_words(t), halves(t)) for i, t in items if t), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        kept = [x for x in kept if x[1]]
        self.ids = [i for i, _, _ in kept]
        self.vocabulary = sorted({w for _, words, _ in kept for w in words})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.parts = [tuple(shingles([number[w] for w in part]) for part in parts) for _, _, parts in kept]
        self.longest, n, mean = totals.longest, totals.items, totals.mean
        term, item, weight = [], [], []
        for k, (_, words, _) in enumerate(kept):
            own = {number[w]: math.log(1 + (n - holds[w] + 0.5) / (holds[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                   for w, tf in Counter(words).items()}
            total = sum(own.values())
            for t, w in own.items():
                term.append(t)
                item.append(k)
                weight.append(w / total)
        order = np.lexsort((item, term))
        self.item, self.weight = np.array(item, np.int64)[order], np.array(weight)[order]
        self.at = np.r_[0, np.cumsum(np.bincount(np.array(term, np.int64), minlength=len(number)))]
        self.block = max(BLOCK, -(-len(kept) // BLOCKS))
        self.bound = np.zeros((len(number) + 1, -(-len(kept) // self.block)), np.float32)  # the last row is for other words
        np.maximum.at(self.bound, (np.array(term, np.int64), np.array(item, np.int64) // self.block), np.array(weight, np.float32))

    def score(self, terms: np.ndarray, block: int, least: float) -> list[tuple[int, float]]:
        """Items of a block that reach ``least`` for a passage's distinct terms."""
        terms = terms[self.bound[terms, block] > 0]
        run = ragged(self.at[terms], self.at[terms + 1] - self.at[terms])
        item = self.item[run]
        own = (item >= block * self.block) & (item < (block + 1) * self.block)
        total = np.bincount(item[own] - block * self.block, self.weight[run[own]], self.block)
        return [(block * self.block + i, float(total[i])) for i in np.flatnonzero(total >= least - 1e-9).tolist()]


def term_runs(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term number of every word, len(vocabulary) for other words; words of each text)."""
    raw = pc.ascii_split_whitespace(texts)
    coded = raw.flatten().dictionary_encode()
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.replace_substring_regex(coded.dictionary, BETWEEN, " ")))
    flat = split.flatten()
    number = pc.fill_null(pc.index_in(flat, value_set=vocabulary), len(vocabulary)).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.empty(0, bool)
    ends = np.r_[0, np.cumsum(real)][np.asarray(split.offsets)]
    codes = coded.indices.to_numpy().astype(np.int64)
    start, size = ends[:-1][codes], np.diff(ends)[codes]
    return number[real][ragged(start, size)], np.diff(np.r_[0, np.cumsum(size)][np.asarray(raw.offsets)])


def leaks_of(index: Index, terms: np.ndarray, lens: np.ndarray, least_score: float, least_overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question overlap, answer overlap, first word of the passage) of every leaked item of every text."""
    span, step = 2 * index.longest, index.longest
    ends = np.cumsum(lens)
    many = np.maximum(1, -(-(lens - step) // step)) * (lens > 0)
    text = np.repeat(np.arange(len(lens)), many)
    at = (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)) * step + (ends - lens)[text]
    to = np.minimum(at + span, ends[text])
    best: dict[tuple[int, int], tuple] = {}
    size = len(index.vocabulary)
    for a in range(0, len(at), CHUNK):
        lo, hi = at[a:a + CHUNK], to[a:a + CHUNK]
        word = terms[ragged(lo, hi - lo)]
        own = np.repeat(np.arange(len(lo)), hi - lo)
        pairs = np.unique(own[word < size] * np.int64(size) + word[word < size])  # distinct terms of each passage
        if not len(pairs):
            continue
        own, term = np.divmod(pairs, size)
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        last = np.r_[first[1:], len(own)]
        which, block = np.nonzero(np.add.reduceat(index.bound[term], first) >= least_score - 1e-4)
        for k, b in zip(which.tolist(), block.tolist()):
            w = int(own[first[k]])
            found = index.score(term[first[k]:last[k]], b, least_score)
            if found:
                run = terms[lo[w]:hi[w]]
                here = shingles(run.tolist()) | {tuple(run[i:i + n].tolist()) for n in range(1, WIDTH) for i in range(len(run) - n + 1)}
                for item, score in found:
                    q, s = (len(part & here) / len(part) for part in index.parts[item])
                    if min(q, s) >= least_overlap - 1e-9:
                        key = int(text[a + w]), item
                        best[key] = max(best.get(key, ()), (score, q, s, -int(lo[w] - (ends - lens)[key[0]])))
    for (k, item), (score, q, s, first) in sorted(best.items()):
        yield k, item, score, q, s, -first


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The indexes of all items, at most about ``ITEMS`` in each; one stands in memory at a time."""
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [clean_words(t) for t in texts_of(part).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(w) for w in own], pa.int64()), pa.array([sorted(set(w)) for w in own], pa.list_(pa.string()))],
                    names=[*part.schema.names, "n_words", "terms"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    parts = max(1, -(-items.count() // ITEMS))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    split = stored(dealt.mapInArrow(words, "item_id long, text string, part long, n_words long, terms array<string>").where("n_words > 0"), "test-items")
    row = split.agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest")).first()
    totals = Totals(row["n"], (row["words"] or 0) / max(1, row["n"]), row["longest"] or 0)
    terms = split.select("part", F.explode("terms").alias("term")).groupBy("part", "term").agg(F.count("*").alias("n"))
    holds = stored(terms.join(terms.groupBy("term").agg(F.sum("n").alias("items")), "term").select("part", "term", "items"), "test-terms")
    for k in range(parts):
        own = split.where(F.col("part") == k).select("item_id", "text").collect()
        yield Index([(r["item_id"], r["text"]) for r in own], totals, {r["term"]: r["items"] for r in holds.where(F.col("part") == k).collect()})


def leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.6, least_overlap: float = 0.8) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, score, question_overlap, answer_overlap, first_word."""
    def search(index: Index) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = pa.array(index.vocabulary, pa.string())
            for batch in batches:
                for part in slices(batch, "text"):
                    if not index.ids:
                        continue
                    ids = part.column(0).to_pylist()
                    rows = [(ids[k], index.ids[item], *rest) for k, item, *rest in leaks_of(index, *term_runs(texts_of(part), vocabulary), least_score, least_overlap)]
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, TYPES)], names=NAMES)

        return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")

    found, before = None, None
    for index in indexes(benchmark):
        if before is not None:  # more than one part: each is written before the next is built
            found = _also(found, stored(before, "leaks"))
        before = search(index)
    return _also(found, before)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_score: float = 0.6, least_overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with all their columns.

    Every row is judged by its own text in a map-only pass, so null and shared doc_ids make no difference.
    """
    def clean(rows: DataFrame, index: Index) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = pa.array(index.vocabulary, pa.string())
            for batch in batches:
                for part in slices(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    if index.ids:
                        keep[[k for k, *_ in leaks_of(index, *term_runs(texts_of(part), vocabulary), least_score, least_overlap)]] = False
                    yield part.filter(pa.array(keep))

        return rows.mapInArrow(each, rows.schema)

    before = None
    for index in indexes(benchmark):
        docs = clean(docs if before is None else stored(before, "clean-of-part"), index)
        before = docs
    return docs


def _also(found: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if found is None else found.unionByName(more)


NAMES = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"]
TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
