"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text, and
every window of a text is compressed with both; a window that the toxic dictionary
shortens more speaks for the label. A window is one word (lower-case, without outer
punctuation), so equal windows are compressed once per batch. A toxic document is mostly
ordinary prose, therefore its dictionary is trained on those windows that occur in more
toxic than ordinary documents of the sample (a one-sided z test). The document's
largest and summed gains are turned into a probability by a logistic calibration.

Learning uses a bounded labelled sample (``per_label`` texts of at most 64 KB each, by a
hash of doc_id); the dictionaries have a fixed size. Of equal or nearly equal texts of a class
(Jaccard similarity of five-window shingles of 0.8 or more) only the first counts for the
dictionaries; all texts of the sample are calibrated on, weighted to the shares that the classes
have among all usable labelled rows. Scoring reads whole texts.

Defined results: a null or empty text has no window and gets the calibrated
score of no gain; with no labelled row of either class every score is 0; a document
labelled twice counts twice in the sample; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from churnforge.llm.common import slices, texts_of
from churnforge.llm.lang_crf import held_out, labelled_sample, usable

ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
# A short window is written several times: a block that saves under three bytes is stored raw, and
# then all short windows would look alike. The repeats cost the same with either dictionary. A gain
# must show at each of these counts; it is the least of them.
REPEATS, SHORT, LEVEL = (4, 3, 5), 32, 6
TOP = 3  # largest gains of a text that are summed
WIDTH, ALIKE = 5, 80  # texts of the sample are copies where their sets of runs of WIDTH windows have this Jaccard similarity in percent


def windows_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct windows, their numbers in text order, windows of each text)."""
    raw = pc.ascii_split_whitespace(texts)
    coded = raw.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters="".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~")
    again = plain.dictionary_encode()
    codes = again.indices.to_numpy()[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
    return again.dictionary.to_pylist(), codes, np.diff(np.asarray(raw.offsets))


def window(word: str, repeats: int = REPEATS[0]) -> bytes:
    return (f" {word}" * (repeats if len(word) <= SHORT else 1) + " ").encode()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Train a dictionary; where there is too little text for the trainer, the distinct samples themselves serve."""
    while samples and size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(dict.fromkeys(samples))[-2048:] or b" " * 8


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = toxic, ordinary
        self.weights = np.zeros(3)
        self.centre, self.scale = np.zeros(2), np.ones(2)
        self._by_dict: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by_dict": None}  # compressors are built in each task

    def gains(self, windows: list[str]) -> np.ndarray:
        """Bytes by which the toxic dictionary shortens each window more than the ordinary one; both hold the prose part."""
        if self._by_dict is None:
            form = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._by_dict = []
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=form)
                self._by_dict.append(zstandard.ZstdCompressor(dict_data=d, compression_params=form).compress)
        ordinary, toxic = self._by_dict
        out = np.fromiter((len(ordinary(b)) - len(toxic(b)) for b in map(window, windows)), np.int64, len(windows))
        for i in np.flatnonzero(out > 0).tolist():
            out[i] = min(out[i], *(len(ordinary(b)) - len(toxic(b)) for b in (window(windows[i], n) for n in REPEATS[1:])))
        return out

    def evidence(self, gains: np.ndarray, codes: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """(largest gain, sum of the TOP largest) of every text, gains below zero as zero."""
        out = np.zeros((len(lens), 2))
        got = np.maximum(gains, 0)[codes]
        text = np.repeat(np.arange(len(lens)), lens)
        some = np.flatnonzero(got)
        order = some[np.lexsort((-got[some], text[some]))]
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        np.add.at(out[:, 1], text[order[rank < TOP]], got[order[rank < TOP]])
        out[text[order[rank == 0]], 0] = got[order[rank == 0]]
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = (evidence - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:2] + self.weights[2], -30, 30)))


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the runs of WIDTH windows; a shorter text is one run."""
    width = min(WIDTH, len(codes))
    runs = np.zeros(len(codes) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        runs = (runs + codes[k:k + len(runs)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return np.unique(runs)


def _first_of_copies(sample: list[tuple[int, str]], codes: list[np.ndarray]) -> list[int]:
    """Texts of the sample that are no copy of an earlier one of their class: not equal, and Jaccard similarity of
    their shingles below ALIKE. Similar sets share one of their rarest shingles, so only such pairs are compared."""
    first = sorted({row: i for i, row in reversed(list(enumerate(sample)))}.values())
    sets = {i: _shingles(codes[i]) for i in first}
    every, held_by = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    holders, alone = defaultdict(list), []
    for i in first:
        own = sets[i]
        n = held_by[np.searchsorted(every, own)]
        rare = np.lexsort((own, n))[:len(own) - -(-ALIKE * len(own) // 100) + 1]
        rare = own[rare[n[rare] > 1]].tolist()
        label = sample[i][0]
        near = {j for h in rare for j in holders[label, h] if 100 * min(len(own), len(sets[j])) >= ALIKE * max(len(own), len(sets[j]))}
        shared = ((len(np.intersect1d(own, sets[j], assume_unique=True)), len(sets[j])) for j in near)
        if any(100 * both >= ALIKE * (len(own) + size - both) for both, size in shared):
            continue
        alone.append(i)
        for h in rare:
            holders[label, h].append(i)
    return alone


def train(sample: list[tuple[int, str]], rows: dict[int, int] | None = None) -> Model | None:
    """Dictionaries and calibration from (label, text) rows; ``rows`` tells how many there are of each class in all."""
    label = np.array([y for y, _ in sample])
    if not (0 < label.sum() < len(label)):
        return None
    windows, codes, lens = windows_of(pa.array([t for _, t in sample]))
    seen = Counter(), Counter()
    ends = np.cumsum(lens)
    of_text = [codes[a:b] for a, b in zip(ends - lens, ends)]
    first = _first_of_copies(sample, of_text)
    for y, c in zip(label[first].tolist(), (np.unique(of_text[i]) for i in first)):
        seen[y].update(c.tolist())
    n1 = max(1, int(label[first].sum()))
    n0 = max(1, len(first) - n1)
    typical = {}
    for w, t in seen[1].items():
        share = (t + seen[0][w]) / (n0 + n1)
        z = (t / n1 - seen[0][w] / n0) / math.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
        if z > 6 and t >= max(4, 0.01 * n1):
            typical[w] = t
    common = [f" {windows[w]} ".encode() for w, t in seen[0].most_common(20_000) if w not in typical for _ in range(min(t, 20))]
    toxic = [window(windows[w], max(REPEATS) + 1) for w, t in sorted(typical.items(), key=lambda x: (x[1], x[0])) for _ in range(t)]
    prose = _dictionary(common, ORDINARY_BYTES)
    trained = _dictionary(toxic, TOXIC_BYTES)
    left_out = b"".join(dict.fromkeys(w for w in toxic if w not in trained))  # the commonest last, where they cost least
    model = Model(prose + (trained + left_out)[-2 * TOXIC_BYTES:], prose)
    found = model.evidence(model.gains(windows), codes, lens)
    sampled = np.bincount(label, minlength=2)
    weight = (np.array([rows[0], rows[1]]) / sampled if rows else np.ones(2))[label]
    weight *= len(label) / weight.sum()  # the classes weigh as in all rows, whether the sample was cut or not
    model.centre = np.average(found, axis=0, weights=weight)
    model.scale = np.sqrt(np.average((found - model.centre) ** 2, axis=0, weights=weight)) + 1e-9
    x = np.c_[(found - model.centre) / model.scale, np.ones(len(found))]
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        ridge = np.diag([1.0, 1.0, 1e-6])
        model.weights += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ model.weights)
    model._by_dict = None
    return model


def predict(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = np.zeros(part.num_rows)
                if model:
                    windows, codes, lens = windows_of(texts_of(part))
                    s = model.score(model.evidence(model.gains(windows), codes, lens))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, per_label: int = 2000, threshold: float = 0.3) -> DataFrame:
    """Train on a bounded labelled sample and score every whole text."""
    known = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    joined = docs.select("doc_id", "text").join(known, "doc_id")
    rows = {r.toxic: r.n for r in usable(joined, "toxic").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return predict(docs, train(labelled_sample(joined, "toxic", per_label), rows), threshold)
