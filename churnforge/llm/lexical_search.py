"""Ranked lexical search by the Best Position Algorithm over impact lists.

A term's impact list holds the documents with the term, largest impact first (equal impacts by place). Lists are
read in parallel. A document that is met is looked up in all other lists of the query: its whole score
is known at once, and so are its positions there. A list's best position is the end of its run of seen positions
from the top, seen by reading or by look-up. No document that is still unseen can score more than the sum of the impacts just
behind the best positions; this bound is tighter than that of the last positions read. A search stops when
it is strictly below the k-th score found, so that ties are decided by the smaller doc_id.

One pass over the documents counts their terms and keeps, for each document, those that a query asks for. The statistics (documents,
terms, documents with a term) are sums over all of them. Each task builds impact lists of shards of at most ``SHARD_POSTINGS``
postings and searches all queries in each; the k-th score of earlier shards of the task starts the next search. What a shard finds, at most k
rows a query, is merged by a ranking in Spark.

The terms of at most about ``QUERY_BYTES`` of query text, with their weights, go to every task; more text is searched in such
parts, one pass over the documents each. Every score depends on the document, the query and whole-table statistics alone.

Defined results: null texts have no terms, and a query without terms has no rows; terms that all documents hold weigh
nothing; rows that share a doc_id are documents of their own and may stand in one ranking; a null doc_id comes behind the others
of its score; equal query rows are one query, different texts of one item_id are ranked apart; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from churnforge.llm.common import slices, stored, texts_of

QUERY_BYTES = 4 << 20
SHARD_POSTINGS = 1_000_000
READ = 32  # rows read of each list between two looks at the bound, doubled while a search goes on
NO_ID = np.iinfo(np.int64).max

# Bytes of terms: digits, Latin letters (A-Z in lower case) and all bytes of other characters; a space between terms.
FOLD = np.full(256, ord(" "), np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    FOLD[_b] = _b
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def terms_of(texts: pa.Array) -> pa.ListArray:
    """The terms of every text, in order."""
    texts = texts.cast(pa.large_string())
    ends, data = texts.buffers()[1], texts.buffers()[2]
    folded = FOLD[np.frombuffer(data, np.uint8)].tobytes() if data is not None else b""
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), ends, pa.py_buffer(folded), None, 0, texts.offset))


def query_terms(text: str) -> Counter:
    return Counter(t for t in terms_of(pa.array([text]))[0].as_py() if t)


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (all terms), and number and occurrences of each term of ``vocabulary`` in every document with a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for part in slices(batch, "text"):
                lists = terms_of(texts_of(part))
                flat, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
                ends = ends - ends[0]
                # the parts before the first and behind the last space are empty strings where a text begins or ends with one
                coded = flat.dictionary_encode()
                real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
                number = pc.fill_null(pc.index_in(coded.dictionary, value_set=wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = coded.indices.to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(part.columns[0])), np.diff(ends))
                n = np.bincount(owner, weights=real[codes] if len(codes) else None, minlength=part.num_rows).astype(np.int64)
                hit = number[codes] >= 0 if len(codes) else np.empty(0, bool)
                pairs, tf = np.unique(owner[hit] * max(1, len(vocabulary)) + number[codes[hit]] if len(codes) else np.empty(0, np.int64), return_counts=True)
                doc, term = np.divmod(pairs, max(1, len(vocabulary)))
                own = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=part.num_rows))].astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.ListArray.from_arrays(own, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(own, pa.array(tf.astype(np.int64)))],
                    ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Impact lists of some documents: by impact for reading, by document for looking up."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        # places of documents go by (doc_id, row), so that ties by place are ties by doc_id
        rank = np.argsort(doc_ids, kind="stable")
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        self.doc_ids, doc = doc_ids[rank], place[doc]
        order = np.lexsort((doc, -impact, term))
        self.at = np.r_[0, np.cumsum(np.bincount(term, minlength=n_terms))]
        self.doc, self.impact = doc[order], impact[order]
        by_doc = np.lexsort((self.doc, term[order]))  # lists stay where they are, their rows go by document
        self.by_doc, self.position = self.doc[by_doc], by_doc

    def search(self, terms: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the best k documents that score at least ``floor`` and more than 0; rows read of all lists.

        ``terms`` are (number, times in the query).
        """
        lists = [(int(self.at[t]), int(self.at[t + 1]), times) for t, times in terms if self.at[t] < self.at[t + 1]]
        lists = [(a, b, times) for a, b, times in lists if self.impact[a] > 0]
        if not lists:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        seen = [np.zeros(b - a, bool) for a, b, _ in lists]
        best = [0] * len(lists)  # rows of the seen run from the top
        known = np.zeros(len(self.doc_ids), bool)
        places, scores, cursor, step = np.empty(0, np.int64), np.empty(0, np.int64), [0] * len(lists), READ
        while True:
            met = []
            for i, (a, b, _) in enumerate(lists):
                # rows known from look-ups need no reading: go on behind the best position
                cursor[i] = min(max(cursor[i], best[i]) + step, b - a)
                met.append(self.doc[a + best[i]:a + cursor[i]])
                seen[i][best[i]:cursor[i]] = True
            new = np.unique(np.concatenate(met))
            new = new[~known[new]]
            known[new] = True
            total = np.zeros(len(new), np.int64)
            for i, (a, b, times) in enumerate(lists):
                found = a + np.searchsorted(self.by_doc[a:b], new)
                hit = np.flatnonzero(found < b)
                hit = hit[self.by_doc[found[hit]] == new[hit]]
                row = self.position[found[hit]]
                total[hit] += times * self.impact[row]
                seen[i][row - a] = True
            bound, more = 0, False
            for i, (a, b, times) in enumerate(lists):
                rest = seen[i][best[i]:]
                best[i] += len(rest) if rest.all() else int(rest.argmin())
                if best[i] < b - a:
                    more = True
                    bound += times * int(self.impact[a + best[i]])
            places, scores = np.r_[places, new], np.r_[scores, total]
            if len(places) > k:
                top = np.lexsort((places, -scores))[:k]
                places, scores = places[top], scores[top]
            least = int(scores.min()) if len(places) == k else 0
            if not more or bound == 0 or bound < max(least, floor):
                good = (scores > 0) & (scores >= floor)
                return places[good], scores[good], sum(cursor)
            step *= 2


def _search_task(weights: np.ndarray, queries: list[list[tuple[int, int]]], documents: int, all_terms: int, k: int):
    """Search all queries in the shards of one task's documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        floors = [1] * len(queries)
        best: list[list[int]] = [[] for _ in queries]

        def flush() -> Iterator[pa.RecordBatch]:
            ids, n, counts, term, tf = (np.concatenate(c) for c in zip(*held))
            m = 75 + (25 * n * documents) // all_terms
            doc = np.repeat(np.arange(len(ids)), counts)
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            shard = Shard(ids, doc, term, impact, len(weights))
            item, place, score = [], [], []
            for q, terms in enumerate(queries):
                p, s, _ = shard.search(terms, k, floors[q])
                best[q] = sorted([*best[q], *s.tolist()], reverse=True)[:k]
                if len(best[q]) == k:
                    floors[q] = best[q][-1]
                item.append(np.full(len(p), q))
                place.append(p)
                score.append(s)
            found = shard.doc_ids[np.concatenate(place)] if place else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(item), pa.int64()), pa.array(found, pa.int64(), mask=found == NO_ID), pa.array(np.concatenate(score), pa.int64())],
                ["query", "doc_id", "score"])

        for batch in batches:
            terms, tfs = batch.column(2), batch.column(3)
            ids = pc.fill_null(batch.column(0), NO_ID).to_numpy()
            held.append((ids, batch.column(1).to_numpy(), np.diff(np.asarray(terms.offsets)).astype(np.int64),
                         terms.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
            size += len(held[-1][3])
            if size >= SHARD_POSTINGS:
                yield from flush()
                held, size = [], 0
        if held and queries:
            yield from flush()

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score for every item."""
    asked = stored(items.select("item_id", F.col("text").alias("text")).where(F.col("text").isNotNull()).distinct(), "search-items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // QUERY_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    return reduce(DataFrame.unionByName, [_search_part(docs, asked.where(part == i), k) for i in range(parts)])


def _search_part(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = [(r.item_id, query_terms(r.text)) for r in asked.collect()]  # a part of at most about QUERY_BYTES
    vocabulary = sorted({t for _, terms in rows for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    counts = stored(term_counts(docs, vocabulary), "search-terms")
    documents, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the part
        holding[r[0]] = r[1]
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    queries = [[(number[t], times) for t, times in terms.items()] for _, terms in rows]
    found = counts.mapInArrow(_search_task(weights, queries, documents, max(1, all_terms), k), "query long, doc_id long, score long")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], "query long, item_id long")
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
