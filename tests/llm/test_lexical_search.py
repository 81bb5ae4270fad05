import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from churnforge.llm import lexical_search
from churnforge.llm.lexical_search import Shard

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """The ranking by its definition: (item_id, rank, doc_id, score)."""
    bags = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        asked, scores = terms(text), []
        for place, (i, bag) in enumerate(bags):
            m = 75 + (25 * sum(bag.values()) * len(bags)) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in asked if t in bag)
            if score > 0:
                scores.append((-score, i is None, i or 0, place, i))
        out += [(item, r, s[-1], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "item_id long, text string, rank int, query int, score string")


@pytest.mark.parametrize("postings, query_bytes", [(1_000_000, 4 << 20), (200, 50_000)])
def test_against_plain_scores(spark, docs_of, items_of, odd_rows, monkeypatch, postings, query_bytes):
    """Rankings equal plain scores, in one shard and in many, with all queries at once and in parts."""
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(lexical_search, "QUERY_BYTES", query_bytes)
    rng = random.Random(1)
    words = ["été", "漢字", "Über", "a1", *["w" + "abcdefgh"[i % 8] * (i // 8 + 1) for i in range(60)]]
    heavy = [w for i, w in enumerate(words) for _ in range(1 + 60 // (i + 1))]
    docs = [(i, " ".join(rng.choice(heavy) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs += [(1000 + i, "été wa. WAA-waaa") for i in range(50)]  # a large group of equal scores
    docs += odd_rows
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(25)]
    items += [(50, None), (51, ""), (52, " .;\n"), (53, "nowhere"), (54, "ÉTÉ wa wa wa"), (54, "ÉTÉ wa wa wa"), (54, "été"), (None, "waa Waaa"), (55, docs[-1][1] + " one"), (56, docs[353][1])]
    got = lexical_search.search(docs_of(docs).repartition(3), items_of(items), k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, [x for x in items if x[1] is not None], 20)


def test_best_positions_stop_early():
    """A few documents lead all lists: the search ends without reading them whole, and finds what a full sum finds."""
    rng = np.random.default_rng(0)
    n, lists = 20_000, 3
    doc = np.tile(np.arange(n), lists)
    term = np.repeat(np.arange(lists), n)
    impact = rng.integers(1, 1000, n * lists)
    impact[doc < 30] = 5000 - doc[doc < 30]
    shard = Shard(np.arange(n), doc, term, impact, lists)
    places, scores, read = shard.search([(0, 1), (1, 2), (2, 1)], 20, 1)
    whole = impact.reshape(lists, n).T @ np.array([1, 2, 1])
    best = np.lexsort((np.arange(n), -whole))[:20]
    assert sorted(places.tolist()) == sorted(best.tolist()) and sorted(scores.tolist()) == sorted(whole[best].tolist())
    assert read < lists * n / 50


def test_ties_at_the_threshold():
    """All scores are equal: only a bound strictly below the k-th score may stop, so the smallest ids win."""
    n = 500
    ids = np.arange(n)[::-1].copy()
    shard = Shard(ids, np.arange(n), np.zeros(n, np.int64), np.full(n, 7), 1)
    places, scores, _ = shard.search([(0, 1)], 20, 1)
    assert sorted(shard.doc_ids[places].tolist()) == list(range(20)) and set(scores.tolist()) == {7}
    assert len(shard.search([(0, 1)], 20, 8)[0]) == 0 and len(shard.search([(0, 1)], 20, 7)[0]) == 20


def test_empty_tables(spark, docs_of, items_of):
    some, none = [(1, "a b")], [(1, "a")]
    assert lexical_search.search(docs_of(some).limit(0), items_of(none)).count() == 0
    assert lexical_search.search(docs_of(some), items_of(none).limit(0)).count() == 0
    # the only document holds the term: weight floor(1000 ln(4/3)) = 287
    assert [tuple(r) for r in lexical_search.search(docs_of(some), items_of(none)).collect()] == brute(some, none, 20)
