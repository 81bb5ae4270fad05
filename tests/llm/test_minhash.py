import random
import re

import numpy as np

from churnforge.llm import minhash
from churnforge.llm.components import components


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) if x]
        sets.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sets, {i: find(i) for i in ids}


def near_rows(seed, n=150):
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows


def test_matches_brute_force(spark, docs_of, odd_rows):
    for rows in (near_rows(1), [r for r in near_rows(2)[20:] + odd_rows]):
        sets, want = brute(rows, 4, 80)
        got = minhash.near_duplicates(docs_of(rows).repartition(5), width=4, percent=80).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
            assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_clusters_cut_into_parts(spark, docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 700)
    rows = near_rows(4, 80)
    got = minhash.near_duplicates(docs_of(rows), width=4, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 4, 80)[1]


def test_groups_inside_a_cluster():
    rng = np.random.default_rng(5)
    for _ in range(40):
        core = rng.integers(0, 1 << 60, 30)
        sets = [np.unique(np.r_[rng.choice(core, rng.integers(20, 30), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 8))]).astype(np.uint64) for _ in range(25)]
        got = {i: i for i in range(25)} | dict(minhash.linked(np.arange(25), sets, 80))
        root = list(range(25))
        for _ in range(25):
            for a in range(25):
                for b in range(25):
                    n = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        root[a] = root[b] = min(root[a], root[b])
        assert [got[i] for i in range(25)] == root


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.r_[a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)]
    s = minhash.signatures([np.sort(a), np.sort(b)], 1000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.06


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 140), (140, 120), (7, 7)] + [(200, 200 + k) for k in range(1, 60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {140: 100, 120: 100} | {200 + k: 200 for k in range(1, 60)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_empty_table(spark, docs_of):
    assert minhash.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0


def test_both_texts_of_a_shared_doc_id_keep_their_links(spark, docs_of):
    rng = random.Random(8)
    one, two = ([f"w{rng.randrange(10 ** 6)}" for _ in range(80)] for _ in range(2))
    rows = [(6, " ".join(one)), (6, " ".join(two)), (20, " ".join(one + ["x"])), (21, " ".join(two + ["y"])), (21, " ".join(two + ["y"]))]
    got = minhash.near_duplicates(docs_of(rows), width=4, percent=80).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {6}
