import hashlib
import random

from churnforge.llm import suffix_dedup


def brute(texts, n=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            s = raw[i:i + n]
            if s in seen:
                gone[i:i + n] = b"\1" * n
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def cases(seed, n=60):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice("abcdeé \n") for _ in range(k))
    shared = [prose(rng.choice([95, 99, 100, 101, 130, 400])) for _ in range(6)]
    texts = [None, "", "ab" * 300, "abc" * 200, "x" * 1000, "x" * 150]
    while len(texts) < n:
        t = "".join(prose(rng.randint(0, 120)) + rng.choice(shared) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.3:
            t = rng.choice([x for x in texts if x])
            if rng.random() < 0.6:
                k = rng.randrange(len(t))
                t = t[:k] + "#" + t[k + 1:]
        texts.append(t)
    rng.shuffle(texts)
    return texts


def test_matches_brute_force(spark, docs_of):
    for seed in (1, 2):
        texts = cases(seed)
        ids = sorted(random.Random(seed).sample(range(-500, 500), len(texts)))
        rows = list(zip(ids, texts))
        want = dict(zip(ids, brute(texts)))
        random.Random(9).shuffle(rows)
        assert result(suffix_dedup.remove_repeats(docs_of(rows).repartition(5))) == want


def test_hot_ranks_give_the_same_result(spark, docs_of, monkeypatch):
    texts = cases(3)
    monkeypatch.setattr(suffix_dedup, "_hot", lambda numbered: [r.g for r in suffix_dedup.positions(numbered.select("doc", "text"), []).select("g").distinct().collect()][::2])
    got = result(suffix_dedup.remove_repeats(docs_of(list(enumerate(texts))).repartition(4)))
    assert got == dict(enumerate(brute(texts)))


def test_odd_rows(spark, docs_of, odd_rows):
    got = suffix_dedup.remove_repeats(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    twice = [r for r in got if r.doc_id == 5]
    assert sorted(r.n_removed == r.n_bytes for r in twice) == [True, True]  # the null id's copy comes first
    assert sum(r.n_removed == 0 for r in got if r.doc_id is None) == 2
    assert suffix_dedup.remove_repeats(docs_of(odd_rows).limit(0)).count() == 0
