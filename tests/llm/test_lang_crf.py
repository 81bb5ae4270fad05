import itertools

import numpy as np

from churnforge.llm import lang_crf
from churnforge.llm.common import table

SF = "/root/testdata/sf0.01"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    model = lang_crf.Model(["a", "b", "c"])
    model.move = rng.normal(size=(3, 3)).astype(np.float32)
    em, lens = rng.normal(size=(5, 3)), np.array([4, 0, 1, 6])
    codes = rng.integers(0, 5, 11)
    got = model.marginals(em, codes, lens)
    at = 0
    for n in lens:
        own = codes[at:at + n]
        p = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(em[c, s] for c, s in zip(own, path)) + sum(model.move[x, y] for x, y in zip(path, path[1:]))) if n else 0
            w *= np.exp(model.move[:, path[0]]).sum() if n else 1  # a uniform state before the first word
            for i, s in enumerate(path):
                p[i, s] += w
        if n:
            assert np.allclose(got[at:at + n], p / p.sum(1, keepdims=True))
        at += n


def test_gradient_matches_finite_differences(monkeypatch):
    monkeypatch.setattr(lang_crf, "BLOCK", 3)  # words of one text in several blocks
    rng = np.random.default_rng(5)
    model = lang_crf.Model(["a", "b", "c"])
    model.move = rng.normal(size=(3, 3))
    em, lens = rng.normal(size=(6, 3)), np.array([8, 0, 1, 5])
    codes, gold = rng.integers(0, 6, 14), rng.integers(0, 3, 14)

    def likelihood() -> float:
        at, total = 0, 0.0
        for n in lens:
            a = np.exp(model.move)
            v, own = np.full(3, 1 / 3), np.full(3, 1 / 3)
            for c, y in zip(codes[at:at + n], gold[at:at + n]):
                v, own = (v @ a) * np.exp(em[c]), (own @ a) * np.exp(em[c]) * np.eye(3)[y]
            total += np.log(own.sum() / v.sum())
            at += n
        return total

    by_word, moves = model.gradient(em, codes, lens, gold)
    by_code = np.stack([np.bincount(codes, by_word[:, j], 6) for j in range(3)], 1)
    for table, got in ((em, by_code), (model.move, moves)):
        for at in np.ndindex(table.shape):
            was, step = table[at], 1e-5
            table[at] = was + step
            up = likelihood()
            table[at] = was - step
            down = likelihood()
            table[at] = was
            assert abs((up - down) / (2 * step) - got[at]) < 1e-6


def test_pieces_reach_the_end_of_long_texts():
    head = "aa bb cc dd " * 200
    sample = [("x", head + "ququ qaqa qiqi " * 400)] * 3 + [("y", head + "vovo vava vivi " * 400)] * 3
    model = lang_crf.train(sample)
    import pyarrow as pa
    distinct, codes, lens = lang_crf.words_of(pa.array(["ququ qaqa qiqi", "vovo vava vivi"]))
    p = model.marginals(model.emissions(lang_crf.features(distinct)), codes, lens)
    assert p.argmax(1).tolist() == [0] * 3 + [1] * 3


def test_blocks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(2)
    model = lang_crf.Model(["a", "b"])
    model.move = rng.normal(size=(2, 2)).astype(np.float32)
    em, codes, lens = rng.normal(size=(50, 2)), rng.integers(0, 50, 700), np.array([300, 1, 0, 64, 65, 270])
    whole = model.marginals(em, codes, lens)
    monkeypatch.setattr(lang_crf, "BLOCK", 7)
    assert np.allclose(whole, model.marginals(em, codes, lens))


def test_code_switched_words_are_labelled():
    sample = [("x", "baba bobo bibi " * 40), ("y", "zuzu zozo zizi " * 40)] * 5
    model = lang_crf.train(sample)
    import pyarrow as pa
    distinct, codes, lens = lang_crf.words_of(pa.array(["baba bobo bibi baba zuzu zozo zizi zuzu zozo bobo bibi baba"]))
    p = model.marginals(model.emissions(lang_crf.features(distinct)), codes, lens)
    assert p.argmax(1).tolist() == [0] * 4 + [1] * 5 + [0] * 3


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = lang_crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").select("lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows, "xx")
    got = lang_crf.identify(docs).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (0, 1, 2):
            assert (r.lang_pred, r.score) == ("und", 0)
        if r.doc_id in (3, 4, 9):
            assert r.lang_pred == "xx"
    assert {r.lang_pred for r in lang_crf.identify(docs_of(odd_rows)).collect()} == {"und"}
    assert lang_crf.identify(docs.limit(0)).count() == 0
