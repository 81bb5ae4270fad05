import random

import pyarrow as pa

from churnforge.llm import toxicity
from churnforge.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    labels = table(spark, SF, "labels")
    got = toxicity.classify(table(spark, SF, "documents"), labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() >= 0.6 and clean.predicted.mean() <= 0.06
    assert toxic.score.mean() > clean.score.mean() + 0.3 and got.score.between(0, 1).all()


def sample():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(800)] + ["home", "night"] * 20
    bad = ["vile fool", "nasty brute", "fool brute vile"]
    return [(int(k % 4 == 0), " ".join(rng.choice(words) for _ in range(40)) + (" " + bad[k % 3] if k % 4 == 0 else "")) for k in range(400)]


def test_copies_do_not_divide_by_nothing():
    assert toxicity.train([(k % 2, "the same few words over and over") for k in range(10)]) is not None


def test_only_real_copies_are_left_out_of_the_sample():
    rng = random.Random(4)
    words = ["w%d" % k for k in range(40)]  # every text holds most of them, so the least word hashes agree
    text = lambda: [rng.choice(words) for _ in range(100)]
    texts = [text() for _ in range(50)]
    near = [t[:-1] + ["changed"] for t in texts[:5]]
    sample = [(k % 2, " ".join(t)) for k, t in enumerate(texts)] + [(k % 2, " ".join(t)) for k, t in enumerate(near)]
    sample += [sample[0], (1, sample[0][1]), (0, ""), (0, ""), (0, "few words"), (0, "few words here")]
    _, codes, lens = toxicity.windows_of(pa.array([t for _, t in sample]))
    ends = lens.cumsum()
    got = toxicity._first_of_copies(sample, [codes[a:b] for a, b in zip(ends - lens, ends)])
    assert got == [*range(50), 56, 57, 59, 60]


def test_score_does_not_depend_on_a_reached_cap(spark, docs_of):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    # one text in ten is toxic, and half of the toxic ones hold nothing that tells
    rows = [(k, int(k % 10 == 0), " ".join(rng.choice(words) for _ in range(30)) + (" vile fool" if k % 20 == 0 else "")) for k in range(1600)]
    labels = spark.createDataFrame([(k, y) for k, y, _ in rows], "doc_id long, toxic int")
    docs = docs_of([(k, t) for k, _, t in rows])
    whole, cut = ({r.doc_id: r for r in toxicity.classify(docs, labels, per_label=n).collect()} for n in (2000, 90))
    for k, y, t in rows:
        assert cut[k].predicted == whole[k].predicted == int(t.endswith("vile fool"))
    silent = [k for k, _, t in rows if not t.endswith("vile fool")]
    assert abs(sum(cut[k].score - whole[k].score for k in silent)) / len(silent) < 0.03


def test_dictionaries_tell_the_classes_apart():
    model = toxicity.train(sample())
    gain = dict(zip(["vile", "fool", "brute", "home", "night", "zzz"], model.gains(["vile", "fool", "brute", "home", "night", "zzz"]).tolist()))
    assert min(gain["vile"], gain["fool"], gain["brute"]) > max(gain["home"], gain["night"], gain["zzz"], 0)


def test_odd_rows(spark, docs_of, odd_rows):
    rows = [(100 + k, t) for k, (_, t) in enumerate(sample())]
    docs = docs_of(odd_rows + rows)
    labels = spark.createDataFrame([(100 + k, y, None) for k, (y, _) in enumerate(sample())] + [(100, 1, "x"), (None, 1, "x"), (101, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, score string")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(odd_rows) + len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (0, 1, 2)} == {min(r.score for r in got)}
    assert all(r.score == 0 for r in toxicity.classify(docs, labels.limit(0)).collect())
    assert toxicity.classify(docs.limit(0), labels).count() == 0
