import random

from churnforge.llm import decontaminate


def test_planted_items_are_found_and_clean_documents_left(spark, docs_of, odd_rows):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(k, " ".join(say(rng.randint(4, 14)) for _ in range(rng.randint(1, 5)))) for k in range(60)] + [(60, None), (61, ""), (62, "...")]
    items.append((63, items[0][1]))
    rows, want = list(odd_rows), set()
    for i in range(100, 220):
        text = say(rng.randint(0, 400))
        if i % 3 == 0:
            k = rng.randrange(60)
            inner = items[k][1].upper().replace(". ", " ,\n") if i % 2 else items[k][1]
            text = text + " " + inner + " " + say(300)
            want |= {(i, k)} | ({(i, 63)} if k == 0 else set())
        rows.append((i, text))
    half = items[5][1].split(". ")
    rows.append((500, say(50) + half[0] + " " + say(80)))  # a question alone is no leak
    bench = spark.createDataFrame([(k, t, 1.0) for k, t in items], "item_id long, text string, score double")
    found = decontaminate.leaks(docs_of(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | ({(500, 5)} if len(half) == 1 else set())
    assert all(0.6 <= r.score <= 1.0 + 1e-9 for r in found)
    assert decontaminate.leaks(docs_of(rows).limit(0), bench).count() == 0
    assert decontaminate.leaks(docs_of(rows), bench.limit(0)).count() == 0


def test_bounds_hold_and_scores_match_a_plain_sum(monkeypatch):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(200)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))) for k in range(100)]
    index = decontaminate.Index(items, *decontaminate.totals_of(items))
    import numpy as np
    for _ in range(30):
        terms = np.unique(rng.choices(range(len(index.vocabulary)), k=60))
        plain = np.zeros(len(index.ids))
        for t in terms:
            run = slice(index.at[t], index.at[t + 1])
            np.add.at(plain, index.item[run], index.weight[run])
        for least in (0.2, 0.4):
            got = {i: s for b in range(index.bound.shape[1]) if index.bound[terms, b].sum() >= least - 1e-4 for i, s in index.score(terms, b, least)}
            assert set(got) == set(np.flatnonzero(plain >= least - 1e-9).tolist())


def test_index_in_parts_gives_the_same_rows(spark, docs_of, odd_rows, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join("w%d" % rng.randrange(300) for _ in range(n)) + "."
    items = [(k, say(rng.randint(4, 30)) + " " + say(rng.randint(1, 8))) for k in range(9)] + [(20, None), (21, "..."), (None, say(12))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, say(rng.randint(0, 90)) + " " + t + " " + say(40)) for k, t in items if t] + list(odd_rows)
    whole = sorted(map(repr, decontaminate.leaks(docs_of(rows), bench).collect()))
    assert len(whole) >= 10
    clean = sorted(map(repr, decontaminate.without_leaks(docs_of(rows), bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert sorted(map(repr, decontaminate.leaks(docs_of(rows), bench).collect())) == whole
    assert sorted(map(repr, decontaminate.without_leaks(docs_of(rows), bench).collect())) == clean


def test_rows_are_judged_apart(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta.")], "item_id long, text string")
    bad, good = "so alpha beta gamma delta epsilon zeta eta and more", "nothing of that kind"
    rows = [(1, bad), (1, good), (None, bad), (None, good), (2, None), (3, ""), (4, good), (4, good)]
    got = decontaminate.without_leaks(docs_of(rows), bench)
    assert got.columns == docs_of(rows).columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted((i or 0, t or "") for i, t in rows if t != bad)
    assert decontaminate.without_leaks(docs_of(rows), bench.limit(0)).count() == len(rows)
    assert decontaminate.without_leaks(docs_of(rows).limit(0), bench).count() == 0
