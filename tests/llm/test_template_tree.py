import random

from churnforge.llm import template_tree


def test_templates_with_variable_fields_are_dropped_after_the_first(spark, docs_of):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        lines = [say(rng.randint(3, 15)) for _ in range(3)]
        lines.insert(1, f"Posted by user {rng.choice(words)} on 2024-0{i % 9 + 1}-11 at home")
        if i % 2:
            lines.append("All rights reserved.")
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r for r in template_tree.drop_recurring_lines(docs_of(rows), least_docs=10).collect()}
    for i, text in rows:
        want = [x for x in text.split("\n") if i == 0 or not x.startswith("Posted") if i == 1 or x != "All rights reserved."]
        assert got[i].text == "\n".join(want) and got[i].n_lines == 4 + i % 2 and got[i].n_dropped == 4 + i % 2 - len(want)


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows + [(50 + k, "a common line of text\r\n\nown%d words%d here%d" % (k, k, k)) for k in range(12)])
    out = template_tree.drop_recurring_lines(docs, least_docs=5)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = out.collect()
    assert len(got) == len(odd_rows) + 12
    by = {r.doc_id: r for r in got}
    assert by[0].text is None and by[0].n_lines == 0 and by[1].text == "" and by[50].n_dropped == 0
    assert all(by[50 + k].text == "\nown%d words%d here%d" % (k, k, k) for k in range(1, 12))
    texts = {t for _, t in odd_rows}
    assert all(r.text in texts for r in got if r.doc_id is None or r.doc_id < 50 or r.doc_id > 70)
    assert template_tree.drop_recurring_lines(docs.limit(0)).count() == 0


def test_lines_alike_in_their_lead_alone_stay(spark, docs_of):
    names = ["Rome", "Greece", "Persia", "Egypt", "Crete", "Troy", "Sparta", "Thebes", "Corinth", "Argos", "Delphi", "Athens", "Sicily", "Cyprus"]
    rows = [(k, f"The history of {n}\nHe went to the {n}\nThat is why {n} fell {n[::-1]}\nNumber of visits: {k * 17}\n{k} of 14") for k, n in enumerate(names)]
    got = template_tree.drop_recurring_lines(docs_of(rows), least_docs=10).collect()
    for r in got:
        want = rows[r.doc_id][1].split("\n")
        assert r.text == "\n".join(want if r.doc_id == 0 else want[:3])


def test_short_lines_recur_by_all_their_tokens(spark, docs_of):
    rows = [(k, f"Read more\nown{k} text{k} here{k}\n\n Subscribe \t\nPage {k}\nw{k}") for k in range(12)] + [(90, "Read less"), (91, "more")]
    got = {r.doc_id: r.text for r in template_tree.drop_recurring_lines(docs_of(rows), least_docs=10).collect()}
    assert got.pop(90) == "Read less" and got.pop(91) == "more" and got.pop(0) == rows[0][1]
    assert all(got[k] == f"own{k} text{k} here{k}\n\nPage {k}\nw{k}" for k in got)
    assert all(r.n_dropped == 0 for r in template_tree.drop_recurring_lines(docs_of(rows), least_tokens=3).collect())


def test_sql_on_short_lines_and_lines_alike_in_their_lead(spark, docs_of):
    import duckdb
    from pyspark.sql import functions as F

    from churnforge.llm.queries import OP7_SQL

    names = ["Rome", "Greece", "Persia", "Egypt", "Crete", "Troy", "Sparta", "Thebes", "Corinth", "Argos", "Delphi", "Athens", "Sicily", "Cyprus"]
    rows = [(k, f"The history of {n}\nRead more\nNumber of visits: {k * 17}\n{k} of 14\n\n Subscribe \t\nPage {k}\nWe went on a long way to {n}\n{k} {k + 1} {k % 3}")
            for k, n in enumerate(names)]
    rows += [(100 + k, f"{k} {k * 7} {k * 11}\n7 8 9\nown {n} line {k}") for k, n in enumerate(names)] + [(200, None), (201, ""), (202, "Read less")]
    docs = docs_of(rows)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.execute(OP7_SQL)
    names = [d[0] for d in want.description]
    rest = template_tree.drop_recurring_lines(docs)
    got = rest.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and sum(r.n_dropped for r in got) > 60


def test_copies_count_as_one_document(spark, docs_of):
    rows = [(k, "first line of copies\nsecond line of copies") for k in range(40)]
    assert all(r.n_dropped == 0 for r in template_tree.drop_recurring_lines(docs_of(rows)).collect())
    everywhere = [(k, "a line that all share\nown%d" % k) for k in range(40)]
    got = template_tree.drop_recurring_lines(docs_of(everywhere)).collect()
    assert sorted(r.n_dropped for r in got) == [0] + [1] * 39


def test_no_python_in_the_plan(spark, docs_of):
    plan = template_tree.drop_recurring_lines(docs_of([(1, "a b c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
