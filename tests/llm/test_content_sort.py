import hashlib

from churnforge.llm import content_sort


def test_odd_rows_and_a_hot_group(spark, docs_of, odd_rows):
    rows = odd_rows + [(100 + k, "the same text") for k in range(500)] + [(1000 + k, "text %d" % (k % 40)) for k in range(300)]
    got = content_sort.content_sort_dedup(docs_of(rows).repartition(7)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}
    kept = {}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + 1
    assert kept == dict.fromkeys(want, 1)


def test_runs_over_partition_borders(spark, docs_of):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort.content_sort_dedup(docs_of([(k, "a" if k % 3 else "b%d" % (k % 9)) for k in range(400)])).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(398, 266)} and sum(r.kept for r in got) == 4


def test_normalisation_and_empty_table(spark, docs_of):
    from pyspark.sql import functions as F

    got = content_sort.content_sort_dedup(docs_of([(1, "A b"), (2, "a  B")]), lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))).collect()
    assert [r.keep_id for r in got] == [2, 2]
    assert content_sort.content_sort_dedup(docs_of([(1, "a")]).limit(0)).count() == 0
