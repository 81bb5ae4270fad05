"""CSV with line breaks in fields: equal to Python's reader, whatever the byte ranges."""

import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from churnforge.sources import csv_records as CR
from churnforge.sources.files import read_dataset

CELLS = ["plain", "", "two words", 'say "hi"', "a,b", "line\nbreak", "many\n\n\nbreaks,\n\"q\"\n", '"', '""', "\n", ",", "été 漢字", "x" * 300, ' lead "in" ', "crlf\r\nin"]


def written(rows, end="\r\n"):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@settings(max_examples=300, deadline=None)
@given(st.text('",a\n', max_size=40))
def test_states_of_lines(text):
    """A text of whole and open fields: the state after each line is that of Python's reader."""
    inside = False
    lines = text.split("\n")
    for i, line in enumerate(lines):
        inside = CR.ends_inside(line, inside)
        # the reader gives one row fewer where the last line is still open, and joins it with what follows
        probe = "\n".join(lines[:i + 1]) + "\n#"
        last = list(csv.reader(io.StringIO(probe, newline="")))[-1]
        assert inside == (last != ["#"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", [64, 1000, 1 << 27])
def test_equal_to_the_reader(spark, tmp_path, end, split):
    rng = random.Random(split)
    want = []
    for part in range(3):
        rows = [[f"k{part}-{i}", *[rng.choice(CELLS) for _ in range(3)]] for i in range(40)]
        rows += [[f"k{part}-long", "long " + "y\n" * 300, 'end"', ""]]
        text = written([["id", "a", "b", "A"], *rows], end)
        (tmp_path / f"p{part}.csv").write_bytes(text.encode())
        want += list(csv.reader(io.StringIO(text, newline="")))[1:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = CR.read_records(spark, str(tmp_path))
        parts = CR._lines(spark, str(tmp_path)).rdd.getNumPartitions()
        rows = [["" if v is None else v for v in r] for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.columns == ["id", "a1", "b", "A3"] and parts > (3 if split < 2000 else 0)
    assert sorted(rows) == sorted(want)


def test_a_large_file_is_many_tasks(spark, tmp_path):
    """One file, read by many tasks, equal to Python's reader."""
    rng = random.Random(9)
    path = tmp_path / "large.csv"
    prose = ["".join(rng.choice('abcdefg ,"\n') for _ in range(4000)) for _ in range(40)]
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["id", "text"])
        for i in range(12_000):
            out.writerow([i, prose[i % 40]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4 << 20)
    try:
        got = CR.read_records(spark, str(path))
        assert CR._lines(spark, str(path)).rdd.getNumPartitions() >= 10
        rows = got.selectExpr("cast(id AS int) AS id", "sha2(text, 256) AS h").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import hashlib
    digest = [hashlib.sha256(p.encode()).hexdigest() for p in prose]
    assert sorted((r.id, r.h) for r in rows) == [(i, digest[i % 40]) for i in range(12_000)]


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert CR.read_records(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "open.csv").write_bytes('﻿id,t\r\n1,"open\r\nfield'.encode())
    got = CR.read_records(spark, str(tmp_path / "open.csv"))
    assert got.columns == ["id", "t"] and [tuple(r) for r in got.collect()] == [("1", "open\r\nfield")]
    (tmp_path / "ragged.csv").write_text('id,t\n\n1\n2,b,more\n3,in 5" pipe\n')
    assert [tuple(r) for r in read_dataset(spark, str(tmp_path / "ragged.csv"), line_breaks=True).collect()] == [(1, None), (2, "b"), (3, 'in 5" pipe')]
