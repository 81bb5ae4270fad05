import hashlib
import random
import re
import zlib

from churnforge.llm import conversation_repair as cr
from churnforge.llm.queries import OP13_SQL

SCHEMA = "conv_id long, turn long, role string, text string, gid string, seg int, first int, edit int, codes int, right_conv_id int"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = BLANK.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired rows): all edits with at most two inserts at a place, tried one by one."""
    marks, best = faults(rows), (3 * len(rows) + 1,)  # deleting all costs less

    def go(i, cost, audit, done, inserts):
        nonlocal best
        # at most one kept system row and pairs: a prefix that no longer fits is given up
        if cost > best[0] or not re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in done)):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in done)):
            best = min(best, (cost, audit, done))
        if inserts < 2:
            for r in ("user", "assistant"):
                go(i, cost + 2, audit + "I", done + [(r, "")], inserts + 1)
        if i < len(rows):
            (role, text), extra = rows[i], marks[i] == "truncated"
            go(i + 1, cost + 3, audit + "D", done, 0)
            if marks[i] not in ("blank", "duplicate"):
                go(i + 1, cost + extra, audit + "K", done + [(role, text)], 0)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 2 + extra, audit + "R", done + [(r, text)], 0)

    go(0, 0, "", [], 0)
    return best


def summary(conv, rows):
    """The contract's row by plain code; ``rows`` after damage."""
    mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
    said, turns = [r[2:] for r in mine], [r[1] for r in mine if r[1] is not None]
    marks, initials = faults(said), [r[:1] for r, _ in said]
    cost, audit, done = brute(said)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest())


def random_rows(rng, convs, longest):
    texts = ["Yes.", "No", "", " \t", "Why?", "a.\n", "été! ", "x" * 50 + ".", None, "b.\xa0", "漢字。"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Umlaut"]
    rows = []
    for c in convs:
        for t in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_against_all_edits(spark):
    rng = random.Random(11)
    rows = random_rows(rng, [None, -1, *range(40)], 4)
    rows += [(100, 0, "user", "Hi."), (100, 0, "user", "Hi."), (101, None, "system", "Be."), (102, 5, "user", "x" * 200_000)]
    table = conversations(spark, rows).repartition(5)
    after = damaged(rows)
    want = sorted((summary(c, after) for c in {r[0] for r in rows}), key=str)
    for bits in (14, 1):  # whole conversations, and segments of two rows
        got = cr.repair_summary(table, cr.damage(table), bits)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_long_conversations_in_segments(spark):
    """One conversation of thousands of rows, among them equal ones: the same edits in one segment and in many."""
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["A.", "B", "", f"text {t}.", "C!"])) for t in range(3000)]
    rows += [(7, 9000, "user", "Same.")] * 500
    table = conversations(spark, rows)
    one, many = ([tuple(r) for r in cr.Repair(table, bits).summary().collect()] for bits in (14, 5))
    assert one == many
    codes = [r.code for r in cr.with_faults(cr.in_order(table)).orderBy("gid").collect()]
    assert cr.costs_before("".join(codes), cr.END)[cr.NOTHING] == one[0][6]
    repaired = cr.Repair(table, 5).rows().orderBy("gid", "part").collect()
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in repaired))
    text = "\n".join(f"{r.role}:{r.text}" for r in repaired)
    assert hashlib.sha256(text.encode()).hexdigest() == one[0][8]
    spent = {"K": 0, "R": 2, "D": 3, "I": 2}
    assert sum(spent[e] for e in one[0][7]) + sum(r.text == "B" and r.edit in "KR" for r in repaired) == one[0][6]


def test_checkpoints_give_the_plain_walk():
    """Walking with costs at square-root checkpoints takes the same edits as with all costs kept."""
    rng = random.Random(4)
    for n in [*range(1, 30), 400]:
        codes = "".join(chr(97 + rng.randrange(12)) for _ in range(n))
        costs = [cr.END]
        for c in reversed(codes):
            costs.append(cr.before_row(c, costs[-1]))
        costs.reverse()
        for begin in range(4):
            state, want = begin, []
            for i, c in enumerate(codes):
                state, letters = cr.edit(c, state, costs[i], costs[i + 1])
                want.append(letters)
            (end,), (got,) = cr.walk(codes, cr.END, [begin], False)
            assert (end, got) == (state, ",".join(want))
            assert cr.through(cr.matrix_of(codes), cr.END)[begin] == costs[0][begin]


def test_sql_on_odd_rows(spark):
    import duckdb

    rows = random_rows(random.Random(5), [None, *range(40)], 6)
    table = conversations(spark, rows)
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(OP13_SQL).fetchall()
    names = [d[0] for d in con.description]
    got = cr.repair_summary(table, cr.damage(table)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    table = conversations(spark, [(1, 1, "user", "a")]).limit(0)
    assert cr.repair_summary(table, cr.damage(table)).count() == 0
