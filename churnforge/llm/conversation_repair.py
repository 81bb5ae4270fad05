"""Repair of conversation structure by a dynamic program with square-root checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``: nothing, or turns of user and assistant, with at
most one system row before them. A row may be kept (0), given the role that its place asks for (2) or deleted (3,
and it must be if it is blank or a duplicate); a row of empty text may be inserted anywhere (2). A truncated row that
is not deleted adds 1. Of the cheapest edits those whose initials D, I, K, R are ASCII-least are taken.

The state is what stands last in the repaired rows: nothing, system, user or assistant. Costs to the end are
computed backwards. In a segment of ``n`` rows only every ``sqrt(n)``-th vector of costs is kept; walking
forward, one stretch of vectors at a time is made again, and the least letter that keeps the cost is taken.

Rows are sorted over all tasks by (conv_id, turn) and cut into segments of at most ``2 ** segment_bits`` rows of one
conversation, so a long conversation is many tasks' work. A segment is a (min, +) matrix of four states by
four; the matrices of a conversation give the costs at the end of each segment, and the walks from all four states
give the state at its beginning. What one task holds of a conversation is one matrix of 4 x 4 for each segment.
Only the digest of a conversation, one value over all its rows, is made by one task, as a stream over its rows.

Defined results: null role or text is one space; null turns come first; rows of one turn are ordered by role and
digest of the text, equal rows are interchangeable; rows with a null conv_id form one conversation; a role without one of the
initials s, u, a (an empty one too) cannot be kept; an empty table gives no rows; columns other than
conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.common import stored

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
FAR = 1 << 40  # a cost that no edits have
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
START = (FAR, FAR, FAR, FAR)
# A row's code letter: 3 x (0 system, 1 user, 2 assistant, 3 other) + (0 sound, 1 truncated, 2 to be deleted), from "a" on.
SOUND, TRUNCATED, BLANK, DUPLICATE = "sound", "truncated", "blank", "duplicate"
# Letters of edits: i, j insert user, assistant; U, A rerole to user, assistant; K keep; D delete.
AUDIT = str.maketrans("ijUA", "IIRR")
SMALL = 64  # segments of at most so many rows are remembered by their codes


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes its
    sentence ends, 3 repeats it, 4 makes it the user's. Nulls are written as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role, kind = F.coalesce("text", space), F.coalesce("role", space), F.col("kind")
    return (rows.withColumn("kind", F.crc32(F.encode(key, "UTF-8")) % 20).where(kind != 0)
            .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")).drop("again"))


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and gid: a number that grows with the place in the order."""
    chosen = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    keyed = chosen.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "digest", "tie"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    return stored(ranged.withColumn("gid", F.monotonically_increasing_id()), "turns")


def ends_sentence(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")


def with_faults(ordered: DataFrame) -> DataFrame:
    """conv_id, gid, code letter of every row; a row is no duplicate where it is the first of its role and text."""
    narrow = ordered.select("conv_id", "gid", "role", "digest", (F.rtrim("text", F.lit(BLANKS)) == "").alias("blank"),
                            ends_sentence(F.col("text")).alias("whole"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min("gid").alias("gid")).select("gid", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    who = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    how = F.when(F.col("fault") == SOUND, 0).when(F.col("fault") == TRUNCATED, 1).otherwise(2)
    return (narrow.drop("digest").join(firsts, "gid", "left").withColumn("fault", fault)
            .select("conv_id", "gid", "fault", F.char(F.lit(97) + 3 * who + how).alias("code")))


def before_row(code: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a row, of the four states, from those after it."""
    who, how = divmod(ord(code) - 97, 3)
    n, s, u, a = after
    out = [n + 3, s + 3, u + 3, a + 3]
    if how < 2:
        to_user = u + how + (0 if who == 1 else 2)
        out = [min(out[0], to_user), min(out[1], to_user), min(out[2], a + how + (0 if who == 2 else 2)), min(out[3], to_user)]
        if who == 0:
            out[0] = min(out[0], s + how)
    return with_inserts(out)


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs where rows may be inserted first."""
    n, s, u, a = costs
    u, a = min(u, a + 2), min(a, u + 2)
    return min(n, u + 2), min(s, u + 2), u, a


END = with_inserts([0, FAR, FAR, 0])


def costs_before(codes: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run of rows."""
    for code in reversed(codes):
        after = before_row(code, after)
    return after


def matrix_of(codes: str) -> list[int]:
    """Least cost from every state before a segment to every state after it, row after row."""
    columns = [costs_before(codes, tuple(0 if e == s else FAR for s in range(4))) for e in range(4)]
    return [columns[e][s] for s in range(4) for e in range(4)]


def through(matrix: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a segment from those after it."""
    return tuple(min(matrix[4 * s + e] + after[e] for e in range(4)) for s in range(4))


def walk(codes: str, after: tuple[int, ...], begin: list[int], last: bool) -> tuple[list[int], list[str]]:
    """(state behind the segment, edits of its rows) for every state to begin with.

    Edits are letters, a comma between rows; ``last`` adds what must be inserted at the end of the conversation.
    """
    n = len(codes)
    step = isqrt(n) + 1
    marks = [after]  # costs at the ends of the stretches, the last one first
    ends = list(range(step, n, step)) + [n]
    for e in reversed(ends[:-1]):
        marks.append(costs_before(codes[e:e + step], marks[-1]))
    state, out = list(begin), [[] for _ in begin]
    for start, end in zip([0, *ends[:-1]], ends):
        costs = [marks.pop()]
        for code in reversed(codes[start:end]):
            costs.append(before_row(code, costs[-1]))
        costs.reverse()
        for i, code in enumerate(codes[start:end]):
            for k in range(len(state)):
                state[k], letters = edit(code, state[k], costs[i], costs[i + 1])
                out[k].append(letters)
    if last:
        for k in range(len(state)):
            more = ""
            while state[k] not in (NOTHING, ASSISTANT):
                state[k], letter = insert(state[k])
                more += letter
            out[k][-1] += more
    return state, [",".join(x) for x in out]


def insert(state: int) -> tuple[int, str]:
    return (ASSISTANT, "j") if state == USER else (USER, "i")


def edit(code: str, state: int, here: tuple[int, ...], after: tuple[int, ...]) -> tuple[int, str]:
    """(state behind a row, letters of its edits): at each step the least of D, I, K, R that keeps the cost."""
    who, how = divmod(ord(code) - 97, 3)
    letters = ""
    while True:
        cost = here[state]
        if cost == after[state] + 3:
            return state, letters + "D"
        to, letter = insert(state)
        if cost == here[to] + 2:
            state, letters = to, letters + letter
            continue
        keep = {0: SYSTEM if state == NOTHING else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None}.get(who)
        if how < 2 and keep is not None and cost == after[keep] + how:
            return keep, letters + "K"
        return to, letters + ("A" if to == ASSISTANT else "U")


@lru_cache(maxsize=100_000)
def _small_matrix(codes: str) -> list[int]:
    return matrix_of(codes)


@lru_cache(maxsize=100_000)
def _small_walk(codes: str) -> tuple[list[int], list[str]]:
    return walk(codes, END, [NOTHING], True)


def illegal_pairs(codes: str) -> int:
    """Adjacent rows whose initials are none of su, ua, au."""
    who = [(ord(c) - 97) // 3 for c in codes]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(who, who[1:]))


SEGMENT = "conv_id long, seg long, first long, codes string, matrix array<long>, ends string, illegal long"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matrix, first and last code and illegal pairs of every segment."""
    for batch in batches:
        codes = batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([_small_matrix(c) if len(c) <= SMALL else matrix_of(c) for c in codes], pa.list_(pa.int64())),
             pa.array([c[0] + c[-1] for c in codes], pa.string()), pa.array([illegal_pairs(c) for c in codes], pa.int64())],
            [*batch.schema.names, "matrix", "ends", "illegal"])


def checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the segments of whole conversations: the costs behind each, backwards; cost and illegal pairs at the first."""
    for batch in batches:
        out: dict[str, list] = {"conv_id": [], "seg": [], "after": [], "first_of": [], "last_of": [], "cost": [], "illegal": []}
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
            after, parts = END, parts.as_py()
            for k in range(len(parts) - 1, -1, -1):
                p = parts[k]
                before = through(p["matrix"], after)
                seam = illegal_pairs(parts[k - 1]["ends"][1] + p["ends"][0]) if k else 0
                for name, value in (("conv_id", conv), ("seg", p["seg"]), ("after", list(after)), ("first_of", k == 0), ("last_of", k == len(parts) - 1),
                                    ("cost", 0 if k else before[NOTHING]), ("illegal", p["illegal"] + seam)):
                    out[name].append(value)
                after = before
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("conv_id", pa.int64()), ("seg", pa.int64()), ("after", pa.list_(pa.int64())), ("first_of", pa.bool_()), ("last_of", pa.bool_()), ("cost", pa.int64()), ("illegal", pa.int64())]))


CHECKPOINT = "conv_id long, seg long, after array<long>, first_of boolean, last_of boolean, cost long, illegal long"


def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, seg, first, codes, after, first_of, last_of) to the walks from all states that a segment may begin in."""
    for batch in batches:
        exits, edits = [], []
        for r in batch.select(["codes", "after", "first_of", "last_of"]).to_pylist():
            if r["first_of"] and r["last_of"] and len(r["codes"]) <= SMALL:
                e, w = _small_walk(r["codes"])
            else:
                e, w = walk(r["codes"], tuple(r["after"]), [NOTHING] if r["first_of"] else [NOTHING, SYSTEM, USER, ASSISTANT], r["last_of"])
            exits.append(e)
            edits.append(w)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(exits, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.string()))],
                                         ["conv_id", "seg", "first", "exits", "edits"])


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the walks of whole conversations: the state in which each segment begins."""
    for batch in batches:
        out: list[tuple[int | None, int, int]] = []
        for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
            state = NOTHING
            for p in parts.as_py():
                out.append((conv, p["seg"], state))
                state = p["exits"][state]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))], ["conv_id", "seg", "entry"])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, edit, role, text) in order to (conv_id, audit, repaired_sha256); one line at a time is held."""
    known, conv, audit, lines = False, None, [], None
    schema = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if not known or r["conv_id"] != conv:
                if known:
                    done.append((conv, "".join(audit), lines.hexdigest()))
                known, conv, audit, lines, between = True, r["conv_id"], [], hashlib.sha256(), ""
            audit.append(r["edit"].translate(AUDIT))
            for line in repaired_lines(r["edit"], r["role"], r["text"]):
                lines.update(f"{between}{line[0]}:{line[1]}".encode())
                between = "\n"
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if known:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((conv, "".join(audit), lines.hexdigest()), schema)], schema=schema)


def repaired_lines(edits: str, role: str, text: str) -> list[tuple[str, str]]:
    """(role, text) of all repaired rows that one row leaves."""
    made = {"i": ("user", ""), "j": ("assistant", ""), "K": (role, text), "U": ("user", text), "A": ("assistant", text)}
    return [made[e] for e in edits if e != "D"]


class Repair:
    """The repair of one table: ``edits`` (one row per row), ``rows()`` (the repaired rows) and ``summary()``."""

    def __init__(self, conversations: DataFrame, segment_bits: int = 14):
        if not 0 < segment_bits < 33:
            raise ValueError("a segment has between 2 and 2**32 rows")
        self.ordered = in_order(conversations)
        coded = stored(with_faults(self.ordered), "turn-codes")
        self.faults = coded.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in (BLANK, DUPLICATE, TRUNCATED)])
        listed = coded.groupBy("conv_id", F.shiftright("gid", segment_bits).alias("seg")).agg(
            F.min("gid").alias("first"), F.sort_array(F.collect_list(F.struct("gid", "code"))).alias("rows"))
        segments = listed.select("conv_id", "seg", "first", F.array_join(F.col("rows.code"), "").alias("codes"))
        scanned = stored(segments.mapInArrow(scan, SEGMENT), "segments")
        chain = scanned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "matrix", "ends", "illegal"))))
        self.checkpoints = stored(chain.mapInArrow(checkpoints, CHECKPOINT), "checkpoints")
        both = _beside(scanned.drop("illegal"), self.checkpoints).select("conv_id", "seg", "first", "codes", "after", "first_of", "last_of")
        walked = stored(both.mapInArrow(walk_all, "conv_id long, seg long, first long, exits array<long>, edits array<string>"), "walks")
        begun = walked.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "exits")))).mapInArrow(entries, "conv_id long, seg long, entry long")
        per_segment = _beside(walked, begun).select("first", F.split(F.element_at("edits", (F.col("entry") + 1).cast("int")), ",").alias("edits"))
        self.edits = per_segment.select("first", F.posexplode("edits").alias("at", "edit")).select((F.col("first") + F.col("at")).alias("gid"), "edit")

    def edited(self) -> DataFrame:
        """conv_id, gid, turn, role, text and edit letters of every row."""
        return self.ordered.drop("digest").join(self.edits, "gid")

    def rows(self) -> DataFrame:
        """The repaired rows: conv_id, gid and part (their order), turn (null where inserted), role, text, edit."""
        letter = F.col("letter")
        each = self.edited().select("*", F.posexplode(F.split("edit", "")).alias("part", "letter")).where(~letter.isin("D", ""))
        new = letter.isin("i", "j")
        role = F.when(letter.isin("i", "U"), "user").when(letter.isin("j", "A"), "assistant").otherwise(F.col("role"))
        return each.select("conv_id", "gid", "part", F.when(~new, F.col("turn")).alias("turn"), role.alias("role"),
                           F.when(new, "").otherwise(F.col("text")).alias("text"), F.translate("letter", "ijUA", "IIRR").alias("edit"))

    def summary(self) -> DataFrame:
        """One row per conversation: gaps, counts of faults, illegal pairs, cost, audit, repaired_sha256."""
        turns = self.ordered.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
        costs = self.checkpoints.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"))
        lines = self.edited().select("conv_id", "edit", "role", "text", "gid").repartition("conv_id").sortWithinPartitions("conv_id", "gid").drop("gid")
        texts = lines.mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string")
        out = turns
        for part in (self.faults, costs, texts):
            out = _beside(out, part, ("conv_id",))
        return out.select("conv_id", "gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost", "audit", "repaired_sha256")


def _beside(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("conv_id", "seg"), how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    named = right.select(*[F.col(c).alias(f"right_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"right_{k}" for k in keys])


def repair_summary(original: DataFrame, damaged: DataFrame, segment_bits: int = 14) -> DataFrame:
    """The summary of the repair of ``damaged`` for every conv_id of ``original``."""
    found = Repair(damaged, segment_bits).summary()
    every = _beside(original.select("conv_id").distinct(), found, ("conv_id",), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return every.na.fill(0, ["gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": nothing})
