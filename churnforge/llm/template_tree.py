"""Line de-duplication with a log-template tree, in DataFrame operations only.

Fixed-depth parsing: a line goes to the leaf named by its number of tokens and its first
``DEPTH`` tokens, where a token with a digit counts as a variable field. In a
leaf that recurs in enough documents, a token is part of a template where a
share of at least ``CONSTANT`` of the leaf's lines has it at its place, and a variable field
(``<*>``) otherwise. A line whose fields are mostly variable is its own template, and so is one
where, behind the first ``DEPTH`` tokens, the fields that are words (without a digit) are as many as the constant
tokens: what all lines of a leaf share by construction says nothing about a difference in words. Templates that occur in ``least_docs`` documents of different text are boilerplate: all
their lines are dropped but the first (smallest doc_id, then line).

Only leaf hashes are shuffled for all lines; lines are carried on for recurring leaves alone. All
counts are partial aggregates, so a line that a third of all documents share costs no task more.

Defined results: lines are separated by ``\\n``, tokens by white space; lines without a token always
stay; lines of fewer than ``DEPTH`` tokens have no fields, also not with digits, and recur by all
their tokens (``least_tokens`` leaves shorter lines out); a null text has no lines and stays
null; an emptied document keeps its row with the empty text; rows that share doc_id
and text are one document and lose the same lines; among equal doc_ids the smaller text hash
comes first, null doc_ids come last; other columns pass through unchanged (columns
named like the two counts are replaced by them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from churnforge.llm.common import stored

DEPTH = 3
CONSTANT = 0.2
SIMILAR = 0.5
FIELD = "<*>"
SPACE = r"[ \t\r\f\x0B]+"
BROADCAST_BYTES = 64 << 20  # a table is sent to every task up to this size there; a larger one is joined by a shuffle
ROW_BYTES = 32  # a row in a task's hash table, beside its arrays


def small(df: DataFrame, entries: Column | int = 0) -> DataFrame:
    """A stored table with the broadcast hint, if its rows and their ``entries`` (numbers in arrays) are counted to be small."""
    size = df.agg(F.coalesce(F.sum(F.lit(ROW_BYTES) + 8 * (entries if isinstance(entries, Column) else F.lit(entries))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, SPACE), lambda t: t != "")


def _lead(tokens: Column) -> Column:
    return F.transform(F.slice(tokens, 1, DEPTH), lambda t: F.when(t.rlike("[0-9]") & (F.size(tokens) >= DEPTH), F.lit(FIELD)).otherwise(t))


def _lines(docs: DataFrame, least_tokens: int) -> DataFrame:
    """doc_id, text_hash, pos, tokens, leaf of all lines with enough tokens."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = each.select("doc_id", "text_hash", "pos", _tokens(F.col("line")).alias("tokens")).where(F.size("tokens") >= least_tokens)
    return tokens.withColumn("leaf", F.xxhash64(F.size("tokens"), F.concat_ws(" ", _lead(F.col("tokens")))))


def boilerplate(docs: DataFrame, least_docs: int, least_tokens: int) -> DataFrame:
    """doc_id, text_hash, drop (line numbers to drop) of the documents that lose lines."""
    lines = _lines(docs, least_tokens)
    in_docs = lines.select("leaf", "text_hash").distinct().groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    leaves = stored(in_docs.select("leaf"), "leaves")
    held = stored(lines.join(small(leaves), "leaf"), "leaf-lines")
    of_leaf = held.groupBy("leaf").agg(F.count("*").alias("lines"))
    at = held.select("leaf", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "place", "token").agg(F.count("*").alias("n"))
    fixed = at.join(of_leaf, "leaf").groupBy("leaf", "place").agg(
        F.collect_list(F.when(F.col("n") >= CONSTANT * F.col("lines"), F.col("token"))).alias("fixed"))  # 1 / CONSTANT tokens at most
    trees = stored(fixed.groupBy("leaf").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "fixed"))), lambda p: p["fixed"]).alias("fixed")), "template-tree")
    general = F.zip_with("tokens", "fixed", lambda t, fixed: F.when(F.array_contains(fixed, t), t).otherwise(F.lit(FIELD)))
    named = held.join(trees, "leaf").withColumn("general", general)
    # 1: constant, 0: a field with a digit, -1: a field that is a word; all lines of a leaf share their lead
    votes = F.zip_with("tokens", "general", lambda t, g: F.when(g != FIELD, 1).when(t.rlike("[0-9]"), 0).otherwise(-1))
    behind = F.aggregate(F.slice(votes, DEPTH + 1, F.size("tokens")), F.lit(0), lambda a, v: a + v)
    is_similar = (F.size(F.filter("general", lambda t: t != FIELD)) >= SIMILAR * F.size("general")) & (~F.array_contains(votes, -1) | (behind > 0))
    parsed = stored(named.select(
        "doc_id", "text_hash", "pos", F.concat_ws(" ", F.when(is_similar, F.col("general")).otherwise(F.col("tokens"))).alias("template")), "parsed-lines")
    seen = parsed.select("template", "text_hash").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "pos")
    first = parsed.groupBy("template").agg(F.min(spot).alias("first"))
    recurring = seen.join(first, "template").select("template", "first")
    lost = parsed.join(recurring, "template").where(spot != F.col("first")).select("doc_id", "text_hash", "pos").distinct()
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("drop"))


def drop_recurring_lines(docs: DataFrame, least_docs: int = 10, least_tokens: int = 1) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines and n_dropped beside its columns."""
    lost = small(stored(boilerplate(docs.select("doc_id", "text"), least_docs, least_tokens), "lost-lines"), F.size("drop"))
    text_hash, drop, text = F.xxhash64(docs["text"]), lost["drop"], docs["text"]
    joined = docs.join(lost, (text_hash == lost["text_hash"]) & docs["doc_id"].eqNullSafe(lost["doc_id"]), "left")
    lines = F.split(text, "\n")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(drop, i)), "\n")
    counts = F.when(text.isNull(), 0).otherwise(F.size(lines)), F.coalesce(F.size(drop), F.lit(0))
    return joined.select(
        *[F.when(drop.isNull(), text).otherwise(rest).alias("text") if c == "text" else docs[c] for c in docs.columns if c not in COUNTS],
        *[n.cast("long").alias(c) for n, c in zip(counts, COUNTS)])


COUNTS = ("n_lines", "n_dropped")
