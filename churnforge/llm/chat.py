"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. It is
rendered for every prefix of a conversation, and consecutive outputs are compared: a
turn's span is what the longer output adds. Where the longer output does not start
with the shorter one, the template rewrites history; the conversation is
flagged and its spans begin at the first changed character. Inside a span the
text is located by rendering the turn once more with a probe character in its place.

Texts are escaped before they reach the template, reversibly: in each run
``<\\...\\|`` one backslash is added, so ``<|`` never comes from a text.

A conversation is one output string, so it is formatted by one task; the work
on it grows with the square of its turns, as every prefix is rendered.

Defined results: null role or text is the empty string; turns are ordered by
(turn, role, text), null turns first, and repeated rows are turns of their own;
rows with a null conv_id form one conversation; an empty table gives no rows;
columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Turns = list[tuple[str, str]]
PROBE = ""


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def im_template(turns: Turns) -> str:
    """``<|im_start|>role``, line break, text, ``<|im_end|>``, line break for every turn."""
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def im_role(header: str) -> str:
    """The role that a header of ``im_template`` names."""
    return header.removeprefix("<|im_start|>").removesuffix("\n")


def role_in(role: str) -> str:
    """A role as templates get it: escaped, on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_out(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """(output, (start, text start, text end, end) of each turn, whether history was rewritten)."""
    safe = [(role_in(r), escape(t)) for r, t in turns]
    spans, rewritten, before, frame = [], False, template([]), {}
    for k, (role, text) in enumerate(safe):
        now = template(safe[:k + 1])
        start = len(before)
        if not now.startswith(before):
            rewritten = True
            start = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
        if (role, k == 0) not in frame or not _fits(now, start, frame[role, k == 0], text):
            probed = template([*safe[:k], (role, PROBE)])
            at = probed.rfind(PROBE)
            frame[role, k == 0] = (at - start, len(probed) - at - 1) if at >= start else (0, len(now) - start)
        head, tail = frame[role, k == 0]
        spans.append((start, start + head, max(start + head, len(now) - tail), len(now)))
        before = now
    return before, spans, rewritten


def _fits(now: str, start: int, frame: tuple[int, int], text: str) -> bool:
    return now[start + frame[0]:len(now) - frame[1]] == text


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = im_template, loss_role: str = "assistant",
                         read_role: Callable[[str], str] = im_role) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, rewrites_history.

    spans is an array of (role, start, text_start, text_end, end, loss) in code
    points; loss marks texts of ``loss_role`` (none where history is rewritten,
    as earlier spans are no longer in the output). Roles are read from the headers.
    """
    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, outs, all_spans, flags = [], [], [], []
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, spans, rewritten = render([(t["role"], t["text"]) for t in turns], template)
                roles = [role_out(read_role(out[a:b])) for a, b, _, _ in spans]
                ids.append(conv_id)
                outs.append(out)
                flags.append(rewritten)
                all_spans.append([dict(zip(SPAN, (r, *s, r == loss_role and not rewritten))) for r, s in zip(roles, spans)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(outs, pa.string()), pa.array(all_spans, pa.list_(pa.struct(
                [("role", pa.string()), *((n, pa.int64()) for n in SPAN[1:5]), ("loss", pa.bool_())]))), pa.array(flags, pa.bool_())],
                names=["conv_id", "formatted", "spans", "rewrites_history"])

    empty = F.lit("")
    turn = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(form, "conv_id long, formatted string, spans array<struct<role:string,start:long,text_start:long,"
                              "text_end:long,end:long,loss:boolean>>, rewrites_history boolean")


SPAN = ("role", "start", "text_start", "text_end", "end", "loss")
