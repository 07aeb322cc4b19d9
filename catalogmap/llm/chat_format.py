"""Chat conversations as training text, with the loss mask found by rendering prefixes.

The template is a black box ``render(turns) -> str``. Rendering one turn more each time and comparing
consecutive outputs shows where a turn stands; rendering the last turn with two other texts shows where
its text stands inside that span. A template whose output for a prefix is not a prefix of the next output
rewrites history, which is reported instead of a mask.

A template that declares it (an attribute ``context``, or the argument) is rendered in steps: so many turns
before the one at hand stand for the history, so the work per turn is bounded. That a turn's output does
not depend on the turn before those is tested at every step by dropping it and comparing; besides, the whole
conversation so far is rendered whenever its length has doubled and at its end, and must equal what the steps gave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogmap.llm.rows import map_rows

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

END = "</turn>"
PROBES = ("a", "b")

FORMATTED = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "rewrites_history boolean, text string, spans array<struct<role:string,start:long,end:long,loss:boolean>>"
)


class RewritesHistory(ValueError):
    """The template changes what it wrote for earlier turns."""


def escape(text: str) -> str:
    """Breaks up the template's control strings; :func:`unescape` gives the text back."""
    text = text.replace("\\", "\\\\").replace("##", "#\\#").replace("##", "#\\#")
    return text.replace(END, "<\\/turn>")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(p.replace("\\", "") for p in parts)


def plain_template(turns: list[Turn]) -> str:
    """``### role: text </turn>`` and a line end for every turn."""
    return "".join(f"### {escape(role).replace(':', chr(92) + ':')}: {escape(text)} {END}\n" for role, text in turns)



def read_role(head: str) -> str:
    """The role in what :func:`plain_template` writes before a text."""
    return unescape(head[len("### ") : -len(": ")])


def _grown(before: str, after: str) -> str:
    if not after.startswith(before):
        raise RewritesHistory("an earlier turn's output changed")
    return after[len(before) :]


def turn_spans(turns: Iterator[Turn], render: Render, context: int | None = None) -> Iterator[tuple[Turn, str, int, int]]:
    """(turn, its piece of the output, start and end of its text in the piece), one after the other.

    Without ``context`` (or the template's own) every prefix of the conversation is rendered.
    """
    context = getattr(render, "context", None) if context is None else context
    history: list[Turn] = []
    every: list[Turn] = []
    written: list[str] = []
    shorter, whole = None, ""

    def compared() -> None:
        nonlocal written
        written = ["".join(written)]
        if render(every) != written[0]:
            raise RewritesHistory("the whole conversation is not what its steps gave")

    if context is not None and render([]):
        raise RewritesHistory("the template writes text without turns")
    for turn in turns:
        before = whole if context is None else render(history)
        whole = render([*history, turn])
        piece = _grown(before, whole)
        if shorter is not None and _grown(render(shorter), render([*shorter, turn])) != piece:
            raise RewritesHistory("a turn depends on turns further back than the context")
        first, second = (_grown(before, render([*history, (turn[0], p)])) for p in PROBES)
        same = next((i for i, (x, y) in enumerate(zip(first, second, strict=False)) if x != y), None)
        if same is None:
            raise RewritesHistory("a turn's text does not show in its output")
        tail = len(first) - same - 1
        if first[same + 1 :] != second[same + 1 :] or piece[:same] != first[:same] or len(piece) < same + tail or piece[len(piece) - tail :] != first[same + 1 :]:
            raise RewritesHistory("a turn's frame depends on its text")
        if context is not None:
            every.append(turn)
            written.append(piece)
            if len(every) & (len(every) - 1) == 0:
                compared()
        yield turn, piece, same, len(piece) - tail
        history.append(turn)
        if context is None:
            continue
        history = history[-context - 1 :]
        shorter = history[1:] if len(history) > context else None
    if every:
        compared()


def format_conversations(rows: DataFrame, render: Render = plain_template, unescaped: Callable[[str], str] = unescape, role_of: Callable[[str], str] = read_role, loss_roles: tuple[str, ...] = ("assistant",), context: int | None = None, keep_text: bool = True) -> DataFrame:
    """One row per conversation of ``rows`` (columns conv_id, turn, role, text).

    ``unescaped`` and ``role_of`` read a text and a turn's head back from the output. Turns come by turn (nulls first), ties by role and text; repeated rows are turns of their own. A null
    role or text is empty. Rows without conv_id form one conversation with a null id. Columns: n_turns,
    turns_sha256 (of role, newline, text, newline per turn), loss_chars and loss_sha256 (of the unescaped
    text under the loss mask), formatted_chars, rewrites_history, text and spans (code points; with
    ``keep_text``, else null). A task holds the turns of one conversation, since the template is given them at once. If the template rewrites
    history, the flag is set and everything read from the output is null.
    """

    def run(sorted_rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, group in groupby(sorted_rows, key=lambda r: r[0]):
            whole, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = at = 0
            texts, spans, failed = [], [], False

            def turns(group=group, whole=whole) -> Iterator[Turn]:
                nonlocal n
                for _, _, role, text in group:
                    n += 1
                    yield role or "", text or ""

            try:
                for _, piece, start, end in turn_spans(turns(), render, context):
                    role = role_of(piece[:start])
                    text = unescaped(piece[start:end])
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role in loss_roles:
                        loss.update(text.encode("utf-8", "surrogatepass"))
                        loss_chars += len(text)
                    if keep_text:
                        texts.append(piece)
                        spans.append((role, at + start, at + end, role in loss_roles))
                    at += len(piece)
            except RewritesHistory:
                failed = True
                n += sum(1 for _ in group)
            if failed:
                yield conv_id, n, None, None, None, None, True, None, None
            else:
                made = [dict(zip(("role", "start", "end", "loss"), s, strict=True)) for s in spans]
                yield conv_id, n, whole.hexdigest(), loss_chars, loss.hexdigest(), at, False, "".join(texts) if keep_text else None, made if keep_text else None

    picked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    # sorted inside hashed partitions and read as a stream: a long conversation never meets in memory
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(ordered, run, FORMATTED)
