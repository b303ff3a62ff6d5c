"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. The turns of a
conversation are rendered as growing prefixes; where the next output starts with the last one, the
rest is the new turn's span. Where it does not, the template has rewritten history: the span starts
at the first difference and ``rewritten`` says so. Spans of assistant turns, cut to their text, are
the loss mask.

The default template marks turns with ``<|im_start|>role`` and ``<|im_end|>``. Inside roles and texts a
backslash is put into every control-like ``<|``, ``<\\|``, ..., which one backslash less undoes, so
no text can forge a mark.

Each conversation is rendered in one task from rows streamed in turn order, in space of one
conversation; rendering all prefixes takes time quadratic in its length, which is the method's price.

Defined results: a null text or role is empty; turns are ordered by turn (nulls first), then role and
text, and repeated rows are turns of their own; a null conv_id is a conversation; an empty
table gives no rows. Only the four named columns are read, so other columns cannot clash.
"""

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
Turn = tuple[str, str]


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """A role is one line: backslashes and line ends are written out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")).replace("<\\|", "<\\\\|")


def unescape_role(role: str) -> str:
    out = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role.replace("<\\\\|", "<\\|"))
    return unescape(out)


def chatml(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape_role(r)}\n{escape(t)}{END}" for r, t in turns)


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int]], bool]:
    """(output, span of each turn, whether history was rewritten)."""
    last, found, rewritten = render([]), [], False
    for n in range(1, len(turns) + 1):
        now = render(turns[:n])
        start = len(last)
        if not now.startswith(last):
            rewritten = True
            start = next((i for i, (a, b) in enumerate(zip(last, now)) if a != b), min(len(last), len(now)))
        found.append((start, len(now)))
        last = now
    return last, found, rewritten


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """(role, text, start and end of the escaped text) of one turn's span in ``chatml`` output."""
    if not (piece.startswith(START) and piece.endswith(END)):
        raise ValueError("not a turn")
    line = piece.index("\n")
    stop = len(piece) - len(END)
    return unescape_role(piece[len(START) : line]), unescape(piece[line + 1 : stop]), line + 1, stop


def format_conversations(
    rows: DataFrame,
    render: Callable[[list[Turn]], str] = chatml,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv_id, formatted, spans array<(start, end, role)>, rewritten: one row per conversation."""
    ready = rows.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    streamed = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def closed(ident, turns):
            output, found, rewritten = spans(turns, render)
            marks = [{"start": a, "end": b, "role": r} for (a, b), (r, _) in zip(found, turns)]
            return ident, output, marks, rewritten

        names = ["conv_id", "formatted", "spans", "rewritten"]
        current, turns, begun = None, [], False
        for batch in batches:
            done = []
            idents = batch["conv_id"].astype("Int64")
            for ident, r, t in zip(idents, batch["role"], batch["text"]):
                ident = None if pd.isna(ident) else int(ident)
                if begun and ident != current:
                    done.append(closed(current, turns))
                    turns = []
                current, begun = ident, True
                turns.append((r, t))
            frame = pd.DataFrame(done, columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame
        if begun:
            frame = pd.DataFrame([closed(current, turns)], columns=names)
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return streamed.mapInPandas(
        run,
        "conv_id long, formatted string, spans array<struct<start long, end long, role string>>, rewritten boolean",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of ``format_conversations`` output in the default template, read from the output itself:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for output, marks in zip(batch["formatted"], batch["spans"]):
                everything, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for mark in marks:
                    role, text, _, _ = read_turn(output[mark["start"] : mark["end"]])
                    everything.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        loss.update(text.encode("utf-8", "surrogatepass"))
                        chars += len(text)
                out.append((len(marks), everything.hexdigest(), chars, loss.hexdigest(), len(output)))
            frame = pd.DataFrame(
                out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            )
            frame.insert(0, "conv_id", batch["conv_id"].astype("Int64"))
            yield frame

    return formatted.mapInPandas(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
