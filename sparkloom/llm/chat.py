"""Operator 6, chat formatting: event-sourced reconstruction.

A log of events per conversation (messages, streamed deltas, edits,
regenerations, deletions) is folded into final messages, each rendered with
a template whose control strings are escaped inside texts, with a loss mask
over the assistant's texts. Everything streams over sorted partitions; a
conversation of any length needs the memory of a few copies of one message.
Events are partitioned by conversation and turn, since a turn's fold needs no
other turn: one conversation may hold a third of all rows. Only what must be
read in conversation order is partitioned by conversation alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the template: what opens a turn, what follows the role, what ends a turn.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
KINDS = ("message", "delta", "edit", "regenerate", "delete")

_RESERVED = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No control string survives: each holds one of the escaped characters."""
    return _RESERVED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as template text, and where the loss mask lies in it."""
    head = f"{OPEN}{escape(role)}{AFTER_ROLE}"
    body = escape(text)
    a = len(head)
    b = a + len(body)
    return f"{head}{body}{CLOSE}", *((a, b) if role == LOSS_ROLE else (0, 0))


# possessive, so that a long text leaves no trail of places to go back to; the text takes the first character of CLOSE with it
_TURN = re.compile(rf"{re.escape(OPEN)}([^\\:]*+(?:\\.[^\\:]*+)*+){re.escape(AFTER_ROLE)}([^\\<]*+(?:\\.[^\\<]*+)*+){re.escape(CLOSE[1:])}", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m or not m[2].endswith(CLOSE[0]):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(x).to_pylist() for x in names), strict=True)


def format_turns(events: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, ord, formatted, loss_start, loss_end), one per
    final message; by conversation ordered by turn, ord they make up the
    formatted text; the mask (code points of ``formatted``) is empty where
    the role is not the assistant's.

    ``events``: conv_id, seq, kind, turn, role, text. A message opens a
    message; a delta adds to the last one of its turn (or opens one), an edit
    replaces its text, a regeneration empties it, a deletion removes it.
    Events go by seq, equal ones by kind, role, text. Null text or role
    counts as empty, null kind as message; a null turn sorts first; repeated
    rows are messages of their own. An unknown kind is an error.
    """
    log = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    log = log.withColumn("_kind", order).repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "seq", "_kind", "role", "text").drop("_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "ord", "formatted", "loss_start", "loss_end"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        here, n, size = None, 0, 0
        message: list | None = None  # role, parts

        def done() -> None:
            nonlocal message, n, size
            if message is not None:
                row = (*here, n, *render(message[0], "".join(message[1])))
                out.append(row)
                size += len(row[3])
                n += 1
                message = None

        def ready() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=names)
            out.clear()
            size = 0
            return batch

        for conv, turn, kind, role, text in _rows(batches, "conv_id", "turn", "kind", "role", "text"):
            if (conv, turn) != here:
                done()
                here, n = (conv, turn), 0
            if kind == "message" or kind == "delta" and message is None:
                done()
                message = [role, [text]]
            elif kind == "delta":
                message[1].append(text)
            elif kind == "edit":
                message = [role or (message[0] if message else ""), [text]]
            elif kind == "regenerate":
                if message is not None:
                    message[1] = []
            elif kind == "delete":
                message = None
            else:
                raise ValueError(f"unknown kind of event: {kind}")
            if size > 1 << 21 or len(out) > 5000:
                yield ready()
        done()
        if out:
            yield ready()

    return log.mapInArrow(run, "conv_id long, turn long, ord long, formatted string, loss_start long, loss_end long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. A null conv_id is
    a conversation of its own; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        here, started, state = None, False, None

        def fresh() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names=names)
            out.clear()
            return batch

        def close() -> None:
            out.append((here, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for conv, formatted, a, b in _rows(batches, "conv_id", "formatted", "loss_start", "loss_end"):
            if not started or conv != here:
                if started:
                    close()
                    if len(out) >= 5000:
                        yield ready()
                here, started, state = conv, True, fresh()
            for role, text in read_back(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            loss = unescape(formatted[a:b])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(formatted)
        if started:
            close()
        if out:
            yield ready()

    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ord")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def assembled(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations in one string each; for those
    that fit a row. ``format_turns`` itself has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct("turn", "ord", "formatted")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["formatted"]), "").alias("formatted"))


def as_events(conversations: DataFrame) -> DataFrame:
    """Finished turns as an event log: one message each, in turn order."""
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")
