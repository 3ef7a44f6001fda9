"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.  Turns
after the last assistant turn make one more example without a target, so that the output holds whole conversations.

The template marks a turn as ``### Role:`` and ``</turn>``.  Inside texts and roles a backslash goes before every ``#``, ``<`` and
backslash, so no text can hold a marker, and ``unescape`` gives the text back.

Rows of one conversation are ordered by turn, then role and text (ties), nulls first.  A null text is empty, a null role the
empty role, and null conversation ids are one conversation.  Conversations come sorted and are streamed through a task, which holds
the turns so far of one conversation and no more; the examples grow with the square of its turns, which is the operator's meaning.
Other columns are ignored, and an empty table has no examples.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

EXAMPLE = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
EXAMPLE_COLUMNS = "conv_id long, example int, text string, loss_start long, loss_end long"
OPEN, CLOSE = "### ", " </turn>\n"
_ESCAPE, _UNESCAPE = re.compile(r"[\\#<]"), re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<])*) </turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role(role: str) -> str:
    """Roles are capitalised in the template only if that can be undone."""
    shown = role[:1].upper() + role[1:]
    return escape(shown if role[:1].islower() and shown[:1].lower() + shown[1:] == role else "\\" + role).replace(":", "\\:")


def _role_back(shown: str) -> str:
    role = unescape(shown)
    return role[1:] if role.startswith("\\") else role[:1].lower() + role[1:]


#: Characters of examples that a task gathers before it hands them on.
FLUSH = 4 << 20
_START = object()


def _expand(batches):
    """Examples of rows that come sorted by conversation; only the turns so far of one conversation are held."""
    current, prefix, k, plain, out, held = _START, "", 0, False, [], 0

    def flush():
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), EXAMPLE, strict=True)], schema=EXAMPLE)

    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != current or current is _START:
                if plain:
                    out.append((current, k, prefix, None, None))
                current, prefix, k, plain = conv, "", 0, False
            role, text = role or "", escape(text or "")
            head = f"{OPEN}{_role(role)}: "
            start = len(prefix) + len(head)
            prefix += head + text + CLOSE
            plain = role != "assistant"
            if not plain:
                out.append((conv, k, prefix, start, start + len(text)))
                k, held = k + 1, held + len(prefix)
                if held > FLUSH:
                    yield flush()
                    out, held = [], 0
    if plain:
        out.append((current, k, prefix, None, None))
    if out:
        yield flush()


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end (code points of text; null without a target) from conv_id, turn, role, text."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_expand, EXAMPLE_COLUMNS)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted example."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not in the template's form")
        turns.append((_role_back(m[1]), unescape(m[2])))
        at = m.end()
    return turns


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches):
    """Digests of examples that come sorted by conversation; only the last example of one conversation is held."""
    current, last, loss, n, size, out = _START, "", None, 0, 0, []

    def row():
        turns, seen = parse(last), hashlib.sha256()
        for role, text in turns:
            seen.update(f"{role}\n{text}\n".encode())
        return current, len(turns), seen.hexdigest(), n, loss.hexdigest(), size

    def table():
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), DIGEST, strict=True)], schema=DIGEST)

    for batch in batches:
        for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end")), strict=True):
            if conv != current or current is _START:
                if current is not _START:
                    out.append(row())
                current, loss, n, size = conv, hashlib.sha256(), 0, 0
            last, size = text, size + len(text)
            if start is not None:
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                n += len(reply)
        if out:
            yield table()
            out = []
    if current is not _START:
        out.append(row())
        yield table()


def read_back(examples: DataFrame) -> DataFrame:
    """A digest of each conversation, parsed from formatted examples."""
    ordered = examples.select("conv_id", "example", "text", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def write_chats(rows: DataFrame) -> DataFrame:
    """The formatted examples as a written table."""
    return written(format_chats(rows), "chats")
