"""Conversations formatted by a template, with the ranges of text that a model is to learn from.

Rows of one conversation come together by a shuffle and are sorted there by turn (nulls first; ties by role and text), so a task holds the turns
of one part at a time: at most ``PART_TURNS`` or ``PART_CHARS``, however long the conversation. Templates that look at the whole
list of messages (``Template.parts`` is None) get it whole, and then the longest conversation must fit into a task.

Null texts and roles count as empty, rows of a null ``conv_id`` are one conversation, repeated rows are turns of their own, other columns are ignored,
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import Escape, compiled
from .storage import stored

PART_TURNS, PART_CHARS = 512, 1 << 20
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
#: Every role's turns between marks of their own; only what assistants say is marked as generated.
TURNS = """<s>
{%- for m in messages -%}
{%- if m.role == 'user' %}[INST] {{ m.content | escape }} [/INST]
{%- elif m.role == 'assistant' %} {% generation %}{{ m.content | escape }}{% endgeneration %} </s>
{%- elif m.role == 'system' %}[SYS] {{ m.content | escape }} [/SYS]
{%- else %}[ROLE] {{ m.role | escape }} [/ROLE] {{ m.content | escape }} [/TURN]
{%- endif -%}
{%- endfor -%}"""
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|\[SYS\] (?P<system>.*?) \[/SYS\]|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) \[/TURN\]", re.S)
_FORMATTED = "conv_id long, part long, last boolean, text string, spans array<struct<start: long, end: long>>"


def format_chats(conversations: DataFrame, template: str = TURNS, controls: tuple[str, ...] = CONTROLS, part_turns: int = PART_TURNS, part_chars: int = PART_CHARS) -> DataFrame:
    """``conv_id, part, last, text, spans``: the formatted conversations, long ones in parts between turns; ``spans`` are
    the generated ranges of the part's text in code points. A conversation that the template refuses is an error."""
    compiled(template, controls)  # errors show here
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches):
        made, rows = compiled(template, controls), []
        for row in _parts(batches, made.parts is not None, part_turns, part_chars):
            conv, part, done, messages, last = row
            out = made.render_part(messages, done, last) if made.parts else made.render(messages)
            rows.append({"conv_id": conv, "part": part, "last": last, "text": out.text(), "spans": [{"start": a, "end": b} for a, b in out.spans]})
            if len(rows) >= 256:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    together = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "role", "text").mapInArrow(run, _FORMATTED)


def _parts(batches, cut: bool, part_turns: int, part_chars: int) -> Iterator[tuple]:
    """``conv_id, part, turns before, messages, last`` of sorted rows."""
    now, part, done, held, size = None, 0, 0, [], 0
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held and conv != now:
                yield now, part, done, held, True
                part, done, held, size = 0, 0, [], 0
            elif cut and (len(held) >= part_turns or size >= part_chars):
                yield now, part, done, held, False
                part, done, held, size = part + 1, done + len(held), [], 0
            now = conv
            held.append({"role": role, "content": text})
            size += len(text)
    if held:
        yield now, part, done, held, True


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of what ``TURNS`` wrote, unescaped."""
    at = 3 if text.startswith("<s>") else 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a text of this template")
        role = m.lastgroup if m["other"] is None else Escape.unescape(m["role"])
        yield role, Escape.unescape(m["other"] if m["other"] is not None else m[role])
        at = m.end()


def digests(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read from a table of formatted conversations of ``TURNS``.

    Conversations of one part are read where they lie; those of more are brought together and read part by part.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["text"]
                for role, said in turns_of(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    sums[0] += 1
                for span in row["spans"]:
                    said = Escape.unescape(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    sums[1] += len(said)
                sums[2] += len(text)
                if row["last"]:
                    rows.append({"conv_id": row["conv_id"], "n_turns": sums[0], "turns_sha256": turns.hexdigest(), "loss_chars": sums[1], "loss_sha256": loss.hexdigest(), "formatted_chars": sums[2]})
                    turns, loss, sums = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    one = formatted.where("part = 0 and last").mapInArrow(run, out)
    more = formatted.where("not (part = 0 and last)").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, out)
    return one.unionByName(more)


def written(conversations: DataFrame, **options) -> DataFrame:
    """``format_chats``, as a table in the shared folder."""
    return stored(format_chats(conversations, **options), "chats")
