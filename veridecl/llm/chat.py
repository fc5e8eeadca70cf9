"""Formatting conversations with a compiled template, and reading them back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .template import compile_template

#: What marks turns in the output.
OPEN, CLOSE, STOP = "<|", "|>\n", "</s>"
TEMPLATE = (
    "{% for m in messages %}<|{{ m.role|escape }}|>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</s>{% endfor %}"
)
#: Every character that begins a control string, and the escape character itself, is written as two in texts and roles,
#: so that none of ``<|``, ``|>``, ``</s>``, ``[INST]``, ``[/INST]`` can stand there.
ESCAPES = {"\\": "\\0", "<": "\\1", "|": "\\2", "[": "\\3"}
_PLAIN = {v[1]: k for k, v in ESCAPES.items()}
_TABLE = str.maketrans(ESCAPES)


def escape(text: str) -> str:
    return text.translate(_TABLE)


def unescape(text: str) -> str:
    head, *rest = text.split("\\")
    return head + "".join(_PLAIN[x[0]] + x[1:] for x in rest)


FILTERS = {"escape": escape, "upper": str.upper, "lower": str.lower, "trim": str.strip}

_SCHEMA = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.int64()))])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations one after the other, from rows that are sorted by conv_id; turns are taken as they are asked for."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.select(["conv_id", "role", "text"]).columns)))
    ahead = next(rows, None)

    def turns(conv_id: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv_id:
            now, ahead = ahead, next(rows, None)
            yield {"role": now[1] or "", "text": now[2] or ""}

    while ahead is not None:
        conv_id = ahead[0]
        left = turns(conv_id)
        yield conv_id, left
        for _ in left:
            pass


def _render(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        rows: list[tuple] = []
        size = 0
        for conv_id, turns in _conversations(batches):
            text, mask, segment, length = [], [], 0, 0
            for piece, made in render(turns):
                text.append(piece)
                if made and piece:
                    if mask and mask[-1] == length:
                        mask[-1] += len(piece)
                    else:
                        mask += [length, length + len(piece)]
                length += len(piece)
                if not made and piece.endswith(STOP):
                    rows.append((conv_id, segment, "".join(text), mask))
                    size += length
                    text, mask, segment, length = [], [], segment + 1, 0
                    if size > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                        rows, size = [], 0
            if text:
                rows.append((conv_id, segment, "".join(text), mask))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted conversations in segments: conv_id, segment, formatted, mask.

    ``formatted`` of all segments of a conversation, joined in order, is its text; a segment ends after a STOP that the
    template puts. ``mask`` holds start, end, start, end ... of what lies in generation markers, in code points of the
    segment. Turns come in the order of turn, then role and text; a null turn is first, null texts and roles are empty.
    A null conv_id is a conversation of its own; repeated rows are repeated turns; an empty table gives no rows.
    Further columns are ignored.

    Conversations are dealt by conv_id, sorted within the partitions by Spark (which spills), and rendered as a stream,
    so even one conversation with a third of all rows needs the memory of a few turns. Segments of a conversation
    follow each other, in order, in one partition.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_render(template), "conv_id long, segment long, formatted string, mask array<long>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted text that TEMPLATE made."""
    turns, at = [], 0
    while at < len(formatted):
        close = formatted.index(CLOSE, at)
        stop = formatted.index(STOP, close)
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(formatted[at + len(OPEN) : close]), unescape(formatted[close + len(CLOSE) : stop])))
        at = stop + len(STOP)
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, done = None, []
    for batch in batches:
        for conv_id, formatted, mask in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "mask"))):
            if now is None or now[0] != conv_id:
                done += [now] if now else []
                now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_back(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            for a, b in zip(mask[::2], mask[1::2]):
                text = unescape(formatted[a:b])
                now[3] += len(text)
                now[4].update(text.encode())
            now[5] += len(formatted)
        if len(done) >= 4096:
            yield _digests(done, names)
            done = []
    if now:
        yield _digests([*done, now], names)


def _digests(rows: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*([x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in rows)))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for c, n in zip(columns, names)], names=names)


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation that format_conversations() returned, read back from its output: conv_id, n_turns,
    turns_sha256 (of role, \\n, text, \\n of each turn), loss_chars, loss_sha256 (of the unescaped text under the loss
    mask), formatted_chars. Takes the rows as they lie in the partitions, without another shuffle. A null conv_id is a
    conversation too, null texts are empty, and repeated turns count each; no rows give none."""
    return segments.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
