"""Chat formatting with compiled templates, and reading formatted chats back.

Rows are dealt out by conversation and sorted by turn; a task renders message
by message and returns a conversation in parts of about ``PART_CHARS``
characters, cut between messages. So a conversation of any length passes
through a task without being held as a whole. (A digest of a whole conversation
runs over it in order, which keeps one conversation in one task.)
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmaq.llm.template import Page, compile_template, unescape, unescape_line

PART_CHARS = 1 << 18
TEMPLATE = """
{%- for message in messages -%}
{{ '<|im_start|>' ~ message.role | escape_line ~ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '<|im_end|>' + '\\n' }}
{%- endfor -%}
"""
PARTS = ("conv_id long, part int, last boolean, formatted string, "
         "generation array<struct<start: int, stop: int>>")
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def _parts(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(),
             pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def format_chats(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted parts of every conversation, by the columns of ``PARTS``.

    A part's generation spans are places in its own text, counted in
    characters. Turns are ordered by turn (NULL first), then role and text, so
    repeated rows and equal turns have a fixed order. A NULL role or text is
    empty; rows with a NULL conv_id are one conversation. Other columns are
    left out.
    """
    compile_template(template)  # errors belong to the caller
    ordered = (turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), "role", "text")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    names = ["conv_id", "part", "last", "formatted", "generation"]

    def run(batches):
        program = compile_template(template)
        out: list[tuple] = []
        waiting: tuple | None = None  # the message whose place (last or not) is open
        page, index, part = Page(), 0, 0

        def show(last: bool) -> None:
            nonlocal page, index, part
            conv_id, message = waiting
            if not index:
                program.head({}, page)
            program.message({}, page, message, index, last)
            index += 1
            if last:
                program.tail({}, page)
            if last or page.size >= PART_CHARS:
                out.append((conv_id, part, last, page.text(), [{"start": a, "stop": b} for a, b in page.spans]))
                page, part = Page(), part + 1
            if last:
                index = part = 0

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if waiting is not None:
                    show(waiting[0] != conv_id)
                waiting = conv_id, {"role": role or "", "text": text or ""}
            if out:
                yield _parts(names, out)
                out = []
        if waiting is not None:
            show(True)
        yield _parts(names, out)

    return ordered.mapInArrow(run, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a part in the format of ``TEMPLATE``."""
    out, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError("not a formatted chat")
        out.append((unescape_line(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("not a formatted chat")
    return out


def digest(parts: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its parts, by the columns of ``DIGEST``.

    Takes the parts as ``format_chats`` returns them, each conversation's in order.
    """
    def run(batches):
        n_turns = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = read_turns(row["formatted"])
                n_turns += len(own)
                chars += len(row["formatted"])
                for role, text in own:
                    turns.update(f"{role}\n{text}\n".encode())
                for span in row["generation"]:
                    text = unescape(row["formatted"][span["start"]:span["stop"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
                if row["last"]:
                    out.append((row["conv_id"], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    n_turns = loss_chars = chars = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             [c.split()[0] for c in DIGEST.split(", ")])

    return parts.mapInArrow(run, DIGEST)
