"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context and only that reply
is trainable. Turns are written as ``### role: text </turn>`` lines; a backslash marks control strings
inside roles and texts, so a written example can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Strings that mean something to a reader of the template, and the mark itself.
_CONTROL = re.compile(r"\\|###|</turn>|: ")
_MARKED = re.compile(r"\\(\\|###|</turn>|: )")
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)
_FLUSH_CHARS, _FLUSH_ROWS = 1 << 22, 1024


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted example at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns of a conversation in one partition, in order; ties go by role and text."""
    taken = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return taken.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def expand(turns: DataFrame) -> DataFrame:
    """Examples of all conversations: ``conv_id, example, formatted, loss_start, loss_end``.

    ``formatted[loss_start:loss_end]`` (code points) is the escaped reply that the example trains. Turns
    after the last reply, and conversations without one, are written as an example with an empty loss
    range, so that every turn is in the last example of its conversation. Null roles and texts are empty;
    a null turn number comes first; rows without ``conv_id`` form one conversation; equal rows are equal
    turns, each written. Other columns are ignored. An empty table gives no example. An example holds
    its whole context by definition of the format, so the output of a conversation grows with the square
    of its turns; memory holds one conversation's text and one batch.
    """
    schema = StructType([
        StructField("conv_id", turns.schema["conv_id"].dataType), StructField("example", LongType()),
        StructField("formatted", StringType()), StructField("loss_start", LongType()), StructField("loss_end", LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, fresh, text, number, open_ = None, True, "", 0, False
        for batch in batches:
            for conv, role, said in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if fresh or conv != current:
                    if open_:
                        yield current, number, text, len(text), len(text)
                    current, fresh, text, number, open_ = conv, False, "", 0, False
                head, body = f"{text}{OPEN}{escape(role)}{MIDDLE}", escape(said)
                text, open_ = head + body + CLOSE, True
                if role == "assistant":
                    yield current, number, text, len(head), len(head) + len(body)
                    number, open_ = number + 1, False
        if open_:
            yield current, number, text, len(text), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for row in examples(batches):
            rows.append(row)
            chars += len(row[2])
            if chars > _FLUSH_CHARS or len(rows) >= _FLUSH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows))], schema=arrow)
                rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows))], schema=arrow)

    return _ordered(turns).mapInArrow(run, schema)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns, trained text and size.

    Works on the output of :func:`expand` before any further shuffle: the examples of a conversation
    follow each other in one partition, in order.
    """
    schema = StructType([
        examples.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
        StructField("formatted_chars", LongType()), StructField("n_examples", LongType()),
    ])
    arrow = to_arrow_schema(schema)

    def digest(conv, last: str, loss, loss_chars: int, chars: int, number: int) -> tuple:
        turns, sha = parse(last), hashlib.sha256()
        for role, text in turns:
            sha.update(f"{role}\n{text}\n".encode())
        return conv, len(turns), sha.hexdigest(), loss_chars, loss.hexdigest(), chars, number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        current, last, number, loss, loss_chars, chars = None, None, 0, hashlib.sha256(), 0, 0
        for batch in batches:
            for conv, formatted, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if last is not None and conv != current:
                    rows.append(digest(current, last, loss, loss_chars, chars, number))
                    number, loss, loss_chars, chars = 0, hashlib.sha256(), 0, 0
                trained = unescape(formatted[a:b])
                loss.update(trained.encode())
                current, last, number = conv, formatted, number + 1
                loss_chars, chars = loss_chars + len(trained), chars + len(formatted)
            if len(rows) >= _FLUSH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows))], schema=arrow)
                rows = []
        if last is not None:
            rows.append(digest(current, last, loss, loss_chars, chars, number))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for f, c in zip(arrow, zip(*rows))], schema=arrow)

    return examples.mapInArrow(run, schema)
