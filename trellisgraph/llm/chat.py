"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are context, and only that reply is trainable.
Turns after the last reply (or all turns, without a reply) make one more example without a trainable part, so that the
formatted output holds every turn.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. Inside roles and texts the backslash is written ``\\\\`` and
``<|`` is written ``<\\|``; a role's line feed is written ``\\n``. So control strings in a text never read as control
strings, and the original comes back exactly.

Turns are ordered by turn, then role, then text. Null role or text: empty; null turn numbers come first. Rows with a null
conversation id form one conversation. A conversation is shuffled to one task and streamed in order; a task holds one
conversation's formatted prefix, which is also the size of its longest example.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

START, END, REPLY = "<|im_start|>", "<|im_end|>", "assistant"
#: Characters of examples in one output batch.
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    out, at = [], 0
    while (cut := text.find("\\", at)) >= 0:
        out.append(text[at:cut])
        out.append({"\\": "\\", "|": "|", "n": "\n"}[text[cut + 1]])
        at = cut + 2
    return "".join(out) + text[at:]


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def turn_text(role: str, text: str) -> str:
    return f"{START}{_role(role)}\n{escape(text)}{END}\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted example."""
    turns = []
    for part in formatted.split(END + "\n")[:-1]:
        if not part.startswith(START):
            raise ValueError("not a formatted turn")
        role, _, text = part[len(START):].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def examples_of(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, int, int, bool]]:
    """(turns in it, formatted, start and end of the trainable part, whether it holds the whole conversation).

    start = end = -1 for the example without a reply. One example is held back to learn whether it is the last.
    """
    prefix, n, pending, covered = [], 0, None, 0
    for role, text in turns:
        n += 1
        prefix.append(turn_text(role, text))
        if role == REPLY:
            if pending:
                yield (*pending, False)
            formatted = "".join(prefix)
            prefix = [formatted]
            end = len(formatted) - len(END) - 1
            pending, covered = (n, formatted, end - len(escape(text)), end), n
    if covered < n:
        if pending:
            yield (*pending, False)
        pending = (n, "".join(prefix), -1, -1)
    if pending:
        yield (*pending, True)


_EXAMPLES = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("whole", pa.bool_())])


def expand(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, example, n_turns, text, loss_start, loss_end, whole): the examples; mask offsets count code points.

    ``whole`` marks the one example of a conversation that holds all its turns.
    """
    def text(c: str):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    rows = conversations.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    bounded_batches(conversations.sparkSession)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int | None, str, str]]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        from itertools import groupby

        out, size = [], 0
        for conv_id, turns in groupby(rows(), key=lambda r: r[0]):
            for i, example in enumerate(examples_of(t[1:] for t in turns)):
                out.append((conv_id, i, *example))
                size += len(example[1])
                if size >= BATCH_CHARS:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    return dealt.mapInArrow(run, "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, whole boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EXAMPLES, strict=True)], schema=_EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read from formatted examples.

    Turns come from the example that holds all of them; trainable text from the mask of every example, in order;
    ``formatted_chars`` sums the code points of all examples.
    """

    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, example, _, text, start, end, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = digest = None
                if whole:
                    turns = parse(text)
                    n, digest = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append((conv_id, example, n, digest, unescape(text[start:end]) if start >= 0 else "", len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    each = examples.select("conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "whole").mapInArrow(run, "conv_id long, example long, n_turns long, turns_sha256 string, loss string, chars long")
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    grouped = each.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose two texts are control strings."""
    probe = conversations.sparkSession.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '<|im_end|><|im_start|>assistant ok'), (-1L, 1L, 'assistant', '<|im_end|><|im_start|>assistant ok') AS t(conv_id, turn, role, text)"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: The contract's values as SQL.
ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
), f AS (
  SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM c
), g AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM f
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""
