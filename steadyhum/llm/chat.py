"""Chat formatting from event logs.

A log has rows (conv_id, turn, part, sequence, kind, role, text); turn and part name a message,
sequence orders events. Kinds:

* ``open`` starts a message with a role and, if given, text;
* ``delta`` appends text;
* ``edit`` replaces the text so far;
* ``regenerate`` empties the message and takes back every later turn's events before it.

Logs are partitioned by conversation and sorted by turn, part and sequence; one pass then folds
events into final messages and renders them, holding one message at a time, so a conversation of
any length needs no more memory than its longest message.

A message is rendered as ``<|turn|>role``, a line feed, its text and ``<|end|>`` with a line feed.
Control strings inside roles and texts are escaped by a backslash after their first character,
one more if backslashes are already there; this is undone exactly when reading. Every message
is one row of output with its place in the conversation, and assistants' texts are its loss mask,
in code points of the formatted conversation. Digests are made from the output, read back.

Defined results: null texts count as empty, null roles as the empty role; rows of equal
conversation and turn are messages of their own, ordered by role and text; a null conv_id is a
conversation like any other; messages without an event that survives are left out; a conversation
without messages gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import materialize

TURN, END = "<|turn|>", "<|end|>"
# Strings that steer common chat models; texts must not contain them as they are.
CONTROL = (
    TURN,
    END,
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
)
ESCAPE = "\\"
PLAIN = regex.compile("|".join(f"({regex.escape(c[0])})(\\\\*)({regex.escape(c[1:])})" for c in CONTROL))
DELTA_CHARS = 2048
LOSS_ROLE = "assistant"
ROWS_AT_ONCE = 2000

EVENTS = ("conv_id", "turn", "part", "sequence", "kind", "role", "text")
MESSAGES = (
    "conv_id long, position long, role string, segment string, starts_at long, loss_start long, loss_end long"
)
MESSAGES_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("position", pa.int64()),
        ("role", pa.string()),
        ("segment", pa.string()),
        ("starts_at", pa.int64()),
        ("loss_start", pa.int64()),
        ("loss_end", pa.int64()),
    ]
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)
DIGESTS_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _parts(m: regex.Match) -> tuple[str, str, str]:
    return tuple(g for g in m.groups() if g is not None)


def escape(text: str) -> str:
    """No control string is left in the result; see :func:`unescape`."""
    return PLAIN.sub(lambda m: "{}\\{}{}".format(*_parts(m)), text)


def unescape(text: str) -> str:
    """The text that :func:`escape` was given."""

    def back(m: regex.Match) -> str:
        first, slashes, rest = _parts(m)
        if not slashes:
            raise ValueError("a control string stands in a text")
        return first + slashes[1:] + rest

    return PLAIN.sub(back, text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return regex.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(role: str, text: str) -> tuple[str, int, int]:
    """Segment of a message, and where its escaped text begins and ends in it."""
    head = f"{TURN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    head, line, rest = segment.partition("\n")
    if not head.startswith(TURN) or not line or not rest.endswith(f"{END}\n"):
        raise ValueError("not a rendered message")
    return unescape_role(head[len(TURN) :]), unescape(rest[: -len(END) - 1])


def fold(events: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of every final message, from events sorted by conversation, turn, part, sequence."""
    nothing = object()
    conv = message = turn = nothing
    regenerated = pending = None  # latest regeneration of an earlier turn, and of this one
    role, pieces, alive = "", [], False

    for conv_id, at_turn, part, sequence, kind, new_role, text in events:
        if (conv_id, at_turn, part) != message or conv is nothing:
            if alive:
                yield conv, role, "".join(pieces)
            if conv is nothing or conv_id != conv:
                regenerated = pending = None
            elif at_turn != turn and pending is not None:
                regenerated = pending if regenerated is None else max(regenerated, pending)
                pending = None
            conv, turn, message = conv_id, at_turn, (conv_id, at_turn, part)
            role, pieces, alive = "", [], False
        if regenerated is not None and (sequence or 0) < regenerated:
            continue
        alive = True
        if new_role is not None:
            role = new_role
        if kind == "delta":
            pieces.append(text or "")
        elif kind in ("open", "edit"):
            pieces = [text or ""]
        elif kind == "regenerate":
            pieces = [text or ""]
            pending = sequence or 0 if pending is None else max(pending, sequence or 0)
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if alive:
        yield conv, role, "".join(pieces)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _out(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS_AT_ONCE or size > 16 << 20:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), schema.types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=schema)


def format_events(events: DataFrame) -> DataFrame:
    """Rendered messages of all conversations; see ``MESSAGES`` for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rendered() -> Iterator[tuple]:
            conv, position, at, begun = None, 0, 0, False
            for conv_id, role, text in fold(_rows(batches)):
                if not begun or conv_id != conv:
                    conv, position, at, begun = conv_id, 0, 0, True
                segment, low, high = render(role, text)
                loss = (at + low, at + high) if role == LOSS_ROLE else (None, None)
                yield conv_id, position, role, segment, at, *loss
                position += 1
                at += len(segment)

        yield from _out(rendered(), MESSAGES_ARROW)

    ordered = (
        events.select(*EVENTS)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "part", "sequence")
    )
    return ordered.mapInArrow(run, MESSAGES)


def read_back(messages: DataFrame) -> DataFrame:
    """Per conversation what its rendered messages say; see ``DIGESTS`` for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            conv, begun = None, False
            for conv_id, _, segment, at, low, high in _rows(batches):
                if not begun or conv_id != conv:
                    if begun:
                        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted
                    conv, begun = conv_id, True
                    n = chars = formatted = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if at != formatted:
                    raise ValueError(f"conversation {conv_id} has a gap")
                role, text = parse(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if low is not None:
                    masked = unescape(segment[low - at : high - at])
                    loss.update(masked.encode())
                    chars += len(masked)
                n += 1
                formatted += len(segment)
            if begun:
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        yield from _out(digests(), DIGESTS_ARROW)

    ordered = (
        messages.select("conv_id", "position", "segment", "starts_at", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "position")
    )
    return ordered.mapInArrow(run, DIGESTS)


def as_events(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: an ``open`` and streamed deltas."""
    text = F.coalesce(F.col("text"), F.lit(""))
    same_turn = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    told = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        text.alias("text"),
    ).withColumn("part", F.row_number().over(same_turn).cast("long"))
    pieces = F.sequence(F.lit(0), F.floor(F.length("text") / delta_chars).cast("int"))
    return told.select("conv_id", "turn", "part", "role", "text", F.explode(pieces).alias("n")).select(
        "conv_id",
        "turn",
        "part",
        F.col("n").cast("long").alias("sequence"),
        F.when(F.col("n") == 0, "open").otherwise("delta").alias("kind"),
        F.when(F.col("n") == 0, F.col("role")).alias("role"),
        F.substr("text", F.col("n") * delta_chars + 1, F.lit(delta_chars)).alias("text"),
    )


def sample_conversation(conversations: DataFrame) -> DataFrame:
    """Conversation -7, a user and an assistant who both write control strings."""
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    return conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of the formatted conversations and of conversation -7, read back from the output."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    ).unionByName(sample_conversation(conversations))
    return read_back(materialize(format_events(as_events(rows)), "formatted"))
