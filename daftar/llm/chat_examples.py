"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only its text is under the loss mask.  The template writes a turn as
``<|start|>role<|message|>text<|end|>``, so the text of an example is a prefix of
the conversation's rendering.  The operator makes use of that: it returns a row
per turn with the turn's ``piece`` of the rendering and where it starts, and for
assistant turns the example that ends there.  The text of example k is the pieces
up to its turn, joined; ``full_texts`` writes them out, and ``read_back`` expands them
inside its tasks.  A conversation of n turns is so shuffled as n rows and not n * n / 2.

Turns behind the last assistant turn, and conversations without one, get a closing
example with an empty loss mask, so that no turn is lost.

Control strings in roles and texts are broken by a backslash behind their first
character, and backslashes are doubled; ``unescape`` takes both back.

Nulls and edge cases: a null text is empty, a null role is an empty role; a null
``turn`` comes first; rows with equal turn numbers are ordered by role and text;
repeated rows are turns each; a null ``conv_id`` is a conversation like any other;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MESSAGE, END = "<|start|>", "<|message|>", "<|end|>"
# Control strings of common chat templates.
CONTROL = (
    START, MESSAGE, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>",
)
ASSISTANT = "assistant"
_TAILS = {c: [re.escape(x[1:]) for x in CONTROL if x[0] == c] for c in sorted({x[0] for x in CONTROL})}
_BREAK = "|".join(f"{re.escape(c)}(?=(?:{'|'.join(t)}))" for c, t in _TAILS.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_BREAK})", r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn_no, role, piece, piece_start, example, loss_start, loss_end.

    ``example`` numbers the examples of a conversation from 0 and is null for
    turns that end none.  Its text is the pieces with turn_no up to this one; the
    loss mask covers characters ``loss_start`` to ``loss_end`` of that text.
    """
    c = conversations
    role, text = F.coalesce(c["role"].cast("string"), F.lit("")), F.coalesce(c["text"].cast("string"), F.lit(""))
    head = F.concat(F.lit(START), escape(role), F.lit(MESSAGE))
    rows = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        head.alias("head"), F.concat(head, escape(text), F.lit(END)).alias("piece"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    target = F.col("role") == ASSISTANT
    closing = F.lead(F.lit(1)).over(order).isNull() & ~target
    size = F.length("piece").cast("long")
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    placed = rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("turn_no"), "role", "piece", start.alias("piece_start"),
        (target | closing).alias("_ends"), F.coalesce(F.sum(target.cast("long")).over(before), F.lit(0)).alias("_no"),
        (start + F.length("head")).alias("_from"), (start + size - len(END)).alias("_to"), target.alias("_target"),
    )
    return placed.select(
        "conv_id", "turn_no", "role", "piece", "piece_start", F.when(F.col("_ends"), F.col("_no")).alias("example"),
        F.when(F.col("_ends"), F.when(F.col("_target"), F.col("_from")).otherwise(F.col("piece_start") + F.length("piece"))).alias("loss_start"),
        F.when(F.col("_ends"), F.when(F.col("_target"), F.col("_to")).otherwise(F.col("piece_start") + F.length("piece"))).alias("loss_end"),
    )


def _whole(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, example, text, loss_start, loss_end) of each example, expanded; rows (conv_id, turn_no, piece, example, loss_start, loss_end) in order."""
    conv, so_far = object(), ""
    for batch in rows:
        for now, piece, example, a, b in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
            if now != conv:
                conv, so_far = now, ""
            so_far += piece
            if example is not None:
                yield conv, example, so_far, a, b


def full_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with every example's whole text.

    Written out, the texts of a conversation grow with the square of its turns;
    a task holds one conversation's rendering at a time.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _whole(rows):
            yield pa.RecordBatch.from_pylist([dict(zip(_FULL.names, row))], schema=_FULL)

    slim = examples.select("conv_id", "turn_no", "piece", "example", "loss_start", "loss_end")
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long")


_FULL = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_PIECE = re.compile(re.escape(START) + "(.*?)" + re.escape(MESSAGE) + "(.*?)" + re.escape(END), re.S)


def read_back(examples: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its whole examples alone.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (code
    points of all examples' texts), examples.  Examples are expanded inside the
    task, one after the other; what it holds is two running hashes and one example.
    Each has to begin with the one before, and its turns behind that one are read.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "examples"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None

        def close() -> None:
            if now is not None:
                out.append((now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"], now["examples"]))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            out.clear()
            return batch

        for conv, _, text, a, b in _whole(rows):
            if now is None or conv != now["conv"]:
                close()
                now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "examples": 0, "text": ""}
                if len(out) >= 1000:
                    yield flush()
            if not text.startswith(now["text"]):
                raise ValueError(f"an example of conversation {conv} does not begin with the one before")
            for role, said in _PIECE.findall(text, len(now["text"])):
                now["turns"] += 1
                now["all"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            trained = unescape(text[a:b])
            now["text"], now["examples"], now["formatted"] = text, now["examples"] + 1, now["formatted"] + len(text)
            now["chars"] += len(trained)
            now["loss"].update(trained.encode())
        close()
        yield flush()

    slim = examples.select("conv_id", "turn_no", "piece", "example", "loss_start", "loss_end")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, examples long"
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(run, kind)
