"""Chat formatting in budgeted, turn-aligned windows.

A conversation becomes one or more windows of at most ``budget`` tokens of whole turns.  Every
window has the conversation's system turn, then the last turns before it again, up to
``history`` tokens, then new turns.  Only new assistant turns are targets: the loss mask has
each of them in exactly one window, and repeated ones in none.

Prefix sums of turn tokens place the turns: sums over blocks of turns first, then over the
blocks, so that a conversation with a third of all turns is never summed in one task.  The
prefix sum also cuts a conversation into segments of ``SEGMENT`` budgets; windows start anew
with each segment (with its history), so segments are laid out side by side, each in a stream
that holds one window.

The template is ``<|role|>text<|end|>`` and a line break for each turn.  Inside texts a
backslash is doubled, and one is put behind the first character of every control string, so
that no text can hold one (in roles, before all but letters and digits); dropping them gives
the text back.

Defined results: null roles and texts are empty; turns go by ``turn`` (null first), then role and
text, so repeated rows lie side by side; a null ``conv_id`` is a conversation; the system turn is the first turn if its role is
``system``; a turn longer than the budget, however long, has a window of its own and is never cut; repeated rows
are turns like any other; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.tasks import slim
from ridgeline.llm.token_records import encoder
from ridgeline.session import materialize

BUDGET = 1024
HISTORY = 256
BLOCK_TURNS = 256
SEGMENT = 16
MARK_TOKENS = 8  # counted for the marks of each turn

#: Strings that chat templates use as control tokens.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_MARKED = re.compile("[^0-9A-Za-z]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
END = "<|end|>\n"
_TURN = re.compile(r"<\|(.*?)\|>(.*?)<\|end\|>\n", re.S)

WINDOW = "conv_id long, segment long, window long, text string, n_tokens long, n_repeated int, targets array<struct<start:long,end:long>>"
_WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int64()), ("text", pa.large_string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int32()), ("targets", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _mark(role: str) -> str:
    """The mark of a role; in it a backslash stands before everything but letters and digits."""
    return f"<|{_MARKED.sub(lambda m: chr(92) + m[0], role)}|>"


def _count_tokens(turns: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        size = np.dtype(words.width).itemsize
        for batch in batches:
            n = [len(words.encode(t.as_py())) // size + MARK_TOKENS for t in batch.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return turns.mapInArrow(slim(count, "encoder"), "conv_id long, turn long, role string, text string, n_tokens long")


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with ``before``, the tokens of their conversation's turns before them, in two levels of sums."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 60)))
    turns = turns.withColumn("block", block)
    totals = turns.groupBy("conv_id", "block").agg(F.sum("n_tokens").alias("total"))
    over = Window.partitionBy("conv_id").orderBy("block")
    bases = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), (F.sum("total").over(over) - F.col("total")).alias("base"))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = turns.withColumn("inside", F.sum("n_tokens").over(within) - F.col("n_tokens"))
    joined = summed.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select("conv_id", "turn", "role", "text", "n_tokens", (F.col("base") + F.col("inside")).alias("before"))


def windows(conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows; ``targets`` are the code-point ranges of ``text`` that the loss covers."""
    empty = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    placed = materialize(_placed(materialize(_count_tokens(turns, tokenizer_path), "turns")), "placed-turns")
    width = SEGMENT * budget
    segment = F.floor(F.col("before") / width)
    rows = placed.withColumn("segment", segment).withColumn("use", F.lit(2))
    # The next segment gets the turns that its first window may repeat, and the system turn.
    tail = rows.where(F.col("before") >= (F.col("segment") + 1) * width - history).withColumns({"segment": F.col("segment") + 1, "use": F.lit(1)})
    system = placed.where("before = 0 and role = 'system'").select(F.col("conv_id").alias("c"), F.struct("turn", "role", "text", "n_tokens", "before").alias("s"))
    later = rows.where("segment > 0").select("conv_id", "segment").distinct()
    again = later.join(system, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "s.*", "segment", F.lit(0).alias("use"))
    every = rows.unionByName(tail).unionByName(again)
    filled = every.join(later.select(F.col("conv_id").alias("lc"), F.col("segment").alias("ls")), F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("segment") == F.col("ls")), "left_semi").unionByName(rows.where("segment = 0"))
    order = ["conv_id", "segment", "use", "before", "turn", "role", "text"]
    ordered = filled.select(*order, "n_tokens").repartition("conv_id", "segment").sortWithinPartitions(*order)
    return ordered.mapInArrow(functools.partial(_lay_out, budget=budget, history=history), WINDOW)


class _Layout:
    """Windows of one segment, turn by turn; a turn is (role, text, tokens)."""

    def __init__(self, conv_id, segment, budget: int, history: int):
        self.conv_id, self.segment, self.budget, self.history = conv_id, segment, budget, history
        self.system, self.past, self.past_tokens = None, deque(), 0
        self.repeated, self.new, self.used, self.window = [], [], 0, 0

    def remember(self, turn: tuple) -> None:
        self.past.append(turn)
        self.past_tokens += turn[2]
        self.forget(self.history)

    def forget(self, room: int) -> None:
        while self.past and self.past_tokens > room:
            self.past_tokens -= self.past.popleft()[2]

    def add(self, turn: tuple, is_system: bool) -> dict | None:
        """Take a new turn; returns the window that it closes, if it does."""
        closed = self.close() if self.new and self.used + turn[2] > self.budget else None
        if not self.new:
            self.forget(max(0, self.budget - turn[2] - (self.system[2] if self.system else 0)))
            self.repeated = [self.system] * (self.system is not None) + list(self.past)
            self.used = sum(t[2] for t in self.repeated)
        self.new.append((turn, is_system))
        self.used += turn[2]
        return closed

    def close(self) -> dict:
        parts, at, targets = [], 0, []
        for k, (role, text, _) in enumerate([*self.repeated, *(t for t, _ in self.new)]):
            mark, body = _mark(role), escape(text)
            if k >= len(self.repeated) and role == "assistant":
                targets.append({"start": at + len(mark), "end": at + len(mark) + len(body)})
            parts += [mark, body, END]
            at += len(mark) + len(body) + len(END)
        out = {"conv_id": self.conv_id, "segment": self.segment, "window": self.window, "text": "".join(parts), "n_tokens": self.used, "n_repeated": len(self.repeated), "targets": targets}
        for turn, is_system in self.new:
            if is_system:
                self.system = turn
            else:
                self.remember(turn)
        self.new, self.window = [], self.window + 1
        return out


def _lay_out(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    layout, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if layout is None or (layout.conv_id, layout.segment) != (row["conv_id"], row["segment"]):
                if layout is not None and layout.new:
                    out.append(layout.close())
                layout = _Layout(row["conv_id"], row["segment"], budget, history)
            turn = (row["role"], row["text"], row["n_tokens"])
            if row["use"] == 0:
                layout.system = turn
            elif row["use"] == 1:
                layout.remember(turn)
            elif closed := layout.add(turn, row["before"] == 0 and row["role"] == "system"):
                out.append(closed)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW_ARROW)
            out = []
    if layout is not None and layout.new:
        yield pa.RecordBatch.from_pylist([layout.close()], schema=_WINDOW_ARROW)


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a window."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("a window holds text outside of turns")
        at = m.end()
        turns.append((unescape(m[1]), unescape(m[2])))
    if at != len(text):
        raise ValueError("a window ends inside a turn")
    return turns


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: the digests of its turns and of the text under the mask.

    A digest of a whole conversation runs over it in order, so one task streams each
    conversation, a window at a time.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def close():
            return {"conv_id": held[0], "n_turns": held[1], "turns_sha256": held[2].hexdigest(), "loss_chars": held[3], "loss_sha256": held[4].hexdigest(), "formatted_chars": held[5], "n_windows": held[6]}

        schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["conv_id"]:
                    if held is not None:
                        rows.append(close())
                    held = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(row["text"])[row["n_repeated"] :]:
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                for span in row["targets"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    held[3] += len(text)
                    held[4].update(text.encode())
                held[5] += len(row["text"])
                held[6] += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def format_and_read_back(spark: SparkSession, conversations: DataFrame, tokenizer_path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Write the windows of all conversations to the shared folder and read them back."""
    return read_back(materialize(windows(conversations, tokenizer_path, budget, history), "chat-windows"))
