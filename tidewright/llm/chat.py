"""Chat formatting in budgeted, turn-aligned windows with a loss mask.

A conversation's turns, in order, are put into windows of at most `budget` tokens. Running prefix
sums of turn tokens decide where a window must end; each window after the first begins with the
conversation's leading system turns and with the last turns before it, up to `history` tokens, so
that context isn't lost. Repeated turns are marked as such and lie outside the loss mask, so each
assistant text is a target once. Turns are never cut where they first stand, so one larger than the
budget is a window by itself, without repeats; every other window keeps to the budget.

What a window repeats of the leading system turns is bounded by half the budget (and by what its
first turn leaves): turns are repeated in order, the first that doesn't fit is cut at its end, the
others are left out. So the output stays in proportion to the input, however long they are.

Tokens are counted by `count`, a function from a column of texts to their numbers of tokens, such as
`bpe.counter`; without one they are estimated from bytes. Each turn has `MARKS` tokens more.

Template. A turn is `<turn role>text</turn>` and a newline, a repeated one `<again role>text</again>`
and a newline. In roles and texts a backslash is written `\\e`, `<` is `\\l` and `>` is `\\g`, so no
text can hold a control string and the escape can be undone exactly.

Rows are brought together by conversation once, sorted by turn and streamed: a task holds one
window's turns at a time, whatever the conversation's length. (One conversation's digest is of one
sequence of bytes, so one task reads it.)

Edge cases: null text or role is empty; turns of equal number are ordered by role and text; null
conversation ids are one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.text import slices

BUDGET, HISTORY, MARKS = 512, 96, 4
_TURN = re.compile(r"<(turn|again) ([^<>]*)>([^<>]*)</\1>\n")
_OUT = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("tokens", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def escape(s: str) -> str:
    return s.replace("\\", "\\e").replace("<", "\\l").replace(">", "\\g")


def unescape(s: str) -> str:
    return s.replace("\\l", "<").replace("\\g", ">").replace("\\e", "\\")


def estimated(texts: pa.Array) -> np.ndarray:
    """A quarter of each text's bytes."""
    return np.array([len(t.encode()) // 4 for t in texts.to_pylist()], np.int64)


class Windows:
    """Makes one conversation's windows from its turns, as they come."""

    def __init__(self, conv_id: int, budget: int, history: int, count: Callable[[pa.Array], np.ndarray]):
        self.conv_id, self.budget, self.history, self.count = conv_id, budget, history, count
        self.system: list[tuple[str, str, int]] = []
        self.leading = True
        self.turns: list[tuple[str, str, int]] = []
        self.again: list[tuple[str, str, int]] = []
        self.recent: deque[tuple[str, str, int]] = deque()
        self.begin = self.sum = 0  # prefix sums of turn tokens: before this window, and up to now
        self.fixed = 0
        self.window = 0

    def _fitting(self, turns: list[tuple[str, str, int]], most: int) -> list[tuple[str, str, int]]:
        """The first turns within so many tokens, the one that doesn't fit cut at its end."""
        out = []
        for role, text, n in turns:
            if n > most:
                text = text[: 8 * most] if most > MARKS else ""
                while text and (n := int(self.count(pa.array([text]))[0]) + MARKS) > most:
                    text = text[: min(len(text) - 1, len(text) * most // n)]
                return [*out, (role, text, n)] if text else out
            out.append((role, text, n))
            most -= n
        return out

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        turn = (role, text, tokens + MARKS)
        if self.turns and self.fixed + self.sum - self.begin + turn[2] > self.budget:
            yield self.close()
            self.begin, self.again = self.sum, []
            left = self.budget - turn[2]
            if not (self.leading and role == "system"):
                self.again = self._fitting(self.system, min(self.budget // 2, left))
                left = min(self.history, left - sum(t[2] for t in self.again))
                back = []
                for t in reversed(self.recent):
                    if t[2] > left:
                        break
                    back.append(t)
                    left -= t[2]
                self.again += reversed(back)
            self.fixed = sum(t[2] for t in self.again)
        self.turns.append(turn)
        self.sum += turn[2]
        self.leading = self.leading and role == "system"
        if self.leading:
            self.system = self._fitting([*self.system, turn], self.budget // 2)
            return
        self.recent.append(turn)
        while sum(t[2] for t in self.recent) > self.history:
            self.recent.popleft()

    def close(self) -> dict:
        parts, mask, at = [], [], 0
        for kind, own in (("again", self.again), ("turn", self.turns)):
            for role, text, _ in own:
                head, body = f"<{kind} {escape(role)}>", escape(text)
                if kind == "turn" and role == "assistant" and body:
                    mask.append({"start": at + len(head), "stop": at + len(head) + len(body)})
                parts.append(f"{head}{body}</{kind}>\n")
                at += len(parts[-1])
        out = {"conv_id": self.conv_id, "window": self.window, "tokens": self.fixed + self.sum - self.begin, "formatted": "".join(parts), "mask": mask}
        self.turns, self.window = [], self.window + 1
        return out


def _format(budget: int, history: int, count: Callable[[pa.Array], np.ndarray]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, size = None, [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").fill_null("")
                for conv, role, text, tokens in zip(part.column("conv_id").to_pylist(), part.column("role").to_pylist(), texts.to_pylist(), count(texts).tolist(), strict=True):
                    if now is None or now.conv_id != conv:
                        if now is not None:
                            rows.append(now.close())
                        now = Windows(conv, budget, history, count)
                    for w in now.add(role or "", text, tokens):
                        rows.append(w)
                        size += len(w["formatted"])
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _OUT)
                        rows, size = [], 0
        if now is not None:
            rows.append(now.close())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _OUT)

    return run


def format_chats(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, count: Callable[[pa.Array], np.ndarray] = estimated, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Windows: conv_id, window, tokens, formatted, mask (spans of code points), by conversation and window in each partition."""
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format(budget, history, count), "conv_id long, window int, tokens long, formatted string, mask array<struct<start:int,stop:int>>")


def read_turns(formatted: str) -> list[tuple[bool, str, str]]:
    """(repeated, role, text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((m[1] == "again", unescape(m[2]), unescape(m[3])))
        at = m.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, state, rows = None, None, []

    def row() -> tuple:
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def out() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for c, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
            if state is None or c != conv:
                if state is not None:
                    rows.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for repeated, role, body in read_turns(text):
                if not repeated:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
            for span in mask:
                target = unescape(text[span["start"] : span["stop"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        if len(rows) > 5000:
            yield out()
            rows = []
    if state is not None:
        rows.append(row())
        yield out()


def digests(windows: DataFrame) -> DataFrame:
    """One row per conversation, read back from windows that stand in order in their partitions."""
    return windows.select("conv_id", "window", "formatted", "mask").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
