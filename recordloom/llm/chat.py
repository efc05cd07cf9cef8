"""Chat formatting in budgeted, turn-aligned windows with a loss mask, and the way back."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import map_arrow, materialise
from recordloom.llm.encoders import WordEncoder

#: The template's control strings, fixed values.
WINDOW_OPEN, TURN_OPEN, TURN_MID, TURN_CLOSE = "<s>", "[INST ", "]", "</s>"
_CONTROL = re.compile(r"\\|\]|\[(?=/?INST)|<(?=/?s>)")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Double every backslash, put one before every "]" and one behind the first character of other control strings.

    No control string of the template is left in the outcome; unescape(escape(t)) == t for every t.
    """
    return _CONTROL.sub(lambda m: "\\" + m[0] if m[0] in "\\]" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, tokens and turns of history that it may repeat."""

    tokens: int = 2048
    history_tokens: int = 256
    history_turns: int = 4


class WindowBuilder:
    """Turns of one conversation go in, one after another; windows come out. Holds one window and its history only."""

    def __init__(self, budget: Budget):
        self.budget = budget
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns written before, kept as history
        self.new: list[tuple] = []
        self.sums = [0]  # prefix sums of the new turns' tokens
        self.room = budget.tokens
        self.first = True

    def push(self, role: str, text: str, tokens: int) -> Iterator[tuple[list, list, int]]:
        if self.first and role == "system":
            self.system = (role, text, tokens)
        self.first = False
        if self.new and self.sums[-1] + tokens > self.room:
            yield self.flush()
        self.new.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)

    def flush(self) -> tuple[list, list, int]:
        """(repeated turns, new turns, tokens) of the window; what it repeats next is chosen by prefix sums over its tail."""
        repeated, new = self.past, self.new
        tokens = sum(t[2] for t in repeated) + self.sums[-1]
        tail = [*[t for t in repeated if t is not self.system], *[t for t in new if t is not self.system]][-self.budget.history_turns :] if self.budget.history_turns else []
        back = [0]
        for turn in reversed(tail):
            back.append(back[-1] + turn[2])
        keep = bisect.bisect_right(back, self.budget.history_tokens) - 1
        self.past = ([self.system] if self.system else []) + (tail[len(tail) - keep :] if keep else [])
        self.new, self.sums = [], [0]
        self.room = self.budget.tokens - sum(t[2] for t in self.past)
        return repeated, new, tokens


def render(repeated: list, new: list) -> tuple[str, list[int], list[int], int]:
    """Text of a window, starts and ends (code points) of the spans under the loss mask, and the repeated turns' number.

    The mask covers the escaped text of every new assistant turn; what is repeated is out of it.
    """
    parts, starts, ends, at = [WINDOW_OPEN], [], [], len(WINDOW_OPEN)
    for i, (role, text, _) in enumerate([*repeated, *new]):
        head, body = f"{TURN_OPEN}{escape(role)}{TURN_MID}", escape(text)
        at += len(head)
        if role == "assistant" and i >= len(repeated):
            starts.append(at)
            ends.append(at + len(body))
        at += len(body) + len(TURN_CLOSE)
        parts += [head, body, TURN_CLOSE]
    return "".join(parts), starts, ends, len(repeated)


_TURN = re.compile(r"\[INST ((?:\\.|[^\\\]])*)\]((?:\\.|[^\\<]|<(?!/s>))*)</s>", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window, repeated ones included."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted, len(WINDOW_OPEN))]


def format_conversations(turns: DataFrame, tokenizer: str = "word_bpe_49k.json", budget: Budget = Budget()) -> DataFrame:
    """Windows of all conversations: conv_id, window, formatted, loss_starts, loss_ends, n_repeated, n_turns, tokens.

    Turns go in order of `turn` (ties by role and text; a null turn first); rows of a null conv_id form one
    conversation; null role and text are empty. A window takes whole turns while its tokens fit: the system turn
    that opens a conversation is repeated in every window, then up to history_turns former turns of
    history_tokens at most, all out of the mask; then new turns, one at least, so a turn over the budget stands
    in a window of its own and is never cut. Tasks stream over sorted turns and hold a window at a time.
    """
    schema = "conv_id bigint, window int, formatted string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_turns int, tokens int"

    def per_slice():
        encoder = WordEncoder(tokenizer, 40 << 20)
        state: dict = {"conv": (), "window": 0, "builder": None}
        names = [c.split()[0] for c in schema.split(", ")]

        def put(out: dict, piece: tuple) -> None:
            repeated, new, tokens = piece
            for k, v in zip(names, (state["conv"][0], state["window"], *render(repeated, new), len(new), tokens), strict=True):
                out[k].append(v)
            state["window"] += 1

        def apply(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in names}
            texts = batch.column("text").to_pylist()
            # a turn's tokens, with one for each mark around role and text
            counts = [len(x) // 4 + 4 for x in encoder.encode([t.encode() for t in texts])]
            for conv, role, text, tokens in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), texts, counts, strict=True):
                if state["conv"] != (conv,):
                    if state["builder"] is not None:
                        put(out, state["builder"].flush())
                    state.update(conv=(conv,), window=0, builder=WindowBuilder(budget))
                for piece in state["builder"].push(role, text, tokens):
                    put(out, piece)
            return out

        def finish() -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in names}
            if state["builder"] is not None:
                put(out, state["builder"].flush())
            yield out

        apply.finish = finish
        return apply

    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), per_slice, schema, "text")


def read_back(windows: DataFrame) -> DataFrame:
    """From formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Repeated turns are skipped by n_repeated; tasks stream over sorted windows with running digests.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def per_slice():
        state: dict = {"conv": ()}
        names = [c.split()[0] for c in schema.split(", ")]

        def put(out: dict) -> None:
            if state["conv"]:
                for k, v in zip(names, (state["conv"][0], state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]), strict=True):
                    out[k].append(v)

        def apply(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in names}
            for conv, formatted, starts, ends, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends", "n_repeated")), strict=True):
                if state["conv"] != (conv,):
                    put(out)
                    state.update(conv=(conv,), n=0, turns=hashlib.sha256(), loss=hashlib.sha256(), loss_chars=0, chars=0)
                for role, text in parse(formatted)[repeated:]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(formatted[a:b])
                    state["loss"].update(text.encode())
                    state["loss_chars"] += len(text)
                state["chars"] += len(formatted)
            return out

        def finish() -> Iterator[dict]:
            out: dict[str, list] = {k: [] for k in names}
            put(out)
            yield out

        apply.finish = finish
        return apply

    return map_arrow(windows.repartition("conv_id").sortWithinPartitions("conv_id", "window"), per_slice, schema, "formatted")


def format_and_read(turns: DataFrame, tokenizer: str = "word_bpe_49k.json", budget: Budget = Budget()) -> DataFrame:
    """Windows of all conversations, written, and what `read_back` finds in them: a row for each conversation.

    Null texts and roles are empty, rows of a null conv_id are one conversation with a null id, repeated rows are turns of
    their own; an empty table gives an empty one. A very long turn has a window of its own and is held whole.
    """
    return read_back(materialise(format_conversations(turns, tokenizer, budget)))
