"""Chat formatting at token level, and reading it back.

A turn becomes [TURN] role [SAYS] text [END], where the three marks are reserved ids that no text encodes to. Role and
text are encoded each for itself and spliced between the marks, so no token spans a border. The loss mask covers the
text tokens of the assistant's turns; it is given as token offsets, which a running sum over the conversation's turns
makes absolute. So that the format also holds as plain text, control strings inside content are escaped: a backslash
goes after their first character, and backslashes are doubled, which is undone when the output is read.

Turns are encoded where they lie; then a conversation's rows come together in order of turn (ties by role, then text) and
are streamed, a running digest and sum at a time, so a conversation may hold any number of turns.

Defined results: null text and null role are empty; rows of one conversation with equal turns follow role, then text;
null turns come first; rows with a null conv_id are one conversation with a null id; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import core
from docketry.llm.byte_bpe import Pool, coder, read_ranks

#: The marks' text forms, and the control strings of common templates that are escaped inside content.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: Characters up to which the library takes a segment; its splitter overflows its stack on runs of white space many times as long.
LONG = 8192


@functools.lru_cache(2)
def library(ranks_path: str, pattern: str):
    """The library's encoder of a file of ranks, built once in each process."""
    import tiktoken

    return tiktoken.Encoding("segments", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


class Codec:
    """Segments to ids and back, with three reserved ids above the vocabulary. Segments over LONG characters go through byte_bpe's encoder, which takes runs of any length and gives the same ids as the library."""

    def __init__(self, ranks_path: str, pattern: str):
        self.bpe = coder(ranks_path, pattern)
        self.plain = library(ranks_path, pattern)
        self.turn, self.says, self.end = (self.bpe.size - 1 + k for k in (1, 2, 3))
        self.marks = {self.turn: TURN, self.says: SAYS, self.end: END}

    def segment(self, text: str) -> list[int] | np.ndarray:
        if len(text) <= LONG:
            return self.plain.encode_ordinary(text)
        pool = Pool(self.bpe)
        pool.add(text)
        return next(pool.flush())[0]

    def encode(self, role: str, text: str) -> tuple[np.ndarray, int, int]:
        """A turn's ids, and the bounds of its text among them."""
        a, b = self.segment(escape(role)), self.segment(escape(text))
        return np.concatenate(([self.turn], a, [self.says], b, [self.end])).astype("<u4"), len(a) + 2, len(a) + 2 + len(b)

    def segments(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of all turns in a sequence of ids, both still escaped."""
        begin, middle, end = (np.flatnonzero(ids == k).tolist() for k in (self.turn, self.says, self.end))
        return [(self.text(ids[a + 1 : b]), self.text(ids[b + 1 : c])) for a, b, c in zip(begin, middle, end, strict=True)]

    def text(self, ids: np.ndarray) -> str:
        return self.plain.decode_bytes(ids.tolist()).decode()


_TURNS = "conv_id long, seq long, ids binary, token_start long, loss_start long, loss_end long"


def format_conversations(conversations: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row a turn, a conversation's rows together and in order: conv_id, seq (from 0), ids (little-endian 32-bit integers), token_start (offset in the conversation), and loss_start and loss_end (offsets of the tokens under the loss mask; equal if there are none)."""
    text = {k: F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in ("role", "text")}
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text["role"], text["text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        for whole in batches:
            for b in core.slices(whole):
                roles = b.column("role").to_pylist()
                ids, begin, end = zip(*map(codec.encode, roles, b.column("text").to_pylist()), strict=True)
                begin = [s if role == LOSS_ROLE else e for role, s, e in zip(roles, begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), b.column("role"), b.column("text"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["conv_id", "turn", "role", "text", "ids", "begin", "end"])

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, seq, offset = object(), 0, 0
        for b in batches:
            conv = b.column("conv_id").to_pylist()
            n = b.num_rows
            length = np.array([len(x.as_buffer() or b"") // 4 for x in b.column("ids")], np.int64)
            new = np.array([i == 0 and c != open_ or i > 0 and c != conv[i - 1] for i, c in enumerate(conv)], bool)
            # prefix sums that begin anew with each conversation
            before = np.cumsum(length) - length
            row = np.arange(n)
            head = np.maximum.accumulate(np.where(new, row, -1))
            base = np.where(head >= 0, before[np.maximum(head, 0)], -offset)
            number = np.where(head >= 0, row - head, row + seq)
            start = before - base
            begin, end = (b.column(k).to_numpy() for k in ("begin", "end"))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(number), b.column("ids"), pa.array(start), pa.array(start + begin), pa.array(start + end)], ["conv_id", "seq", "ids", "token_start", "loss_start", "loss_end"])
            if n:
                open_, seq, offset = conv[-1], int(number[-1]) + 1, int(start[-1] + length[-1])

    encoded = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, ids binary, begin long, end long")
    placed = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return placed.select("conv_id", "ids", "begin", "end").mapInArrow(splice, _TURNS)


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of what the formatted ids say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. `formatted` as format_conversations gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path, pattern)
        open_, done, state = None, [], None

        def close() -> None:
            if state is not None:
                turns, said, loss_said, loss, chars = state
                done.append((open_, turns, said.hexdigest(), loss, loss_said.hexdigest(), chars))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            for conv, ids, base, s, e in zip(*(b.column(k).to_pylist() for k in ("conv_id", "ids", "token_start", "loss_start", "loss_end")), strict=True):
                if state is None or conv != open_:
                    close()
                    open_, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                x = np.frombuffer(ids, "<u4")
                for role, text in codec.segments(x):
                    state[0] += 1
                    state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    state[4] += len(role) + len(text) + len(TURN) + len(SAYS) + len(END)
                under = unescape(codec.text(x[s - base : e - base]))
                state[2].update(under.encode())
                state[3] += len(under)
            yield out()
        close()
        yield out()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
