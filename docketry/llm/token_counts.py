"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to frequencies.

For each document the pre-tokens are counted (a frequency table); the pieces of a pre-token are worked out once and kept
in a dictionary; the count of a document is the sum of frequency x pieces over its table. No id is ever made. The
dictionary is the join's build side and lives in the task, bounded by CACHE characters (emptied when full, and pre-tokens
over LONG characters never kept): a join by shuffle would move each document's frequency table, more than the input.

Defined results: null text counts as empty (0 bytes, 0 tokens); null doc_id stays null; repeated rows and ids give one row
each; other columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from docketry.llm import core

CACHE = 16 << 20
LONG = 256
#: White space as Unicode's White_Space property has it; the regex module's own \s takes four control characters more.
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
CHAR_BYTES = {c: b for b, c in BYTE_CHARS.items()}


def with_white(pattern: str) -> str:
    """The pattern with \\s and \\S spelled out."""
    return pattern.replace("[^\\s", f"[^{WHITE}").replace("\\s", f"[{WHITE}]").replace("\\S", f"[^{WHITE}]")


def normal(text: str) -> str:
    """NFC and lower case by Python's tables. The library lowers character by character, so a final sigma is like any other."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.lru_cache(4)
def disputed(path: str) -> tuple[tuple[int, int], ...]:
    """Ranges of code points that Python's and the regex module's Unicode tables treat otherwise than the library's: letters or numbers to one only, composed, ordered or lowered differently, or not assigned in Python's tables at all. Found by asking both about every code point, once, on the driver."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    # what Python doesn't know is disputed anyway; it may compose with what follows
    wrong = {ord(c) for c in points if unicodedata.category(c) == "Cn"}
    points = [c for c in points if ord(c) not in wrong]
    every = "".join(points)
    letters = regex.findall(r"\p{L}", every)
    chars = letters + regex.findall(r"\p{N}", every)
    # a letter stays with letters around it; a number, which is taken by itself, parts from other marks
    probe = " ".join(f"a{c}a" if i < len(letters) else f"${c}$" for i, c in enumerate(chars))
    starts = {begin for _, (begin, _) in tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
    wrong |= {ord(c) for i, c in enumerate(chars) if (4 * i + 1 in starts) == (i < len(letters))}
    # between marks of the classes 232 and 220 every combining character shows its class by its place
    points = [c for c in points if not c.isspace()]
    probe = "|".join(f"{c};a{c};a\u0315{c}\u0323" for c in points)
    theirs, ours = (x.split("|") for x in (tokenizer.normalizer.normalize_str(probe), normal(probe)))
    wrong |= {ord(c) for c, x, y in zip(points, theirs, ours, strict=True) if x != y}
    ranges: list[list[int]] = []
    for c in sorted(wrong):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return tuple((a, b) for a, b in ranges)


class PieceCounter:
    """Counts tokens of texts for a tokenizers file of this shape: NFC, white space and lower-case normalisers, a Split by regex, byte-level characters, a BPE model. A text with one of the `ranges` of disputed characters is split by the library."""

    def __init__(self, path: str, ranges: tuple[tuple[int, int], ...]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("this tokenizer's normaliser or pre-tokenizer is of another shape")
        self.split = regex.compile(with_white(steps[0]["pattern"]["Regex"])).findall
        self.model = self.tokenizer.model.tokenize
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.marks = special
        first = chr(min((a for a, _ in ranges), default=0x10FFFF))
        self.beyond = re.compile(f"[{first}-\U0010ffff]").search
        self.disputed = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]" if ranges else "(?!)").search
        self.pieces: dict[str, int] = {}
        self.held = 0

    def count_pieces(self, pre_token: str) -> int:
        mapped = pre_token.encode().decode("latin-1").translate(BYTE_CHARS)
        return len(self.model(mapped))

    def library_split(self, part: str) -> list[str]:
        """The part's pre-tokens as the library gives them, turned back from byte-level characters to text."""
        mapped = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part))
        return [x.translate(CHAR_BYTES).encode("latin-1").decode() for x, _ in mapped]

    def table(self, text: str) -> tuple[Counter, int]:
        """The text's pre-token frequencies, and how many special tokens its text spells."""
        parts, marks = [text], 0
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            marks = len(parts) - 1
        found: Counter = Counter()
        for part in parts:
            if not part.isascii():
                if self.beyond(part) and self.disputed(part):
                    found.update(self.library_split(part))
                    continue
                found.update(self.split(normal(part)))
            else:
                found.update(self.split(part.lower()))
        return found, marks

    def __call__(self, text: str) -> int:
        found, total = self.table(text)
        pieces = self.pieces
        for token, times in found.items():
            n = pieces.get(token)
            if n is None:
                n = self.count_pieces(token)
                if len(token) <= LONG:
                    if self.held > CACHE:
                        pieces.clear()
                        self.held = 0
                    pieces[token] = n
                    self.held += len(token)
            total += n * times
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document. One pass, no shuffle."""

    ranges = disputed(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer_path, ranges)
        for whole in batches:
            for part in core.slices(whole):
                text = part.column("text").fill_null("")
                n_tokens = [counter(t) for t in text.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return core.texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
