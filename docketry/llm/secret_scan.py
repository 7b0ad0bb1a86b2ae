"""Secret scans: one automaton of all rules passes over the bytes, and spans are read off by transition arrays.

The rules themselves are compiled, by subset construction and minimisation, into one deterministic automaton, which passes
once over the bytes of all texts and tells at which byte a match of which rule ends. Most texts have none. In the others

* the automaton of the reversed rules passes over their bytes from the end, which gives every byte where a match of a
  rule begins;
* from left to right, each rule takes the first such byte behind its last match, and an anchored automaton of the rule
  reads on from there to the longest match's end (and where a rule's secret is only its last part, one of the part
  before tells where that begins).

No text is searched by a regex engine. Matches are leftmost and longest; for rules whose parts after the first choice can
be read in one way only, such as all of these, that is what a backtracking engine finds.

Base kinds: assign, access, hex. Added kinds: github, slack, google, stripe, private_key. Spans are code points, end
exclusive. Defined results: null text is empty; null doc_id stays null; each row gives one row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm import core
from docketry.llm.automaton import GAP, Automaton

BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """A secret with what must stand before it; a match takes both, and counts if the secret has `least` bytes."""

    kind: str
    secret: str
    least: int = 1
    before: str = ""


#: The kinds' patterns, in the order in which kinds are listed. A run of hexadecimal digits is as long as it
#: must be, since any shorter one is no match and the digits' runs don't overlap.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 8, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [r.before + r.secret for r in rules]
        self.forward, self.backward = Automaton(whole), Automaton(whole, backwards=True)
        self.whole = [Automaton([w], anchored=True) for w in whole]
        self.before = [Automaton([r.before], anchored=True) if r.before else None for r in rules]

    def fired(self, flat: core.Flat) -> dict[int, int]:
        """The rules of which a match ends in each text, as bits by the text's number; texts without any are left out."""
        at, rules = self.forward.scan(flat.buf)
        doc = np.searchsorted(flat.start, at - 1, "right") - 1
        out: dict[int, int] = {}
        for k in range(len(self.rules)):
            for d in np.unique(doc[rules >> k & 1 == 1]).tolist():
                out[d] = out.get(d, 0) | 1 << k
        return out

    def spans(self, flat: core.Flat) -> dict[int, list[tuple[int, int, int]]]:
        """(start, rule, end) of the texts' matches, in bytes of the text, in order of start, then rule; texts without any are left out."""
        fired = self.fired(flat)
        if not fired:
            return {}
        docs = sorted(fired)
        # the fired texts, each reversed, the last first
        length = (flat.end - flat.start)[docs]
        place = np.concatenate(([0], np.cumsum(length + 1)))
        buf = np.full(int(place[-1]), GAP, np.uint8)
        for d, a, n in zip(docs, place.tolist(), length.tolist(), strict=False):
            buf[a : a + n] = flat.buf[flat.start[d] : flat.end[d]]
        at, rules = self.backward.scan(buf[::-1])
        begins, rules = len(buf) - at[::-1], rules[::-1]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for k, rule in enumerate(self.rules):
            mine = begins[rules >> k & 1 == 1]
            i = 0
            while i < len(mine):
                start = int(mine[i])
                which = int(np.searchsorted(place, start, "right")) - 1
                stop = int(place[which] + length[which])
                end = self.whole[k].longest(buf, start, stop)
                before = self.before[k]
                if end - (start if before is None else before.longest(buf, start, end)) >= rule.least:
                    out.setdefault(docs[which], []).append((start - int(place[which]), k, end - int(place[which])))
                i = int(np.searchsorted(mine, end))
        return {d: sorted(found) for d, found in out.items()}


@functools.lru_cache(2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The rules' automata, built once on the driver and sent to the executors (a megabyte or so for these rules, whatever the table)."""
    return Scanner(rules)


def code_points(text: bytes, at: list[int]) -> list[int]:
    """Byte offsets as offsets in code points."""
    if text.isascii():
        return at
    heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(heads[x - 1]) if x else 0 for x in at]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document. One pass, no shuffle."""
    n_base = len(BASE)
    automata = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automata.value
        nothing = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for part in core.slices(whole, limit=4 * core.SLICE):
                flat = core.Flat(part.column("text"), gap=GAP)
                counts = np.zeros((n_base, flat.n), np.int64)
                digest, spans = [nothing] * flat.n, [""] * flat.n
                for d, found in scan.spans(flat).items():
                    text = flat.buf[flat.start[d] : flat.end[d]].tobytes()
                    ends = code_points(text, [x for s, _, e in found for x in (s, e)])
                    named = [f"{rules[k].kind}:{s}:{e}" for (_, k, _), s, e in zip(found, ends[0::2], ends[1::2], strict=True)]
                    for _, k, _ in found:
                        if k < n_base:
                            counts[k, d] += 1
                    base = ",".join(x for (_, k, _), x in zip(found, named, strict=True) if k < n_base)
                    digest[d], spans[d] = hashlib.sha256(base.encode()).hexdigest(), ",".join(named)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)], names)

    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    return core.texts(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
