"""Personal data: base rules, and a character-level tagger that finds what the rules' forms don't cover.

The tagger (crf_lstm.Tagger) is trained here, from a seed, on labelled spans that a generator writes: e-mail addresses,
IP addresses, card and phone numbers in common and in disguised forms, among words, dates, prices and versions. Windows of
WINDOW characters, STRIDE apart, are laid wherever one has a digit, an "@", or a written-out "at" and a dot, written out
or not. That loses nothing: plausible() refuses every span of the tagger without one of these, and a test holds the
spans against those of all windows. Each window is decoded by Viterbi; spans cut by a window's edge give way to the neighbour that has them whole; and
of all windows' spans of a text those are kept that don't overlap and weigh most together (weighted intervals).

A base span always stays. The tagger's spans are added where they touch no base span and no text that a rule of the
same kind has looked at and refused (such as a number that fails Luhn), and only if they have their kind's least digits.
A refused text with fewer digits than that is a piece of a form that the rule doesn't know (a group of 4111.1111.1111.1111)
and refuses nothing.

Kinds: email, ip, card, phone. Spans are code points, end exclusive. Defined results: null text is empty; null doc_id
stays null; each row gives one row; other columns are ignored (redact keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm import core
from docketry.llm.crf_lstm import Tagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
#: A batch of windows that is decoded at once.
BATCH = 512
#: Digits that a span of the tagger must have at least, by kind.
LEAST = (0, 4, 16, 8)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the base rules by kind, then start; and the same of matches that failed a rule's check.

    The e-mail rule is read from its "@" to both sides, and the IP rule begins no match inside a run of digits (none can
    succeed there that failed at the run's begin), so all four take time in proportion to the text.
    """
    found, failed = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((0, start, m.end()))
            free = m.end()
        # what ends at this "@" can't be the local part of a later one
        free = max(free, at + 1)
        at = text.find("@", free)
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        (found if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in parts) else failed).append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        (found if 16 <= len(digits) <= 19 and luhn(digits) else failed).append((2, *m.span()))
    for m in _PHONE.finditer(text):
        (found if 8 <= len(_DIGIT.findall(m[0])) <= 15 else failed).append((3, *m.span()))
    return found, failed


# ---- the tagger: symbols, generated training spans


def _symbols() -> np.ndarray:
    """Classes of characters below U+0180: letters, digits and the marks that occur in personal data; 1 for the rest, 0 beyond the text."""
    table = np.ones(0x180, np.uint8)
    table[ord("0") : ord("9") + 1] = 2
    table[ord("a") : ord("z") + 1] = 3
    table[ord("A") : ord("Z") + 1] = 4
    table[0xC0:] = 3
    for i, c in enumerate("@.-_+() /:,%[]\n\"#"):
        table[ord(c)] = 5 + i
    return table


SYMBOLS = _symbols()
#: The symbols of the letters of a written-out "at" and "dot" (see plausible), and how many symbols there are.
AT, DOT, N_SYMBOLS = 22, 23, 24
#: What stands around these words.
AROUND = "  []()"


def enclosed(codes: np.ndarray, word: str) -> np.ndarray:
    """Where a word with a pair of AROUND around it begins; the codes are bytes or code points."""
    at = np.flatnonzero(codes == ord(word[0]))
    at = at[(at > 0) & (at + len(word) < len(codes))]
    for i, c in enumerate(word):
        at = at[codes[at + i] == ord(c)]
    before, after = codes[at - 1], codes[at + len(word)]
    return at[np.any([(before == ord(x)) & (after == ord(y)) for x, y in zip(AROUND[::2], AROUND[1::2], strict=True)], 0)]


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ids = SYMBOLS[np.minimum(points, 0x17F)]
    for word, symbol in (("at", AT), ("dot", DOT)):
        at = enclosed(points, word)
        for i in range(len(word)):
            ids[at + i] = symbol
    return ids


def make_examples(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Generated lines with the labelled spans (kind, start, end) in them."""
    rng = np.random.default_rng(seed)
    letters = list("aaeeiioourstnlmdcphbgfzäöéüñ")

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def one(options):
        return options[int(rng.integers(len(options)))]

    def word() -> str:
        w = "".join(rng.choice(letters, int(rng.integers(1, 9))))
        return one((w, w, w, w.capitalize(), w + ",", w + ".", w.upper()))

    def name() -> str:
        return one(("", "", one("abcdk") + ".")) + "".join(rng.choice(list("abcdefghiklmnorstu"), int(rng.integers(2, 8)))) + one(("", "", digits(2), "." + digits(2), "_x"))

    def email() -> str:
        host, tld = name().replace("_", "-"), one(("com", "org", "example.com", "de", "net"))
        return one((f"{name()}@{host}.{tld}",) * 3 + (f"{name()} at {host} dot {tld}", f"{name()}[at]{host}[dot]{tld}", f"{name()} @ {host} . {tld}"))

    def ip() -> str:
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return one((".", ".", ".", "[.]", " . ")).join(parts)

    def card() -> str:
        body = digits(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = one(("", "", " ", "-", ".", "/"))
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c, d = digits(int(rng.integers(1, 3))), digits(3), digits(3), digits(4)
        return one((f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"+{a}{b}{c}{d}", f"({b}) {c}-{d}", f"00{a} {b} {c} {d}", f"({b}) {c}.{d}"))

    def other() -> str:
        return one((digits(4), digits(2), digits(3) + "." + digits(2), f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", digits(int(rng.integers(5, 12))), "@" + word(), f"{digits(4)} {digits(4)}", "v" + digits(1) + "." + digits(2), "#" + digits(3), f"{digits(1)},{digits(3)}", "".join(rng.choice(list("0123456789abcdef"), 40)), word() + digits(2), f"{digits(2)}%"))

    makers = (email, ip, card, phone)
    lines, spans = [], []
    for _ in range(n):
        line, here = "", []
        for _ in range(int(rng.integers(1, 7))):
            line += word() + " "
        for _ in range(int(rng.integers(1, 3))):
            if rng.random() < 0.55:
                kind = int(rng.integers(4))
                text = makers[kind]()
                here.append((kind, len(line), len(line) + len(text)))
            else:
                text = other()
            line += text + one((" ", " ", " ", ". ", ", ", "\n"))
            for _ in range(int(rng.integers(0, 5))):
                line += word() + " "
        lines.append(line)
        spans.append(here)
    return lines, spans


def make_written(n: int, seed: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Generated prose without digits: every second line has an address whose "at" and "dot" are written out, the others an "at" or a dot in plain use."""
    rng = np.random.default_rng(seed)

    def one(options):
        return options[int(rng.integers(len(options)))]

    def word(low: int = 1, high: int = 10) -> str:
        return "".join(rng.choice(list("aaeeiioouurstnlmdcphbgfwyk"), int(rng.integers(low, high))))

    def prose(k: int) -> str:
        words = (word() if rng.random() < 0.75 else one(("at", "to", "that", "do", "it", "dot", "add", "a")) for _ in range(k))
        return "".join(w + one((" ", " ", " ", " ", ", ", ". ", "\n")) for w in words)

    lines, spans = [], []
    for i in range(n):
        line, here = prose(int(rng.integers(0, 7))), []
        if i % 2:
            at, dot = one(((" at ", " dot "),) * 6 + ((" at ", "."),) * 5 + ((" (at) ", "."), (" [at] ", "."), (" @ ", " . ")) + (("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", ".")))
            text = one((word(3), word(2) + one("._-") + word(2))) + at + one((word(2), word(2) + dot + word(2), word(2) + "-" + word(2))) + dot + one(("com", "org", "de", "net", "eu", "info"))
            here.append((0, len(line), len(line) + len(text)))
        else:
            text = word() + one((" at ", " at ", " at the ", " at that", " dot ", " (at ", " [at ")) + word() + one((". ", ".", " ", ", ", ") ")) + word()
        lines.append(line + text + one((" ", ". ", ", ", "\n", "")) + prose(int(rng.integers(0, 7))))
        spans.append(here)
    return lines, spans


def windows(line: str, spans: list[tuple[int, int, int]], at: int) -> tuple[np.ndarray, np.ndarray]:
    """A window's symbols and tags: 0 none, 1 + 2k begins kind k, 2 + 2k goes on."""
    ids, tags = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int64)
    part = symbols(line)[at : at + WINDOW]
    ids[: len(part)] = part
    for kind, start, end in spans:
        lo, hi = max(start - at, 0), min(end - at, WINDOW)
        if lo < hi:
            tags[lo:hi] = 2 + 2 * kind
            if start >= at:
                tags[lo] = 1 + 2 * kind
    return ids, tags


@functools.lru_cache(2)
def trained(examples: int = 1000, epochs: int = 9, seed: int = 5) -> Tagger:
    """The tagger, trained anew from the seed once in each process that calls an operator (half a minute or so)."""
    lines, spans = (a + b for a, b in zip(make_examples(examples, seed), make_written(4 * examples, seed), strict=True))
    rng = np.random.default_rng(seed)
    pairs = [windows(a, b, int(rng.integers(0, max(1, len(a) - STRIDE)))) for a, b in zip(lines, spans, strict=True)]
    tagger = Tagger(N_SYMBOLS, 1 + 2 * len(KINDS), hidden=20, kind=np.float32)
    tagger.train(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), epochs, batch=80)
    return tagger


# ---- windows of texts


def lay(ids: np.ndarray) -> np.ndarray:
    """Begins of the windows of one text: every one on the grid that has a digit, an "@", or a written-out "at" and a dot."""
    cells = len(ids) // STRIDE + 1

    def has(*which: int) -> np.ndarray:
        cell = np.zeros(cells + 1, bool)
        cell[np.flatnonzero(np.isin(ids, which)) // STRIDE] = True
        return cell[:-1] | cell[1:]

    return np.flatnonzero(has(2, 5) | has(AT) & has(6, DOT)) * STRIDE


def tagged(tagger: Tagger, texts: list[np.ndarray], lay: Callable[[np.ndarray], np.ndarray] = lay) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans (kind, start, end) of texts given as symbols; `lay` gives the windows' begins."""
    begins = [np.unique(lay(ids)) for ids in texts]
    owner = np.repeat(np.arange(len(texts)), [len(b) for b in begins])
    begin = np.concatenate(begins) if len(begins) else np.zeros(0, np.int64)
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    for at in range(0, len(begin), BATCH):
        block = np.zeros((min(BATCH, len(begin) - at), WINDOW), np.uint8)
        for row in range(len(block)):
            part = texts[owner[at + row]][begin[at + row] : begin[at + row] + WINDOW]
            block[row, : len(part)] = part
        path, margin = tagger.decode(block)
        for row in np.flatnonzero(path.any(1)).tolist():
            d, b = int(owner[at + row]), int(begin[at + row])
            n = min(WINDOW, len(texts[d]) - b)
            tags, t = path[row, :n], 0
            while t < n:
                tag = int(tags[t])
                if tag == 0:
                    t += 1
                    continue
                kind, s = (tag - 1) // 2, t
                t += 1
                while t < n and tags[t] == 2 + 2 * kind:
                    t += 1
                cut = (s == 0 and b > 0) or (t == n and b + n < len(texts[d]))
                # log-odds over no personal data; a span that the window's edge may have cut weighs next to nothing beside a whole one
                found[d].append((b + s, b + t, kind, tagger.odds(path[row], margin[row], s, t) * (0.01 if cut else 1)))
    return [reconcile(f) for f in found]


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, end, kind, weight), those without overlap that weigh most together."""
    spans = sorted(set(spans), key=lambda x: (x[1], x[0], x[2]))
    ends, best = [s[1] for s in spans], [(0.0, -1, -1)]
    for i, (start, _, _, weight) in enumerate(spans):
        j = bisect_right(ends, start, 0, i)
        take = best[j][0] + weight
        best.append((take, i, j) if take > best[i][0] else (best[i][0], -2, i))
    out, i = [], len(spans)
    while i > 0:
        _, mine, j = best[i]
        if mine >= 0:
            out.append((spans[mine][2], spans[mine][0], spans[mine][1]))
        i = j
    return out[::-1]


def plausible(kind: int, text: str) -> bool:
    """What a span of the tagger must have: an "@" or a disguised one and dots; four numbers; 16 digits or more; 8 or more."""
    digits = len(_DIGIT.findall(text))
    if kind == 0:
        return bool(re.search(r"@|\[at\]|\(at\)| at ", text) and re.search(r"\.|\[dot\]|\(dot\)| dot ", text)) and " " not in text.strip()[:1]
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return LEAST[2] <= digits <= 19 and luhn("".join(_DIGIT.findall(text)))
    return LEAST[3] <= digits <= 15 and bool(re.match(r"[+(]|00", text))


def find(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Per text: base spans, and all spans; both by kind, then start."""
    out = []
    for text, extra in zip(texts, tagged(tagger, [symbols(t) for t in texts]), strict=True):
        base, failed = base_spans(text)
        every = sorted((s, e) for _, s, e in base)
        starts = [s for s, _ in every]
        reach = np.maximum.accumulate([e for _, e in every]) if every else []
        refused = {k: [(s, e) for kind, s, e in failed if kind == k and len(_DIGIT.findall(text[s:e])) >= LEAST[k]] for k in {x[0] for x in extra}}
        added = []
        for kind, s, e in extra:
            i = bisect_right(starts, e - 1)
            if i and reach[i - 1] > s:
                continue
            j = bisect_right(refused[kind], (e - 1, 1 << 60))
            if j and refused[kind][j - 1][1] > s:
                continue
            if plausible(kind, text[s:e]):
                added.append((kind, s, e))
        out.append((base, sorted(base + added)))
    return out


def marked(flat: core.Flat) -> np.ndarray:
    """Numbers of the texts that have a digit, an "@" or a written-out "at"; lay() looks for the dot beside it."""
    at = np.sort(np.concatenate((np.flatnonzero(MARK[flat.buf]), enclosed(flat.buf, "at"))))
    return np.unique(np.searchsorted(flat.start, at, "right") - 1)


MARK = np.zeros(256, bool)
MARK[0x30:0x3A] = MARK[0x40] = True


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all) of every document. One pass, no shuffle."""
    tagger = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for part in core.slices(whole):
                flat = core.Flat(part.column("text"))
                counts = np.zeros((len(KINDS), flat.n), np.int64)
                digest, spans = [nothing] * flat.n, [""] * flat.n
                hit = marked(flat).tolist()
                for d, (base, every) in zip(hit, find(tagger, part.column("text").take(pa.array(hit, pa.int64())).to_pylist()), strict=True):
                    for k, _, _ in base:
                        counts[k, d] += 1
                    digest[d], spans[d] = hashlib.sha256(_named(base).encode()).hexdigest(), _named(every)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return core.texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in `text` masked; all other columns as they are. Rows without any come out unchanged."""
    tagger, names = trained(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in core.slices(whole, text):
                hit = marked(core.Flat(part.column(text))).tolist()
                old = part.column(text).take(pa.array(hit, pa.int64())).to_pylist()
                new = part.column(text).to_pylist() if hit else None
                for d, t, (_, every) in zip(hit, old, find(tagger, old), strict=True):
                    new[d] = masked(t, every)
                if new is not None:
                    i = names.index(text)
                    part = part.set_column(i, part.schema.field(i), pa.array(new, part.schema.field(i).type))
                yield part

    return docs.mapInArrow(core.releasing(run), docs.schema)
