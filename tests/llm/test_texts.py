"""Operators that look at one text at a time: token counts, BPE, secrets, personal data, quality, decontamination."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docketry.llm import byte_bpe, core, decontaminate, pii, quality, secret_scan, token_counts
from docketry.llm.automaton import Automaton
from docketry.llm.crf_lstm import Tagger

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TRICKY = ["", "It's <|endoftext|>x<|startoftext|> ΑΣ ΑΣΣ İ ñ ñ \x1c\x85 y", "a" * 3000, " " * 300 + "x", "ab" * 2000 + "!!!" * 50, "😀👍🏽 12 345 　z", "\x00\x01 don't 're 'S", "ſK 'll''s <|endoftext", "thenanananre anananan", "ab\ua7dccd \ua7cb", "Ê\U000187f8 x\U00011de0\U00011de1 $\u0558a"]
text = st.text(alphabet=st.one_of(st.sampled_from(list("aenrst' .1<|>\néΣ")), st.characters(codec="utf-8")), max_size=60)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PieceCounter(WORD_BPE, token_counts.disputed(WORD_BPE)), Tokenizer.from_file(WORD_BPE)


@pytest.mark.parametrize("t", TRICKY)
def test_token_counts_of_tricky_texts(counter, t):
    assert counter[0](t) == len(counter[1].encode(t, add_special_tokens=False).ids)


def test_token_counts_of_letters_that_tables_differ_on(counter):
    """The borders of all disputed ranges, two letters that only newer tables lower, and a sample of all code points; all of them in three places were compared once."""
    rng = random.Random(8)
    borders = {c + k for ends in token_counts.disputed(WORD_BPE) for c in ends for k in (-1, 0, 1)}
    points = [chr(c) for c in sorted(borders | {0xA7CB, 0xA7DC} | {rng.randrange(0x80, 0x110000) for _ in range(1500)}) if c < 0x110000 and not 0xD800 <= c <= 0xDFFF]
    for place in ("ab{0}cd {0}", "a{0}\u0301 x{0}1{0}", "\u0315{0}\u0323 {0}{0}"):
        lines = [place.format(c) for c in points]
        assert [counter[0](t) for t in lines] == [len(e.ids) for e in counter[1].encode_batch(lines, add_special_tokens=False)]


@given(text)
@settings(max_examples=400, deadline=None)
def test_token_counts_equal_the_library(t):
    assert COUNTER[0](t) == len(COUNTER[1].encode(t, add_special_tokens=False).ids)


COUNTER = token_counts.PieceCounter(WORD_BPE, token_counts.disputed(WORD_BPE)), Tokenizer.from_file(WORD_BPE)
BPE = byte_bpe.ByteBpe(byte_bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def encoded(texts):
    pool = byte_bpe.Pool(BPE)
    for t in texts:
        pool.add(t)
    return [ids.tolist() for (ids,) in pool.flush()]


def test_encoding_of_tricky_texts():
    assert encoded(TRICKY) == [LIBRARY.encode_ordinary(t) for t in TRICKY]


@given(st.lists(text, max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoding_equals_the_library_and_decodes(texts):
    ids = encoded(texts)
    assert ids == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [BPE.decode(np.array(i, np.uint32)) for i in ids] == [t.encode() for t in texts]


def test_encoding_one_merge_at_a_time_agrees():
    for t in ("anananan", "b" * 500, "thontreatinti", "é😀é"):
        assert BPE.encode_alone(t.encode()) == BPE.encode_pool([t.encode()])[0].tolist()


def test_rank_queue_pops_in_order():
    queue, rng = byte_bpe.RankQueue(60_000), random.Random(1)
    ranks = [rng.randrange(60_000) for _ in range(500)]
    for r in ranks:
        queue.push(r, r)
    out = []
    while (x := queue.pop()) is not None:
        out += [x[0]] * len(x[1])
    assert out == sorted(ranks)


def test_a_pool_takes_little_memory_and_leaves_none_behind():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(100_000)]
    encoded(["warm up"])
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        pool = byte_bpe.Pool(BPE)
        pool.add(" ".join(words))
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        (ids,) = next(pool.flush())
        peak = tracemalloc.get_traced_memory()[1]
        n = ids.nbytes
        del ids
        left = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
        gc.enable()
    assert n and left < held / 8
    assert peak < held + 50 * sum(map(len, words))


def test_queries_on_edges(spark, edge_docs, empty_docs):
    for run in (lambda d: token_counts.count_tokens(d, WORD_BPE), lambda d: byte_bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN), secret_scan.scan_secrets, pii.find_personal_data):
        rows = run(edge_docs).collect()
        assert len(rows) == edge_docs.count()
        assert sum(r["doc_id"] is None for r in rows) == 2
        assert run(empty_docs).collect() == []
    empty = next(r for r in byte_bpe.encode_documents(edge_docs, RANKS, public_tokenizers.PATTERN).collect() if r["doc_id"] == 3)
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest() == empty["decoded_sha256"]


# ---- secrets


#: Kind, pattern, group whose length counts, least length: written out here, apart from the operator's rules.
SECRETS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)


def plain_secrets(t: str):
    """(start, kind's number, end) of the matches of all kinds, by a regex engine."""
    found = []
    for k, (_, pattern, group, least) in enumerate(SECRETS):
        for m in re.compile(pattern, re.ASCII).finditer(t):
            if len(m[group]) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


FRAGMENTS = ["token", "=", "a" * 31, "f", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL", "é", " ", "secret: ", "'", "xoxb-", "ghp_", "0" * 700, "z" * 900, "PaSSwd", "-----BEGIN RSA PRIVATE KEY-----", "\n", "api_key", "deadbeef", "ſecret=abcdefghij", ":", "\"", "AIza", "rk_live_", "-----BEGIN ", "PRIVATE KEY-----", "_", "-", "g" * 40, "aPi_KeY  = '", "secret=", "passwd:token="]


def test_spans_equal_a_regex_engine():
    scanner, rng = secret_scan.Scanner(), random.Random(1)
    docs = ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["", "f" * 5000, "token=" * 3000]
    found = scanner.spans(core.Flat(pa.array([t.encode().decode() for t in docs]), gap=secret_scan.GAP))
    for d, t in enumerate(docs):
        assert [(*secret_scan.code_points(t.encode(), [s, e]), k) for s, k, e in found.get(d, [])] == [(s, e, k) for s, k, e in plain_secrets(t)], t


@given(st.lists(st.sampled_from(["token", "=", ":", " ", "'", '"', "a", "0", "f", ".", "é", "AKIA", "Z", "ApI", "_", "key", "-"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_spans_equal_a_regex_engine_on_short_texts(t):
    found = secret_scan.scanner(secret_scan.RULES).spans(core.Flat(pa.array([t]), gap=secret_scan.GAP))
    assert [(*secret_scan.code_points(t.encode(), [s, e]), k) for s, k, e in found.get(0, [])] == [(s, e, k) for s, k, e in plain_secrets(t)]


def test_long_runs_of_secrets_take_linear_time():
    for t in ("f" * 3_000_000, "token=" * 300_000, "token=" + "a" * 2_000_000):
        found = secret_scan.scanner(secret_scan.RULES).spans(core.Flat(pa.array([t]), gap=secret_scan.GAP))
        assert [(s, k, e) for s, k, e in found[0]] == plain_secrets(t)


def test_automaton_is_minimal_and_exact():
    a = Automaton(["ab+c", "(?i:xy){2}"])
    assert a.scan(np.frombuffer(b"zabbc XyxY", np.uint8))[0].tolist() == [5, 10]
    assert len(Automaton(["a|a|aa?"]).table) == 2


def test_secrets_equal_plain_regexes(spark):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    for r, (_, t) in zip(sorted(secret_scan.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()), docs, strict=True):
        every = plain_secrets(t)
        assert r["spans"] == ",".join(f"{SECRETS[k][0]}:{s}:{e}" for s, k, e in every)
        want = [x for x in every if x[1] < 3]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        named = ",".join(f"{secret_scan.BASE[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()


# ---- personal data

PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_personal_data(t: str):
    out = []
    for k, pattern in enumerate(PII):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = (lambda: True, lambda m=m: all(int(v) <= 255 for v in m[0].split(".")), lambda d=digits: 16 <= len(d) <= 19 and pii.luhn(d), lambda d=digits: 8 <= len(d) <= 15)[k]
            if good():
                out.append((k, *m.span()))
    return out


def test_base_rules_equal_plain_regexes():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.-+ 019()é%") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t)[0] == plain_personal_data(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 100_000, "a" * 100_000 + "@", "a@" * 50_000, "1." * 50_000, "+1" * 50_000):
        pii.base_spans(t)


def test_tagger_gradient():
    rng = np.random.default_rng(0)
    t = Tagger(5, 3, hidden=4)
    ids, tags = rng.integers(0, 5, (3, 6)), rng.integers(0, 3, (3, 6))
    g = t.gradient(ids, tags)[1]
    for k in g:
        i = tuple(rng.integers(0, s) for s in g[k].shape)
        t.p[k][i] += 1e-5
        a = t.gradient(ids, tags)[0]
        t.p[k][i] -= 2e-5
        b = t.gradient(ids, tags)[0]
        t.p[k][i] += 1e-5
        assert abs((a - b) / 2e-5 - g[k][i]) < 1e-6


def test_tagger_on_held_out_lines():
    lines, spans = pii.make_examples(300, seed=99)
    got = pii.tagged(pii.trained(), [pii.symbols(x) for x in lines])
    hits = sum(any(k == a and s < c and b < e for k, s, e in mine) for want, mine in zip(spans, got, strict=True) for a, b, c in want)
    assert hits / sum(map(len, spans)) > 0.8


def test_added_spans_reach_disguised_forms_and_leave_refused_numbers():
    tagger = pii.trained()
    (_, every), (_, refused), (_, dates) = pii.find(tagger, ["tion ther 10[.]2[.]33[.]4 and", "order 1234567890123456 and 999.1.1.1 in", "on 2024-05-06 at 12:30 for 1,200"])
    assert (1, 10, 25) in every and refused == [] and dates == []


CARDS = ("4111.1111.1111.1111", "4111/1111/1111/1111", "5500.0000.0000.0004")


@pytest.mark.parametrize("card", CARDS)
def test_cards_in_groups_that_the_rule_does_not_know_are_added(spark, card):
    docs = spark.createDataFrame([(1, f"he paid with {card} today"), (2, f"he paid with {card[:-1]}9 today"), (3, f"he paid with {card.replace(card[4], '')}0000 today")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert got[1]["spans"] == f"card:13:{13 + len(card)}" and got[1]["n_card"] == 0
    assert got[2]["spans"] == got[3]["spans"] == ""
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[1] == "he paid with <card> today" and masked[2] == f"he paid with {card[:-1]}9 today"


WRITTEN = ("anna at host dot org", "anna[at]host[dot]org", "anna(at)host(dot)org")


def test_windows_lie_at_written_out_addresses():
    for address in WRITTEN:
        for k in range(0, 150):
            ids = pii.symbols("x" * k + " " + address + " " + "x" * 70)
            laid = pii.lay(ids)
            assert any(b <= k + 1 and k + 1 + len(address) <= b + pii.WINDOW for b in laid), (address, k)
    assert not len(pii.lay(pii.symbols("no such place " * 20 + "at " + "x" * 100 + ".")))


def test_windows_that_are_not_laid_hold_no_plausible_span(small):
    """Of all windows of whole texts, and of those that are laid: the same plausible spans."""
    texts = [r["text"] or "" for r in small.select("text").collect()]
    lines = pii.make_written(150, seed=31)[0] + pii.make_examples(150, seed=32)[0]
    texts += ["\n".join(lines[i::20]) for i in range(20)]
    ids, tagger = [pii.symbols(t) for t in texts], pii.trained()

    def plausible(found):
        return [[(k, s, e) for k, s, e in spans if pii.plausible(k, t[s:e])] for t, spans in zip(texts, found, strict=True)]

    every = plausible(pii.tagged(tagger, ids, lambda x: np.arange(len(x) // pii.STRIDE + 1) * pii.STRIDE))
    assert sum(map(len, every)) > 50 and plausible(pii.tagged(tagger, ids)) == every


def test_recall_of_written_out_addresses():
    rng = np.random.default_rng(77)
    words = "the of and we write court judge please contact office for people letters house about more answer when said green".split()

    def name():
        return "".join(rng.choice(list("abcdefghiklmnorstu"), int(rng.integers(3, 9))))

    for at, dot in ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" @ ", " . ")):
        texts, want = [], []
        for _ in range(100):
            before, address = " ".join(rng.choice(words, int(rng.integers(1, 9)))), f"{name()}{at}{name()}{dot}org"
            texts.append(f"{before} {address} {' '.join(rng.choice(words, 5))}")
            want.append((len(before) + 1, len(before) + 1 + len(address)))
        hits = sum(any(s < b and a < e for _, s, e in every) for (a, b), (_, every) in zip(want, pii.find(pii.trained(), texts), strict=True))
        assert hits >= 70, (at, dot, hits)
    (_, every), (_, none) = pii.find(pii.trained(), ["write to john at example dot com please", "They met at noon. The court sat at the dot."])
    assert [k for k, _, _ in every] == [0] and none == []


def test_very_long_texts_of_digits_are_tagged():
    t = "call 12 at 3.45, " * 60_000 + "anna[at]host[dot]org"
    (_, every), = pii.find(pii.trained(), [t])
    assert (0, len(t) - 20, len(t)) in every


@pytest.mark.parametrize("address", WRITTEN)
def test_addresses_without_a_digit_are_found_and_masked(spark, address):
    docs = spark.createDataFrame([(1, f"please ask {address} for more"), (2, "They met at the court. Then, at noon, all went home."), (3, address)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    assert got == {1: f"email:11:{11 + len(address)}", 2: "", 3: f"email:0:{len(address)}"}
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[1] == "please ask <email> for more" and masked[2].startswith("They met at") and masked[3] == "<email>"


def test_reconciled_spans_do_not_overlap():
    assert pii.reconcile([(0, 5, 1, 5.0), (4, 9, 1, 6.0), (9, 12, 0, 1.0)]) == [(1, 4, 9), (0, 9, 12)]
    assert pii.reconcile([]) == []


def test_redaction_keeps_columns_and_clean_rows(edge_docs):
    got = pii.redact(edge_docs)
    assert got.columns == edge_docs.columns
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by[8].endswith("<email> <phone>") and by[4] == "x" * 40_000 and by[2] is None


# ---- quality


def test_quality_on_the_held_out_fold(spark, edge_docs, empty_docs):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    held = [(r["quality"], scored[r["doc_id"]]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(s["held_out"] for _, s in held) and len(held) > 40
    assert np.mean([q == s["predicted"] for q, s in held]) > 0.9
    assert all(0 <= s["score"] <= 1 for s in scored.values())
    assert len(quality.score_quality(edge_docs, labels).collect()) == edge_docs.count()
    assert quality.score_quality(empty_docs, labels.limit(0)).collect() == []
    assert {r["score"] for r in quality.score_quality(edge_docs, labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_depend_on_neighbours():
    w = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1)
    texts = ["a b", "", "!!! x", "a " * 50, "é"]
    together = quality.scores(w, pa.array(texts))
    assert together.tolist() == [quality.scores(w, pa.array([t]))[0] for t in texts]


# ---- decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_overlaps(docs, items, size):
    found: dict = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            found.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w = words(t)
        hit, its = [False] * len(w), set()
        for n in {len(k) for k in found}:
            for k in range(len(w) - n + 1):
                x = found.get(tuple(w[k : k + n]))
                if x is not None:
                    its |= {str(v) for v in x if v is not None}
                    hit[k : k + n] = [True] * n
        out.append((d, len(w), sum(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), any(hit)))
    return out


def plain_matches(t, items, size):
    """All (words, begin in the text, item, begin in the item) of longest common stretches of a window or more."""
    w = words(t)
    for i, x in items:
        v = words(x)
        for a in range(len(w)):
            for b in range(len(v)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n and n >= min(size, len(v)):
                    yield n, a, None if i is None else str(i), b


def plain_longest(t, items, size):
    best = min(((-n, a, i is None, i or "", b) for n, a, i, b in plain_matches(t, items, size)), default=None)
    return (0, None, None, None) if best is None else (-best[0], best[1], None if best[2] else best[3], best[4])


def test_suffix_search_equals_brute_force():
    rng = random.Random(5)

    def make(n):
        return "".join(rng.choice(["a", "b", "C", "é", "1x"]) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randint(0, n)))

    for _ in range(150):
        docs = [(i, make(60)) for i in range(12)] + [(99, None), (98, "")]
        items = [(i, make(9)) for i in range(5)] + [(3, make(3)), (None, make(4)), (7, None), (8, make(25))]
        docs += [(50, make(5) + items[-1][1] + make(5)), (51, make(5) + items[-1][1][3:])]
        size = rng.choice([1, 2, 3, 4, 6])
        bench = decontaminate.Suffixes([i for i, _ in items], [t for _, t in items], size)
        m = decontaminate.Matches(pa.array([t for _, t in docs], pa.string()), bench)
        w, want = m.words, plain_overlaps(docs, items, size)
        named = [len({bench.names[k] for t, k in zip(m.text.tolist(), m.item.tolist(), strict=True) if t == d and bench.names[k] is not None}) for d in range(len(docs))]
        assert [(int(w.count[i]), int(m.hit[w.first[i] : w.last[i]].sum()), named[i]) for i in range(len(docs))] == [x[1:4] for x in want]
        got = [(0, None, None, None)] * len(docs)
        for d, k in zip(*(x.tolist() for x in m.longest()), strict=True):
            s = m.suffix[k]
            got[d] = (int(m.depth[k]), int(m.place[k] - w.first[d]), bench.names[bench.item[s]], int(bench.word[s]))
        assert got == [plain_longest(t, items, size) for _, t in docs]


def test_suffixes_of_one_word_over_and_over():
    bench = decontaminate.Suffixes([1], ["a " * 60], 10)
    m = decontaminate.Matches(pa.array(["a " * 5000, "b " + "a " * 30]), bench)
    assert m.hit[:5000].all() and m.hit[5001:].all() and not m.hit[5000]
    assert [int(m.depth[k]) for k in m.longest()[1]] == [60, 30]


def test_longest_matches_of_items(spark, monkeypatch):
    rng = random.Random(6)

    def make(n):
        return " ".join(rng.choice("abcd") for _ in range(n))

    items = [(f"i{i}", make(30)) for i in range(8)] + [("i0", make(12)), (None, make(12)), ("short", "a b"), ("none", "z y x"), ("empty", "")]
    docs = [(i, make(40) + " " + items[i % 8][1][: rng.randint(0, 60)]) for i in range(30)] + [(None, "a b c"), (31, None)]
    df, benchmark = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    best: dict = {}
    for d, t in docs:
        for n, a, i, b in plain_matches(t, items, 5):
            if i is not None:
                way = (-n, b, -1 if d is None else d, a)
                best[i] = min(best.get(i, way), way)
    want = {(i, -n, b, None if d < 0 else d, a) for i, (n, b, d, a) in best.items()}
    assert {tuple(r) for r in decontaminate.longest_matches(df, benchmark, 5).collect()} == want
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 200)
    assert {tuple(r) for r in decontaminate.longest_matches(df, benchmark, 5).collect()} == want


def test_decontamination_of_tables(spark, small, edge_docs, empty_docs, monkeypatch):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs, items = [tuple(r) for r in small.select("doc_id", "text").collect()], [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    want = sorted(plain_overlaps(docs, items, 10))
    whole = sorted(map(tuple, decontaminate.decontaminate(small, benchmark).collect()))
    assert [r[:6] for r in whole] == want
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 4000)  # a benchmark beyond the bound of one broadcast
    assert sorted(map(tuple, decontaminate.decontaminate(small, benchmark).collect())) == whole
    clean = {r["doc_id"] for r in decontaminate.keep_clean(small, benchmark).collect()}
    assert clean == {w[0] for w in want if not w[5]}
    assert decontaminate.decontaminate(edge_docs, benchmark).count() == edge_docs.count()
    assert decontaminate.decontaminate(empty_docs, benchmark).collect() == [] and decontaminate.decontaminate(small, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.longest_matches(empty_docs, benchmark).collect() == [] and decontaminate.longest_matches(edge_docs, benchmark).count() == 0
