"""Operators over many rows: substring dedup, Jaccard join, top-k search, chat formatting, the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.llm import chat, components, core, jaccard_join, sketch, substring_dedup, topk


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def plain_substrings(rows, size):
    first, texts = {}, [(d, split(t)) for d, t in sorted(rows, key=lambda r: r[0])]
    for d, w in texts:
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), (d, i))
    out = []
    for d, w in texts:
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] != (d, i):
                keep[i : i + size] = [False] * size
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        out.append((d, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_equal_brute_force(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in substring_dedup.dedup_substrings(small, 20, keep_text=False).collect()) == plain_substrings(rows, 20)


def test_substrings_across_tasks_and_flushes(spark, monkeypatch):
    rng = random.Random(1)
    passage = " ".join(rng.choice("abcdef") for _ in range(30))
    rows = [(i, " ".join([rng.choice("uvw") for _ in range(rng.randint(0, 9))] + ([passage] if i % 3 else []) + [rng.choice("xyz") for _ in range(rng.randint(0, 20))])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    got = substring_dedup.dedup_substrings(df, 4).collect()
    assert sorted(tuple(r)[:4] for r in got) == plain_substrings(rows, 4)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substrings_on_edges(edge_docs, empty_docs):
    rows = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(edge_docs, 5).collect()}
    assert (2, 0, 0) in rows and (3, 0, 0) in rows and (7, 12, 12) in rows and (5, 3000, 2999) in rows
    assert {x for x in rows if x[0] is None} == {(None, 3, 0), (None, 0, 0)}
    # a repetition of the row removes nothing, the windows that repeat inside the text do
    assert {x for x in rows if x[0] == 1} == {(1, 12, 9)}
    assert substring_dedup.dedup_substrings(empty_docs).collect() == []


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    hashes = core.mix(rng.integers(0, 1 << 62, 60_000).astype(np.uint64))
    hashes[1000:2000] = hashes[:1000]
    blocks: dict[int, sketch.Counts] = {}
    for part in np.array_split(hashes, 3):
        for b, blob in sketch.blobs(part, 18):
            blocks.setdefault(b, sketch.Counts(18)).add(blob)
    seen = sketch.Seen([(b, *c.result(100)) for b, c in blocks.items()], 18)
    told = seen.repeated(hashes)
    assert told[:2000].all() and told[2000:].mean() < 0.1


def plain_components(rows):
    sets = []
    for d, t in rows:
        w = split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            i = len(x & y)
            if i and 100 * i >= 80 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return sorted((d, len(s), find(d)) for d, s in sets)


def near_copies(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((i, " ".join(w[: rng.randint(0, 60)] if rng.random() < 0.3 else w)))
    return rows


def chain(n):
    """Documents that link each with the next alone: no group swallows the rest before the ends meet."""
    return [(1000 - i, " ".join(f"w{k}" for k in range(6 * i, 6 * i + 70))) for i in range(n)]


@pytest.mark.parametrize("unit,make", [(jaccard_join.UNIT, near_copies), (2000, near_copies), (300, near_copies), (300, lambda n, seed: chain(n // 4))])
def test_components_equal_brute_force(spark, monkeypatch, unit, make):
    monkeypatch.setattr(jaccard_join, "UNIT", unit)  # small units: clusters are cut
    rows = make(250, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in jaccard_join.similar_documents(df).collect()) == plain_components(rows)


def test_groups_alone_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 14))
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint64) for _ in range(n)]
        got = dict(jaccard_join.link(list(range(n)), sets, 80))
        label = list(range(n))
        for a in range(n):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 180 * i >= 80 * (len(sets[a]) + len(sets[b])):
                    lo, hi = sorted((label[a], label[b]))
                    label = [lo if x == hi else x for x in label]
        assert [got.get(k, k) for k in range(n)] == label


def test_a_node_of_two_sets_joins_what_each_links_with():
    a, b = np.arange(10, dtype=np.uint64), np.arange(20, 40, dtype=np.uint64)
    assert dict(jaccard_join.link([5, 3, 5, 7], [a, a, b, b], 80)) == {5: 3, 7: 3}


def test_components_on_edges(edge_docs, empty_docs):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_documents(edge_docs).collect()]
    assert len(rows) == edge_docs.count()
    assert rows.count((1, 3, 1)) == 2 and (7, 3, 1) in rows and (2, 0, 2) in rows and (6, 0, 6) in rows and rows.count((None, 1, None)) == 1
    assert jaccard_join.similar_documents(empty_docs).collect() == []
    kept = jaccard_join.keep_one(edge_docs)
    assert kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id is null").count() == 2
    assert kept.columns == edge_docs.columns and 7 not in {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_stars_of_a_long_path(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges, str(tmp_path)).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


# ---- top-k


def plain_top(ids, x, k):
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind,seed", [("unit", 1024), ("lengths", 1024), ("lengths", 30), ("lengths", 5), ("copies", 30)])
def test_top_k_equals_brute_force(spark, monkeypatch, kind, seed):
    monkeypatch.setattr(topk, "SEED", seed)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= np.exp(rng.normal(0, 2, 700))[:, None]
    if kind == "copies":
        x[100:400] = x[100]
    ids = np.arange(700)
    monkeypatch.setattr(topk, "GROUP", 150)
    monkeypatch.setattr(topk, "QUERIES", 20)
    monkeypatch.setattr(topk, "BUCKET", 40)
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = topk.top_inner_products(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted(tuple(r) for r in got) == plain_top(ids, np.floor(64 * x).astype(np.int64), 20)


def test_top_k_leaves_out_what_is_no_vector(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, None]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [3.0, 1.0]), (6, [3.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("unit", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_inner_products(df, F.col("vec_id") % 20 == 0, k=20, scale=1.0).collect())
    assert got == [(0, 1, 5, 5), (0, 2, 6, 5), (0, 3, 8, 0)]
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_floor_is_the_kth_product_without_the_query_itself():
    x = np.array([[3, 0], [2, 0], [1, 0], [0, 5]], np.int64)
    ids = np.array([10, 11, 12, 13])
    assert topk.floors(ids[:2], x[:2], ids, x, 2).tolist() == [3.0, 2.0]
    assert topk.floors(ids[:2], x[:2], ids, x, 4) is None
    assert topk.floors(ids[:1], x[:1] << 30, ids, x << 30, 1) is None


def test_top_k_drops_short_vectors_before_they_meet(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 8)) * np.where(np.arange(400) < 60, 1000, 10)[:, None]).astype(np.int64)
    ids = np.arange(400)
    verified = []
    plain = topk._verify
    monkeypatch.setattr(topk, "_verify", lambda best, which, rows, *rest: (verified.append(len(which) * len(rows)), plain(best, which, rows, *rest)))
    floor = topk.floors(ids[:40], x[:40], ids[:60], x[:60], 5)
    short = ids[60:]
    assert topk.search(ids[:40], x[:40], short, x[short], 5, floor).query.size == 0 and not verified


def test_top_k_does_not_wrap_round():
    big = np.array([[2**40, 2**40]], np.int64)
    with pytest.raises(OverflowError):
        topk.search(np.array([0]), big, np.array([1]), big, 1)


# ---- chat

RANKS = None
PROBE = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.text(alphabet=st.one_of(st.sampled_from(list("<>/s[]INSTY|turnend\\")), st.characters(codec="utf-8")), max_size=60) | st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "x"]), max_size=8).map("".join))
def test_escapes_are_undone_and_hide_control_strings(t):
    assert chat.unescape(chat.escape(t)) == t
    assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_chat_reads_back(spark, codec):
    rows = [(1, 0, "user", PROBE), (1, 1, "assistant", PROBE), (1, 2, None, None), (2, 1, "assistant", "b\\"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b"), (None, 0, "user", "x"), (None, None, "user", "y"), (3, 0, "system", "")] + [(4, i, "assistant", f"t{i} ") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1)).repartition(3)
    formatted = chat.format_conversations(df, *codec)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, *codec).collect()}

    def turns(*pairs):
        return hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest()

    assert got[1]["turns_sha256"] == turns(("user", PROBE), ("assistant", PROBE), ("", "")) and got[1]["loss_chars"] == len(PROBE)
    assert got[1]["loss_sha256"] == hashlib.sha256(PROBE.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[2]["turns_sha256"] == turns(("assistant", "a"), ("assistant", "b"), ("assistant", "b\\"))
    assert got[None]["turns_sha256"] == turns(("user", "y"), ("user", "x")) and got[3]["loss_chars"] == 0
    assert got[4]["n_turns"] == 3000 and got[4]["loss_sha256"] == hashlib.sha256("".join(f"t{i} " for i in range(3000)).encode()).hexdigest()
    # offsets run on over a conversation, whatever batches its rows came in
    long = formatted.filter("conv_id = 4").orderBy("seq").collect()
    ends = np.cumsum([len(r["ids"]) // 4 for r in long])
    assert [r["token_start"] for r in long] == [0, *ends[:-1].tolist()] and [r["seq"] for r in long] == list(range(3000))
    assert chat.read_back(chat.format_conversations(df.limit(0), *codec), *codec).collect() == []


def test_chat_takes_long_white_space(spark, codec):
    rows = [(1, 0, "user", " " * 2_000_000), (1, 1, "assistant", "\n" * 2_000_000), (1, 2, "assistant", "a" * 300_000)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), *codec), *codec).collect()
    assert [(r["n_turns"], r["loss_chars"]) for r in got] == [(3, 2_300_000)]
    assert got[0]["loss_sha256"] == hashlib.sha256(("\n" * 2_000_000 + "a" * 300_000).encode()).hexdigest()


# ---- the pipeline


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_pipeline_stages_on_edges(spark, edge_docs, empty_docs):
    """Every stage alone: nulls, empty and long texts, repeated rows, clashing columns; and no rows at all."""
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    rows = edge_docs.count()
    kept = {"quality": range(rows + 1), "near_duplicates": [rows - 2], "decontamination": [rows], "personal_data": [rows], "tokens": [rows]}
    for name, stage in p.STAGES:
        got, none = stage(spark, edge_docs, d), stage(spark, empty_docs, d)
        assert got.count() in kept[name] and none.count() == 0
        assert name == "tokens" or got.columns == edge_docs.columns and got.dtypes == edge_docs.dtypes


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    from docketry.llm import pii, quality

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, folder = docs.columns, str(tmp_path)
    assert [s for s, _ in p.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for name, stage in p.STAGES[:-1]:
        before, docs = docs, core.stored(stage(spark, docs, d), folder, name)
        rows = {r["doc_id"]: r for r in before.collect()}
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns
        if name == "quality":
            score = {r["doc_id"]: r["score"] for r in quality.score_quality(before, spark.read.parquet(f"{d}/labels.parquet")).collect()}
            assert set(after) == {i for i in rows if score[i] >= 0.3} and after
        elif name == "near_duplicates":
            assert set(after) == {i for i, _, c in plain_components([(i, r["text"]) for i, r in rows.items()]) if i == c} and len(after) < len(rows)
        elif name == "decontamination":
            items = [words(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}

            def hit(t):
                w = words(t)
                return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

            assert set(after) == {i for i, r in rows.items() if not hit(r["text"])}
        else:
            assert set(after) == set(rows)
            for i, r in rows.items():
                assert after[i]["text"] == pii.masked(r["text"], pii.find(pii.trained(), [r["text"]])[0][1]) and after[i]["n_chars"] == len(after[i]["text"])
        if name != "personal_data":
            assert all(tuple(after[i]) == tuple(rows[i]) for i in after)
    got = {r["doc_id"]: r for r in p.STAGES[-1][1](spark, docs, d).collect()}
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}


def test_workers_keep_no_memory_of_earlier_tasks(spark, small, monkeypatch):
    import pyarrow as pa

    def kept(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(a) for pair in core._powers.values() for a in pair) for _ in batches], pa.int64())], ["n"])

    monkeypatch.setitem(spark.sparkContext.environment, "DOCKETRY_WORKERS", "of this test alone")
    assert jaccard_join.keep_one(small).count()
    assert spark.range(8, numPartitions=8).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0
