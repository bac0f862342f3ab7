"""Periodic runs against a search of all periods and places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import queries, runs, words

SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_runs(w, least=12):
    """(start, length, period) by start, then period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((i, j - i, q) for (i, j), q in best.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant=True):
    w = SPLIT(text or "")
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), s, n, q, 1000 * n // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic_words(rng, n):
    out: list[str] = []
    while len(out) < n:
        kind = rng.random()
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out += part * rng.randint(1, 9) if kind < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        if kind > 0.9 and out:  # a period of periods
            out += out[-rng.randint(1, 40) :] * rng.randint(1, 3)
    return out[:n]


def test_random_texts(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(periodic_words(rng, rng.choice((0, 5, 11, 12, 13, 40, 150, 400))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    for i, text in rows:
        w = text.split()
        found = brute_runs(w)
        assert [tuple(r) for r in out[i]["runs"]] == found
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        assert out[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4))
def test_extensions(stretches):
    symbols = np.array([10 * i + x for i, s in enumerate(stretches) for x in s], np.int64)
    first = np.concatenate([[0], np.cumsum([len(s) for s in stretches])])
    if not len(symbols):
        return
    end = np.repeat(first[1:], np.diff(first))
    order, rank = runs.suffix_array(symbols, end)
    assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i : end[i]].tolist())
    assert (rank[order] == np.arange(len(symbols))).all()
    agree = runs.Extension(symbols, end)
    pairs = [(x, y) for x in range(len(symbols)) for y in range(len(symbols)) if x != y]
    if pairs:
        x, y = map(np.array, zip(*pairs, strict=True))
        want = [next((k for k in range(99) if a + k >= end[a] or b + k >= end[b] or symbols[a + k] != symbols[b + k]), 0) for a, b in pairs]
        assert agree(x, y).tolist() == want


def test_range_minimum():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1000, 777).astype(np.int32)
    least = runs.RangeMinimum(values)
    a, b = np.sort(rng.integers(0, 777, (2, 5000)), axis=0)
    assert least(a, b).tolist() == [int(values[x : y + 1].min()) for x, y in zip(a, b, strict=True)]


def test_awkward_rows(spark):
    long = " ".join(["z"] * 60_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (None, "a b " * 9), (4, "x " * 11), (5, "x\t" * 12), (6, "é ü " * 6), (7, long), (8, "w" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("runs"), F.lit(1).alias("start"))
    got = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs).collect())
    small = [(str(i), brute_runs((t or "").split()), t) for i, t in rows if i != 7]
    assert [(i, f) for i, f, _ in got if i != "7"] == sorted((i, f) for i, f, _ in small)
    assert [(f, c) for i, f, c in got if i == "7"] == [([(0, 60_000, 1)], "z")]
    assert {c for i, _, c in got if i == "6"} == {"é ü"}
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_blocks_agree(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(periodic_words(rng, 90)) for _ in range(20)]
    whole = [runs.block_runs(b) for b in words.blocks(pa.array(texts))]
    assert len(whole) == 1
    parts, shift = [], 0
    for b in words.blocks(pa.array(texts), limit=200):
        parts += [(int(s) + shift, int(e) + shift, int(p)) for s, e, p in zip(*runs.block_runs(b), strict=True)]
        shift += int(b.first[-1])
    assert sorted(parts) == sorted(map(tuple, np.stack(whole[0], 1).tolist()))
    assert runs.ASKED == 1 << 19
    pieces = [sum(len(x[0]) for x in runs.grid(np.array([30, 7, 0, 12]), n)) for n in (1, 5, 1000)]
    assert len(set(pieces)) == 1


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).select(*columns).collect()}
    assert got == {brute_row(r["doc_id"], r["text"]) for r in docs}
