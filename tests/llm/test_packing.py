import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.packing import best_cuts, default_vocabulary, pack, tail_lengths

TEXTS = [
    (1, "It's a <|endoftext|> test, 123 4.5 x² naïve café́."),
    (2, None), (3, ""), (4, "  \n\t "), (5, "日本語 text x 😀y. İstanbul ΣΑΣ! ÀÉÎ×÷ß"),
    (6, "one two three. " * 4000), (7, "x" * 9000), (8, "no stop here " * 900), (8, "no stop here " * 900), (None, "null id"),
]


def check(rows, texts, width=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_vocabulary())
    want = sorted([[*tok.encode(t or "", add_special_tokens=False).ids, 1] for _, t in texts], key=len)
    seqs, left = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
        left[r["doc_id"], r["doc_tokens"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= width
    got = defaultdict(int)
    for t, ids in [(t, [*tok.encode(t[1] or "", add_special_tokens=False).ids, 1]) for t in texts]:
        mine = [r for r in left[t[0], len(ids)]]
        assert sum(r["length"] for r in mine) == len(ids) * sum(x == t for x in texts)
        for r in mine:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
        got[t] += 1
    lengths = [sum(r["length"] for r in p) for p in seqs.values()]
    pad = sum(0 if n & (n - 1) == 0 else width - n for n in lengths)
    return pad / sum(lengths), want


def test_round_trip_of_odd_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "'x' AS start", "1 AS length").coalesce(1)
    pad, _ = check(pack(docs, default_vocabulary(), block=4096).collect(), TEXTS)
    assert pad < 0.02


def test_documents_round_trip_with_little_padding(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    pad, _ = check(pack(docs, default_vocabulary()).collect(), texts)
    assert pad < 0.01


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), default_vocabulary()).collect() == []


def brute(at, cost, width, last):
    n = len(at)
    pos, pen = [0, *at], [0, *cost]
    f = [0] + [10**9] * n
    for i in range(1, n + 1):
        for j in range(i):
            if pos[i] - pos[j] <= width:
                f[i] = min(f[i], f[j] + width - pos[i] + pos[j] + pen[i])
    return f[n] if last else min(f[j] for j in range(n + 1) if pos[n] - pos[j] <= width)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=30), st.integers(9, 25), st.booleans())
def test_cuts_are_optimal(steps, width, last):
    at = np.cumsum([s for s, _ in steps]).tolist()
    cost = [c for _, c in steps]
    cuts = best_cuts(at, cost, width, last)
    pen = dict(zip(at, cost, strict=True))
    total, lo = 0, 0
    for c in cuts:
        assert 0 < c - lo <= width
        total, lo = total + width - (c - lo) + pen[c], c
    assert total == brute(at, cost, width, last)


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1500, 2047, 2048])
def test_tail(n):
    parts = tail_lengths(n, 2048)
    assert sum(parts) == n
