import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import neardup
from lodestone.llm.neardup import deduplicated, near_duplicates, super_minhash
from lodestone.llm.textscan import shingle_sets, text_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, k, num=80, den=100):
    sets = {i: shingles(t, k) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Ünïcode", "café", "日本"]
    base = [rnd.choice(vocab) for _ in range(120)]
    docs = [" ".join(base)] * 3
    for _ in range(60):  # near copies at all distances around the threshold
        w = list(base)
        for _ in range(rnd.randrange(1, 9)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        docs.append(" ".join(w))
    line = "a very common first line of many texts"
    docs += [line + "\n" + " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(2, 40))) for _ in range(60)]
    docs += [None, "", " \t\n", "one", "ONE", "one two", "one  Two", "One two three four", "é " * 5000, ("long text " + " ".join(base)) * 60]
    return list(enumerate(docs))


@pytest.mark.parametrize("k", [4, 5])
def test_against_brute_force(spark, k):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'a' AS rep", "1 AS n", "'b' AS label", "2 AS key").repartition(5)
    got = {tuple(r) for r in near_duplicates(df, k).collect()}
    assert got == brute(docs, k)


def test_sketches_do_not_depend_on_the_batch():
    docs = [t for _, t in corpus()]
    whole = shingle_sets(*text_bytes(pa.array(docs)), 4)
    for i, t in enumerate(docs):
        one = shingle_sets(*text_bytes(pa.array([t], pa.string())), 4)
        assert np.array_equal(one[0], whole[0][whole[1][i] : whole[1][i + 1]])


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(5)
    pool = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sig = super_minhash(np.concatenate([a, b]), np.array([0, 2000, 4000]), 216)
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.12
    parts = neardup.signatures(np.concatenate([a, b]), np.array([0, 2000, 4000]), 216, most=300)
    assert np.array_equal(parts, sig), "a set taken in parts has the same signature"
    small = super_minhash(a[:3], np.array([0, 3]), 216)
    assert (small < np.iinfo(np.uint64).max).all(), "few elements fill all slots"


def test_nulls_repeats_and_ties(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (5, "A B C D E F"), (9, None), (9, None), (1, "")]
    got = sorted(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), key=str)
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([("7", "5", False)] * 2 + [("None", "None", True), ("5", "5", True)] + [("9", "9", True)] * 2 + [("1", "1", True)])
    left = deduplicated(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, gone_id int"), 4)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "5", "9", "None"]


def test_texts_of_one_doc_id_are_linked(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = b.replace("b7", "x")
    rows = [(3, a), (5, a), (5, b), (9, b), (4, c), (4, d), (12, near), (20, d + " e"), (21, "lone text of some words"), (5, b.upper()), (8, None), (8, a)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, num=70).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (12, 3, False), (8, 8, True), (8, 3, False), (4, 4, True), (20, 4, False), (21, 21, True)}


def test_rare_pairs_leave_out_a_large_group(spark):
    """A shingle that a large group and one outsider share meets only the outsider."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for _ in range(400):
        w = list(base)
        w[rnd.randrange(60)] = f"x{rnd.randrange(10**6)}"
        docs.append((len(docs), " ".join(w)))
    docs.append((1000, " ".join(base[:30] + [f"y{i}" for i in range(3)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rest = df.selectExpr("doc_id", "CAST(size(split(text, ' ')) - 3 AS BIGINT) AS n", "CASE WHEN doc_id = 1000 THEN doc_id ELSE 0 END AS label")
    pairs = neardup.rare_pairs(rest, df, 4, 20, 100, neardup.Scratch(spark)).collect()
    sets = {i: shingles(t, 4) for i, t in docs}
    linked = {(i, 1000) for i in range(400) if 100 * len(sets[i] & sets[1000]) >= 20 * len(sets[i] | sets[1000])}
    assert linked and linked <= {(r["a"], r["b"]) for r in pairs} and all(r["b"] == 1000 for r in pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and deduplicated(df).collect() == []
