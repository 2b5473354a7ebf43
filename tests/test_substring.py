"""The substring index against a scan of all texts."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, substring
from lodestone.operators.substring import SubstringIndex

SCHEMA = "id long, title string, body string, part int, number string"
WEIGHTS = {"title": 3, "body": 1}


def texts():
    rnd = random.Random(3)
    parts = ["ab", "fee", "Fee", "rate", "AA_PAY", "日本", "語", "𝒳𝒴𝒵", "é", " ", "\n", "%", "_", "\\", "x" * 50, "TB_", "\x00"]
    make = lambda n: "".join(rnd.choices(parts, k=rnd.randrange(n)))
    rows = [(i, make(4), make(30), 7, "clash") for i in range(400)]
    rows += [(900, None, None, 0, ""), (901, "", "", 0, ""), (902, "a", "ab", 0, ""), (903, None, "z" * 1_100_000 + "needle" + "y" * 1_100_000, 0, ""), (5, "repeat fee", "fee", 0, ""), (5, "repeat fee", "fee", 0, "")]
    return rows


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(texts(), SCHEMA).repartition(6)
    path = str(tmp_path_factory.mktemp("index") / "i")
    return df, SubstringIndex.build(df, WEIGHTS, path), path


QUERIES = ["fee", "fee fee rate", "ab", "日本 語é", "𝒳𝒴", "𝒴𝒵\n", "x" * 60, "nothing_here", "needle", "", "a", "% _ \\ TB_AA_PAY", "zzneedleyy", "éab AA_PAY fee", "\x00fee", "日本語 ra"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_a_scan(spark, index, query):
    df, idx, _ = index
    want = search.keyword_search(df, query, WEIGHTS, "id", None)
    got = idx.keyword_search(query, WEIGHTS, "id", None)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    top = lambda d: [(r["id"], r["score"]) for r in d.collect()]
    assert top(idx.keyword_search(query, WEIGHTS, "id", 5)) == top(search.keyword_search(df, query, WEIGHTS, "id", 5))


def test_candidates_lose_nothing_and_are_few(spark, index):
    df, idx, _ = index
    for term in ("fee", "AA_PAY", "needle", "ab", "語"):
        found = {r[0] for r in idx.candidates([term], ["body"]).collect()}
        having = {r[0] for r in idx.rows.where(F.contains("body", F.lit(term))).select(idx.number).collect()}
        assert having <= found and len(found) <= len(having) + 20


def test_only_asked_folders_are_read(spark, index, tmp_path):
    """Lists of other folders may be broken, and the result stays."""
    _, idx, path = index
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    want = [(r["id"], r["score"]) for r in idx.keyword_search("needle", WEIGHTS, "id").collect()]
    keys = [(c, g) for c in WEIGHTS for g in substring.grams("needle").tolist()]
    asked = {r[0] for r in spark.createDataFrame(keys, "field string, gram long").select(substring.shard(substring.SHARDS)).collect()}
    other = [f for t in ("postings", "counts") for d in Path(copy, t).glob("shard=*") if int(d.name.split("=")[1]) not in asked for f in d.glob("*.parquet")]
    assert len(other) > 3
    sub = SubstringIndex(spark, copy)
    for f in other:
        f.write_bytes(b"broken")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert [(r["id"], r["score"]) for r in sub.keyword_search("needle", WEIGHTS, "id").collect()] == want == [(903, 1)]


def test_of_nothing(spark, tmp_path):
    idx = SubstringIndex.build(spark.createDataFrame([], SCHEMA), WEIGHTS, str(tmp_path / "none"))
    assert idx.keyword_search("fee ab", WEIGHTS, "id").collect() == []


def test_lists_are_cut_into_parts(spark, tmp_path, monkeypatch):
    """Numbers of many parts, lists handed over in fragments: the same rows."""
    monkeypatch.setattr(substring, "PART_BITS", 3)
    monkeypatch.setattr(substring, "PAIRS", 500)
    df = spark.createDataFrame(texts(), SCHEMA).repartition(3)
    idx = SubstringIndex.build(df, ["body"], str(tmp_path / "parts"))
    assert idx.postings.select("part").distinct().count() > 30
    for query in ("fee rate", "AA_PAY", "ab"):
        assert sorted(map(str, idx.keyword_search(query, {"body": 2}, "id", None).collect())) == sorted(map(str, search.keyword_search(df, query, {"body": 2}, "id", None).collect()))
