"""Pruned nearest neighbours against the search of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cells, search

SCHEMA = "id string, embedding array<float>, cell int, q int"


def rows(df):
    return sorted(tuple(r) for r in df.select("query_key", "id", "distance", "rank", "score").collect())


def frame(spark, x, odd=()):
    return spark.createDataFrame([(f"k{i:05}", [float(c) for c in v], 1, 2) for i, v in enumerate(x)] + [(k, v, 1, 2) for k, v in odd], SCHEMA).repartition(7)


@pytest.mark.parametrize("kind", ["clusters", "even", "copies", "line"])
def test_equals_search_of_all(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 50)
    rnd = np.random.default_rng(5)
    x = {
        "clusters": lambda: rnd.normal(size=(900, 6)) + 40 * rnd.integers(0, 4, (900, 1)),
        "even": lambda: rnd.normal(size=(600, 16)),
        "copies": lambda: np.vstack([np.tile(rnd.normal(size=(1, 3)), (500, 1)), rnd.normal(size=(100, 3))]),
        "line": lambda: np.floor(rnd.normal(size=(700, 1)) * 50),
    }[kind]().astype(np.float32)
    odd = [("n0", None), ("n1", []), ("n2", [1.0] * (x.shape[1] - 1) + [None]), (None, x[0].tolist()), ("nan", [float("nan")] * x.shape[1]), ("short", [1.0] * (x.shape[1] + 1))]
    df = frame(spark, x, odd)
    asked = df.where("id < 'k00060' OR id >= 'n'")
    index = cells.CellIndex.build(df, "id", "embedding", str(tmp_path / "i"), 9)
    for k in (1, 20):
        got, read = index.search_with_cells(asked, "id", k=k)
        assert rows(got) == rows(search.vector_search_batch(df, asked.where(F.size("embedding") == x.shape[1]), "id", k=k).where("query_key <> 'nan'"))
        seen = {r["query_key"]: r["cells_read"] for r in read.collect()}
        assert set(seen) == {f"k{i:05}" for i in range(60)} and {r["cells"] for r in read.collect()} == {len(index.ids)}
        if kind == "clusters" and k == 1:
            assert sum(seen.values()) < 0.6 * len(seen) * len(index.ids)


def test_hot_cell_is_many_shells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 64)
    monkeypatch.setattr(cells, "QUERIES", 7)
    rnd = np.random.default_rng(6)
    df = frame(spark, rnd.normal(size=(1000, 4)).astype(np.float32))
    index = cells.CellIndex.build(df, "id", "embedding", str(tmp_path / "i"), 1)
    sizes = [r["n"] for r in index.shells.select("n").collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 64
    asked = df.where("id < 'k00040'")
    assert rows(index.search_batch(asked, "id")) == rows(search.vector_search_batch(df, asked, "id"))


@pytest.mark.parametrize("far", [0, 1e8, 1e200])
def test_only_near_rows_are_summed(far, monkeypatch):
    """The nearest rows are those of sums over all, bit by bit, ties included; only those that can be among them are summed."""
    rnd = np.random.default_rng(8)
    v = np.vstack([rnd.normal(size=(2000, 8)), np.round(rnd.normal(size=(2000, 8))), np.ones((40, 8))]) + far
    q = np.vstack([v[::50], rnd.normal(size=(9, 8))])
    summed = []
    plain = np.square
    monkeypatch.setattr(np, "square", lambda x: (summed.append(np.size(x)), plain(x))[1])
    got = search._nearest(v, q, 5)
    monkeypatch.undo()
    if not far:
        assert sum(summed) < 0.1 * q.size * len(v)
    want = search._nearest_plainly(v, q, 5)
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    most = np.full(len(q), np.median(want[2]))
    near = search._nearest(v, q, 5, most=most)
    if far < 1e100:
        assert all(np.array_equal(a[want[2] <= most[0]], b[near[2] <= most[0]]) for a, b in zip(want, near, strict=True)) and len(near[0]) < len(want[0])


def test_shells_are_copied_by_their_own_queries(spark, tmp_path, monkeypatch):
    """Queries of other cells don't make more copies of a shell."""
    monkeypatch.setattr(cells, "QUERIES", 40)
    df = frame(spark, np.random.default_rng(9).normal(size=(600, 4)).astype(np.float32))
    index = cells.CellIndex.build(df, "id", "embedding", str(tmp_path / "i"), 20)
    read, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: (read.append(self) if "qs" in self.columns else None, plain(self, run, schema))[1])
    got = rows(index.search_batch(df.where("id < 'k00040'"), "id"))
    assert len(read) == 2 and all(r.count() <= 3 * index.shells.count() for r in read)
    assert got == rows(search.vector_search_batch(df, df.where("id < 'k00040'"), "id"))


def test_queries_go_to_places_in_slices(spark, tmp_path, monkeypatch):
    """A query that has to read most cells isn't copied by each of them, and no task yields all copies at once."""
    monkeypatch.setattr(cells, "PLACES", 8, raising=False)
    monkeypatch.setattr(cells, "SLICE_BYTES", 1 << 16, raising=False)
    df = frame(spark, np.random.default_rng(10).normal(size=(900, 16)).astype(np.float32))
    index = cells.CellIndex.build(df, "id", "embedding", str(tmp_path / "i"), 300)
    asked, made, plain = df.where("id < 'k00060'"), [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: (made.append((self, run)) if "reach" in schema else None, plain(self, run, schema))[1])
    got, read = index.search_with_cells(asked, "id", k=3)
    assert rows(got) == rows(search.vector_search_batch(df, asked, "id", k=3))
    assert len(index.ids) > 200 and min(r["cells_read"] for r in read.collect()) > 100
    assert len(made) == 2
    for queries, run in made:
        pairs = list(run(iter(queries.toArrow().combine_chunks().to_batches())))
        assert 60 <= sum(p.num_rows for p in pairs) <= 60 * 16
        assert max(p.nbytes for p in pairs) <= 1 << 16


@pytest.mark.parametrize("n", [1, 40])
def test_places_take_blocks_in_turns(spark, tmp_path, monkeypatch, n):
    """Few blocks at a time, places of many cells, a cell of many places, shells cut by bytes."""
    for name, value in {"QUERIES": 7, "TURN": 2, "KEPT": 70, "PLACES": 3, "BLOCK_BYTES": 4 * 8 * 20, "BLOCK": 60}.items():
        monkeypatch.setattr(cells, name, value)
    x = np.round(np.random.default_rng(11).normal(size=(700, 4)), 1).astype(np.float32)  # with ties
    df = frame(spark, np.vstack([x, x[:90]]))
    index = cells.CellIndex.build(df, "id", "embedding", str(tmp_path / "i"), n)
    assert max(r["n"] for r in index.shells.select("n").collect()) <= 20
    assert int(index.parts.sum()) > 3 if n == 1 else len(set(index.place)) < len(index.ids)
    asked = df.where("id < 'k00050' OR id >= 'k00750'")
    for k in (1, 6, 1000):
        assert rows(index.search_batch(asked, "id", k=k)) == rows(search.vector_search_batch(df, asked, "id", k=k))


def test_of_little(spark, tmp_path):
    one = frame(spark, np.array([[1.0, 2.0]], np.float32))
    index = cells.CellIndex.build(one, "id", "embedding", str(tmp_path / "one"))
    assert [r[1] for r in rows(index.search_batch(one, "id"))] == ["k00000"]
    assert rows(index.search_batch(one.where("false"), "id")) == []
    none = cells.CellIndex.build(one.where("false"), "id", "embedding", str(tmp_path / "none"))
    assert rows(none.search_batch(one, "id")) == []
