"""Exact nearest neighbours that read only the cells which can hold one.

Vectors are dealt to the nearest of some centres (k-means on a bounded sample) and stored by
cell, in shells: blocks of at most BLOCK vectors of rising distance from the centre, each with its
least and largest distance. For a query at distance c from a centre, no vector of a shell
[low, high] is nearer than max(c - high, low - c), by the triangle inequality. A search takes
the nearest cells first, until they have k vectors; the k-th best distance then says
which other cells and shells can still improve it, and only these are read. The result is that of
``search.vector_search_batch``, whatever the centres; good centres only make it read less.

Centres (at most CENTRES, bounded in bytes) are sent to all tasks. Near cells together are a place,
a large cell's shells are dealt to several. A query goes once to each place it has to read, so its copies grow
with the places, not the cells; blocks of at most QUERIES queries meet a place's shells one by one and keep the k
best so far, which narrow what the next shell has to give. Blocks and shells are bounded in bytes, and so is what
a place has of blocks at a time (TURN, KEPT): its shells come again for more.

Rows without key or vector, with an empty vector, a null, NaN or infinity in it take no part;
vectors of another length than the index's are not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.search import _nearest, similarity
from lodestone.plans.store import settled

BLOCK, QUERIES, CENTRES, SAMPLE_BYTES, ROUNDS = 4096, 1024, 4096, 64 << 20, 10
#: Bytes of vectors in a shell or block at most, in a place (but for the shells of one cell), in what a task yields at once.
BLOCK_BYTES, PLACE_BYTES, SLICE_BYTES = 2 << 20, 8 << 20, 8 << 20
#: Places of an index that is smaller than so many of PLACE_BYTES; blocks that meet a place's shells in one turn; rows that these keep, about.
PLACES, TURN, KEPT = 64, 64, 1 << 20
#: Bounds are eased by this share of the numbers they come from, far more than rounding can take.
SLACK = 1e-9


def lists(column: pa.Array) -> np.ndarray:
    """A list column of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row from each centre, by differences, a slice of rows at a time."""
    out = np.empty((len(x), len(centres)))
    step = max(1, (1 << 22) // max(1, centres.size))
    for lo in range(0, len(x), step):
        out[lo : lo + step] = np.sqrt(np.square(x[lo : lo + step, None, :] - centres[None, :, :]).sum(2))
    return out


def can_hold(c: np.ndarray, low: np.ndarray, high: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Whether vectors between ``low`` and ``high`` from a centre can lie within ``reach`` of a query ``c`` from it; true where that overflows."""
    with np.errstate(over="ignore", invalid="ignore"):
        return ~(np.maximum(c - high, low - c) > reach + SLACK * (c + high))


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row up to rounding, a slice of rows at a time."""
    size, step = np.square(centres).sum(1) / 2, max(1, (1 << 22) // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *((size - x[lo : lo + step] @ centres.T).argmin(1) for lo in range(0, len(x), step))])


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of at most ``k`` cells; first ones are spread by sampling far rows, cells that lose all rows go."""
    rnd = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres, far = x[rnd.integers(len(x))][None], np.full(len(x), np.inf)
    while len(centres) < min(k, len(x)):
        far = np.minimum(far, np.square(x - centres[-1]).sum(1))
        if not far.any():
            break
        centres = np.vstack([centres, x[rnd.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        held = np.unique(near)
        centres = np.vstack([x[near == c].mean(0) for c in held])
    return centres


class CellIndex:
    """An index stored by ``build``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.shells, self.summary = spark.read.parquet(f"{path}/shells"), spark.read.parquet(f"{path}/cells")
        known = {r["cell"]: r for r in self.summary.collect()}  # at most CENTRES rows
        self.ids = np.array(sorted(known), np.int64)
        self.centres = np.array([known[c]["centre"] for c in self.ids])
        self.n, self.low, self.high = (np.array([known[c][f] for c in self.ids], float) for f in ("n", "low", "high"))
        self.pieces = np.array([known[c]["shells"] for c in self.ids], np.int64)
        self.kind = self.shells.schema["keys"].dataType.elementType.simpleString()
        self.dims = self.centres.shape[1] if len(self.ids) else -1
        self.place, self.parts = self._deal()

    def _deal(self) -> tuple[np.ndarray, np.ndarray]:
        """First place and number of places of each cell: near small cells share one, a large cell has some of its own."""
        place, parts, left, at = np.zeros(len(self.ids), np.int64), np.ones(len(self.ids), np.int64), np.ones(len(self.ids), bool), 0
        room = max(1, min(PLACE_BYTES // (8 * self.dims), int(self.n.sum()) // PLACES)) if len(self.ids) else 1
        while left.any():
            order = distances(self.centres[[left.argmax()]], self.centres)[0].argsort(kind="stable")
            order = order[left[order]]
            take = order[: max(1, np.searchsorted(self.n[order].cumsum(), room, "right"))]
            place[take], left[take] = at, False
            if take.size == 1:
                parts[take] = np.minimum(self.pieces[take], -(-self.n[take] // room))
            at += parts[take[0]]
        return place, parts

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, path: str, cells: int | None = None) -> CellIndex:
        """Stores ``df``'s keys and vectors by cell. ``key`` is unique. By default a cell for each root of the number of rows."""
        spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
        fine = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = settled(df.where(fine).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")))
        sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
        dims, total = (sizes["dims"], sizes["count"]) if sizes else (1, 0)
        rows = rows.where(F.size("v") == dims)
        most = max(1, min(CENTRES, (8 << 20) // dims))
        wanted = max(1, min(most, cells or round(total**0.5)))
        take = max(wanted, min(64 * wanted, SAMPLE_BYTES // (8 * dims)))
        sample = rows.select("v").sample(min(1.0, 1.2 * take / max(1, total)), seed=7).limit(take).toPandas()["v"]  # bounded by SAMPLE_BYTES
        centres = k_means(np.array(sample.tolist(), float), wanted) if len(sample) else np.zeros((1, dims))

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    x = lists(batch.column(1))
                    cell = nearest_centre(x, centres)
                    d = np.sqrt(np.square(x - centres[cell]).sum(1))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d)], ["key", "v", "cell", "d"])

        block = max(1, min(BLOCK, BLOCK_BYTES // (8 * dims)))

        def pack(batches):
            held, size = [], 0

            def shells(rows: pa.Table):
                cell, d, v = rows.column(2).to_numpy(), rows.column(3).to_numpy(), lists(rows.column(1).combine_chunks())
                keys = rows.column(0).combine_chunks()
                cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
                starts = [s for a, b in zip(cuts, np.append(cuts[1:], cell.size), strict=True) for s in range(a, b, block)]
                for a, b in zip(starts, [*starts[1:], cell.size], strict=True):
                    one = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), keys.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([pa.array([cell[a]], pa.int32()), pa.array([b - a], pa.int32()), pa.array([d[a]]), pa.array([d[b - 1]]), one, pa.array([v[a:b].tobytes()], pa.binary())], ["cell", "n", "low", "high", "keys", "vals"])

            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= 4 * block:
                    yield from shells(pa.Table.from_batches(held))
                    held, size = [], 0
            if size:
                yield from shells(pa.Table.from_batches(held))

        dealt = rows.mapInArrow(assign, f"key {kind}, v array<double>, cell int, d double").hint("rebalance", "cell").sortWithinPartitions("cell", "d")
        stored = dealt.mapInArrow(pack, f"cell int, n int, low double, high double, keys array<{kind}>, vals binary")
        stored.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/shells")
        schema = stored.schema
        found = spark.read.schema(schema).parquet(f"{path}/shells").groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("shells"), F.min("low").alias("low"), F.max("high").alias("high"))
        places = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        found.join(F.broadcast(places), "cell").write.mode("overwrite").parquet(f"{path}/cells")
        if not total:
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/shells")
        return cls(spark, path)

    def _near_cells(self, asked: DataFrame, k: int) -> DataFrame:
        """Pairs of each query with the places of its nearest cells that have k vectors together, one for each cell; reach is infinite."""
        ids, place, parts, slices, nearest = self.ids, self.place, self.parts, self._slices, _first_cells(self.centres, self.n, k)

        def run(batches):
            for batch in slices(batches):
                row, cell = np.nonzero(nearest(lists(batch.column(1)))[1])
                of, part = _counted(parts[cell])
                row, cell = row[of], cell[of]
                yield _pairs(batch, row, np.full(row.size, np.inf), place[cell] + part, ids[cell], np.zeros(row.size))

        return asked.mapInArrow(run, self._pair_schema(asked))

    def _more_cells(self, asked: DataFrame, k: int) -> DataFrame:
        """Pairs of each query with all places where a cell can hold a vector within its reach; ``asked``: q, v, reach."""
        low, high, slices, nearest = self.low, self.high, self._slices, _first_cells(self.centres, self.n, k)
        cell, part = _counted(self.parts)
        at = self.place[cell] + part
        cell, at = cell[at.argsort(kind="stable")], np.sort(at)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if at.size else at

        def run(batches):
            for batch in slices(batches):
                c, seen = nearest(lists(batch.column(1)))
                reach = batch.column(2).to_numpy()
                ok = can_hold(c, low, high, reach[:, None])
                row, to = np.nonzero(np.logical_or.reduceat(ok[:, cell], starts, axis=1))
                yield _pairs(batch, row, reach[row], at[starts][to], np.full(row.size, -1), (ok | seen).sum(1)[row])

        return asked.mapInArrow(run, self._pair_schema(asked))

    def _pair_schema(self, asked: DataFrame) -> str:
        return f"q {asked.schema['q'].dataType.simpleString()}, v array<double>, reach double, place int, only int, cells_read int"

    @property
    def _slices(self):
        """Cuts batches of queries so that neither their distances from the centres nor their pairs take more than SLICE_BYTES."""
        step = max(1, SLICE_BYTES // (8 * max(1, len(self.ids), int(self.parts.sum()) * self.dims)))
        return lambda batches: (batch.slice(lo, step) for batch in batches for lo in range(0, batch.num_rows, step))

    def _read(self, pairs: DataFrame, k: int) -> DataFrame:
        """q, key, distance (squared): of the shells of a place (of the cell ``only``, or of any if it is -1) the k best for each query, some more at times."""
        kind, q_kind, ids, centres = self.kind, pairs.schema["q"].dataType.simpleString(), self.ids, self.centres
        most = max(1, min(QUERIES, BLOCK_BYTES // (8 * max(1, self.dims)), KEPT // k))
        turn = max(1, min(TURN, KEPT // (most * k)))
        asked = {r["place"]: -(-r["count"] // most) for r in pairs.groupBy("place").count().collect()}  # at most a row for each place
        small = lambda rows, schema: F.broadcast(self.spark.createDataFrame(rows, schema))
        salts = small([(p, s) for p, s in asked.items()], "place int, salts int")
        salted = pairs.join(salts, "place").withColumn("salt", F.pmod(F.xxhash64("q"), "salts").cast("int"))
        packed = salted.groupBy("place", "salt").agg(F.collect_list(F.struct("q", "v", "reach", "only")).alias("qs")).withColumn("turn", F.floor(F.col("salt") / turn).cast("int"))
        cells = [(int(c), int(p), int(n)) for c, p, n in zip(self.ids, self.place, self.parts, strict=True) if any(x in asked for x in range(p, p + n))]
        found = self.shells.where(F.col("cell").isin([c for c, _, _ in cells])).join(small(cells, "cell int, first int, parts int"), "cell")
        placed = found.withColumn("place", (F.col("first") + F.pmod(F.xxhash64(F.col("keys")[0]), "parts")).cast("int")).join(salts, "place")
        turned = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.floor((F.col("salts") - 1) / turn).cast("int"))))
        both = turned.hint("merge").join(packed, ["place", "turn"]).select("place", "turn", "salt", "cell", "low", "high", "keys", "vals", "qs")

        def run(batches):
            at, held = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    place, part, salt, cell, low, high = (batch.column(c)[i].as_py() for c in range(6))
                    if (place, part) != at:
                        yield from (r for b in held.values() for r in b.rows())
                        at, held = (place, part), {}
                    q, v, reach, only = (batch.column(8)[i].values.field(f) for f in range(4))
                    if salt not in held:
                        held[salt] = _Best(reach.to_numpy(), k)
                    block = held[salt]
                    y, only = lists(v), only.to_numpy()
                    with np.errstate(over="ignore"):
                        c = np.sqrt(np.square(y - centres[np.searchsorted(ids, cell)]).sum(1))
                    use = np.flatnonzero(((only == cell) | (only < 0)) & can_hold(c, low, high, np.sqrt(block.most)))
                    if use.size:
                        keys = batch.column(6)[i].values
                        x = np.frombuffer(batch.column(7)[i].as_buffer(), np.float64).reshape(len(keys), -1)
                        order = pc.sort_indices(keys)
                        qi, vi, d = _nearest(x[order.to_numpy()], y[use], k, most=block.most[use])
                        block.add(use[qi], q.take(pa.array(use[qi])), keys.take(order.take(pa.array(vi))), d)
            yield from (r for b in held.values() for r in b.rows())

        return both.mapInArrow(run, f"q {q_kind}, key {kind}, distance double")

    def search_with_cells(self, queries: DataFrame, key: str, vector: str = "embedding", k: int = 5) -> tuple[DataFrame, DataFrame]:
        """The neighbours, and query_key, cells_read, cells: how many cells were read for each query, of how many."""
        fine = F.col(key).isNotNull() & (F.size(vector) == self.dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        asked = settled(queries.where(fine).select(F.col(key).alias("q"), F.col(vector).cast("array<double>").alias("v")))
        if self.dims < 0:
            asked = asked.where("false")
        w = Window.partitionBy("q").orderBy("distance", "key")
        best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found = best(self._read(settled(self._near_cells(asked, k)), k))
        # Fewer than k in all cells together: nothing is left out.
        reach = found.groupBy("q").agg(F.when(F.count("*") >= k, F.sqrt(F.max("distance"))).otherwise(F.lit(float("inf"))).alias("reach"))
        more = settled(self._more_cells(asked.join(reach, "q").select("q", "v", "reach"), k))
        near = best(self._read(more, k)).select(F.col("q").alias("query_key"), F.col("key").alias(key), "distance", "rank", similarity(F.col("distance")).alias("score"))
        read = more.groupBy(F.col("q").alias("query_key")).agg(F.max("cells_read").alias("cells_read")).withColumn("cells", F.lit(len(self.ids)))
        return near, read

    def search_batch(self, queries: DataFrame, key: str, vector: str = "embedding", k: int = 5) -> DataFrame:
        """query_key, key, distance, rank, score, as ``search.vector_search_batch``; ``key`` is unique in ``queries``."""
        return self.search_with_cells(queries, key, vector, k)[0]


class _Best:
    """The k nearest rows so far for each query of a block, ties by key."""

    def __init__(self, reach: np.ndarray, k: int):
        with np.errstate(over="ignore"):
            self.most, self.k, self.kept, self.new = np.square(reach) * (1 + SLACK), k, [], 0

    def add(self, at: np.ndarray, q: pa.Array, key: pa.Array, d: np.ndarray) -> None:
        self.kept.append(pa.table({"at": pa.array(at), "q": q, "key": key, "distance": pa.array(d)}))
        self.new += len(d)
        if self.new >= len(self.most) * self.k:
            self.cut()

    def cut(self) -> None:
        rows = pa.concat_tables(self.kept)
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("at", "distance", "key")])
        at = rows["at"].take(order).to_numpy()
        rank = np.arange(at.size) - np.searchsorted(at, at)
        rows, at, rank = rows.take(order.filter(pa.array(rank < self.k))).combine_chunks(), at[rank < self.k], rank[rank < self.k]
        last = rank == self.k - 1
        self.most[at[last]] = np.minimum(self.most[at[last]], rows["distance"].to_numpy()[last])
        self.kept, self.new = [rows], 0

    def rows(self):
        if self.kept:
            self.cut()
            yield from self.kept[0].select(["q", "key", "distance"]).to_batches()


def _first_cells(centres: np.ndarray, n: np.ndarray, k: int):
    """Of queries the distances from all centres, and which cells come first: the nearest that have k vectors together."""

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            c = distances(x, centres)
        order = np.argsort(c, 1, kind="stable")
        before = np.cumsum(n[order], 1) - n[order]
        first = np.zeros(c.shape, bool)
        np.put_along_axis(first, order, before < k, 1)
        return c, first

    return run


def _counted(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position as often as its part says, and the number of that time from 0."""
    of = np.repeat(np.arange(len(parts)), parts)
    return of, np.arange(of.size) - (np.cumsum(parts) - parts)[of]


def _pairs(batch: pa.RecordBatch, row: np.ndarray, reach: np.ndarray, place: np.ndarray, only: np.ndarray, cells_read: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    numbers = [pa.array(x.astype(np.int32)) for x in (place, only, cells_read)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(reach), *numbers], ["q", "v", "reach", "place", "only", "cells_read"])
