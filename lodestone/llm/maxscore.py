"""Exact top-k inner-product search by MaxScore over sharded postings.

A component is a term; a shard keeps each term's values as a column over its
vectors (a posting list in which every vector stands). For a query, a term's
bound is the most it can add over the shard. Terms go by falling bound; once the
bounds of the last terms together can't lift a vector past the k-th best score
so far, they are non-essential: the essential columns are traversed whole, the
others are probed, a few terms at a time, only for vectors that the remaining
bounds still let compete. Each shard gives its k best for each query, and these
are merged. Scores are exact: sums are kept in a floating type only where its
integers reach, else in 64-bit integers.

Queries meet shards in blocks, by an equi-join. Query blocks are sent to all tasks
only if they take at most ``broadcast_bytes``; else shards are dealt into groups, each
shard moved once, and every group gets a copy of the queries, so what is shuffled are the
vectors once and the queries once a group. Python gets shards in batches of at most
BATCH_BYTES, whatever their number.

Defined results: a null vector, or one with a null or non-finite component, and
rows with a null id take no part; missing components of shorter vectors count as
0; every row with the query's id is the query's own and no candidate; of repeated
rows of a query's id the smallest vector asks; repeated candidate rows each
count. Fewer than k candidates give all of them. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import written

#: Non-essential terms probed between two looks at the bounds.
PROBE = 6
#: Vectors traversed at a time, so that early ones raise the threshold for later ones.
CHUNK = 4096
#: Bytes of a batch of shards on the way to Python, where the session sets no limit of its own.
BATCH_BYTES = 64 << 20
BLOCK_SCHEMA = "block long, n int, dims int, ids binary, vals binary"


def integer_parts(c: Column) -> Column:
    """floor(256 * x) of each component, x as double; null where a component is null or not finite."""
    ok = ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(c, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(vec_id, v) rows packed into blocks of at most ``rows`` vectors."""

    def pack(ids: list[np.ndarray], vals: list[np.ndarray], number: int):
        dims = max(v.shape[1] for v in vals)
        whole = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vals])
        i = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([i.size], pa.int32()), pa.array([dims], pa.int32()), pa.array([i.tobytes()], pa.binary()), pa.array([whole.tobytes()], pa.binary())],
            ["block", "n", "dims", "ids", "vals"],
        )

    def run(batches):
        number, held, ids, vals = TaskContext.get().partitionId() << 24, 0, [], []
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                lists = part.column(1)
                flat, offs = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
                offs, size = offs - offs[0], np.diff(offs)
                v = np.zeros((part.num_rows, int(size.max(initial=0))), np.int64)
                v[np.repeat(np.arange(size.size), size), np.arange(flat.size) - np.repeat(offs[:-1], size)] = flat
                if held and held + part.num_rows > rows:
                    yield pack(ids, vals, number)
                    number, held, ids, vals = number + 1, 0, [], []
                ids.append(part.column(0).to_numpy())
                vals.append(v)
                held += part.num_rows
        if held:
            yield pack(ids, vals, number)

    return vectors.select("vec_id", "v").mapInArrow(run, BLOCK_SCHEMA)


def search_shard(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, work: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query id, vector id and score of each query's k best vectors of one shard, ties to smaller ids.

    ``work`` counts the values traversed in essential and probed in other terms.
    """
    work = Counter() if work is None else work
    dims = max(v.shape[1], q.shape[1])
    v, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, q))
    order = np.argsort(ids, kind="stable")  # ascending ids: a later vector must beat the threshold to enter
    ids, v = ids[order], v[order]
    reach = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * dims
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
    v, q = v.astype(kind), q.astype(kind)
    top, low = v.max(0, initial=None), v.min(0, initial=None)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    columns = np.ascontiguousarray(v.T)
    for qid, query in zip(qids, q, strict=True):
        bound = np.maximum(query * top, query * low)
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # most that terms i, i + 1, ... can add
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        for lo in range(0, ids.size, CHUNK):
            hi = min(lo + CHUNK, ids.size)
            full = best_s.size >= k
            floor = best_s[-1] if full else None
            # The first terms are essential: without them the rest can't pass the threshold.
            essential = max(1, int(np.argmax(rest <= floor))) if full and (rest <= floor).any() else dims
            t = terms[:essential]
            score = query[t] @ columns[t, lo:hi]
            work["essential"] += score.size * t.size
            live = np.flatnonzero(ids[lo:hi] != qid)
            while essential < dims:
                live = live[score[live] + rest[essential] > floor]
                if not live.size:
                    break
                t = terms[essential : essential + PROBE]
                score[live] += query[t] @ columns[t[:, None], lo + live[None, :]]
                work["probed"] += live.size * t.size
                essential += t.size
            if full:
                live = live[score[live] > floor]
            if live.size:
                s, i = np.concatenate([best_s, score[live]]), np.concatenate([best_i, lo + live])
                if s.size > 8 * k:
                    cut = np.partition(s, s.size - k)[s.size - k]
                    s, i = s[s >= cut], i[s >= cut]
                keep = np.lexsort((i, -s))[:k]
                best_s, best_i = s[keep], i[keep]
        out.append((np.full(best_i.size, qid), ids[best_i], best_s.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16_384, block_rows: int = 2048, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of ``vectors``; both have vec_id and v (integers)."""
    queries = queries.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(blocks(queries, block_rows))
    shards = blocks(vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()), shard_rows)
    known = asked.select("block", (F.length("ids") + F.length("vals")).alias("size")).collect()  # a row for each block of queries
    numbers = [r["block"] for r in known]
    if not numbers:
        return shards.select(F.lit(0).cast("long").alias("query_id"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score")).where("false")
    asked = asked.select(F.col("block").alias("q_block"), F.col("n").alias("q_n"), F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals"))
    spark = vectors.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sum(r["size"] for r in known) <= broadcast_bytes:
        both = shards.withColumn("q_block", F.explode(F.lit(numbers).cast("array<bigint>"))).join(F.broadcast(asked), "q_block")
    else:
        groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = shards.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
        both = dealt.join(asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))), "g")

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ints = lambda name, i, col=col: np.frombuffer(col[name][i].as_buffer(), np.int64)
            for i in range(batch.num_rows):
                n, dims, q_n, q_dims = (col[c][i].as_py() for c in ("n", "dims", "q_n", "q_dims"))
                found = search_shard(ints("ids", i), ints("vals", i).reshape(n, dims), ints("q_ids", i), ints("q_vals", i).reshape(q_n, q_dims), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = both.select("n", "dims", "ids", "vals", "q_n", "q_dims", "q_ids", "q_vals").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark, sf_dir):
    """The 5 best vectors for every vector whose id is divisible by 50."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), integer_parts(F.col("embedding")).alias("v"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
