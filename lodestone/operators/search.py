"""Search operators: weighted keyword scores, exact vector top-k, name candidates, context."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms
from lodestone.operators import patterns as pat
from lodestone.operators.graph import reached
from lodestone.plans.store import settled


def keyword_score(query: str, weights: dict[str, int]) -> Column:
    """Sum over the query's terms of the weights of the columns that contain them, case-sensitive."""
    parts = [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(t)).cast("int") * w for t in query_terms(query) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def keyword_search(df: DataFrame, query: str, weights: dict[str, int], order: str, limit: int | None = 3) -> DataFrame:
    """Rows with a positive score and ``score``, best first, ties in ``order``; all of them if ``limit`` is None."""
    found = df.withColumn("score", keyword_score(query, weights)).where(F.col("score") > 0)
    return found if limit is None else found.orderBy(F.desc("score"), order).limit(limit)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + distance), 4)


def vector_search(df: DataFrame, query: list[float], key: str, vector: str = "embedding", k: int = 5) -> DataFrame:
    """The k rows nearest to ``query`` by squared L2 distance, with ``distance`` and ``score``; exact."""
    d = squared_l2(F.col(vector), F.lit([float(x) for x in query]))
    return df.withColumn("distance", d).orderBy("distance", key).limit(k).withColumn("score", similarity(F.col("distance")))


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """block, dims, keys, vals: about ``rows`` vectors of one length in each row, as doubles; a task packs its own rows."""

    def run(batches):
        task, made, held = TaskContext.get().partitionId() << 32, 0, {}

        def packed(dims):
            keys, vals = zip(*held.pop(dims), strict=True)
            every, names = np.concatenate(vals), pa.concat_arrays(keys)
            lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            return pa.RecordBatch.from_arrays([pa.array([task + made]), pa.array([dims]), lists, pa.array([every.tobytes()])], ["block", "dims", "keys", "vals"])

        for batch in batches:
            size, vals = batch.column(2).to_numpy(), batch.column(1).flatten().to_numpy()
            begin = np.cumsum(size) - size
            for dims in np.unique(size).tolist():
                at = np.flatnonzero(size == dims)
                held.setdefault(dims, []).append((batch.column(0).take(pa.array(at)), vals[begin[at][:, None] + np.arange(dims)]))
                if sum(len(v) for _, v in held[dims]) >= rows:
                    yield packed(dims)
                    made += 1
        for dims in list(held):
            yield packed(dims)
            made += 1

    whole = F.col(key).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    kept = df.where(whole).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("size"))
    return kept.mapInArrow(run, f"block long, dims long, keys array<{df.schema[key].dataType.simpleString()}>, vals binary")


def _nearest(v: np.ndarray, q: np.ndarray, k: int, step: int = 64, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``q`` and ``v`` and squared distance of the k nearest rows, ties to the earlier; sums run in the order of dimensions.

    One matrix product says, up to what rounding can take, which rows can be among them; only these are summed. ``most``: for each
    row of ``q`` the largest distance of use.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        vv, qq = np.square(v).sum(1), np.square(q).sum(1)
        error = 8 * np.finfo(float).eps * (v.shape[1] + 8) * np.square(np.sqrt(vv.max(initial=0)) + np.sqrt(qq))
    if not (np.isfinite(vv).all() and np.isfinite(error).all()):
        return _nearest_plainly(v, q, k, step)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(q), step):
        some, slack = q[lo : lo + step], error[lo : lo + step]
        near = some @ v.T
        near *= -2
        near += vv
        near += qq[lo : lo + step, None]
        limit = np.full(len(some), np.inf) if most is None else most[lo : lo + step] + slack
        under = near <= limit[:, None]
        if len(v) > k:
            many = np.flatnonzero(np.count_nonzero(under, axis=1) > 4 * k)  # the others have few to sum as it is
            if many.size:
                limit[many] = np.minimum(limit[many], np.partition(near[many], k - 1, 1)[:, k - 1] + 2 * slack[many])
                under = near <= limit[:, None]
        qi, vi = np.divmod(np.flatnonzero(under), len(v)) if len(v) else (np.zeros(0, np.int64),) * 2
        d = np.zeros(qi.size)
        for x, y in zip(v.T, some.T, strict=True):
            d += np.square(x[vi] - y[qi])
        at = np.lexsort((vi, d, qi))
        at = at[np.arange(at.size) - np.searchsorted(qi, qi) < k]  # qi rises, so it is the same before and after sorting
        out.append((lo + qi[at], vi[at], d[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _nearest_plainly(v: np.ndarray, q: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions in ``q`` and ``v`` and squared distance of the k nearest rows, ties to the earlier, for numbers that aren't finite or whose squares aren't."""
    out = []
    columns = np.ascontiguousarray(v.T)
    for lo in range(0, len(q), step):
        some = q[lo : lo + step]
        d = np.zeros((len(some), len(v)))
        for x, y in zip(columns, some.T, strict=True):
            d += np.square(x[None, :] - y[:, None])
        for i, row in enumerate(d):
            at = np.flatnonzero(~np.isnan(row))
            if at.size > k:
                at = at[row[at] <= np.partition(row[at], k - 1)[k - 1]]
            at = at[np.argsort(row[at], kind="stable")[:k]]
            out.append((np.full(at.size, lo + i), at, row[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def vector_search_batch(df: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", k: int = 5, shard_rows: int = 16_384, broadcast_rows: int = 2048, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """query_key, key, distance, score, rank: the k nearest rows for each row of ``queries`` (same columns), exact.

    Shards of ``df`` meet blocks of ``broadcast_rows`` queries and keep k rows a
    query, so only these are shuffled and ranked. Up to ``broadcast_bytes`` (counted) the
    blocks are sent to all tasks; beyond, they are copied to groups of shards, and a shard moves
    once. ``key`` is unique on either side. Rows without key or vector, with an empty
    vector or a null in it take no part; vectors of other lengths are not compared.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    asked = settled(_blocks(queries, key, vector, broadcast_rows)).select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"), F.col("keys").alias("q_keys"), F.col("vals").alias("q_vals"))
    shards = _blocks(df, key, vector, shard_rows)
    size = asked.agg(F.coalesce(F.sum(F.length("q_vals") + F.octet_length(F.to_json("q_keys"))), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        both = shards.join(F.broadcast(asked), F.col("dims") == F.col("q_dims"))
    else:
        groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = shards.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
        copies = asked.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
        both = dealt.join(copies, (dealt["g"] == copies["g"]) & (F.col("dims") == F.col("q_dims")))

    def run(batches):
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                keys, q_keys = (col[c][i].values for c in ("keys", "q_keys"))
                dims = col["dims"][i].as_py()
                v, q = (np.frombuffer(col[c][i].as_buffer(), np.float64).reshape(-1, dims) for c in ("vals", "q_vals"))
                order = pc.sort_indices(keys)
                qi, vi, d = _nearest(v[order.to_numpy()], q, k)
                yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(qi)), keys.take(order).take(pa.array(vi)), pa.array(d)], ["query_key", "key", "distance"])

    found = both.select("dims", "keys", "vals", "q_keys", "q_vals").mapInArrow(run, f"query_key {kind}, key {kind}, distance double")
    w = Window.partitionBy("query_key").orderBy("distance", "key")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_key", F.col("key").alias(key), "distance", "rank", similarity(F.col("distance")).alias("score"))


def name_candidates(chunks: DataFrame, text: str = "text", score: str = "score", pattern: str = pat.NAME, stop: tuple[str, ...] = pat.NOT_NAMES, keys: tuple[str, ...] = ()) -> DataFrame:
    """name, score of upper-case names in scored chunks: a name's best chunk counts; ``at`` orders ties by first sight. By ``keys``, if given."""
    each = chunks.select(*keys, F.col(score).alias("score"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("pos", "name"))
    kept = each.where(~F.col("name").isin(*stop) & ~F.col("name").startswith("TB_") & ~F.col("name").startswith("SQ_")) if stop else each
    return kept.groupBy(*keys, "name").agg(F.max("score").alias("score"), F.min(F.struct((-F.col("score")).alias("s"), "pos")).alias("at"))


def rendered_struct() -> Column:
    """A struct as C text, from its row's columns."""
    field = F.transform(
        "fields",
        lambda f: F.concat(F.lit("    "), f["c_type"], F.lit(" "), f["name"], F.coalesce(F.concat(F.lit("["), f["size"], F.lit("]")), F.lit("")), F.lit(";"), F.coalesce(F.concat(F.lit("    /* "), f["comment"], F.lit(" */")), F.lit(""))),
    )
    return F.array_join(F.concat(F.array(F.concat(F.lit("/* "), "description", F.lit(" */")), F.lit("typedef struct {")), field, F.array(F.concat(F.lit("} "), "name", F.lit(";")))), "\n")


def rendered_table() -> Column:
    """A table definition as SQL text, from its row's columns."""
    cols = F.transform("columns", lambda c: F.concat(F.lit("    "), c["name"], F.lit("  "), c["data_type"], F.when(c["nullable"], "").otherwise("  NOT NULL")))
    key = F.when(F.size("primary_key") > 0, F.array(F.concat(F.lit("    PRIMARY KEY ("), F.array_join("primary_key", ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("CREATE TABLE "), "name", F.lit(" (\n"), F.array_join(F.concat(cols, key), ",\n"), F.lit("\n);"), F.coalesce(F.concat(F.lit("\n-- "), "comment"), F.lit("")))


def context_many(rel: dict[str, DataFrame], entries: DataFrame, depth: int = 2) -> DataFrame:
    """entry, section, pos, filename, content, role, relevance: all that belongs to each function of ``entries`` (name, distinct).

    Its body; the first struct of each header that it includes; the bodies of what
    it calls within ``depth`` steps; the definitions of all tables that these use.
    Missing headers, functions and definitions are left out.
    """
    functions, structs, ddl, usage = (rel[k] for k in ("functions", "structs", "tables_ddl", "sql_usage"))
    edges = rel["function_calls"].select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    asked = entries.select(F.col("name").alias("entry"), "name")
    fn = functions.join(asked, "name")
    row = lambda section, pos, content, role, relevance: ["entry", F.lit(section).alias("section"), pos.alias("pos"), F.col("file_path").alias("filename"), content.alias("content"), role.alias("role"), F.lit(relevance).alias("relevance")]
    order = lambda c: F.array(F.lpad(c.cast("string"), 9, "0"))
    entry = fn.select(*row(1, order(F.lit(0)), F.col("body"), F.lit("entry"), "direct"))
    inc = fn.select("entry", F.posexplode("includes").alias("ipos", "file_path")).where(F.col("file_path") != pat.COMMON_HEADER)
    first = structs.groupBy("file_path").agg(F.min_by(F.struct("name", "description", "fields"), "ord").alias("s")).select("file_path", "s.*")
    headers = inc.join(first, "file_path").select(*row(2, order(F.col("ipos")), rendered_struct(), F.lit("struct"), "direct"))
    called = reached(edges, asked, depth, ("entry",)).groupBy("entry", "name").agg(F.min("depth").alias("depth"))
    bodies = functions.join(called, "name").select(*row(3, F.concat(order(F.col("depth")), F.array("name")), F.col("body"), F.concat(F.lit("callee ("), "name", F.lit(")")), "dependency"))
    who = called.unionByName(asked.select("entry", "name", F.lit(0).alias("depth"))).withColumnRenamed("name", "function_name")
    tables = usage.join(who, "function_name").groupBy("entry", F.col("table_name").alias("name")).agg(F.min(F.struct("depth", "function_name", "ord")).alias("seen"))
    defs = ddl.join(tables, "name").select(*row(4, F.concat(order(F.col("seen.depth")), F.array("seen.function_name"), F.col("seen.ord")), rendered_table(), F.concat(F.lit("table ("), "name", F.lit(")")), "dependency"))
    return entry.unionByName(headers).unionByName(bodies).unionByName(defs)


def context(rel: dict[str, DataFrame], name: str, depth: int = 2) -> DataFrame:
    """``context_many`` of one function, without ``entry``."""
    spark = rel["functions"].sparkSession
    return context_many(rel, spark.range(1).select(F.lit(name).alias("name")), depth).drop("entry")
