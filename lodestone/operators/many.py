"""Many queries in one plan: keyword scores, contexts, candidates and files for a whole table of queries.

A stated set of queries (distinct, sent to all tasks) meets all rows in one pass:
one Aho-Corasick automaton of all their terms goes over each text once, and each task
keeps the k best rows of each query, so what is shuffled is bounded by tasks, queries
and k. Rows are scored in blocks, one query at a time over the rows that hold its terms, so a task
holds a block's hits and the best rows, never all pairs of rows and queries; a query whose rarest terms a block lacks,
so that it can't reach the k-th best score yet known, passes it by. The strategies for all queries take a fixed number of jobs, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms
from lodestone.operators import search
from lodestone.plans.store import settled

#: A task scores its rows in blocks of about so many hits (terms in texts).
HITS = 2_000_000


def sortable(x) -> tuple:
    """A value that sorts as Spark sorts it: null first, arrays and structs by their parts."""
    if isinstance(x, dict):
        x = list(x.values())
    return () if x is None else (tuple(map(sortable, x)) if isinstance(x, (list, tuple)) else x,)


def keyword_search_many(df: DataFrame, queries: DataFrame, weights: dict[str, int], key: str, order: str, k: int = 3) -> DataFrame:
    """query, key, score, rank: for each distinct ``query`` the k rows that ``search.keyword_search`` gives it.

    Ties go by ``order`` (null first, then by its values), rows of the same order by ``key``. Queries that are null or
    have no terms, and queries that no row matches, give no rows. A repeated term of a query counts each time.
    """
    asked = [r["query"] for r in queries.select("query").distinct().where(F.col("query").isNotNull()).collect()]  # the stated set
    place_of: dict[str, int] = {}
    uses = [(number, place_of.setdefault(term, len(place_of))) for number, q in enumerate(asked) for term in query_terms(q)]
    terms = list(place_of)
    asker, wanted = np.array(uses, np.int64).reshape(-1, 2).T  # a query's terms lie together
    begin = np.searchsorted(asker, np.arange(len(asked) + 1))
    columns, points = list(weights), list(weights.values())
    kind = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    held_schema = f"number long, score long, key {kind[key]}, ord {kind[order]}"
    if not terms:
        return df.select(F.lit("").alias("query"), F.col(key), F.lit(0).cast("long").alias("score"), F.lit(1).alias("rank")).where("false")

    def place(values: list) -> np.ndarray:
        """Ranks of (order, key) pairs as Spark sorts them, nulls first."""
        flat = [sortable(v) for v in values]
        seen = {v: i for i, v in enumerate(sorted(set(flat)))}
        return np.array([seen[v] for v in flat], np.int64)

    def best(number: np.ndarray, score: np.ndarray, rank: np.ndarray) -> np.ndarray:
        at = np.lexsort((rank, -score, number))
        sorted_number = number[at]
        first = np.searchsorted(sorted_number, sorted_number, "left")
        return at[np.arange(at.size) - first < k]

    def block_best(found: list[tuple], rows: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """number, score, row of the k best of a block's rows, in whose order ties go, where they reach ``floor``; ``found``: row, terms, weight."""
        term = np.concatenate([t for _, t, _ in found])
        row = np.repeat(np.array([r for r, _, _ in found], np.int64), [t.size for _, t, _ in found])
        gain = np.repeat(np.array([w for _, _, w in found], np.int64), [t.size for _, t, _ in found])
        at = np.argsort(term, kind="stable")
        row, gain = row[at], gain[at] if len(set(points)) > 1 or points[0] != 1 else None
        held = np.bincount(term, minlength=len(terms))
        ends = np.cumsum(held)
        starts = ends - held
        # All but a query's rarest terms together stay below its floor: rows without any of the rarest are left out.
        rare = wanted[np.lexsort((held[wanted], asker))]
        spare = (floor - 1) // max(1, sum(w for w in points if w > 0))
        sums = np.append(0, np.cumsum(held[rare]))
        need = np.maximum(begin[1:] - spare, begin[:-1])
        number, score, chosen = [], [], []
        for n in np.flatnonzero(sums[need] > sums[begin[:-1]]).tolist():
            parts = [slice(starts[t], ends[t]) for t in rare[begin[n] : begin[n + 1]].tolist()]
            s = np.bincount(np.concatenate([row[p] for p in parts]), None if gain is None else np.concatenate([gain[p] for p in parts]), rows)
            at = np.flatnonzero(s >= floor[n])
            if at.size > k:
                at = at[s[at] >= np.partition(s[at], at.size - k)[at.size - k]]
            at = at[np.argsort(-s[at], kind="stable")[:k]]
            number.append(np.full(at.size, n, np.int64))
            score.append(s[at].astype(np.int64))
            chosen.append(at)
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (number, score, chosen))

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            machine.add_word(t, i)
        machine.make_automaton()
        held, new, floor = None, [], np.ones(len(asked), np.int64)

        def merged() -> pa.Table:
            """The k best so far, all columns; a query with k rows has its worst score as its floor."""
            table = pa.concat_tables([*([held] if held else []), *new]).combine_chunks()
            ranks = place(list(zip(table.column(3).to_pylist(), table.column(2).to_pylist(), strict=True)))
            table = table.take(pa.array(best(table.column(0).to_numpy(), table.column(1).to_numpy(), ranks)))
            number, score = table.column(0).to_numpy(), table.column(1).to_numpy()
            full = np.bincount(number, minlength=len(asked)) >= k
            floor[full] = score[np.searchsorted(number, np.flatnonzero(full), "right") - 1]
            return table

        for batch in batches:
            texts = [batch.column(2 + i) for i in range(len(columns))]
            order = np.argsort(place(list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))), kind="stable")
            found, hits, lo = [], 0, 0
            for i, r in enumerate(order.tolist()):
                for column, w in zip(texts, points, strict=True):
                    if (text := column[r].as_py()) and (seen := {t for _, t in machine.iter(text)}):
                        found.append((i - lo, np.fromiter(seen, np.int32, len(seen)), w))
                        hits += len(seen)
                if found and (hits >= HITS or i + 1 == batch.num_rows):
                    number, score, at = block_best(found, i + 1 - lo, floor)
                    rows = pa.array(order[lo + at])
                    new.append(pa.Table.from_arrays([pa.array(number), pa.array(score), batch.column(0).take(rows), batch.column(1).take(rows)], ["number", "score", "key", "ord"]))
                    if sum(len(t) for t in new) > (len(held) if held else 0):
                        held, new = merged(), []
                    found, hits, lo = [], 0, i + 1
        if held or new:
            yield from merged().to_batches(max_chunksize=10_000)

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"text{i}") for i, c in enumerate(columns)]
    found = df.select(F.col(key).alias("key"), F.col(order).alias("ord"), *texts).mapInArrow(run, held_schema)
    w = Window.partitionBy("number").orderBy(F.desc("score"), "ord", "key")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = df.sparkSession.createDataFrame(list(enumerate(asked)), "number long, query string")
    return top.join(names, "number").select("query", F.col("key").alias(key), "score", "rank")


def vector_files(chunks: DataFrame, embedded: DataFrame, k: int) -> DataFrame:
    """query, rank, id, file, score, text of the k nearest chunks of each query; ``embedded``: query, embedding."""
    near = search.vector_search_batch(chunks, embedded.select(F.col("query").alias("id"), "embedding"), "id", k=k)
    return near.withColumnRenamed("query_key", "query").join(chunks.select("id", "file", "text"), "id").select("query", "rank", "id", "file", "score", "text")


def files_of(rel: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """query, returned_files: for each (query, name) the files of the function's context, in its order."""
    who = search.context_many(rel, entries.select("name").distinct()).groupBy("entry", "filename").agg(F.min(F.struct("section", "pos")).alias("at"))
    listed = who.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "filename"))), lambda x: x["filename"]).alias("returned_files"))
    return entries.join(listed, entries["name"] == listed["entry"]).select("query", "returned_files")


def returned_files(rel: dict[str, DataFrame], chunks: DataFrame, embedded: DataFrame, strategies: tuple[str, ...], top_k: int) -> dict[str, DataFrame]:
    """strategy -> (query, returned_files), one row for each query with a result; each is a plan of its own.

    chunk: files of the nearest chunks. structural: context of the best function by
    keywords. hybrid: names in the nearest chunks, the best of them searched by keywords,
    else the query itself; no name, no result.
    """
    queries, weights, out = embedded.select("query"), {"description": 3, "body": 1}, {}
    near = settled(vector_files(chunks, embedded, top_k)) if {"chunk", "hybrid"} & set(strategies) else None
    if {"structural", "hybrid"} & set(strategies):
        best = settled(keyword_search_many(rel["functions"], queries, weights, "name", "ord", 1).select("query", "name"))
    if "chunk" in strategies:
        out["chunk"] = near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: x["file"]).alias("returned_files"))
    if "structural" in strategies:
        out["structural"] = files_of(rel, best)
    if "hybrid" in strategies:
        named = search.name_candidates(near, keys=("query",))
        w = Window.partitionBy("query").orderBy(F.desc("score"), "at", "name")
        first = settled(named.withColumn("n", F.row_number().over(w)).where("n = 1").select("query", F.col("name").alias("asked")))
        by_name = keyword_search_many(rel["functions"], first.select(F.col("asked").alias("query")), weights, "name", "ord", 1).select(F.col("query").alias("asked"), F.col("name").alias("by_name"))
        chosen = first.join(by_name, "asked", "left").join(best.withColumnRenamed("name", "by_query"), "query", "left")
        out["hybrid"] = files_of(rel, chosen.select("query", F.coalesce("by_name", "by_query").alias("name")).where(F.col("name").isNotNull()))
    return out
