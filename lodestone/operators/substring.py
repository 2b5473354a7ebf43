"""Substring index: posting lists of character trigrams, for keyword search without a scan of all texts.

Stored under one path are the rows, numbered; the lists, a row for each column, trigram and
part of 65,536 row numbers, in folders by a hash of column and trigram; and how many rows each trigram has.
A text that contains a term contains all of the term's trigrams, so the lists of the
term's rarest trigrams are intersected and only the rows in all of them are read and
tested. Of the lists only the folders and row groups of these trigrams are read.
A list is cut into parts, so a trigram that stands everywhere is spread over tasks and files.

A term of one or two characters has no trigram; the lists of all trigrams with it
are united. Texts of one or two characters have themselves as their only entry.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import query_terms
from lodestone.operators.search import keyword_search
from lodestone.plans.store import settled

#: Row numbers of a part, as bits; folders; rarest lists that are intersected for a term.
PART_BITS, SHARDS, LISTS = 16, 16, 3
#: Pairs of trigram and row that a task holds, characters of one text that it takes at a time, parts dealt to one task.
PAIRS, PIECE, SPREAD = 2_000_000, 1 << 20, 16
LIST = "field string, gram long, part long, rows array<long>"
COUNT = "field string, gram long, n long, shard int"
_BITS = 21


def grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text as whole numbers: three code points, each plus one, in 21 bits each; 0 stands for no character."""
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(text), PIECE):
        p = np.frombuffer(text[lo : lo + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        if p.size < 3:
            if lo:
                break  # its trigrams end in the piece before
            p = np.pad(p, (0, 3 - p.size))
        found.append(np.unique(p[:-2] << 2 * _BITS | p[1:-1] << _BITS | p[2:]))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def has_short(gram: Column, term: str) -> Column:
    """Whether a trigram has a term of one or two characters in it."""
    at = [F.shiftright(gram, 2 * _BITS), F.shiftright(gram, _BITS).bitwiseAND(F.lit((1 << _BITS) - 1)), gram.bitwiseAND(F.lit((1 << _BITS) - 1))]
    codes = [ord(c) + 1 for c in term]
    hits = [reduce(lambda a, b: a & b, [at[i + j] == c for j, c in enumerate(codes)]) for i in range(4 - len(codes))]
    return reduce(lambda a, b: a | b, hits)


def shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("field", "gram"), F.lit(shards)).cast("int")


def posting_lists(rows: DataFrame, number: str, columns: Iterable[str]) -> DataFrame:
    """field, gram, part, rows: what each task has of every list; several rows of one list and part may occur."""
    columns = list(columns)

    def packed(held):
        for name, pairs in held.items():
            if not pairs:
                continue
            gram, row = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.lexsort((row, gram))
            gram, row = gram[order], row[order]
            new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] >> PART_BITS != row[:-1] >> PART_BITS)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, gram.size), pa.int32()), pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array([name] * new.size, pa.string()), pa.array(gram[new]), pa.array(row[new] >> PART_BITS), lists], ["field", "gram", "part", "rows"])

    def run(batches):
        held, size = {c: [] for c in columns}, 0
        for batch in batches:
            number = batch.column(0).to_numpy()
            for i, name in enumerate(columns, 1):
                for row, text in zip(number, batch.column(i), strict=True):
                    if (t := text.as_py()) and (g := grams(t)).size:
                        held[name].append((g, np.full(g.size, row)))
                        size += g.size
                    if size >= PAIRS:
                        yield from packed(held)
                        held, size = {c: [] for c in columns}, 0
        yield from packed(held)

    return rows.select(number, *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(run, LIST)


class SubstringIndex:
    """An index stored by ``build``; ``columns`` are those it can search."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.rows = spark, spark.read.parquet(f"{path}/rows")
        self.postings, self.counts = (spark.read.schema(schema).parquet(f"{path}/{n}") for n, schema in (("postings", f"{LIST}, shard int"), ("counts", COUNT)))
        self.part, self.number = self.rows.columns[-2:]

    @classmethod
    def build(cls, df: DataFrame, columns: Iterable[str], path: str) -> SubstringIndex:
        """Stores the rows of ``df`` and the lists of ``columns`` under ``path``. Null and empty texts have no entries."""
        spark = df.sparkSession
        fresh = lambda name: fresh(name + "_") if name in df.columns else name
        part, number = fresh("part"), fresh("number")
        numbered = df.withColumn(number, F.monotonically_increasing_id())
        numbered.select(*df.columns, F.shiftright(number, PART_BITS).alias(part), number).write.mode("overwrite").parquet(f"{path}/rows")
        lists = posting_lists(spark.read.parquet(f"{path}/rows"), number, columns).withColumn("shard", shard(SHARDS))
        # A list's parts go to several tasks, 16 parts (a million row numbers) to each.
        dealt = lists.repartition("shard", F.floor(F.col("part") / SPREAD)).sortWithinPartitions("shard", "field", "gram", "part")
        dealt.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
        counted = spark.read.schema(f"{LIST}, shard int").parquet(f"{path}/postings").groupBy("shard", "field", "gram").agg(F.sum(F.size("rows")).alias("n"))
        counted.repartition("shard").sortWithinPartitions("shard", "field", "gram").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/counts")
        return cls(spark, path)

    def _of(self, table: DataFrame, keys: list[tuple[str, int]]) -> DataFrame:
        """The rows of some (field, gram): their folders and, by pushed filters, their row groups alone."""
        asked = self.spark.createDataFrame(keys, "field string, gram long").select("field", "gram", shard(SHARDS).alias("shard"))
        folders = sorted({r["shard"] for r in asked.collect()})  # a row for each trigram of the query
        some = table.where(F.col("shard").isin(folders) & F.col("gram").isin(sorted({g for _, g in keys})))
        return some.join(F.broadcast(asked), ["shard", "field", "gram"], "left_semi")

    def candidates(self, terms: Iterable[str], columns: Iterable[str]) -> DataFrame:
        """Numbers of the rows that may contain one of the terms in one of the columns, and of all that do."""
        columns, terms = list(columns), list(dict.fromkeys(t for t in terms if t))
        out = [self.postings.where((F.col("field") == c) & has_short(F.col("gram"), t)).select(F.explode("rows").alias(self.number)) for t in terms if len(t) < 3 for c in columns]
        long = {(c, t): grams(t).tolist() for t in terms if len(t) > 2 for c in columns}
        if long:
            keys = sorted({(c, g) for (c, _), gs in long.items() for g in gs})
            n = {(r["field"], r["gram"]): r["n"] for r in self._of(self.counts, keys).select("field", "gram", "n").collect()}  # no more than trigrams of the query
            picks = []
            for want, ((c, _), gs) in enumerate(long.items()):
                if all((c, g) in n for g in gs):
                    rare = sorted(gs, key=lambda g: n[c, g])[:LISTS]
                    picks += [(c, g, want, len(rare)) for g in rare]
            if picks:
                lists = self._of(self.postings, [p[:2] for p in picks])
                wanted = self.spark.createDataFrame(picks, "field string, gram long, want int, need int")
                hits = lists.join(F.broadcast(wanted), ["field", "gram"]).select("want", "need", F.explode("rows").alias(self.number))
                out.append(hits.groupBy("want", "need", self.number).count().where(F.col("count") == F.col("need")).select(self.number))
        none = self.spark.createDataFrame([], f"{self.number} long")
        return reduce(DataFrame.unionByName, out, none).distinct()

    def keyword_search(self, query: str, weights: dict[str, int], order: str, limit: int | None = 3, most_parts: int = 1000) -> DataFrame:
        """As ``search.keyword_search`` on the indexed rows; parts of the rows without a candidate are not read, if at most ``most_parts`` have one."""
        found = settled(self.candidates(query_terms(query), weights))
        parts = [r[0] for r in found.select(F.shiftright(self.number, PART_BITS)).distinct().limit(most_parts + 1).collect()]
        rows = self.rows.where(F.col(self.part).isin(parts)) if len(parts) <= most_parts else self.rows
        return keyword_search(rows.join(found, self.number, "left_semi").drop(self.part, self.number), query, weights, order, limit)
