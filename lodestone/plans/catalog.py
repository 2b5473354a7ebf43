"""CodeCatalog: the relations of one source tree with the verbs that query them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunk, evaluate, graph, lookup, many, parse, search
from lodestone.operators.substring import SubstringIndex
from lodestone.plans.store import settled
from lodestone.plans.versions import VersionedCatalog
from lodestone.sources.files import RELATIONS, load_relations, save_relations, source_files


class CodeCatalog:
    """Relations (functions, function_calls, sql_usage, structs, tables_ddl) and chunks of a source tree.

    ``embedder`` turns a text column into a vector column; the default hashes
    words, a pandas UDF around a model can take its place. Results are DataFrames;
    the few verbs that must decide by a value (does the name exist, which is the
    best match) read one row.
    """

    def __init__(self, rel: dict[str, DataFrame], chunks: DataFrame | None = None, files: DataFrame | None = None, embedder: Callable[[Column], Column] = chunk.hash_embedding):
        self.rel, self.chunks, self.files, self.embedder = rel, chunks, files, embedder
        self.keywords: SubstringIndex | None = None
        self.edges = rel["function_calls"].select(F.col("caller").alias("src"), F.col("callee").alias("dst"))

    @classmethod
    def index(cls, spark: SparkSession, root: str, strategy: str = "semantic", recursive: bool = True, embedder: Callable[[Column], Column] = chunk.hash_embedding) -> CodeCatalog:
        """Parses and chunks a source tree; ``strategy``: semantic or fixed."""
        files = source_files(spark, root, recursive)
        cut = chunk.chunk_semantic if strategy == "semantic" else chunk.chunk_fixed
        return cls(parse.relations(files), chunk.embed(cut(files), embedder), files, embedder)

    def save(self, path: str) -> CodeCatalog:
        """Replaces what is stored at ``path`` and returns the catalog that reads it."""
        extra = {k: v for k, v in (("chunks", self.chunks), ("files", self.files)) if v is not None}
        save_relations({**self.rel, **extra}, path)
        return self.load(self.edges.sparkSession, path, self.embedder)

    @classmethod
    def load(cls, spark: SparkSession, path: str, embedder: Callable[[Column], Column] = chunk.hash_embedding) -> CodeCatalog:
        """The catalog that ``save`` stored last."""
        rel = load_relations(spark, path)
        return cls({n: rel[n] for n in RELATIONS}, rel.get("chunks"), rel.get("files"), embedder)

    @classmethod
    def versioned(cls, spark: SparkSession, root: str, version: int | None = None, strategy: str = "semantic", embedder: Callable[[Column], Column] = chunk.hash_embedding) -> CodeCatalog:
        """The newest or another version of a ``VersionedCatalog``."""
        stored = VersionedCatalog(spark, root)
        files = stored.files(version)
        cut = chunk.chunk_semantic if strategy == "semantic" else chunk.chunk_fixed
        return cls(stored.relations(version), chunk.embed(cut(files), embedder), files, embedder)

    def views(self) -> None:
        """Registers the relations as temporary views."""
        for name, df in self.rel.items():
            df.createOrReplaceTempView(name)

    def index_substrings(self, path: str) -> CodeCatalog:
        """Stores a substring index of the functions under ``path``; keyword searches read it from now on."""
        self.keywords = SubstringIndex.build(self.rel["functions"], ("description", "body"), path)
        return self

    # Search

    def search_keywords(self, query: str, limit: int | None = 3) -> DataFrame:
        if self.keywords:
            return self.keywords.keyword_search(query, {"description": 3, "body": 1}, "ord", limit)
        return search.keyword_search(self.rel["functions"], query, {"description": 3, "body": 1}, "ord", limit)

    def search(self, query: str) -> dict | None:
        """Best function for a query with candidates, call graph, context (with contents), files, their roles and tables; None without a match."""
        best = self.search_keywords(query).select("name", "description", "score", "tables_used").collect()
        if not best:
            return None
        name = best[0]["name"]
        context = self.context(name)
        return {
            "matched_function": name, "description": best[0]["description"], "candidates": [r.asDict() for r in best], "call_graph": self.call_graph(name), "context": context,
            "files_returned": context.groupBy("filename").agg(F.min(F.struct("section", "pos")).alias("at")).orderBy("at").select("filename"),
            "related_files": context.groupBy("filename", "role").agg(F.min(F.struct("section", "pos")).alias("at")).orderBy("at").select("filename", "role"),
            "tables_used": self.rel["sql_usage"].where(F.col("function_name") == name).select("table_name").distinct(),
        }

    def embedded(self, query: str) -> list[float]:
        return self.edges.sparkSession.range(1).select(self.embedder(F.lit(query)).alias("e")).first()["e"]

    def search_chunks(self, query: str, top_k: int = 7) -> DataFrame:
        return search.vector_search(self.chunks, self.embedded(query), "id", k=top_k).select("file", "start_line", "end_line", "score", "text")

    def search_hybrid(self, query: str, top_k: int = 5) -> dict | None:
        """Nearest chunks, names in them, and the structural search for the best name (else for the query)."""
        names = [r["name"] for r in search.name_candidates(self.search_chunks(query, top_k)).orderBy(F.desc("score"), "at", "name").limit(5).collect()]
        if not names:
            return None
        found = self.search(names[0]) or self.search(query)
        return {"vector_candidates": names, **(found or {})}

    def returned_files(self, query: str, strategy: str, top_k: int = 5) -> list[str]:
        """Names of the files that ``strategy`` (chunk, structural or hybrid) returns for a query, best first."""
        if strategy == "chunk":
            return [r["file"] for r in self.search_chunks(query, top_k).collect()]
        found = self.search(query) if strategy == "structural" else self.search_hybrid(query, top_k)
        return [r["filename"] for r in found["files_returned"].collect()] if found and "files_returned" in found else []

    def returned_files_many(self, queries: DataFrame, strategies: tuple[str, ...] = ("chunk", "structural", "hybrid"), top_k: int = 5) -> DataFrame:
        """query, strategy, returned_files (empty without a result), seconds: all distinct queries under all strategies.

        The number of jobs doesn't depend on the number of queries; ``seconds`` is a strategy's time by query, with what strategies share in the first.
        """
        asked = settled(queries.select("query").where(F.col("query").isNotNull()).distinct())
        n, out, began = max(1, asked.count()), None, time.perf_counter()
        for strategy, found in many.returned_files(self.rel, self.chunks, asked.withColumn("embedding", self.embedder(F.col("query"))), strategies, top_k).items():
            rows = settled(asked.join(found, "query", "left").select("query", F.lit(strategy).alias("strategy"), F.coalesce("returned_files", F.array().cast("array<string>")).alias("returned_files")))
            now = time.perf_counter()
            rows, began = rows.withColumn("seconds", F.lit((now - began) / n)), now
            out = rows if out is None else out.unionByName(rows)
        return out

    def _measured(self, queries: DataFrame, strategies: tuple[str, ...], truth: DataFrame, top_k: int) -> DataFrame:
        timed = self.returned_files_many(queries, strategies, top_k)
        return evaluate.evaluate(timed, truth).join(timed.select("query", "strategy", "seconds"), ["query", "strategy"])

    def search_full(self, query: str, truth: DataFrame, top_k: int = 5) -> DataFrame:
        """Metrics of the chunk and the structural strategy for one query; ``files`` lists each file with is_noise and is_relevant."""
        found = self._measured(self.edges.sparkSession.createDataFrame([(query,)], "query string"), ("chunk", "structural"), truth, top_k)
        flags = F.transform(F.array_distinct("returned_files"), lambda f: F.struct(f.alias("file"), F.array_contains("noise_files", f).alias("is_noise"), F.array_contains("relevant_returned", f).alias("is_relevant")))
        return found.withColumn("files", flags)

    def run_evaluation(self, truth: DataFrame, top_k: int = 5) -> DataFrame:
        """Metrics and seconds of all queries of the ground truth under all strategies, in a fixed number of jobs."""
        return self._measured(truth, ("chunk", "structural", "hybrid"), truth, top_k)

    # Graph

    def call_graph(self, name: str) -> DataFrame:
        return graph.neighbours(self.edges, name)

    def call_tree(self, name: str, depth: int = 2) -> DataFrame:
        t = graph.tree(self.edges, name, depth)
        return t.select(F.col("dst").alias("callee"), F.col("src").alias("caller"), "depth").orderBy("depth", "caller", "callee")

    def context(self, name: str, depth: int = 2) -> DataFrame:
        return search.context(self.rel, name, depth)

    def impact(self, name: str, depth: int = 5) -> tuple[str, DataFrame | None]:
        """("function" | "table" | "unknown", affected services); a name that is both counts as a function."""
        described = self.rel["functions"].select("name", "description")
        if not described.where(F.col("name") == name).isEmpty():
            hit = graph.function_impact(self.edges, name, depth).join(described, "name", "left")
            return "function", hit.select("name", "depth", F.coalesce("description", F.lit("")).alias("description")).orderBy("depth", "name")
        if not self.rel["tables_ddl"].where(F.col("name") == name).isEmpty():
            hit = graph.table_impact(self.edges, self.rel["sql_usage"], name, depth).join(described, "name", "left")
            return "table", hit.select("name", "operation", "depth", "via", "kind", F.coalesce("description", F.lit("")).alias("description")).orderBy("via", "kind", "depth", "name")
        return "unknown", None

    def business_flow(self, entry: str, depth: int = 5) -> DataFrame:
        """Steps in pre-order; no rows for an unknown entry."""
        known = self.rel["functions"].select("name", "description")
        if known.where(F.col("name") == entry).isEmpty():
            return self.edges.sparkSession.createDataFrame([], "path array<string>, name string, description string, depth int, sql_operations array<struct<table_name:string,operation:string>>")
        steps = graph.flow(self.edges, self.rel["sql_usage"], entry, depth).join(known, "name", "left")
        return steps.select("path", "name", F.coalesce("description", F.lit("")).alias("description"), "depth", "sql_operations").orderBy("path")

    def tables_used(self, name: str) -> DataFrame:
        """Distinct (table_name, operation) of one function, as its impact lists them."""
        return graph.tables_used(self.rel["sql_usage"], name).orderBy("table_name", "operation")

    def tables_touched(self, entry: str, depth: int = 5) -> DataFrame:
        """Distinct tables of all steps of a business flow."""
        return graph.tables_touched(self.business_flow(entry, depth)).orderBy("table_name")

    # Lookups

    def function(self, name: str) -> DataFrame:
        return lookup.function_detail(self.rel, name)

    def find_by_table(self, table: str) -> DataFrame:
        """Every use of a table, with the comment and columns of its definition, null where there is none."""
        ddl = self.rel["tables_ddl"].where(F.col("name") == table).select("comment", "columns", F.lit(table).alias("table_name"))
        used = lookup.functions_by_table(self.rel["sql_usage"], table).withColumn("table_name", F.lit(table))
        return used.join(F.broadcast(ddl), "table_name", "left").orderBy("function_name", "ord")

    def table(self, name: str) -> DataFrame:
        return self.rel["tables_ddl"].where(F.col("name") == name).select("name", "comment", "columns", "primary_key")

    def find_by_error_code(self, code: str) -> DataFrame:
        return lookup.by_error_code(self.rel["functions"], code).orderBy("ord")

    def search_by_domain(self, domain: str) -> DataFrame:
        return lookup.by_domain(self.rel, domain).orderBy("kind", "name")

    def list_services(self) -> DataFrame:
        return lookup.services(self.rel["functions"])

    def counts(self) -> DataFrame:
        return lookup.counts(self.rel)

    def file(self, file_path: str) -> DataFrame:
        return self.files.where(F.col("file_path") == file_path).select("file_path", "text")
