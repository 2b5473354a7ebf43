"""Lookup operators: point, table, error-code and prefix lookups as joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines
from lodestone.operators.patterns import COMMON_HEADER


def function_detail(rel: dict[str, DataFrame], name: str | None = None) -> DataFrame:
    """Functions with calls, called_by, struct_files, dependency_files and ddl_files; one function, or all.

    Lists of files keep the order of their sources; included headers are listed
    whether they exist or not, dependencies and definitions only where they do. For nodes
    with too many neighbours for one list there is ``graph.links``.
    """
    functions, edges, ddl = rel["functions"], rel["function_calls"], rel["tables_ddl"]
    only = lambda df, key: df if name is None else df.where(F.col(key) == name)  # noqa: E731 - pushed to the scans, so one function reads its own edges
    fn, called, calling = only(functions, "name"), only(edges, "caller"), only(edges, "callee")
    out = called.groupBy(F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    back = calling.groupBy(F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("called_by"))
    files = called.join(functions.select(F.col("name").alias("callee"), "file_path"), "callee").groupBy(F.col("caller").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("callee", "file_path"))), lambda x: x["file_path"]).alias("dependency_files"))
    used = fn.select("name", F.posexplode("tables_used").alias("pos", "t")).join(ddl.select(F.col("name").alias("t"), "file_path"), "t").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file_path"))), lambda x: x["file_path"]).alias("ddl_files"))
    joined = fn.join(out, "name", "left").join(back, "name", "left").join(files, "name", "left").join(used, "name", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "name", "file_path", "description", "body", "params", "tables_used", *[F.coalesce(c, none).alias(c) for c in ("calls", "called_by")],
        F.filter("includes", lambda i: i != COMMON_HEADER).alias("struct_files"), *[F.coalesce(c, none).alias(c) for c in ("dependency_files", "ddl_files")],
    )


def functions_by_table(usage: DataFrame, table: str) -> DataFrame:
    """Every use of a table, repeats kept; order by function_name, ord."""
    return usage.where(F.col("table_name") == table).select("function_name", "operation", "raw_sql", "ord")


def hits_with_context(df: DataFrame, key: str, text: str, needle: str, before: int = 2, after: int = 3, message: str = "err_msg", reach: int = 4) -> DataFrame:
    """key, line_no, context, message of the first line of each text that contains ``needle``.

    The message is the first quoted string of the first line, from the hit to
    ``reach`` lines on, that contains ``message``; empty if that line has none.
    """
    found = df.where(F.contains(F.col(text), F.lit(needle))).select(F.col(key), lines(F.col(text)).alias("l"))
    at = F.array_position(F.transform("l", lambda x: F.contains(x, F.lit(needle))), True).cast("int")
    spot = found.withColumn("line_no", at).where(F.col("line_no") > 0)
    top = F.greatest(F.col("line_no") - before, F.lit(1))
    near = F.filter(F.slice("l", F.col("line_no"), reach + 1), lambda x: F.contains(x, F.lit(message)))
    return spot.select(
        key, "line_no", F.array_join(F.slice("l", top, F.col("line_no") + after - top + 1), "\n").alias("context"),
        F.coalesce(F.regexp_extract(F.try_element_at(near, F.lit(1)), '"([^"]+)"', 1), F.lit("")).alias("error_message"),
    )


def by_error_code(functions: DataFrame, code: str) -> DataFrame:
    """Functions that set an error code: where, in what context, with what message."""
    keyed = functions.select(F.struct("ord", "name", "file_path").alias("fn"), "body")
    hits = hits_with_context(keyed, "fn", "body", f'"{code}"')
    return hits.select(F.col("fn.ord").alias("ord"), F.col("fn.name").alias("function_name"), F.col("fn.file_path").alias("file_path"), "error_message", "context", "line_no")


def prefix_like(c: Column, pattern: str) -> Column:
    """LIKE that ignores case; ``%`` and ``_`` are wildcards, a backslash is itself."""
    return c.ilike(pattern.replace("\\", "\\\\"))


def by_domain(rel: dict[str, DataFrame], domain: str) -> DataFrame:
    """kind, name, file_path of the functions, tables and structs of a domain prefix."""
    d = domain.upper()
    pick = lambda df, kind, col, like: df.where(prefix_like(F.col(col), like)).select(F.lit(kind).alias("kind"), "name", "file_path")
    return pick(rel["functions"], "function", "name", f"{d}_%").unionByName(pick(rel["tables_ddl"], "table", "name", f"TB_{d}%")).unionByName(pick(rel["structs"], "struct", "file_path", f"{d.lower()}_%"))


def services(functions: DataFrame) -> DataFrame:
    return functions.select("name", "file_path", "description").orderBy("name")


def counts(rel: dict[str, DataFrame]) -> DataFrame:
    """relation, n: how many rows each relation has."""
    out = None
    for name, df in rel.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out
