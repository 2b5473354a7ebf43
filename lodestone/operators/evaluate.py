"""Retrieval quality: set metrics of returned files against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"
CATEGORIES = ("function_body", "structs", "called_functions", "table_ddl")


def ratio(a: Column, b: Column) -> Column:
    """a / b to three digits, 0 where b is 0."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 3)


def set_metrics(returned: Column, required: Column, noise: Column) -> dict[str, Column]:
    some = F.array_distinct(returned)
    hit, bad = F.array_intersect(some, required), F.array_intersect(some, noise)
    return {
        "precision": ratio(F.size(hit), F.size(some)), "recall": ratio(F.size(hit), F.size(F.array_distinct(required))), "noise_ratio": ratio(F.size(bad), F.size(some)),
        "relevant_returned": F.array_sort(hit), "missing_files": F.array_sort(F.array_except(required, some)), "noise_files": F.array_sort(bad),
    }


def evaluate(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Metrics of each row of ``results`` (query, strategy, returned_files); queries without ground truth score 0.

    ``truth``: query, required_files, noise_files, context_categories (a struct of
    lists). A category counts as covered if it is empty or one of its files is
    there; the function's own body has to be there.
    """
    t = truth.select("query", "required_files", "noise_files", "context_categories", F.lit(True).alias("known"))
    both = results.join(t, "query", "left")
    none = F.array().cast(NONE)
    held = F.col("returned_files")
    m = set_metrics(held, F.coalesce("required_files", none), F.coalesce("noise_files", none))
    known = F.coalesce("known", F.lit(False))
    wanted = {c: F.coalesce(F.col(f"context_categories.{c}"), none) for c in CATEGORIES}
    has = {c: known & (F.coalesce(F.arrays_overlap(held, w), F.lit(False)) | ((F.size(w) == 0) if c != "function_body" else F.lit(False))) for c, w in wanted.items()}
    full = sum((h.cast("int") for h in has.values()), F.lit(0)) / F.lit(4.0)
    return both.select("query", "strategy", "returned_files", *[v.alias(k) for k, v in m.items()], *[h.alias(f"has_{c}") for c, h in has.items()], F.round(full, 3).alias("context_completeness"))


def evaluate_rows(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query, strategy, precision, recall, noise_ratio from rows, for results too large to hold as one list.

    ``results``: query, strategy, file; ``truth``: query, file, kind (required or noise). Repeats count once.
    """
    is_ = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    told = truth.groupBy("query", "file").agg(is_("required").alias("required"), is_("noise").alias("noise"))
    wanted = told.groupBy("query").agg(F.sum("required").alias("wanted"))
    found = results.select("query", "strategy", "file").distinct().join(told, ["query", "file"], "left")
    each = found.groupBy("query", "strategy").agg(F.count("*").alias("n"), F.sum(F.coalesce("required", F.lit(0))).alias("hit"), F.sum(F.coalesce("noise", F.lit(0))).alias("bad")).join(wanted, "query", "left")
    return each.select("query", "strategy", ratio(F.col("hit"), F.col("n")).alias("precision"), ratio(F.col("hit"), F.coalesce("wanted", F.lit(0))).alias("recall"), ratio(F.col("bad"), F.col("n")).alias("noise_ratio"))


METRICS = ("precision", "recall", "noise_ratio", "context_completeness")


def strategy_averages(metrics: DataFrame) -> DataFrame:
    """Mean of the rounded metrics, those that are there, for each strategy."""
    return metrics.groupBy("strategy").agg(F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in METRICS if m in metrics.columns])
