"""Chunking operators: fixed line windows and chunks at function boundaries; embedding."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from lodestone.functions.text import lines, strip
from lodestone.operators import patterns as pat

SIZE, OVERLAP = 6, 2


def fixed_windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """ARRAY<STRUCT<start_line, end_line, text>>: windows of ``size`` lines at every size - overlap, blank ones left out."""
    step = size - overlap
    all_lines = lines(text)
    starts = F.sequence(F.lit(0), F.size(all_lines) - 1, F.lit(step))
    cut = F.transform(starts, lambda i: F.struct((i + 1).alias("start_line"), F.least(i + size, F.size(all_lines)).alias("end_line"), F.slice(all_lines, i + 1, size).alias("part")))
    kept = F.filter(cut, lambda w: F.exists(w["part"], lambda x: x.rlike(r"(?U)\S")))
    return F.transform(kept, lambda w: F.struct(w["start_line"].alias("start_line"), w["end_line"].alias("end_line"), F.array_join(w["part"], "\n").alias("text")))


def chunk_fixed(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """chunks of every file in fixed windows."""
    each = files.select("file", "ext", F.explode(fixed_windows(F.col("text"), size, overlap)).alias("w"))
    return each.select(
        F.concat("file", F.lit(":"), F.col("w.start_line").cast("string"), F.lit("-"), F.col("w.end_line").cast("string")).alias("id"), F.col("w.text").alias("text"), "file", F.col("ext").alias("file_type"),
        F.lit(None).cast("string").alias("function_name"), F.col("w.start_line").alias("start_line"), F.col("w.end_line").alias("end_line"), F.lit(None).cast("boolean").alias("has_sql"),
    )


def function_spans(text: str) -> list[tuple[int, int, str]]:
    """First and last line (from 0) and name of each function, prototypes and indented definitions included.

    A function ends on the first line behind an opening brace on which the braces are
    level with its start again, else with the file; what begins inside another is none.
    """
    rows = text.split("\n")
    opened = [0, *accumulate(r.count("{") for r in rows)]
    level = [o - c for o, c in zip(opened, [0, *accumulate(r.count("}") for r in rows)], strict=True)]
    out: list[tuple[int, int, str]] = []
    for first, m in ((i, re.match(pat.FUNCTION_LINE, r.strip())) for i, r in enumerate(rows)):
        if m and (not out or first > out[-1][1]):
            shut = (j for j in range(first, len(rows)) if opened[j + 1] > opened[first] and level[j + 1] == level[first])
            out.append((first, next(shut, len(rows) - 1), m[1]))
    return out


SPANS = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType()), StructField("name", StringType())]))


@F.pandas_udf(SPANS)
def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("first", "last", "name"), x, strict=True)) for x in function_spans(t or "")])


def _begins(line: Column, marks: tuple[str, ...]) -> Column:
    """Whether a line is blank, ends a comment or begins with one of ``marks``."""
    s = strip(line)
    return reduce(lambda a, b: a | b, [s.startswith(m) for m in marks], (s == "") | s.endswith("*/"))


def _run(rows: Column, marks: tuple[str, ...]) -> Column:
    """How many lines at the beginning of ``rows`` are such lines."""
    other = F.array_position(F.transform(rows, lambda r: _begins(r, marks)), False).cast("int")
    return F.when(other > 0, other - 1).otherwise(F.size(rows))


def function_chunks(files: DataFrame) -> DataFrame:
    """Chunks of C files: a function each, with what leads up to it, or the whole file where there is none.

    The file's head goes in front of a function that stands clear of it.
    """
    rows = files.select("file", F.coalesce("text", F.lit("")).alias("text")).select("file", "text", lines(F.col("text")).alias("ls"), _spans(F.col("text")).alias("spans"))
    rows = rows.withColumn("head", _run(F.col("ls"), pat.HEAD_LINE)).withColumn("edge", F.least(F.col("head"), F.size("ls") - 1))
    each = rows.select("*", F.explode_outer("spans").alias("f")).drop("spans")
    lead = _run(F.reverse(F.slice("ls", F.col("edge") + 1, F.greatest(F.col("f.first") - F.col("edge"), F.lit(0)))), pat.LEAD_LINE)
    each = each.withColumn("top", F.col("f.first") - lead)
    head = F.array_join(F.slice("ls", 1, F.col("head")), "\n")
    own = F.array_join(F.slice("ls", F.col("top") + 1, F.col("f.last") - F.col("top") + 1), "\n")
    each = each.withColumn("own", F.coalesce(own, F.col("text"))).withColumn("front", F.when((F.col("top") > F.col("edge")) & (strip(head) != ""), F.concat(F.regexp_replace(head, r"(?U)\s+$", ""), F.lit("\n\n"))))
    end = F.coalesce(F.col("f.last") + 1, F.size("ls"))
    return each.select(
        F.concat("file", F.lit(":"), F.coalesce("f.name", F.concat(F.lit("1-"), F.size("ls").cast("string")))).alias("id"), F.concat(F.coalesce("front", F.lit("")), "own").alias("text"), "file", F.lit("pc").alias("file_type"),
        F.coalesce("f.name", F.lit("")).alias("function_name"), F.coalesce(F.col("top") + 1, F.lit(1)).alias("start_line"), end.alias("end_line"), F.contains("own", F.lit("EXEC SQL")).alias("has_sql"),
    )


def chunk_semantic(files: DataFrame) -> DataFrame:
    """chunks at function boundaries; headers and definitions whole."""
    code = function_chunks(files.where(F.col("ext") == "pc"))
    whole = files.where(F.col("ext").isin("h", "sql")).select(
        F.concat("file", F.lit(":full")).alias("id"), "text", "file", F.col("ext").alias("file_type"), F.lit("").alias("function_name"),
        F.lit(1).alias("start_line"), F.size(lines(F.col("text"))).alias("end_line"), (F.col("ext") == "sql").alias("has_sql"),
    )
    return code.unionByName(whole)


@F.pandas_udf(ArrayType(FloatType()))
def _summed(spots: pd.Series, signs: pd.Series, dims: pd.Series) -> pd.Series:
    """Sums of signs by spot, scaled to length one; one pass over the words of a text."""

    def one(at, sign, size):
        if at is None:
            return None
        v = np.bincount(np.asarray(at, np.int64), np.asarray(sign, float), size)
        norm = np.sqrt(np.square(v).sum())
        return (v / norm if norm > 0 else v).astype(np.float32)

    return pd.Series([one(*x) for x in zip(spots, signs, dims, strict=True)])


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic embedding without a model: hashed word counts, scaled to length one."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    spots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("int"))
    signs = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    return _summed(spots, signs, F.lit(dims))


def embed(chunks: DataFrame, embedder: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """Adds ``embedding``; pass a pandas UDF that wraps a model in place of the default."""
    return chunks.withColumn("embedding", embedder(F.col("text")))
