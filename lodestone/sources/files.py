"""Source trees as DataFrames, and stored relations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import utf8
from lodestone.plans.store import Manifests

KINDS = ("pc", "h", "sql")
RELATIONS = ("functions", "function_calls", "sql_usage", "structs", "tables_ddl")


def source_files(spark: SparkSession, root: str, recursive: bool = True, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """ord, file_path, file, ext, text of every source file below ``root``.

    ``ord`` is the path's parts: it sorts as paths do and needs no global numbering.
    Suffixes count in any case; other files are left out before their content is read.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(path).toString().rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in k) for k in kinds) + "}"
    raw = reader.option("pathGlobFilter", glob).load(root)
    rel = F.substring(F.col("path"), len(base) + 2, 1 << 20)
    named = raw.select(rel.alias("file_path"), "content")
    return named.select(
        F.split("file_path", "/").alias("ord"), "file_path", F.element_at(F.split("file_path", "/"), -1).alias("file"),
        F.lower(F.regexp_extract("file_path", r"\.([^./]*)$", 1)).alias("ext"), utf8(F.col("content")).alias("text"),
    )


def file_text(files: DataFrame, file_path: str) -> DataFrame:
    """One file's text, by its path within the tree; no row if there is none. Never opens a given path."""
    return files.where(F.col("file_path") == file_path).select("file_path", "text")


def save_relations(relations: dict[str, DataFrame], path: str) -> None:
    """Stores a snapshot of all relations in a new folder, then makes it the current one in one step.

    A crash in between leaves the snapshot before. That one stays, for readers under way; older ones go.
    """
    spark = next(iter(relations.values())).sparkSession
    manifests = Manifests(spark, path)
    old = manifests.read() or {"version": 0}
    folder = f"snapshots/{uuid.uuid4().hex}"
    for name, df in relations.items():
        df.write.parquet(f"{manifests.root}/{folder}/{name}")
    manifests.publish({"version": old["version"] + 1, "folder": folder, "names": list(relations)})
    for number in manifests.numbers()[:-2]:
        manifests.fs.delete(manifests.path(manifests.read(number)["folder"]), True)
        manifests.drop(number)


def load_relations(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The relations of the current snapshot, all or those of ``names``."""
    current = Manifests(spark, path).read()
    if current is None:
        raise FileNotFoundError(f"no snapshot at {path}")
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{current['folder']}/{n}") for n in names or current["names"]}
