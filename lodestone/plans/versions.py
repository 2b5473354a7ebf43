"""Versioned catalogs: immutable folders, a manifest written last, deletes, upserts by name.

A version is a manifest, a small JSON file with the folders of each relation. A commit first
writes new folders, then the manifest under the next number, which must not exist yet; so a crash
before that leaves the old version as it was, and of two writers one has to try again. Readers take
one manifest and never see half a commit.

Every parsed row carries the path of its file (``source``) and its commit (``version``), and a log has
each file's commits, deletes included. A row counts if its commit is its file's last, so a commit adds what changed
and rewrites nothing. Names are unique in the result: of several files that define one, the last
in order wins, and when that file goes, the next is there again. Relations by name are stored in
BUCKETS folders by hash of the name, and a lookup reads one of them. ``compact`` writes a version
without what no longer counts; ``vacuum`` drops folders that no kept version names.

Defined results: files of one name in different folders are different files; a path given
twice in one commit counts as its last row by ``ord``; deleting an unknown path does nothing; null paths are refused.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lodestone.operators import parse
from lodestone.plans.store import Manifests, settled

#: Relations whose names are unique, and the column by which each relation is bucketed.
UNIQUE = ("functions", "structs", "tables_ddl")
KEYS = {"functions": "name", "structs": "name", "tables_ddl": "name", "function_calls": "caller", "sql_usage": "function_name"}
BUCKETS = 8
#: Deltas of a relation after which ``commit`` says that ``compact`` is due.
MANY = 50


def bucket(name: str | Column) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


class VersionedCatalog:
    """The versions under one root; ``relations`` and ``files`` read the newest, or the one asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifests = spark, root.rstrip("/"), Manifests(spark, root)

    def versions(self) -> list[int]:
        """Numbers of all versions, rising."""
        return self.manifests.numbers()

    def manifest(self, version: int | None = None) -> dict:
        return self.manifests.read(version) or {"version": 0, "folders": {}, "schemas": {}, "epochs": {}}

    # Writing

    def _write(self, name: str, df: DataFrame, version: int) -> str:
        folder = f"{name}/{version:09d}-{uuid.uuid4().hex[:8]}"
        key = KEYS.get(name)
        if key:
            df.withColumn("bucket", bucket(key)).repartition("bucket", key).sortWithinPartitions(key).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        else:
            df.write.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, files: DataFrame, deleted: DataFrame | None = None, stream: str | None = None, epoch: int | None = None) -> int:
        """Parses new and changed ``files`` (columns of ``sources.files``), drops ``deleted`` (file_path), and returns the version.

        A path that is both deleted and given is replaced. With ``stream`` and ``epoch`` a commit that
        is there already is not done again.
        """
        old = self.manifest()
        if stream is not None and old["epochs"].get(stream, -1) >= epoch:
            return old["version"]
        version = old["version"] + 1
        given = files.select("ord", "file_path", "file", "ext", "text")
        if not given.where(F.col("file_path").isNull()).isEmpty():
            raise ValueError("a file without a path")
        changed = settled(parse.last_wins(given, "file_path"))
        log = changed.select("file_path", F.lit(False).alias("gone"))
        if deleted is not None:
            log = log.unionByName(deleted.select("file_path").where(F.col("file_path").isNotNull()).distinct().join(changed, "file_path", "left_anti").select("file_path", F.lit(True).alias("gone")))
        made = {name: df.withColumn("version", F.lit(version)) for name, df in {**parse.parsed_rows(changed), "files": changed, "log": log}.items()}
        folders, schemas = {k: list(v) for k, v in old["folders"].items()}, dict(old["schemas"])
        for name, df in made.items():
            folders.setdefault(name, []).append(self._write(name, df, version))
            schemas[name] = json.loads(df.schema.json())
        epochs = {**old["epochs"], **({stream: epoch} if stream is not None else {})}
        self.manifests.publish({"version": version, "folders": folders, "schemas": schemas, "epochs": epochs})
        return version

    def is_due(self) -> bool:
        """Whether ``compact`` would make reading cheaper."""
        return any(len(f) > MANY for f in self.manifest()["folders"].values())

    def compact(self) -> int:
        """A version with the same content in one folder for each relation."""
        old = self.manifest()
        if not old["folders"]:
            return old["version"]
        version = old["version"] + 1
        live = self._last(old).where(~F.col("gone"))
        folders = {}
        for name in old["folders"]:
            rows = live.select("file_path", "gone") if name == "log" else self._live(name, old)
            folders[name] = [self._write(name, rows.withColumn("version", F.lit(version)).select(*[f["name"] for f in old["schemas"][name]["fields"]]), version)]
        self.manifests.publish({**old, "version": version, "folders": folders})
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Drops all but the last ``keep`` versions, and folders that these don't name; not while a commit is under way."""
        known, fs = self.versions(), self.manifests.fs
        for v in known[:-keep]:
            self.manifests.drop(v)
        used = {f for v in known[-keep:] for fs in self.manifest(v)["folders"].values() for f in fs}
        for name in {f.split("/")[0] for f in used}:
            for status in fs.listStatus(self.manifests.path(name)):
                if f"{name}/{status.getPath().getName()}" not in used:
                    fs.delete(status.getPath(), True)

    # Reading

    def _stored(self, name: str, manifest: dict) -> DataFrame:
        schema = StructType.fromJson(manifest["schemas"][name])
        if name in KEYS:
            schema = schema.add("bucket", IntegerType())
        paths = [f"{self.root}/{f}" for f in manifest["folders"][name]]
        return reduce(DataFrame.unionAll, [self.spark.read.schema(schema).parquet(p) for p in paths])  # each folder is the root of its own buckets

    def _last(self, manifest: dict) -> DataFrame:
        """file_path, version, gone: the last commit of each file."""
        return self._stored("log", manifest).groupBy("file_path").agg(F.max(F.struct("version", "gone")).alias("x")).select("file_path", "x.version", "x.gone")

    def _live(self, name: str, manifest: dict) -> DataFrame:
        """Rows whose commit is their file's last."""
        last = self._last(manifest).where(~F.col("gone")).select(F.col("file_path").alias("source"), "version")
        rows = self._stored(name, manifest)
        by = "file_path" if name == "files" else "source"
        kept = rows.join(last.withColumnRenamed("source", by), [by, "version"], "left_semi")
        return kept.drop("bucket")

    def files(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._live("files", m).drop("version").select("ord", "file_path", "file", "ext", "text")

    def relation(self, name: str, version: int | None = None, key: str | None = None) -> DataFrame:
        """One relation as ``parse.relations`` gives it for the files of a version; with ``key`` the rows of that name alone, from its bucket."""
        m = self.manifest(version)
        rows = self._live(name, m) if key is None else self._of_key(name, m, key)
        if name in UNIQUE:
            rows = parse.last_wins(rows.drop("version"), "name")
        rows = rows.drop("source", "version")
        return rows.distinct() if name == "function_calls" else rows

    def _of_key(self, name: str, manifest: dict, key: str) -> DataFrame:
        number = self.spark.range(1).select(bucket(F.lit(key))).first()[0]
        last = self._last(manifest).where(~F.col("gone")).select(F.col("file_path").alias("source"), "version")
        rows = self._stored(name, manifest).where((F.col("bucket") == number) & (F.col(KEYS[name]) == key))
        return rows.join(last, ["source", "version"], "left_semi").drop("bucket")

    def relations(self, version: int | None = None) -> dict[str, DataFrame]:
        return {name: self.relation(name, version) for name in KEYS}
