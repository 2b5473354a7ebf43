"""Cutting lineage in multi-pass plans: tables written in the folder that all executors share; manifests of versions."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; it goes when the JVM that made it ends.

    A private folder is made only where that setting is absent and the master is local.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = work_dir.own = getattr(work_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as Parquet in the shared folder and read again."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer has published meanwhile; read again and try again."""


class Manifests:
    """Numbered small JSON files under ``root``/manifests, in any file system that Spark reads; the newest is the current version.

    One is written aside and renamed to the next number, which must be free: readers see the old version or the new one, whole.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def numbers(self) -> list[int]:
        at = self.path("manifests")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, number: int | None = None) -> dict | None:
        """One manifest, or the newest; None if there is none at all."""
        known = self.numbers()
        if number is not None and number not in known:
            raise KeyError(f"no version {number}")
        if not known:
            return None
        stream = self.fs.open(self.path("manifests", f"{known[-1] if number is None else number:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, manifest: dict) -> None:
        """Makes ``manifest`` (with its number as ``version``) the newest; Conflict if that number is taken."""
        aside, final = self.path("manifests", f"_{uuid.uuid4().hex}"), self.path("manifests", f"{manifest['version']:09d}.json")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise Conflict(f"version {manifest['version']} is there already")

    def drop(self, number: int) -> None:
        self.fs.delete(self.path("manifests", f"{number:09d}.json"), False)
