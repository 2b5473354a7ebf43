"""Exact deduplication of texts with a heavy-hitter split.

A text's digest is the SHA-256 of the text with A-Z lower-cased. Digests are written
once (48 bytes a row), so texts are read and hashed a single time and never
shuffled. Spark's ``approx_top_k`` functions keep a frequent-items sketch of the digests in
every task, a Misra-Gries summary whose counters are lowered together when they run out;
the sketches are merged, first within salts and then into one. A Misra-Gries summary misses
no digest above its error bound, n / 18,000 rows here, but its counts are estimates and it may
name rare digests. So its candidates are verified: they are counted exactly, with
map-side combining, and those with at least n / ``parts`` rows, never more than ``parts``
digests, become the winners table. It is sent to all tasks, which settle the heavy rows
where they lie; the rest, in groups of fewer than n / ``parts`` rows, is shuffled by digest once.

Only DataFrame operations run on the executors.

Defined results: a null text counts as empty, and empty texts are equal; the row with
the largest doc_id stays, a null id being the smallest; of rows with one text and one
doc_id exactly one stays; every other row returns too. An empty table gives no rows.
Extra columns, whatever their names, are ignored by ``groups`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch, ascii_lower, table

#: Counters of the sketch, and how many of its digests are verified: all with over n / 8192 rows are among them.
COUNTERS, CANDIDATES, PARTS = 65_536, 16_384, 8192
#: First-level merges of sketches.
SALTS = 64


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased, null as empty; texts of ASCII alone take the quick way."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def frequent(digests: DataFrame) -> DataFrame:
    """key: 64-bit hashes of the digests that may be frequent, by merged Misra-Gries summaries; at most CANDIDATES rows."""
    keyed = digests.select(F.xxhash64("digest").alias("key"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    salted = keyed.groupBy("salt").agg(F.expr(f"approx_top_k_accumulate(key, {COUNTERS})").alias("summary"))
    # One partition: Spark 4.1's combine fails with a MatchError in a task without rows.
    found = salted.repartition(1).agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"))
    return found.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {CANDIDATES})")).alias("x")).select(F.col("x.item").alias("key"))


def winners(digests: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """digest, n, best of the candidates' digests with ``least`` rows or more, counted exactly."""
    some = digests.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("key"), "left_semi")
    return some.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row")).alias("best")).where(F.col("n") >= least)


def decided(digests: DataFrame, scratch: Scratch, parts: int = PARTS) -> DataFrame:
    """doc_id, row, digest, n, best for each row of ``digests`` (doc_id, row, digest; written, row unique).

    ``parts`` up to PARTS bounds the winners table; a digest is heavy if it has 1 / ``parts`` of all rows.
    """
    parts = min(parts, PARTS)
    n = digests.count()
    candidates = frequent(digests) if n else digests.sparkSession.createDataFrame([], "key long")
    heavy = scratch.written(winners(digests, candidates, max(2, -(-n // parts))))
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    shuffled = light.select("doc_id", "row", "digest", F.count("*").over(same).alias("n"), F.max(F.struct("doc_id", "row")).over(same).alias("best"))
    return digests.join(F.broadcast(heavy), "digest").select(*shuffled.columns).unionByName(shuffled)


def groups(docs: DataFrame, parts: int = PARTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    scratch = Scratch(docs.sparkSession)
    digests = scratch.written(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), digest(F.col(text)).alias("digest")))
    d = decided(digests, scratch, parts)
    return d.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, parts: int = PARTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts; ``docs`` is written once, with row numbers."""
    scratch = Scratch(docs.sparkSession)
    row = "row_number_of_exact_dedup"
    while row in docs.columns:
        row += "_"
    tagged = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()))
    digests = scratch.written(tagged.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), digest(F.col(text)).alias("digest")))
    stay = decided(digests, scratch, parts).where(F.col("best.row") == F.col("row")).select(F.col("row").alias(row))
    return tagged.join(stay, row, "left_semi").select(*docs.columns)


def op11_exact_dedup(spark, sf_dir):
    """All ``documents``."""
    return groups(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(n) AS text_sha256
FROM t WINDOW w AS (PARTITION BY n)
"""
