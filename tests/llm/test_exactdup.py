"""Exact deduplication against plain dictionaries."""

import hashlib
import random
from collections import Counter

import pytest

from lodestone.llm import exactdup

SCHEMA = "doc_id long, text string, digest string, row long, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(heavy):
    rnd = random.Random(5)
    out = [(i, rnd.choice(["Ärger", "ärger", "ÄRGER", "a b", "A B", "a  b", "", None, "İx", "ix", "\x00", "x" * 300_000, "X" * 300_000])) for i in range(300)]
    out += [(1000 + i, "Common" if i % 2 else "cOMMON") for i in range(heavy)]
    return out + [(None, "a b"), (None, "only null"), (None, "only null"), (5, "repeat"), (5, "repeat"), (5, "Repeat"), (5, "other")]


def expected(rows):
    """Bag of what groups() returns, and the rows that stay."""
    held = {}
    for i, t in rows:
        held.setdefault((t or "").translate(LOWER), []).append(i)
    out, stay = Counter(), Counter()
    for t, ids in held.items():
        best = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out.update((i, best, len(ids), False, sha) for i in ids)
        out[best, best, len(ids), False, sha] -= 1
        out[best, best, len(ids), True, sha] += 1
        stay[best, sha] += 1
    return +out, stay


@pytest.mark.parametrize("parts", [1, 3, 8192])
def test_groups(spark, parts):
    """No heavy digest, few, and all that repeat: the same rows."""
    rows = texts(500)
    df = spark.createDataFrame([(i, t, "clash", 7, 0) for i, t in rows], SCHEMA).repartition(7)
    want, stay = expected(rows)
    assert Counter(tuple(r) for r in exactdup.groups(df, parts).collect()) == want
    left = exactdup.deduplicated(df, parts)
    assert left.columns == df.columns
    got = left.collect()
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").translate(LOWER).encode()).hexdigest()) for r in got) == stay
    assert all(r["digest"] == "clash" and r["row"] == 7 for r in got)


def test_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exactdup.groups(none).collect() == [] and exactdup.deduplicated(none).collect() == []
    assert [tuple(r)[:4] for r in exactdup.groups(spark.createDataFrame([(3, None)], "doc_id long, text string")).collect()] == [(3, 3, 1, True)]


def test_summaries_miss_nothing_frequent(spark):
    """Every digest of at least n / 8192 rows is a candidate, also when the counters run out many times over."""
    from pyspark.sql import functions as F

    n = 400_000
    mixed = spark.range(n, numPartitions=16).select(F.when(F.col("id") % 4 == 0, F.pmod(F.xxhash64("id"), F.lit(1500))).otherwise(F.col("id")).alias("k"))
    digests = mixed.select(F.unhex(F.sha2(F.col("k").cast("string"), 256)).alias("digest"))
    found = exactdup.frequent(digests)
    rows = digests.groupBy("digest").count().where(F.col("count") >= n // 8192).select(F.xxhash64("digest").alias("key"))
    assert rows.count() > 1000
    assert rows.join(found, "key", "left_anti").count() == 0
    assert found.count() <= exactdup.CANDIDATES
    assert exactdup.winners(digests.select("digest", F.lit(1).alias("doc_id"), F.monotonically_increasing_id().alias("row")), found, n // 8192).count() == rows.count() <= exactdup.PARTS


def test_heavy_rows_are_not_shuffled(spark):
    """The plan settles heavy rows by a broadcast join and shuffles others by digest, once."""
    df = spark.createDataFrame([(i, "same" if i % 2 else str(i)) for i in range(100)], "doc_id long, text string")
    plan = exactdup.groups(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(digest") == 1 and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_tasks_without_rows(spark):
    """More tasks than rows, and no merging of small partitions."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i, "a" if i % 3 else str(i)) for i in range(50)], "doc_id long, text string").repartition(97)
        assert sum(r["kept"] for r in exactdup.groups(df).collect()) == 18
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
