"""Benchmark decontamination: which documents hold a benchmark item's passage.

Texts are reduced to words (lower-cased runs of letters and digits); an item of
w words is compared with every document window of w words, windows cut off at a
document's ends included. A document meets an item only by one of the item's rarest
shingles, as many as can't all be missing in a passage of the similarity asked for;
and a window is fingerprinted for an item unless it has too few of the item's
shingles, at whatever offset, to reach the threshold (``starts``). Both are bounds
on what the two can have in common, so no window of that similarity is left out,
and passages with moved or inserted parts are found. Work grows with the items that
a document shares shingles with, not with the items there are.

Each window gets a 64-bit SimHash of its shingles, weighted by how often they
occur. Windows meet their items in a multi-index of Hamming blocks:
the fingerprints are cut into radius + 1 blocks, and two that differ in at most
``radius`` bits agree in one block at least, so no pair within the radius is
missed. Candidates within the radius are then confirmed by the exact weighted
Jaccard similarity, the sum of the smaller counts over the sum of the larger.
At the threshold of 0.8 two fingerprints differ in about 9.7 bits on average (deviation
2.9); tests count pairs beyond the radius of 23 among random ones at the threshold.

Only DataFrame operations run on the executors. An item with fewer than five words
has its whole sequence as one shingle and matches only texts of just those words.

Defined results: null or blank texts and items match nothing; rows with a null
doc_id can't be named and are left out of ``matches`` but kept by ``clean``;
repeated rows of a document count once in ``matches``; repeated items are compared once and
match each by their own item_id. Of windows of the same similarity the first and then the longest
comes first. Items may have any length. Extra columns are ignored by
``matches`` and kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import table, written

K, RADIUS = 5, 23
#: Parts into which the rows of a key are dealt where a join is shuffled.
PARTS = 16


def word_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; the whole sequence if it is shorter."""
    n = F.size(words)
    at = lambda i, j: F.get(words, i + j)
    many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[at(i, j) for j in range(k)]))
    return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(words, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(hashes: Column, lanes: int = 3) -> Column:
    """64-bit SimHash of an array of hashes, each occurrence counting once.

    One pass over the array counts ``lanes`` bits, each in 64 / lanes bits of a long: three for
    arrays of less than 2^21 hashes, two for all that Spark's arrays can hold.
    """
    zero, width = F.lit(0).cast("long"), 64 // lanes

    def lane(x: Column, i: int) -> Column:
        return F.shiftleft(x.bitwiseAND(F.lit(1 << i).cast("long")), (width - 1) * i)

    def counter(low: int):
        return lambda acc, h: acc + reduce(Column.bitwiseOR, [lane(F.shiftrightunsigned(h, low), i) for i in range(lanes)])

    out = zero
    for low in range(0, 64, lanes):
        sums = F.aggregate(hashes, zero, counter(low))
        for i in range(min(lanes, 64 - low)):
            count = F.shiftrightunsigned(sums, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = out.bitwiseOR(F.when(2 * count > F.size(hashes), F.lit(_signed(1 << (low + i))).cast("long")).otherwise(zero))
    return out


def block_masks(radius: int) -> list[int]:
    """Masks of radius + 1 blocks of adjacent bits that cover a 64-bit fingerprint."""
    n = radius + 1
    edges = [64 * b // n for b in range(n + 1)]
    return [((1 << hi) - (1 << lo)) for lo, hi in zip(edges, edges[1:], strict=False)]


def blocks(fp: Column, radius: int) -> Column:
    """The (number, value) of each block of a fingerprint."""
    return F.array(*[F.struct(F.lit(b).alias("b"), fp.bitwiseAND(F.lit(_signed(m)).cast("long")).alias("v")) for b, m in enumerate(block_masks(radius))])


def first_block(x: Column, radius: int) -> Column:
    """Number of the first block in which two fingerprints with the xor ``x`` agree."""
    out = F.lit(None).cast("int")
    for b, m in reversed(list(enumerate(block_masks(radius)))):
        out = F.when(x.bitwiseAND(F.lit(_signed(m)).cast("long")) == 0, F.lit(b)).otherwise(out)
    return out


def weighted_common(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the values that the arrays share."""
    times = lambda xs, d: F.size(F.filter(xs, lambda x: x == d))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, d: acc + F.least(times(a, d), times(b, d)))


def _up(a, b) -> Column:
    return F.floor((a + (b - 1)) / b).cast("int")


def starts(at: Column, m: Column, k: int, num: int, den: int) -> Column:
    """(item, w, start, take) of all windows that can reach num / den, of a text of ``m`` shingles.

    ``at``: an item, its words w and ps, the sorted positions of its shingles
    in the text. A window of n shingles and an item of s need num * (n + s) / (num + den)
    in common, n at least num / den * s. The windows whose first hit is ps[i] begin after
    ps[i - 1], and those with enough hits late enough to hold ps[i + need - 1].
    """
    ps, size = at["ps"], F.greatest(at["w"] - (k - 1), F.lit(1))
    least = _up(num * size, den)

    def first(p: Column, i: Column) -> Column:
        far = F.get(ps, i + least - 1)
        begin = F.greatest(F.when(i > 0, F.get(ps, i - 1)), far - size) + 1
        return F.when(far - p < size, F.transform(F.sequence(begin, p), lambda b: F.struct(b.alias("start"), i.alias("i")))).otherwise(F.array())

    def take(x: Column) -> Column:
        return F.least(x["start"] + size, m) - F.greatest(x["start"], F.lit(0))

    all_ = F.flatten(F.transform(ps, first))
    able = F.filter(all_, lambda x: F.get(ps, x["i"] + _up(num * (take(x) + size), num + den) - 1) < x["start"] + size)
    return F.transform(able, lambda x: F.struct(at["item"].alias("item"), at["w"].alias("w"), x["start"].alias("start"), take(x).alias("take")))


def sized(df: DataFrame, bytes_: int, most: int) -> DataFrame:
    """``df`` to be sent to all tasks if its ``bytes_``, as counted, are at most ``most``."""
    return F.broadcast(df) if bytes_ <= most else df


def joined(many: DataFrame, few: DataFrame, on: list[str], spread: list[str], bytes_: int, most: int) -> DataFrame:
    """``many`` joined to ``few``, which is sent to all tasks up to ``most`` bytes.

    Beyond, both are shuffled, a key's rows of ``many`` dealt into parts by the columns ``spread``.
    """
    if bytes_ <= most:
        return many.join(F.broadcast(few), on)
    dealt = many.withColumn("part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int"))
    return dealt.join(few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "part"]).drop("part")


def rarest(items: DataFrame, known, num: int, den: int, broadcast_bytes: int) -> DataFrame:
    """h, items: every shingle of the items, and the items among whose rarest it is.

    What reaches num / den has that share of an item's shingles at least; so it can't be
    without all of the rarest ones, one more than may be missing. Most shingles have no items.
    """
    each = items.select("item", F.explode("item_sh").alias("h"))
    times = each.groupBy("h").agg(F.count("*").alias("times"))
    by_item = joined(each, times, ["h"], ["item"], 32 * known["n"], broadcast_bytes).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("x"))
    some = F.slice(F.col("x.h"), 1, F.size("x") - _up(num * F.size("x"), den) + 1)
    rare = by_item.select("item", F.explode(F.array_distinct(some)).alias("h"))
    return each.select(F.lit(None).cast("long").alias("item"), "h").unionByName(rare).groupBy("h").agg(F.collect_set("item").alias("items"))


def matches(docs: DataFrame, benchmark: DataFrame, k: int = K, num: int = 80, den: int = 100, radius: int = RADIUS, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: for each document and item the best window that reaches num / den.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. What comes from the
    benchmark is broadcast only up to ``broadcast_bytes``, else shuffled.
    """
    named = benchmark.select("item_id", word_list(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("key", F.sha2(F.array_join("words", " "), 256))
    items = named.select("key", "words").dropDuplicates(["key"]).select(F.monotonically_increasing_id().alias("item"), "key", F.size("words").alias("w"), shingles(F.col("words"), k).alias("item_sh"))
    items = written(items)
    known = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("item_sh")), F.lit(0)).alias("n"), F.coalesce(F.max(F.size("item_sh")), F.lit(0)).alias("longest")).first()
    lanes, full = 3 if known["longest"] < 1 << 21 else 2, 64 * known["rows"] + 8 * known["n"]

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = texts.select("doc_id", word_list(F.col("text")).alias("words")).select("doc_id", F.posexplode(shingles(F.col("words"), k)).alias("p", "h"))
    hits = joined(found, rarest(items, known, num, den, broadcast_bytes), ["h"], ["doc_id", "p"], 64 * known["n"], broadcast_bytes)
    near = F.array_distinct(F.flatten(F.collect_set(F.when(F.size("items") > 0, F.col("items")))))
    hits = hits.groupBy("doc_id").agg(F.collect_set(F.struct("p", "h")).alias("hit"), near.alias("near")).select("doc_id", "hit", F.explode("near").alias("item"))
    pairs = joined(hits, items.select("item", "w", "item_sh"), ["item"], ["doc_id"], full, broadcast_bytes)
    own = F.filter("hit", lambda x: F.array_contains(F.col("item_sh"), x["h"]))
    pairs = pairs.select("doc_id", "item", "w", F.array_sort(F.array_distinct(F.transform(own, lambda x: x["p"]))).alias("ps"))
    pairs = pairs.where(den * F.size("ps") >= num * F.greatest(F.col("w") - (k - 1), F.lit(1)))
    wanted = written(pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item", "w", "ps")).alias("at")))

    held = texts.join(wanted, "doc_id").select("doc_id", "at", word_list(F.col("text")).alias("words")).select("doc_id", "at", shingles(F.col("words"), k).alias("sh"))
    held = held.select("doc_id", "sh", F.flatten(F.transform("at", lambda a: starts(a, F.size("sh"), k, num, den))).alias("xs"))
    begin = F.greatest(F.col("x.start"), F.lit(0))
    # Outer, since Spark would push a filter on xs down to the texts and compute it twice; rows without windows go just below.
    windows = held.select("doc_id", "sh", F.explode_outer("xs").alias("x")).select("doc_id", "x.item", begin.alias("start"), F.slice("sh", begin + 1, F.greatest(F.col("x.take"), F.lit(0))).alias("sh")).where(F.size("sh") > 0)
    windows = windows.withColumn("fp", simhash(F.col("sh"), lanes))

    index = items.select("item", simhash(F.col("item_sh"), lanes).alias("item_fp")).select("item", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("k")).select("item", "item_fp", "k.b", "k.v")
    probes = windows.select("*", F.explode(blocks(F.col("fp"), radius)).alias("k")).select("doc_id", "item", "start", "sh", "fp", "k.b", "k.v")
    diff = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = joined(probes, index, ["item", "b", "v"], ["doc_id", "start"], 64 * known["rows"] * (radius + 1), broadcast_bytes).where((F.bit_count(diff) <= radius) & (F.col("b") == first_block(diff, radius)))
    both = joined(met.select("doc_id", "item", "start", "sh"), items.select("item", "item_sh"), ["item"], ["doc_id", "start"], full, broadcast_bytes)
    scored = both.select("doc_id", "item", "start", F.size("sh").alias("n"), F.size("item_sh").alias("m"), weighted_common(F.col("sh"), F.col("item_sh")).alias("c"))
    whole = F.col("n") + F.col("m") - F.col("c")
    hit = scored.where(den * F.col("c") >= num * whole).select("doc_id", "item", F.struct((F.col("c") / whole).alias("similarity"), (-F.col("start")).alias("back"), (F.col("n") + k - 1).alias("n_words")).alias("x"))
    members = named.select("key", "item_id").distinct()
    members = joined(members, items.select("key", "item"), ["key"], ["item_id"], 96 * known["rows"], broadcast_bytes).select("item", "item_id")
    best = hit.groupBy("doc_id", "item").agg(F.max("x").alias("x")).join(members, "item").groupBy("doc_id", "item_id").agg(F.max("x").alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.back")).alias("start"), F.col("x.n_words").alias("n_words"), F.col("x.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item's passage."""
    bad = written(matches(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["bad_id"], "left_anti")


def op9_decontamination(spark, sf_dir):
    """Passages of ``benchmark`` in all ``documents``."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every window that shares a shingle with an item of its length, compared with that item.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS MATERIALIZED (SELECT doc_id, p, array_to_string(w[p + 1:p + 5], ' ') AS h FROM d, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS t(p)),
isx AS MATERIALIZED (SELECT item_id, greatest(len(w) - 4, 1) AS size, array_to_string(w[p + 1:p + 5], ' ') AS h FROM i, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS t(p)),
win AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, size, s FROM (SELECT DISTINCT doc_id, item_id, size, p FROM ds JOIN isx USING (h)), unnest(range(p - size + 1, p + 1)) AS t(s)),
wc AS (SELECT win.doc_id, win.item_id, win.s, ds.h, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p >= win.s AND ds.p < win.s + win.size GROUP BY ALL),
ic AS (SELECT item_id, h, count(*) AS c FROM isx GROUP BY ALL),
com AS (SELECT doc_id, item_id, s, sum(least(wc.c, ic.c)) AS c FROM wc JOIN ic USING (item_id, h) GROUP BY ALL),
tot AS (SELECT doc_id, item_id, s, sum(c) AS n FROM wc GROUP BY ALL),
itot AS (SELECT item_id, sum(c) AS m FROM ic GROUP BY ALL),
hit AS (SELECT doc_id, item_id, greatest(s, 0) AS start, n, c / (n + m - c) AS similarity FROM com JOIN tot USING (doc_id, item_id, s) JOIN itot USING (item_id) WHERE 100 * c >= 80 * (n + m - c)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n DESC) AS k FROM hit)
SELECT doc_id, item_id, start, n + 4 AS n_words, similarity FROM r WHERE k = 1
"""
