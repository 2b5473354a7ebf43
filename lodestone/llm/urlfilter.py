"""Rule and list based URL filtering: a blocked Bloom filter, then an exact hash join.

``judge`` splits every URL into host and path and forms the keys under which a
rule or listed URL could fit it: each host suffix (of the label counts that the
list has) with each path prefix (of the lengths that the list has). A blocked
Bloom filter of the list's keys, a table with a row for each block, lets only possible hits through; those meet the
list in an exact equi-join that removes the false positives. The longest rule
wins, of contradicting rules of one host and path the one that blocks; where no rule fits, a listed URL is blocked and any other allowed. For the
list, but not for rules, hosts and paths of both sides are made canonical: without
user, default port and trailing dots, an empty path as /.

Null URLs and URLs without ``://`` have an empty host and path, fit nothing and
are allowed. Repeated rows are judged alike and all returned. Columns other
than the id and the URL are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import ascii_lower

#: 64-bit words of a block: a key's bits all lie in one cache line.
BLOCK_WORDS, PROBES = 8, 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def canonical(host: Column, path: Column, scheme: Column | None = None) -> tuple[Column, Column]:
    """Host without user, default port and trailing dots, and path with an empty one as /; without a scheme both default ports go."""
    host = F.regexp_replace(ascii_lower(host), "(?s)^.*@", "")
    bare = lambda ports: F.regexp_replace(host, rf":({ports})?\z", "")
    if scheme is None:
        host = bare("80|443")
    else:
        host = F.when(scheme == "http", bare("80")).when(scheme == "https", bare("443")).otherwise(bare(""))
    return F.regexp_replace(host, r"\.+\z", ""), F.when(path == "", "/").otherwise(path)


def block_of(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 45), F.lit(blocks))


def _bits(h: Column) -> list[tuple[Column, Column]]:
    """Word index within its block and mask of each probe of hash ``h``."""
    spots = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511).cast("long")) for i in range(PROBES)]
    return [(F.shiftright(p, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))) for p in spots]


def bloom_blocks(keys: int, bits_per_key: int = 16, max_bytes: int = 32 << 20) -> int:
    """Number of blocks for ``keys`` keys, of ``max_bytes`` together at most.

    A longer list makes the filter less selective, never wrong, since an exact join follows.
    """
    return max(1, min(max_bytes // (8 * BLOCK_WORDS), -(-keys * bits_per_key // (64 * BLOCK_WORDS))))


def bloom(hashes: DataFrame, column: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter of ``column`` as a table: a row (block, w0 .. w7) for each block that holds a key."""
    word = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(w == i, m).otherwise(F.lit(0).cast("long")) for w, m in _bits(F.col(column))]) for i in range(BLOCK_WORDS)]
    each = hashes.select(block_of(F.col(column), blocks).alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(word)])
    return each.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])


def maybe(df: DataFrame, h: Column, filter_: DataFrame, blocks: int, send: bool) -> DataFrame:
    """The rows of ``df`` whose hash ``h`` the filter may hold; the filter is sent to all tasks or joined by block."""
    held = F.broadcast(filter_) if send else filter_
    both = df.withColumn("h", h).withColumn("block", block_of(F.col("h"), blocks)).join(held, "block")
    ok = F.lit(True)
    for w, m in _bits(F.col("h")):
        ok = ok & (F.get(F.array(*[F.col(f"w{i}") for i in range(BLOCK_WORDS)]), w).bitwiseAND(m) != 0)
    return both.where(ok).select(*df.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Judges every row of ``pages``.

    ``rules``: verdict, host, path. ``listed``: host, path of blocked URLs (and
    of all below them). Returns id, host, path, rule, verdict, listed.
    The filter, of 32 MB at most, and the list are each sent to all tasks only if they
    take at most ``broadcast_bytes`` there; else they are joined by shuffles.
    """
    list_host, list_path = canonical(F.col("host"), F.col("path"))
    keys = (
        rules.select("verdict", "host", "path", F.lit(True).alias("is_rule"))
        .unionByName(listed.select(F.lit("block").alias("verdict"), list_host.alias("host"), list_path.alias("path"), F.lit(False).alias("is_rule")))
        .where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select("verdict", "is_rule", F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("plen"))
        .groupBy("key", "is_rule", "labels", "plen").agg(F.max(F.struct(F.col("verdict") == "block", "verdict")).alias("x"))
        .select("x.verdict", "is_rule", "key", "labels", "plen")
    )
    shape = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0)).alias("bytes"), F.array_sort(F.collect_set("labels")).alias("labels"), F.array_sort(F.collect_set("plen")).alias("plens")).first()
    host, path = split_url(F.col(url_col))
    scheme = ascii_lower(F.substring_index(F.coalesce(F.col(url_col), F.lit("")), "://", 1))
    list_host, list_path = canonical(F.col("host"), F.col("path"), F.col("scheme"))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), scheme.alias("scheme"))
    urls = urls.select("page_id", "host", "path", list_host.alias("list_host"), list_path.alias("list_path"))
    url = ["host", "path", "list_host", "list_path"]
    if not shape["n"]:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"), F.lit(False).alias("listed"))
    blocks = bloom_blocks(shape["n"])
    filter_ = bloom(keys.select(F.xxhash64("key", "is_rule").alias("h")), "h", blocks)
    suffix = lambda parts, n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    sides = [("parts", "path", "s", True), ("list_parts", "list_path", "t", False)]
    suffixes = [suffix(parts, n).alias(f"{s}{i}") for parts, _, s, _ in sides for i, n in enumerate(shape["labels"])]
    cands = [
        F.struct(F.when(F.length(at) >= p, F.concat(F.col(f"{s}{i}"), F.substring(at, 1, p))).alias("key"), F.lit(is_rule).alias("is_rule"))
        for _, at, s, is_rule in sides for i in range(len(shape["labels"])) for p in shape["plens"]
    ]
    probes = (
        urls.where(F.col("host") != "").select(*url).distinct()
        .withColumn("parts", F.split("host", r"\."))
        .withColumn("list_parts", F.split("list_host", r"\."))
        .select(*url, *suffixes)
        .select(*url, F.explode(F.array(*cands)).alias("x"))
        .select(*url, "x.key", "x.is_rule")
        .where(F.col("key").isNotNull())
    )
    probes = maybe(probes, F.xxhash64("key", "is_rule"), filter_, blocks, 128 * blocks <= broadcast_bytes)
    table = F.broadcast(keys) if shape["bytes"] <= broadcast_bytes else keys
    longest = F.struct(F.length("key"), "labels")
    best = (
        probes.join(table.select("key", "is_rule", "labels", F.col("verdict").alias("says")), ["key", "is_rule"])
        .groupBy(*url)
        .agg(
            F.max(F.when(F.col("is_rule"), F.struct(longest, F.col("key").alias("rule"), "says"))).alias("best"),
            F.max(~F.col("is_rule")).alias("hit"),
        )
    )
    # URLs without a host, however many, fit nothing and stay out of the join.
    bare = urls.where(F.col("host") == "").select("*", *[F.lit(None).cast(best.schema[c].dataType).alias(c) for c in ("best", "hit")])
    return urls.where(F.col("host") != "").join(best, url, "left").unionByName(bare).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.says"), F.when(F.col("hit"), "block"), F.lit("allow")).alias("verdict"),
        F.coalesce("hit", F.lit(False)).alias("listed"),
    )


#: Fixed values of the query: rules (verdict, host, path) and listed hosts.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
LISTED = (
    ("cheap-pills.example.com", "/"),
    ("spam-farm.example.com", "/"),
    ("spam-farm.example.net", "/"),
    ("spam-farm.example.org", "/"),
)


def op7_url_filter(spark, sf_dir):
    """Every ``pages`` URL under the fixed rules and list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    listed = spark.createDataFrame(list(LISTED), "host string, path string")
    return judge(pages, rules, listed)


OP7_SQL = """
WITH r(verdict, host, path, rule) AS (VALUES
  ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'),
  ('block', 'example.org', '/en/1', 'example.org/en/1'), ('allow', 'com', '/fr/', 'com/fr/'),
  ('block', 'com', '/de/', 'com/de/')),
l(host, path) AS (VALUES ('cheap-pills.example.com', '/'), ('spam-farm.example.com', '/'), ('spam-farm.example.net', '/'), ('spam-farm.example.org', '/')),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
  translate(coalesce(regexp_extract(url, '^(.*?)://', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme FROM pages),
b AS (SELECT n, page_id, rest, scheme, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
u AS (SELECT n, page_id, scheme, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
c AS (SELECT n, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), CASE scheme WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE ':$' END, ''), '[.]+$', '') AS host,
  CASE WHEN path = '' THEN '/' ELSE path END AS path FROM u WHERE host <> ''),
m AS (SELECT u.n, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY u.n),
h AS (SELECT DISTINCT c.n FROM c JOIN l ON (c.host = l.host OR ends_with(c.host, '.' || l.host)) AND starts_with(c.path, l.path))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, CASE WHEN h.n IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, h.n IS NOT NULL AS listed
FROM u LEFT JOIN m USING (n) LEFT JOIN h USING (n)
"""
