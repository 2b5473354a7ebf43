"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

``sketch`` reads each text once and gives the size of its shingle set, a 128-bit
fingerprint of that set, and the keys of its signature's bands. Documents with
equal fingerprints are one class; only its representative, the row of the smallest
doc_id, goes on, and all members get its component in the end. Both steps deal a
class by SALTS hashes of doc_id, so a class of any size is spread over the cluster.
Representatives that share a band key are candidates. A bucket of any size is first tried as a star around its
smallest member. Members of buckets that then still span several groups are
compared where they share rare enough shingles (see ``rare_pairs``), which loses
no link. So a large group of near copies costs rows in proportion to its size. Every
link is confirmed on both full shingle sets. Groups come from repeated
min-label passes with pointer jumping over written tables.

Defined results: a null, empty or blank text has an empty set and links with
nothing; a null doc_id links with nothing and is its own component (null).
Repeated rows are all returned, in one component; rows of one doc_id with
different texts are linked with one another, and each text has its own links.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch, written
from lodestone.llm.textscan import U, mix, pieces, shingle_sets, text_bytes

#: 36 bands of 6 ranks: a pair of similarity 0.8 shares no band with probability below 2e-5.
BANDS, ROWS = 36, 6
#: Parts into which the members of a class of equal sets are dealt.
SALTS = 1024
GOLD = 0x9E3779B97F4A7C15


def super_minhash(sets: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (rows x m) of the sets that ``begin`` cuts from ``sets``.

    An element draws a rank j + r for the slot p(j), for j = 0, 1, ...; p is its
    own random permutation, drawn step by step. All elements take step j
    together. A set whose slots are all filled at step j can gain nothing from
    later steps, whose ranks are larger, so it stops there. A rank is kept as
    the integer j * 2^32 + r * 2^32.
    """
    rows = begin.size - 1
    sig = np.full(rows * m, np.iinfo(U).max, U)
    owner = np.repeat(np.arange(rows), np.diff(begin))
    e, perm = sets, None
    for j in range(m):
        if not e.size:
            break
        draw = mix(e + U((GOLD * (j + 1)) & (2**64 - 1)))
        k = j + (((draw & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if perm is None:
            p = k
        else:
            i = np.arange(e.size)
            p = perm[i, k]
            perm[i, k] = perm[:, j]
            p = p.astype(np.int64)
        np.minimum.at(sig, owner * m + p, U(j << 32) | (draw >> U(32)))
        full = sig.reshape(rows, m).max(1) < U((j + 1) << 32)
        if not j:
            go = ~full[owner]
            e, owner, k = e[go], owner[go], k[go]
            perm = np.tile(np.arange(m, dtype=np.uint16), (e.size, 1))
            i = np.arange(e.size)
            perm[i, k] = perm[:, 0]
        else:
            go = ~full[owner]
            if np.count_nonzero(go) < 0.8 * go.size:
                e, owner, perm = e[go], owner[go], perm[go]
    return sig.reshape(rows, m)


def _spans(begin: np.ndarray, most: int):
    """Runs of rows with at most ``most`` elements together, or of one row."""
    lo, n = 0, begin.size - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(begin, begin[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi


def signatures(sets: np.ndarray, begin: np.ndarray, m: int, most: int = 1 << 15) -> np.ndarray:
    """``super_minhash`` in spans of bounded memory; a longer set goes by parts, joined by minimum."""
    out = []
    for lo, hi in _spans(begin, most):
        a, b = begin[lo], begin[hi]
        if hi - lo == 1 and b - a > 4 * most:
            parts = [super_minhash(sets[x : min(x + most, b)], np.array([0, min(most, b - x)]), m) for x in range(a, b, most)]
            out.append(np.minimum.reduce(parts))
        else:
            out.append(super_minhash(sets[a:b], begin[lo : hi + 1] - a, m))
    return np.concatenate(out) if out else np.zeros((0, m), U)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = sig.reshape(-1, bands, rows)
    acc = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(GOLD)), parts.shape[:2]).copy()
    for r in range(rows):
        acc = mix(acc * U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return acc


def sketch(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, text: bool = False) -> DataFrame:
    """doc_id, n_shingles, set fingerprint (f1, f2) and band keys of every document, and its text if asked for."""
    names = ["doc_id", "n_shingles", "f1", "f2", "bands", *["text"] * text]

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                sets, begin = shingle_sets(buf[part[0] : part[-1]], part - part[0], k)
                n = np.diff(begin)
                sums = [np.concatenate([[U(0)], np.cumsum(mix(sets + U(c)))]) for c in (GOLD, 0x5851F42D4C957F2D)]
                f1, f2 = ((s[begin[1:]] - s[begin[:-1]]).view(np.int64) for s in sums)
                has = np.flatnonzero(n)
                keys = np.zeros((n.size, bands), np.int64)
                if has.size:
                    keys[has] = band_keys(signatures(sets, np.concatenate([[0], np.cumsum(n[has])]), bands * rows), bands, rows).view(np.int64)
                held = np.where(n > 0, bands, 0)
                flat = pa.array(keys[has].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32)), flat)
                own = [batch.column(i).slice(lo, hi - lo) for i in range(1 + text)]
                yield pa.RecordBatch.from_arrays([own[0], pa.array(n), pa.array(f1), pa.array(f2), lists, *own[1:]], names)

    schema = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>" + ", text string" * text
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union, counted on both full sets."""

    def run(batches):
        for batch in batches:
            a_buf, a_offs = text_bytes(batch.column(2))
            b_buf, b_offs = text_bytes(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi in pieces(a_offs + b_offs):
                sides = []
                for buf, offs in ((a_buf, a_offs), (b_buf, b_offs)):
                    part = offs[lo : hi + 1]
                    sides.append(shingle_sets(buf[part[0] : part[-1]], part - part[0], k))
                (x, xb), (y, yb) = sides
                for i in range(hi - lo):
                    p, q = x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]]
                    if p.size and q.size:
                        both = np.concatenate([p, q])
                        both.sort()
                        common = int(np.count_nonzero(both[1:] == both[:-1]))
                        keep[lo + i] = den * common >= num * (p.size + q.size - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tmp: Scratch) -> DataFrame:
    """node, label: the smallest node reachable from each node over the undirected edges (a, b).

    Each pass gives a node the smallest label around it and then the label of
    that label; only the number of changed labels reaches the driver.
    """
    both = tmp.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tmp.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = tmp.written(step.join(roots, "label", "left").select("node", "was", F.coalesce(F.least("label", "up"), "label").alias("label")))
        changed = new.where(F.col("was") != F.col("label")).limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def rare_pairs(rest: DataFrame, texts: DataFrame, k: int, num: int, den: int, tmp: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of different groups among ``rest`` (doc_id, n, label): no link is left out.

    Shingles are put in one order, those of the fewest documents first. Two sets
    of the similarity asked for share a shingle among the first
    n - ceil(n * num / den) + 1 of each, and from the first such shingle on each has
    as many left as they have in common at most. Near copies that differ from their
    source in many places of their own thus meet few others, however many copies
    there are; shingles that only one group has there are left out.
    """

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                sets, begin = shingle_sets(buf[part[0] : part[-1]], part - part[0], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(sets.view(np.int64)))], ["doc_id", "h"])

    each = tmp.written(texts.join(rest, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, h array<long>")).select("doc_id", F.explode("h").alias("h"))
    common = tmp.written(each.groupBy("h").agg(F.count("*").alias("df")))  # as above: a popular shingle's rows can be split
    ordered = each.join(common, "h").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s")).join(rest, "doc_id")
    first = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int"))
    heads = tmp.written(ordered.select("doc_id", "n", "label", F.posexplode(first).alias("i", "x")).where("x.df > 1").select("doc_id", "n", "label", "i", F.col("x.h").alias("h")))
    # A shingle's largest group meets only the documents of other groups, never itself.
    groups = heads.groupBy("h", "label").agg(F.count("*").alias("c"))
    mixed = groups.groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("g")).where("g > 1").select("h", "main")
    heads = tmp.written(heads.join(tmp.written(mixed), "h"))
    x = heads.where(F.col("label") != F.col("main")).select("h", F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), F.col("i").alias("ai"))
    y = heads.select("h", F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"), F.col("i").alias("bi"))
    most = F.least(F.col("an") - F.col("ai"), F.col("bn") - F.col("bi"))
    possible = den * most >= num * (F.col("an") + F.col("bn") - most)
    return x.join(y, "h").where((F.col("al") != F.col("bl")) & possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _split_ids(sk: DataFrame, docs: DataFrame, odd: DataFrame, k: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``sk`` and (node, text) of ``docs`` where the doc_ids in ``odd`` have a node of their own for each text."""
    own = lambda df: df.withColumn("node", F.xxhash64("doc_id", "f1", "f2"))
    nodes = sk.join(odd, "doc_id", "left_anti").withColumn("node", F.col("doc_id")).unionByName(own(sk.join(odd, "doc_id", "left_semi")))
    told = own(sketch(docs.join(odd, "doc_id", "left_semi"), k, bands, rows, text=True)).select("node", "text")
    return nodes, docs.join(odd, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "text").unionByName(told)


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tmp = Scratch(docs.sparkSession)
    sk = written(sketch(docs, k, bands, rows))
    live = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # A doc_id is one node, unless it has several sets: then each is one, and all are linked.
    several = F.min(F.struct("f1", "f2")) != F.max(F.struct("f1", "f2"))
    odd = tmp.written(live.groupBy("doc_id").agg(several.alias("several")).where("several").select("doc_id"))
    split = bool(odd.limit(1).count())
    nodes, of_node = _split_ids(live, docs, odd, k, bands, rows) if split else (live.withColumn("node", F.col("doc_id")), docs.withColumnRenamed("doc_id", "node"))

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    parts = nodes.groupBy("f1", "f2", salt.alias("salt")).agg(F.min("doc_id").alias("low"), F.min_by("node", "doc_id").alias("rep"))
    classes = written(parts.groupBy("f1", "f2").agg(F.min_by("rep", "low").alias("rep"), F.min("low").alias("low"), F.collect_set("salt").alias("salts")))

    reps = nodes.join(classes.select("f1", "f2", F.col("rep").alias("node")), ["node", "f1", "f2"], "left_semi")
    rows_ = reps.select(F.col("node").alias("doc_id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    hubs = rows_.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where(F.col("hub") != F.col("last")).select("key", "hub")
    hubs = tmp.written(hubs)
    buckets = tmp.written(rows_.join(hubs, "key").select("key", "hub", "doc_id", "n").distinct())
    stars = buckets.where(F.col("doc_id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()

    wanted = buckets.select(F.col("doc_id").alias("node")).distinct()
    texts = tmp.written(of_node.join(wanted, "node").groupBy(F.col("node").alias("doc_id")).agg(F.min("text").alias("text")))
    links = confirmed(stars, texts, k, num, den)
    if split:
        mine = nodes.join(odd, "doc_id", "left_semi").join(classes.select("f1", "f2", "rep"), ["f1", "f2"])
        one = mine.groupBy("doc_id").agg(F.min("rep").alias("a"))
        links = links.unionByName(mine.join(one, "doc_id").where(F.col("a") != F.col("rep")).select("a", F.col("rep").alias("b")).distinct())
    links = tmp.written(links)
    labels = components(links, tmp)

    # Buckets that the stars left in several groups: their members of different groups are compared.
    marked = buckets.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("label", "doc_id").alias("label"))
    open_keys = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    rest = tmp.written(marked.join(open_keys, "key").select("doc_id", "n", "label").distinct())
    cross = rare_pairs(rest, texts, k, num, den, tmp)
    more = tmp.written(confirmed(cross.join(stars, ["a", "b"], "left_anti"), texts, k, num, den))
    if more.limit(1).count():
        labels = components(links.unionByName(more), tmp)
    labels = written(labels)
    tmp.drop()

    # A component is named by its smallest doc_id, which its label is, unless a doc_id has several nodes.
    marked = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "salts", "low", F.coalesce("label", "rep").alias("label"))
    if split:
        least = marked.groupBy("label").agg(F.min("low").alias("name"))
        marked = marked.join(least, "label").withColumn("label", F.col("name"))
    of_class = marked.select("f1", "f2", F.explode("salts").alias("salt"), F.col("label").alias("component_id"))
    found = live.select("doc_id", "n_shingles", "f1", "f2", salt.alias("salt")).join(of_class, ["f1", "f2", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = sk.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    out = found.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs``, all columns, with one document of each group of near duplicates: the one of smallest doc_id.

    Of repeated rows of one doc_id one stays. Rows with a null doc_id stay.
    """
    found = written(near_duplicates(docs, k, num, den))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_id"))
    if not again.limit(1).count():
        return left
    twice = docs["doc_id"].cast("long") == again["again_id"]
    return left.join(again, twice, "left_anti").unionByName(left.join(again, twice, "left_semi").dropDuplicates(["doc_id"]))


def op1_near_duplicates(spark, sf_dir):
    """All ``documents``: 4-word shingles, similarity 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, num=80, den=100)


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS sh FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT sh FROM s GROUP BY sh HAVING count(*) > 1),
t AS MATERIALIZED (SELECT s.* FROM s SEMI JOIN f USING (sh)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""
