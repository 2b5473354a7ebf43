"""Source divergence audit: how the words of each source differ from those of the others of its language.

Plain relational steps: regular-expression matches are exploded and counted by language,
source and term; terms in at least ``least`` documents of a language are its
vocabulary; every group (a language's source) is crossed with the vocabulary, so that
terms it lacks have a count of 0; smoothed shares are compared by a
self-join on language and term; sums are ranked in windows.

All numbers are whole: p = 1 + floor(10^9 (count + 1) / (N + V)), and a term adds
floor((p - q)^2 / q). Products that pass 64 bits go through decimals.

Counts are combined before they are shuffled, so a common term or a hot source is a row a task at
most. A term's counts are held as one map over its language's sources; the groups are joined to these rows by
language, sent to all tasks up to ``broadcast_rows`` groups (counted) and dealt by salt
beyond. The dense rows thus arise from rows already dealt and sorted by language and term and are never
shuffled themselves up to that bound. Parts ``pair`` are combined map-side; of parts ``term``
each task keeps its ``top`` rows a group before the shuffle.

Defined results: null lang, source and text count as ''; a group without terms has counts of
0 throughout; a language without vocabulary gives its pairs a value of 0 and no terms; a
language of one source gives no pairs; repeated rows each count as a document; an empty table gives
no rows; extra columns are ignored. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import Scratch, table

#: What stands between terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ once A-Z are lower-cased.
OTHER = r"[\x00-\x60\x7B-\x7F]+"
#: Bytes of texts that are counted at a time.
SLICE = 16 << 20
SCALE = 1_000_000_000
#: Groups that are sent to all tasks: at most some 20 MB.
BROADCAST_ROWS = 100_000


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE (count + 1) / total), exact for counts of any size."""
    short = F.call_function("div", SCALE * (count + 1), total)
    long = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return 1 + F.when(count < (1 << 62) // SCALE, short).otherwise(long)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c, d: how often a group has a term, and in how many of its documents. Columns lang, source, text.

    Matches are exploded and counted by slices of SLICE bytes of text inside Arrow batches, so Spark's grouping gets a row for
    each term of a slice's group and not one for each match.
    """

    def count(batch):
        terms = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), OTHER)
        doc, term = pc.list_parent_indices(terms).to_numpy(), pc.list_flatten(terms).dictionary_encode()
        code = term.indices.to_numpy().astype(np.int64)
        real = np.append(np.ones(len(term.dictionary), bool), False)
        real[pc.index(term.dictionary, "").as_py()] = False  # before a first and after a last separator; -1 hits the appended one
        doc, code = doc[real[code]], code[real[code]]
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        known = {g: i for i, g in enumerate(dict.fromkeys(names))}
        group, width = np.array([known[g] for g in names], np.int64), max(1, len(term.dictionary))
        each, times = np.unique(doc * width + code, return_counts=True)
        key, at, d = np.unique(group[each // width] * width + each % width, return_inverse=True, return_counts=True)
        c = np.bincount(at, times, key.size).astype(np.int64)
        lang, source = (pa.array([g[k] for g in known], pa.string()).take(pa.array(key // width)) for k in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, term.dictionary.take(pa.array(key % width)), pa.array(c), pa.array(d.astype(np.int64))], ["lang", "source", "term", "c", "d"])

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE, "right")))
                yield count(batch.slice(lo, hi - lo))
                lo = hi

    parts = docs.select("lang", "source", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "lang string, source string, term string, c long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def vocabulary(counts: DataFrame, least: int) -> DataFrame:
    """lang, term, c (in the language), by (source to count): the terms in at least ``least`` documents of a language."""
    held = counts.groupBy("lang", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "c"))).alias("by"))
    return held.where(F.col("d") >= least).select("lang", "term", "c", "by")


def totals(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """lang, source, total, lang_total for every group: N + V of the group and of its language; 0 without vocabulary."""
    of_lang = vocab.groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    of_group = vocab.select("lang", F.explode("by").alias("source", "c")).groupBy("lang", "source").agg(F.sum("c").alias("n"))
    found = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang.withColumnRenamed("n", "lang_n"), "lang", "left")
    zero = F.lit(0).cast("long")
    return found.select("lang", "source", (F.coalesce("n", zero) + F.coalesce("v", zero)).alias("total"), F.coalesce(F.col("lang_n") + F.col("v"), zero).alias("lang_total"))


def crossed(vocab: DataFrame, groups: DataFrame, broadcast_rows: int) -> DataFrame:
    """lang, term, source, c, p, q: every group of a language with every term, sorted by language and term.

    p is the group's share and q the language's. Each language also has the term '' (no
    match is empty) with p = q = 1 everywhere, so that languages without vocabulary have their pairs.
    """
    none = groups.select("lang").distinct().select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("c"), F.create_map().cast("map<string,bigint>").alias("by"))
    rows = vocab.unionByName(none).withColumnRenamed("c", "lang_c")
    if groups.count() <= broadcast_rows:
        both = rows.repartition("lang", "term").sortWithinPartitions("lang", "term").join(F.broadcast(groups), "lang")
    else:
        salts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int")).join(copies, ["lang", "salt"])
    c = F.coalesce(F.try_element_at("by", F.col("source")), F.lit(0).cast("long"))
    dense = both.select("lang", "term", "source", c.alias("c"), "lang_c", "total", "lang_total")
    at = lambda n, total: F.when(F.col("term") == "", F.lit(1).cast("long")).otherwise(share(F.col(n), F.col(total)))
    return dense.select("lang", "term", "source", "c", at("c", "total").alias("p"), at("lang_c", "lang_total").alias("q"))


def pairs(dense: DataFrame) -> DataFrame:
    """lang, source, item, value: for each other source of the language the summed distance of the group from it."""
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
    both = dense.select("lang", "term", "source", "p").join(other, ["lang", "term"]).where(F.col("source") != F.col("item"))
    return both.groupBy("lang", "source", "item").agg(F.sum(distance(F.col("p"), F.col("other"))).alias("value"))


def marked_terms(dense: DataFrame) -> DataFrame:
    """lang, source, item, value: the group's own terms of a larger share than in its language."""
    more = dense.where((F.col("c") > 0) & (F.col("p") > F.col("q")))
    return more.select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def divergence(docs: DataFrame, least: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank, by falling value and then by item; of terms the first ``top``."""
    scratch = Scratch(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(text).alias("text"))
    vocab = scratch.written(vocabulary(term_counts(docs), least))
    groups = scratch.written(totals(docs, vocab))
    dense = crossed(vocab, groups, broadcast_rows)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs(dense), "pair").unionByName(out(marked_terms(dense), "term").where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir):
    """All ``documents``: terms in at least 3 documents of a language, 200 terms a group."""
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(t) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY 1, 2, 3),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
e AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c)::HUGEINT + count(*) AS n FROM e GROUP BY 1, 2),
p AS MATERIALIZED (SELECT e.lang, e.source, e.term, e.c, 1 + (1000000000 * (e.c + 1)) // n.n AS p FROM e JOIN n ON n.lang = e.lang AND n.source = e.source),
l AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM e GROUP BY 1, 2),
ln AS (SELECT lang, sum(c)::HUGEINT + count(*) AS n FROM l GROUP BY 1),
q AS (SELECT l.lang, l.term, 1 + (1000000000 * (l.c + 1)) // ln.n AS q FROM l JOIN ln ON ln.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.v, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 200
"""
