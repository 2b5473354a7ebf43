"""Quality grades by ordinal cumulative-link regression on hashed text.

Grades are 0 (low quality), 1 (fair quality but toxic), 2 (good). All thresholds
share one weight vector w over hashed features: P(grade <= k) = sigmoid(t_k - w.x)
with t_0 < t_1. Features are present or absent: every word's letters and digits
(A-Z lower-cased), the shapes of words (capitals, trailing marks, digits, marks
alone, a word that repeats the one before) by how large a share of the words has them, and the share of distinct
words. A text yields its expected grade and the probability that the grade is 2;
texts with that tail probability of at least ``cut`` are selected.

The weights are fitted on a bounded sample of about ``per_grade`` labelled texts
of each grade, drawn by a hash of doc_id. Features of fewer than ``least`` sampled
texts, or whose rate hardly differs between grades (chi-square below ``tell``),
have weight 0.

Defined results: a null, empty or blank text has only the features of an empty
text and is not selected (probability 0, grade 0). Labels with a null are
ignored; of several labels of one doc_id the lowest grade counts. Without labels
every text that has a word is selected, grade 2. Repeated rows are all returned;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textscan import U, distinct, mix, pieces, powers, text_bytes, words

BITS = 18
GRADES = 3
_CORE = np.zeros(256, U)  # codes of letters and digits, 0 for marks
for _i in range(256):
    if chr(_i).isalnum() and _i < 128 or _i >= 128:
        _CORE[_i] = ord(chr(_i).lower()) + 1 if _i < 128 else _i + 1
_ALNUM = _CORE > 0
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each row, and where each row's begin."""
    start, end, row, _ = words(buf, offs, lower=False)
    rows = offs.size - 1
    total = np.bincount(row, minlength=rows)
    alnum = np.concatenate([[0], np.cumsum(_ALNUM[buf])])
    first = np.flatnonzero(_ALNUM[buf])
    has = alnum[end] > alnum[start]
    begin = np.where(has, first[np.minimum(alnum[start], max(first.size - 1, 0))] if first.size else start, start)
    up, down = powers(buf.size + 1)
    sums = np.zeros(buf.size + 1, U)
    np.cumsum(_CORE[buf] * up[: buf.size], out=sums[1:])
    core = h = mix((sums[end] - sums[begin]) * down[begin])
    key = (row.astype(np.int64) << BITS) | (h >> U(64 - BITS)).astype(np.int64)
    key = distinct(key[has])
    different = np.bincount(key >> BITS, minlength=rows)

    def amount(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[end] - sums[start]

    b1 = buf[end - 1].astype(np.int64)
    b2 = buf[np.maximum(end - 2, start)].astype(np.int64)
    marks = ~_ALNUM
    caps = amount(_CAPITAL[buf])
    shapes = [
        (1, (caps >= 2) & (amount(_SMALL[buf]) == 0)),
        (2, ~has),
        (3, amount(_DIGIT[buf]) > 0),
        *((10 + i, ends) for i, ends in enumerate(b1 == ord(c) for c in "!*#%$&|~?;:")),
        (30, marks[b1] & marks[b2] & (end - start > 1)),
        (32, np.concatenate([[False], (core[1:] == core[:-1]) & (row[1:] == row[:-1])])[: row.size]),
        (31, has & ((caps > 1) & (caps < amount(_ALNUM[buf])))),
    ]
    some = np.maximum(total, 1)
    extra_row, extra = [], []
    for code, mask in shapes:
        share = np.bincount(row[mask], minlength=rows) / some
        for step, bound in enumerate((0.02, 0.1, 0.3, 0.6)):
            at = np.flatnonzero((share > bound) & (total > 0))
            extra_row.append(at)
            extra.append(np.full(at.size, code * 8 + step, np.int64))
    ratio = different / some
    for step, bound in enumerate((0.05, 0.15, 0.25, 0.35, 0.5)):
        at = np.flatnonzero((ratio < bound) & (total >= 40))
        extra_row.append(at)
        extra.append(np.full(at.size, 500 + step, np.int64))
    extra_row, extra = np.concatenate(extra_row), np.concatenate(extra)
    spot = (mix(extra.astype(U) * U(0x9E3779B97F4A7C15) + U(7)) >> U(64 - BITS)).astype(np.int64)
    key = distinct(np.concatenate([key, (extra_row << BITS) | spot]))
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(key >> BITS, minlength=rows))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def chosen(index: np.ndarray, begin: np.ndarray, grade: np.ndarray, least: int, tell: float) -> np.ndarray:
    """Features of ``least`` texts or more that some grade has at another rate than its share of all features tells.

    The rest is noise that would add up in long texts.
    """
    row = np.repeat(np.arange(grade.size), np.diff(begin))
    df = np.bincount(index, minlength=1 << BITS)
    odd = np.zeros(1 << BITS)
    for k in range(GRADES):
        mine = (grade == k)[row]
        expected = df * (np.count_nonzero(mine) / max(1, index.size))
        odd += (np.bincount(index[mine], minlength=1 << BITS) - expected) ** 2 / np.maximum(expected, 0.5)
    return np.flatnonzero((df >= least) & (odd >= tell))


def loss(p: np.ndarray, row: np.ndarray, col: np.ndarray, grade: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Class-balanced mean of -log P(grade) plus ridge / 2 * w.w, and its gradient.

    ``p``: the weights w, the first threshold and the log of the gap to the second;
    text row[i] has feature col[i].
    """
    w, t = p[:-2], np.array([p[-2], p[-2] + np.exp(p[-1])])
    share = np.bincount(grade, minlength=GRADES) / grade.size
    weight = 1 / (np.maximum(share, 1e-9)[grade] * np.count_nonzero(share)) / grade.size
    s = np.bincount(row, weights=w[col], minlength=grade.size)
    cut = np.concatenate([[-np.inf], t, [np.inf]])
    hi, lo = _sigmoid(cut[grade + 1] - s), _sigmoid(cut[grade] - s)
    q = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = weight * hi * (1 - hi) / q, weight * lo * (1 - lo) / q
    at = [d_lo[grade == k + 1].sum() - d_hi[grade == k].sum() for k in range(2)]
    g = np.concatenate([np.bincount(col, weights=(d_hi - d_lo)[row], minlength=w.size) + ridge * w, [at[0] + at[1], at[1] * np.exp(p[-1])]])
    return float(-(weight * np.log(q)).sum() + ridge / 2 * (w @ w)), g


def train(index: np.ndarray, begin: np.ndarray, grade: np.ndarray, least: int = 5, tell: float = 30.0, steps: int = 250, rate: float = 0.08, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the least loss, by Adam."""
    seen = chosen(index, begin, grade, least, tell)
    at = np.full(1 << BITS, -1, np.int64)
    at[seen] = np.arange(seen.size)
    col, row = at[index], np.repeat(np.arange(grade.size), np.diff(begin))
    col, row = col[at[index] >= 0], row[at[index] >= 0]
    p = np.concatenate([np.zeros(seen.size), [-1.0, np.log(2.0)]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        _, g = loss(p, row, col, grade, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(1 << BITS, np.float32)
    out[seen] = p[:-2]
    return out, np.array([p[-2], p[-2] + np.exp(p[-1])])


def fit(docs: DataFrame, labels: DataFrame, per_grade: int = 3000) -> tuple[np.ndarray, np.ndarray] | None:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality, toxic)."""
    graded = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
        .select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
    )
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, per_grade / n))])
    drawn = graded.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share[F.col("grade")] * (1 << 20))

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                index, begin = features(buf[part[0] : part[-1]], part - part[0])
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(index))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["grade", "index"])

    # At most about GRADES * per_grade rows of two integers: small enough to send to every task.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(drawn), "doc_id").select("grade", "text").mapInArrow(run, "grade int, index array<int>").toArrow()
    if not found.num_rows:
        return None
    lists = found.column("index").combine_chunks()
    return train(lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), found.column("grade").to_numpy().astype(np.int64))


def probabilities(buf: np.ndarray, offs: np.ndarray, model: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """P(grade >= 1) and P(grade >= 2) of each row."""
    rows = offs.size - 1
    index, begin = features(buf, offs)
    full = np.bincount(words(buf, offs)[2], minlength=rows) > 0
    if model is None:
        return full.astype(float), full.astype(float)
    s = np.bincount(np.repeat(np.arange(rows), np.diff(begin)), weights=model[0][index], minlength=rows)
    fair, good = (np.where(full, 1 - _sigmoid(t - s), 0.0) for t in model[1])
    return fair, good


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, expected_grade and p_good of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                fair, good = probabilities(buf[part[0] : part[-1]], part - part[0], model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(good + fair), pa.array(good)], ["doc_id", "expected_grade", "p_good"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, expected_grade double, p_good double")


def selected(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that are good with probability ``cut`` at least."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(at))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                _, good = probabilities(buf[part[0] : part[-1]], part - part[0], model)
                yield batch.slice(lo, hi - lo).filter(pa.array(good >= cut))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark, sf_dir, cut: float = 0.5):
    """Every document's expected grade and selection, learned from ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return grade(docs, model).withColumn("selected", F.col("p_good") >= cut)
