"""Language identification by word-first backoff.

A word known to the model scores, for each language, minus the log10 of its
relative frequency there (``ABSENT`` where that language lacks it). A word not
known is scored by its longest character n-grams of which any is known: the mean
over those, from 5 characters down to 1, a space standing for the word's edges.
A text's score is the mean over its words, and the least score wins.

The model is counted on the executors from a sample of at most about
``per_lang`` texts of each language, picked by a hash of doc_id, and holds at
most ``keep`` words and n-grams of each length a language; only that bounded
table reaches the driver and the tasks.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
A text none of whose words and characters is known gets the language with most
training texts, score 0. Texts without language teach nothing but are
predicted. A null doc_id is never learned from and counts as held out. Without
any training text every prediction is ``und``. Repeated rows are all returned;
extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textscan import PIECE, Table, U, runs_hash

ORDERS = (5, 4, 3, 2, 1)
ABSENT = 7.0
SALT = [U(0x9E3779B97F4A7C15 * (n + 1) & (2**64 - 1)) for n in range(6)]


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter; whether it belongs to a word (letters and marks)."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    mark = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)
    return alpha, alpha | mark


def scan(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the lower-cased texts (non-letters 33), start, end, row of each word, and which rows have a letter."""
    low = [(t or "").lower() for t in texts]
    offs = np.cumsum([1, *(len(t) + 1 for t in low)])
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "replace"), np.uint32)
    alpha, inside = letters()
    word = inside[points]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    row = np.searchsorted(offs, start, "right") - 1
    has = np.zeros(len(low), bool)
    has[row[np.add.reduceat(alpha[points], start) > 0] if start.size else row] = True
    codes = np.where(word, points.astype(U) + U(1), U(33))
    return codes, start, end, row, has


def grams(codes: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each word with its edges (single characters without), and the word of each."""
    edge = int(n > 1)
    many = np.maximum(0, end - start + 2 * edge - n + 1)
    owner = np.repeat(np.arange(start.size), many)
    at = np.arange(owner.size) - np.repeat(np.cumsum(many) - many, many) + (start - edge)[owner]
    return runs_hash(codes, at, at + n) ^ SALT[n], owner


def _slices(texts: list[str | None]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def counts(train: DataFrame) -> DataFrame:
    """lang, kind (0 a word, else the n-gram's length), h, n over (lang, text)."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                codes, start, end, row, _ = scan(texts[lo:hi])
                names = sorted(set(langs[lo:hi]))
                of = np.array([names.index(x) for x in langs[lo:hi]], np.int64)[row]
                h = runs_hash(codes, start, end)
                for i, name in enumerate(names):
                    mine = np.flatnonzero(of == i)
                    uniq, first, many = np.unique(h[mine], return_index=True, return_counts=True)
                    first = mine[first]
                    found = [(0, uniq ^ SALT[0], many)]
                    for n in ORDERS:
                        g, owner = grams(codes, start[first], end[first], n)
                        u, back = np.unique(g, return_inverse=True)
                        found.append((n, u, np.bincount(back, weights=many[owner], minlength=u.size).astype(np.int64)))
                    for kind, u, m in found:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * u.size, pa.string()), pa.array(np.full(u.size, kind, np.int32)), pa.array(u.view(np.int64)), pa.array(m.astype(np.int64))], ["lang", "kind", "h", "n"])

    found = train.select("lang", "text").mapInArrow(run, "lang string, kind int, h long, n long")
    return found.groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, per_lang: int = 1000, keep: int = 20_000, least: int = 2) -> dict:
    """The model from (doc_id, text, lang): for each kind a hash table and log frequencies."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return {"langs": [], "kinds": {}}
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, per_lang / n))])
    drawn = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    table = counts(usable.where(drawn).select("lang", "text"))
    table = table.withColumn("all", F.sum("n").over(_by("lang", "kind"))).where(F.col("n") >= least)
    table = table.withColumn("rank", F.row_number().over(_by("lang", "kind").orderBy(F.desc("n"), "h"))).where(F.col("rank") <= keep)
    got = table.select("lang", "kind", "h", (-F.log10(F.col("n") / F.col("all"))).cast("float").alias("cost")).toArrow()
    langs = sorted(sizes, key=lambda l: (-sizes[l], l))
    kind, h, cost = (got.column(c).to_numpy() for c in ("kind", "h", "cost"))
    which = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    kinds = {}
    for k in (0, *ORDERS):
        mine = kind == k
        keys, back = np.unique(h[mine].astype(np.int64).view(U), return_inverse=True)
        scores = np.full((keys.size, len(langs)), ABSENT, np.float32)
        scores[back, which[mine]] = np.minimum(cost[mine], ABSENT)
        kinds[k] = (keys, scores)
    return {"langs": langs, "kinds": kinds}


def _by(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def score_texts(model: dict, tables: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and confidence of each text."""
    codes, start, end, row, has = scan(texts)
    langs, rows = model["langs"], len(texts)
    if not langs:
        return ["und"] * rows, np.zeros(rows)
    sums, many = np.zeros((rows, len(langs))), np.zeros(rows)

    def add(owner: np.ndarray, scores: np.ndarray) -> None:
        many[:] += np.bincount(owner, minlength=rows)
        for i in range(len(langs)):
            sums[:, i] += np.bincount(owner, weights=scores[:, i], minlength=rows)

    at = tables[0].find(runs_hash(codes, start, end) ^ SALT[0])
    known = at >= 0
    add(row[known], model["kinds"][0][1][at[known]])
    left = np.flatnonzero(~known)
    for n in ORDERS:
        if not left.size:
            break
        h, owner = grams(codes, start[left], end[left], n)
        at = tables[n].find(h)
        hit = at >= 0
        owner, scores = owner[hit], model["kinds"][n][1][at[hit]]
        per = np.bincount(owner, minlength=left.size)
        mean = np.stack([np.bincount(owner, weights=scores[:, i], minlength=left.size) for i in range(len(langs))], 1) / np.maximum(per, 1)[:, None]
        done = per > 0
        add(row[left[done]], mean[done])
        left = left[~done]
    mean = sums / np.maximum(many, 1)[:, None]
    best = mean.argmin(1)
    sure = 1 / np.power(10.0, mean.min(1, keepdims=True) - mean).sum(1)
    sure = np.where(has & (many > 0), sure, 0.0)
    return [langs[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist(), strict=True)], sure


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        tables = {k: Table(keys) for k, (keys, _) in model["kinds"].items()}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _slices(texts):
                pred, sure = score_texts(model, tables, texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(sure)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: dict, least: float) -> DataFrame:
    """The rows of ``docs``, with all columns, whose language is told with a score of at least ``least``.

    A model that knows no language can't reject: then texts with a letter stay.
    """
    if not model["langs"]:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index("text")

    def run(batches):
        tables = {k: Table(keys) for k, (keys, _) in model["kinds"].items()}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for lo, hi in _slices(texts):
                pred, sure = score_texts(model, tables, texts[lo:hi])
                yield batch.slice(lo, hi - lo).filter(pa.array((sure >= least) & np.array([p != "und" for p in pred], bool)))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def op2_language_id(spark, sf_dir):
    """All ``documents``; learns from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
