"""Packs token ids of documents into sequences of bounded length, in order, with little padding.

Each task turns its documents, in input order, into one stream of ids and cuts
that into windows of at most ``width`` ids. A dynamic program over possible cuts
(document ends, sentence ends; word ends and every 32nd id only inside longer
stretches) minimises padding plus a penalty for each cut inside a document. The
best predecessor of a cut is the least of ``cost + position`` over the last
``width`` ids, kept in a monotone queue, so the program is linear in the cuts.
It runs on about ``block`` ids at a time and carries the open window over.
A sequence whose length is a power of two is not padded, so a task's last
window is cut into such lengths where that costs less than padding it.

Defined results: a null or empty text is the one id that ends each document;
repeated rows are packed each; a null doc_id stays null; no rows give no rows;
a text longer than a window spans sequences. Sequence ids are unique over all
tasks (task number in the high bits). Input that is reread in the same order,
as tables are, gives the same rows when a lost task runs again.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import word_bpe
from lodestone.llm.textscan import distinct, pieces, text_bytes

WIDTH, END_ID = 2048, 1
#: Penalties of a cut, in ids of padding: at a sentence's end, a word's, anywhere.
SENTENCE, WORD, INSIDE = 2, 6, 16
#: Stretches without a cut that are longer than this get word ends as cuts.
STRETCH = 24
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _union(*parts: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    return distinct(np.concatenate(parts))


def stream(enc, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows with END_ID after each; ids per row; possible cuts and their penalties."""
    flat, n, per, stop = enc.encode(buf, offs)
    rows = n.size
    many = n + 1
    ends = np.cumsum(many)
    ids = np.full(int(ends[-1]) if rows else 0, END_ID, np.uint32)
    ids[np.arange(flat.size) + np.repeat(np.arange(rows), n)] = flat
    word = np.cumsum(per)
    word = word + np.searchsorted(np.cumsum(n), word, "left")
    strong = _union(ends, word[stop])
    edges = np.concatenate([[0], strong])
    long = np.diff(edges) > STRETCH
    weak = word[long[np.minimum(np.searchsorted(strong, word, "left"), long.size - 1)]] if long.size else word[:0]
    cuts = _union(strong, weak)
    gaps = np.diff(np.concatenate([[0], cuts]))
    fill = [np.arange(c - g + 32, c, 32) for c, g in zip(cuts[gaps > STRETCH].tolist(), gaps[gaps > STRETCH].tolist(), strict=True)]
    every = _union(cuts, np.concatenate(fill)) if fill else cuts
    every = every[every > 0]
    cost = np.full(every.size, INSIDE, np.int64)
    cost[np.isin(every, word)] = WORD
    cost[np.isin(every, word[stop])] = SENTENCE
    cost[np.isin(every, ends)] = 0
    return ids, many, every, cost


def best_cuts(at: list[int], cost: list[int], width: int, last: bool) -> list[int]:
    """Ends of windows over cuts at ascending positions (the first window begins at 0).

    Minimises the sum of width - length + cost over the windows. If not ``last``,
    the open window after the final cut returned costs nothing.
    """
    pos = [0, *at]
    n = len(at)
    # g[i] = best cost up to cut i, plus its position: g[i] = min g[j] + cost + width over cuts j within the width.
    g, came = [0] * (n + 1), [0] * (n + 1)
    who, key = [0] * (n + 1), [0] * (n + 1)  # the queue: cuts with ascending g, from head on
    head, tail, i = 0, 0, 0
    for p, c in zip(at, cost, strict=True):
        k = g[i]
        while tail > head and key[tail - 1] >= k:
            tail -= 1
        who[tail], key[tail] = i, k
        tail += 1
        low = p - width
        while pos[who[head]] < low:
            head += 1
        i += 1
        came[i], g[i] = who[head], key[head] + c + width
    if not last and n:
        i = min((j for j in range(n, -1, -1) if pos[n] - pos[j] <= width), key=lambda j: g[j] - pos[j])
    out = []
    while i:
        out.append(pos[i])
        i = came[i]
    return out[::-1]


def tail_lengths(n: int, width: int) -> list[int]:
    """Lengths of the sequences for a last window of ``n`` ids."""
    parts = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return parts if INSIDE * (len(parts) - 1) < width - n else [n]


class Packer:
    """The state of one task's stream."""

    def __init__(self, base: int, width: int, block: int):
        self.base, self.width, self.block = base, width, block
        self.ids, self.at, self.cost = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs: deque[list] = deque()  # doc_id, all its ids, ids of it already packed
        self.made = 0

    def add(self, doc_ids: list, ids: np.ndarray, many: np.ndarray, at: np.ndarray, cost: np.ndarray) -> list[tuple]:
        self.at, self.cost = np.concatenate([self.at, at + self.ids.size]), np.concatenate([self.cost, cost])
        self.ids = np.concatenate([self.ids, ids])
        self.docs.extend([d, m, 0] for d, m in zip(doc_ids, many.tolist(), strict=True))
        return self.flush(False) if self.ids.size >= self.block else []

    def flush(self, last: bool) -> list[tuple]:
        cuts = best_cuts(self.at.tolist(), self.cost.tolist(), self.width, last)
        if last and cuts:
            begin = cuts[-2] if len(cuts) > 1 else 0
            cuts[-1:] = (begin + np.cumsum(tail_lengths(cuts[-1] - begin, self.width))).tolist()
        out, lo = [], 0
        for hi in cuts:
            seq, offset = self.base + self.made, 0
            self.made += 1
            while lo < hi:
                doc, total, begun = self.docs[0]
                n = min(hi - lo, total - begun)
                out.append((doc, begun, n, zlib.crc32(self.ids[lo : lo + n].astype("<u4").tobytes()), total, seq, offset))
                lo, offset = lo + n, offset + n
                if begun + n == total:
                    self.docs.popleft()
                else:
                    self.docs[0][2] = begun + n
        self.ids, keep = self.ids[lo:], self.at > lo
        self.at, self.cost = self.at[keep] - lo, self.cost[keep]
        return out


def pack(docs: DataFrame, vocabulary: str, width: int = WIDTH, block: int = 1 << 17) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text); ``vocabulary`` is a file's path."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        enc = word_bpe(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, width, block)
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for lo, hi in pieces(offs):
                part = offs[lo : hi + 1]
                rows = packer.add(batch.column(0).slice(lo, hi - lo).to_pylist(), *stream(enc, buf[part[0] : part[-1]], part - part[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        if rows := packer.flush(True):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_packing(spark, sf_dir):
    """All ``documents`` in sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
