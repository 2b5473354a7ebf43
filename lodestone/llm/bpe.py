"""Token ids of whole texts under the public word-BPE vocabulary, a column at a time.

The ids equal ``Tokenizer.encode(text, add_special_tokens=False).ids``. The
tokenizer joins nothing across ASCII white space, so the ids of each run
between it (a chunk) are found once per worker and kept in a bounded table.
New chunks of ASCII (without ``'`` and ``<``) and of the letters U+00C0 to U+00FF
are lower-cased, cut into runs of letters, single digits and runs of other
characters, and merged in numpy, all chunks step by step together; any other
chunk goes to the tokenizer itself.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from lodestone.llm.textscan import U, words

LETTER, DIGIT, OTHER, HARD = 1, 2, 3, 0
END = "</w>"


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Pairs:
    """Rank and result of a merge, by open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(4 * max(1, keys.size)))))
        size = 1 << self.bits
        self.key, self.rank, self.made = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.most = 1
        left, slot = np.arange(keys.size), self._slot(keys)
        while left.size:
            at = slot[left] & (size - 1)
            free = self.key[at] < 0
            take, where = np.unique(at[free], return_index=True)
            won = left[free][where]
            self.key[take], self.rank[take], self.made[take] = keys[won], ranks[won], made[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] += 1
            self.most += bool(left.size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a large number if none) and result of each key."""
        rank, made = np.full(keys.size, 1 << 30, np.int32), np.zeros(keys.size, np.int32)
        at, left = self._slot(keys), np.arange(keys.size)
        mask = self.key.size - 1
        for _ in range(self.most):
            got = self.key[at]
            hit = got == keys[left]
            if hit.any():
                rank[left[hit]], made[left[hit]] = self.rank[at[hit]], self.made[at[hit]]
            go = ~hit & (got >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) & mask
        return rank, made


class WordBPE:
    """Encodes columns of text; ``path`` names the vocabulary file."""

    def __init__(self, path: str, keep: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        from tokenizers import Tokenizer

        self.keep = keep
        self.slow = Tokenizer.from_file(path)
        model = json.loads(self.slow.to_str())["model"]
        vocab = model["vocab"]
        shown = _byte_letters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + END] for c in shown], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pairs = Pairs(keys, np.arange(keys.size, dtype=np.int32), made)
        kind = np.full(256, HARD, np.int8)
        kind[33:127] = OTHER
        kind[48:58] = DIGIT
        kind[65:91] = kind[97:123] = LETTER
        kind[[ord("'"), ord("<")]] = HARD
        kind[0xC3] = LETTER
        self.kind = kind
        self.reset()

    def reset(self) -> None:
        self.bits = 16
        self.hash, self.row = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int64)
        self.used = 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids, self.filled = np.zeros(1 << 16, np.uint16), 0

    def _merge(self, sym: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Merges each row of ``sym`` (n symbols, then -1) until no pair is in the table."""
        rows = np.arange(sym.shape[0])
        rank, made = np.full((sym.shape[0], sym.shape[1] - 1), 1 << 30, np.int32), np.zeros((sym.shape[0], sym.shape[1] - 1), np.int32)
        pair = sym[:, 1:] >= 0
        r, m = self.pairs.find((sym[:, :-1][pair].astype(np.int64) << 20) | sym[:, 1:][pair])
        rank[pair], made[pair] = r, m
        out, width = sym, sym.shape[1]
        live, s = rows, sym
        while live.size:
            at = rank.argmin(1)
            i = np.arange(live.size)
            go = rank[i, at] < (1 << 30)
            if not go.all():
                out[live[~go]] = s[~go]
                live, s, rank, made, at = live[go], s[go], rank[go], made[go], at[go]
                if not live.size:
                    break
                i = np.arange(live.size)
            s[i, at] = made[i, at]
            col = np.arange(width)
            shift = np.minimum(col[None, :] + (col[None, :] > at[:, None]), width - 1)
            s = np.take_along_axis(s, shift, 1)
            s[:, -1] = -1
            shift = np.minimum(col[None, :-1] + (col[None, :-1] > at[:, None]), width - 2)
            rank, made = np.take_along_axis(rank, shift, 1), np.take_along_axis(made, shift, 1)
            rank[:, -1] = 1 << 30
            for side in (at - 1, at):
                ok = (side >= 0) & (side < width - 1)
                j, c = i[ok], side[ok]
                b = s[j, c + 1]
                r, m = self.pairs.find((s[j, c].astype(np.int64) << 20) | np.maximum(b, 0))
                rank[j, c], made[j, c] = np.where(b >= 0, r, 1 << 30), m
        return out

    def _fresh(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new chunks one after another, and how many each has."""
        size = end - start
        offs = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(start - offs[:-1], size) + np.arange(offs[-1])
        b = buf[at]
        owner = np.repeat(np.arange(start.size), size)
        kind = self.kind[b]
        two = np.flatnonzero(b == 0xC3)
        ok2 = two[(two + 1 < b.size)]
        tail = b[ok2 + 1]
        good = (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7) & (owner[ok2] == owner[ok2 + 1])
        kind[ok2[good] + 1] = LETTER
        kind[np.setdiff1d(two, ok2[good])] = HARD
        hard = np.zeros(start.size, bool)
        hard[owner[kind == HARD]] = True
        hard |= size > 4000
        up = (b >= 65) & (b <= 90)
        lower = b + (up * 32).astype(np.uint8)
        tails = ok2[good] + 1
        big = tails[b[tails] <= 0x9E]
        lower[big] += 0x20
        soft = ~hard[owner]
        first = np.ones(b.size, bool)
        first[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        lower, kind, owner, first = lower[soft], kind[soft], owner[soft], first[soft]
        cut = np.flatnonzero(first)
        n = np.diff(np.append(cut, first.size))
        boss = owner[cut]
        ids = np.zeros(0, np.int32)
        count, pieces = np.zeros(start.size, np.int64), []
        lo = 0
        for width in (1, 4, 8, 12, 16, 24, 32, 64, 128, 4096):
            mine = np.flatnonzero((n > lo) & (n <= width))
            lo = width
            if not mine.size:
                continue
            if width > 128:
                for x in mine.tolist():
                    got = [t.id for t in self.slow.model.tokenize("".join(_byte_letters()[c] for c in lower[cut[x] : cut[x] + n[x]]))]
                    pieces.append((np.array([x]), np.array([len(got)]), np.array(got, np.int32)))
                continue
            for part in np.array_split(mine, max(1, mine.size * width // 400_000)):
                col = np.arange(width)
                inside = col[None, :] < n[part][:, None]
                src = np.minimum(cut[part][:, None] + col[None, :], lower.size - 1)
                sym = np.where(inside, self.inner[lower[src]], -1).astype(np.int32)
                sym[np.arange(part.size), n[part] - 1] = self.last[lower[cut[part] + n[part] - 1]]
                if width > 1:
                    sym = self._merge(sym, n[part])
                held = sym >= 0
                pieces.append((part, held.sum(1), sym[held]))
        if pieces:
            which, many, flat = (np.concatenate(x) for x in zip(*pieces, strict=True))
            per = np.zeros(cut.size, np.int64)
            per[which] = many
            to = np.concatenate([[0], np.cumsum(per)])
            dest = np.repeat(to[which] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(flat.size)
            ids = np.zeros(flat.size, np.int32)
            ids[dest] = flat
            count = np.bincount(boss, weights=per, minlength=start.size).astype(np.int64)
        if hard.any():
            odd = np.flatnonzero(hard)
            got = [x.ids for x in self.slow.encode_batch_fast([buf[start[x] : end[x]].tobytes().decode("utf-8", "replace") for x in odd.tolist()], add_special_tokens=False)]
            count[odd] = [len(x) for x in got]
            to = np.concatenate([[0], np.cumsum(count)])
            whole = np.zeros(to[-1], np.int32)
            easy = np.ones(to[-1], bool)
            for x, g in zip(odd.tolist(), got, strict=True):
                whole[to[x] : to[x + 1]] = g
                easy[to[x] : to[x + 1]] = False
            whole[easy] = ids
            ids = whole
        return ids, count

    def _rows(self, h: np.ndarray) -> np.ndarray:
        """The table row of each chunk hash, -1 if it is new."""
        mask = (1 << self.bits) - 1
        at = (h >> U(64 - self.bits)).astype(np.int64)
        out, left = np.full(h.size, -1, np.int64), None
        for _ in range(64):
            row = self.row[at]
            same = (self.hash[at] == (h if left is None else h[left])) & (row >= 0)
            if left is None:
                out[same] = row[same]
                left = np.arange(h.size)
            else:
                out[left[same]] = row[same]
            go = ~same & (row >= 0)
            if not go.any():
                break
            left, at = left[go], (at[go] + 1) & mask
        return out

    def _put(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask, left = (1 << self.bits) - 1, np.arange(h.size)
        at = (h >> U(64 - self.bits)).astype(np.int64)
        while left.size:
            spot = at[left]
            free = np.flatnonzero(self.row[spot] < 0)
            take, where = np.unique(spot[free], return_index=True)
            won = free[where]
            self.hash[take], self.row[take] = h[left[won]], rows[left[won]]
            go = np.ones(left.size, bool)
            go[won] = False
            left = left[go]
            at[left] = (at[left] + 1) & mask

    def _learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        ids, count = self._fresh(buf, start, end)
        if self.used + h.size > self.start.size:
            grow = max(2 * self.start.size, self.used + h.size)
            self.start, self.count = np.resize(self.start, grow), np.resize(self.count, grow)
        if self.filled + ids.size > self.ids.size:
            self.ids = np.resize(self.ids, max(2 * self.ids.size, self.filled + ids.size))
        rows = np.arange(self.used, self.used + h.size)
        self.start[rows], self.count[rows] = self.filled + np.cumsum(count) - count, count
        self.ids[self.filled : self.filled + ids.size] = ids
        self.used, self.filled = self.used + h.size, self.filled + ids.size
        if 2 * self.used > 1 << self.bits:
            old = self.row >= 0
            hashes, held = self.hash[old], self.row[old]
            while 2 * self.used > 1 << self.bits:
                self.bits += 2
            self.hash, self.row = np.zeros(1 << self.bits, U), np.full(1 << self.bits, -1, np.int64)
            self._put(hashes, held)
        self._put(h, rows)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows, how many each row has, and of each chunk its ids and whether it ends a sentence."""
        start, end, row, h = words(buf, offs)
        rows = offs.size - 1
        if not h.size:
            none = np.zeros(0, np.int64)
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64), none, np.zeros(0, bool)
        at = self._rows(h)
        new = np.flatnonzero(at < 0)
        if new.size:
            if self.used + new.size > self.keep:
                self.reset()
                new = np.arange(h.size)
            uniq, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            base = self.used
            self._learn(buf, start[new[first]], end[new[first]], uniq)
            at[new] = base + back
        n = self.count[at].astype(np.int64)
        total = np.cumsum(n)
        src = np.repeat(self.start[at] - (total - n), n) + np.arange(total[-1])
        tail = buf[end - 1]
        stop = (tail == 46) | (tail == 33) | (tail == 63)
        return self.ids[src], np.bincount(row, weights=n, minlength=rows).astype(np.int64), n, stop


@lru_cache(maxsize=1)
def word_bpe(path: str) -> WordBPE:
    """One encoder for each worker process."""
    return WordBPE(path)
