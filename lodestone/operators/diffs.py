"""Unified diffs as rows, and histories composed from them.

``diff_lines`` reads diff text by a small state machine: a hunk ends when the line counts of its head are
used up, so a removed line that begins with "-- " is no file head. ``line_maps`` turns a
revision's hunks of a file into runs: lines taken over from the revision before, and lines that are new. Maps of
neighbouring revisions compose to one map, in any grouping, so ``composed`` goes by spans of revisions,
many tasks to a file, then by spans of spans, however long a history is; ``blame`` reads off who wrote each line. Maps
carry the text of the lines that are new, so lines needn't be looked up again.

Defined results: null and blank texts give no rows; property changes and binary files have no lines; a text cut off in a
hunk gives the lines that are there; line ends of CR LF lose the CR. Maps need each (file, revision) once, revisions as rising numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.store import settled

HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
FILE = re.compile(r"(?:---|\+\+\+) (.*?)(?:\t.*)?$")
KINDS = {" ": "context", "-": "delete", "+": "insert"}
ROW = "file string, hunk int, pos int, kind string, old_line int, new_line int, content string, ends_file boolean"
#: Length of the run of all lines behind the last hunk.
REST = 1 << 40
MAP = "file string, revision long, part long, runs array<struct<length:bigint,old:bigint,revision:bigint,line:bigint>>, texts array<string>"
#: Revisions (then spans) that one task composes, and rows of a batch.
SPAN, BATCH = 1024, 50_000


def parsed(text: str) -> Iterator[list]:
    """Rows of one diff text: file, hunk within the file, position in the text, kind, line numbers, content, and whether no line end follows."""
    file, hunk, left, held = None, 0, [0, 0], None
    for pos, line in enumerate(text.split("\n")):
        line = line.removesuffix("\r")
        if held and line.startswith("\\"):
            held[7] = True
            continue
        if max(left) > 0 and (line[:1] or " ") in KINDS:
            if held:
                yield held
            sign = line[:1] or " "
            held = [file, hunk, pos, KINDS[sign], None if sign == "+" else old, None if sign == "-" else new, line[1:], False]
            old, new = old + (sign != "+"), new + (sign != "-")
            left = [left[0] - (sign != "+"), left[1] - (sign != "-")]
            continue
        left = [0, 0]
        if found := HEAD.match(line):
            hunk += 1
            old, some, new, more = (int(x) if x is not None else 1 for x in found.groups())
            left = [some, more]
        elif line.startswith("Index: "):
            file, hunk = line[7:].strip(), 0
        elif (found := FILE.match(line)) and (line[0] == "-" or file in (None, "/dev/null")):
            if found[1] != file:
                file, hunk = found[1], 0
    if held:
        yield held


def diff_lines(df: DataFrame, raw: str, key: str | None = None) -> DataFrame:
    """key, file, hunk, pos, kind (context, delete or insert), old_line, new_line, content, ends_file of each line of a diff."""
    keys = [key] if key else []
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in ROW.split(", ")]

    def run(batches):
        for batch in batches:
            rows, at = [], []
            for i, text in enumerate(batch.column(0)):
                for row in parsed(text.as_py() or ""):
                    rows.append(row)
                    at.append(i)
                if len(rows) > 50_000:
                    yield made(batch, rows, at)
                    rows, at = [], []
            if rows:
                yield made(batch, rows, at)

    def made(batch, rows, at):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(1).take(pa.array(at)) for _ in keys), *columns], [*keys, *names])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), ROW])
    return df.select(F.col(raw).cast("string"), *keys).mapInArrow(run, schema)


def runs_of(rows: list[tuple[int, int, str, int | None, int | None]], revision: int) -> list[tuple]:
    """Runs (length, old, revision, line) of a revision's new lines, from its sorted (hunk, pos, kind, old_line, new_line)."""
    out, old, new = [], 1, 1

    def put(length: int, at: int | None, line: int | None) -> None:
        if out and at is not None and out[-1][1] is not None and out[-1][1] + out[-1][0] == at:
            out[-1] = (out[-1][0] + length, out[-1][1], None, None)
        elif out and at is None and out[-1][1] is None:
            out[-1] = (out[-1][0] + length, None, revision, out[-1][3])
        elif length:
            out.append((length, at, None if at is not None else revision, line))

    for _, _, kind, old_line, new_line in rows:
        if kind == "delete":
            put(old_line - old, old, None)  # what lies between this line and the one before is as it was
            new, old = new + old_line - old, old_line + 1
        elif kind == "insert":
            put(new_line - new, old, None)
            old, new = old + new_line - new, new_line + 1
            put(1, None, new_line)
        else:
            put(old_line - old + 1, old, None)
            old, new = old_line + 1, new_line + 1
    put(REST, old, None)
    return out


def compose(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The runs of ``second`` over ``first``: lines that it takes over are looked up there."""
    starts, at = [], 1
    for r in first:
        starts.append(at)
        at += r[0]
    out, j = [], 0
    for length, old, revision, line in second:
        if not old:
            out.append((length, old, revision, line))
            continue
        j = j if j < len(starts) and starts[j] <= old else 0
        while j + 1 < len(starts) and starts[j + 1] <= old:
            j += 1
        i, begin, left = j, old, length
        while left > 0 and i < len(first):
            n, o, r, k = first[i]
            skip = begin - starts[i]
            take = min(left, n - skip)
            if take > 0:
                out.append((take, o + skip if o else o, r, k + skip if k else k))
            begin, left, i = begin + take, left - take, i + 1
    return out


def map_of(rows: list, revision: int) -> tuple[list[tuple], list[str]]:
    """The runs of a revision of a file, 0 for what they lack, and the lines it wrote, from its (hunk, pos, kind, old_line, new_line, content)."""
    if any(a[:2] > b[:2] for a, b in zip(rows, rows[1:])):
        rows = sorted(rows, key=lambda r: r[:2])
    return [(n, o or 0, r or 0, k or 0) for n, o, r, k in runs_of([r[:5] for r in rows], revision)], [r[5] for r in rows if r[2] == "insert"]


def new_lines(runs: list[tuple]) -> list[tuple[int, int]]:
    """(revision, line) of each line in ``runs`` that isn't taken over, in their order."""
    return [(revision, k) for length, old, revision, line in runs if not old for k in range(line, line + length)]


def packed(maps: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of MAP from (file, revision, part, runs, texts)."""
    files, revisions, parts, runs, texts = zip(*maps, strict=True)
    ends = lambda lists: pa.array(np.append(0, np.cumsum(list(map(len, lists)))), pa.int32())
    flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 4).T
    held = pa.StructArray.from_arrays([pa.array(c) for c in flat], ["length", "old", "revision", "line"])
    lines = pa.array([t for ts in texts for t in ts], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(files), pa.array(revisions, pa.int64()), pa.array(parts, pa.int64()), pa.ListArray.from_arrays(ends(runs), held), pa.ListArray.from_arrays(ends(texts), lines)], schema=schema)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The (file, revision, part, runs, texts) of a batch of MAP."""
    plain = list(zip(*(c.to_numpy().tolist() for c in batch.column(3).flatten().flatten()), strict=True))
    lines = batch.column(4).flatten().to_pylist()
    r = t = 0
    for file, rev, part, r_to, t_to in zip(*(batch.column(i).to_pylist() for i in range(3)), *(np.cumsum(pc.list_value_length(batch.column(i)).to_numpy()).tolist() for i in (3, 4)), strict=True):
        yield file, rev, part, plain[r:r_to], lines[t:t_to]
        r, t = r_to, t_to


def in_batches(maps: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of MAP, closed once they have BATCH maps or lines."""
    schema = pa.schema([("file", pa.string()), ("revision", pa.int64()), ("part", pa.int64()), ("runs", pa.list_(pa.struct([(f, pa.int64()) for f in ("length", "old", "revision", "line")]))), ("texts", pa.list_(pa.string()))])
    held, size = [], 0
    for m in maps:
        held.append(m)
        size += 1 + len(m[3]) + len(m[4])
        if size >= BATCH:
            yield packed(held, schema)
            held, size = [], 0
    if held:
        yield packed(held, schema)


def line_maps(lines: DataFrame, file: str = "file", revision: str = "revision") -> DataFrame:
    """file, revision, part (0), runs, texts (of the lines that are new) of each revision of each file, from ``diff_lines`` with a revision."""
    whole = lines.select(F.col(file).alias("file"), F.col(revision).cast("long").alias("revision"), F.struct("hunk", "pos", "kind", "old_line", "new_line", "content").alias("row")).dropna(subset=["file", "revision"])

    def run(batches):
        for batch in batches:
            yield from in_batches((f, r, 0, *map_of([tuple(x.values()) for x in rows.as_py()], r)) for f, r, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))

    return whole.groupBy("file", "revision").agg(F.collect_list("row").alias("rows")).mapInArrow(run, MAP)


def text_maps(df: DataFrame, raw: str, revision: str) -> DataFrame:
    """``line_maps`` of ``diff_lines``, where all lines of a (file, revision) are in one text: nothing is shuffled."""

    def maps(batch):
        for text, r in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            files: dict[str, list] = {}
            for row in parsed(text.as_py() or ""):
                files.setdefault(row[0], []).append(row[1:7])
            for f, rows in files.items():
                if f is not None:
                    yield f, r, 0, *map_of(rows, r)

    def run(batches):
        for batch in batches:
            yield from in_batches(maps(batch))

    return df.select(F.col(raw).cast("string").alias("raw"), F.col(revision).cast("long").alias("revision")).dropna().mapInArrow(run, MAP)


def joined(a: tuple, b: tuple) -> tuple:
    """Two neighbouring maps as one, with the lines that are left."""
    runs = compose(a[3], b[3])
    lines = dict(zip(new_lines(a[3]) + new_lines(b[3]), a[4] + b[4], strict=True))
    return *b[:3], runs, [lines[at] for at in new_lines(runs)]


def folded(maps: Iterator[tuple]) -> Iterator[tuple]:
    """One map for the neighbours of one (file, part): pairs are joined, then pairs of pairs, so a long run of maps costs each a few steps."""
    stack: list[tuple[int, tuple]] = []

    def whole() -> tuple:
        one = stack.pop()[1]
        while stack:
            one = joined(stack.pop()[1], one)
        return one

    for m in maps:
        if stack and (stack[-1][1][0], stack[-1][1][2]) != (m[0], m[2]):
            yield whole()
        level = 0
        while stack and stack[-1][0] == level:
            m, level = joined(stack.pop()[1], m), level + 1
        stack.append((level, m))
    if stack:
        yield whole()


def composed(maps: DataFrame) -> DataFrame:
    """file, revision (the last), runs, texts: all maps of a file as one. A task composes those of a file within SPAN revisions, the next round the results of SPAN such."""

    def run(batches):
        yield from in_batches(folded(m for batch in batches for m in unpacked(batch)))

    part = "revision"
    while True:
        parts = maps.withColumn("part", F.expr(f"{part} div {SPAN}"))
        maps, part = settled(parts.repartition("file", "part").sortWithinPartitions("file", "revision").mapInArrow(run, MAP)), "part"
        low, high = maps.agg(F.min("part"), F.max("part")).first()
        if low == high:
            return maps.select("file", "revision", "runs", "texts")


def written(maps: DataFrame) -> DataFrame:
    """file, line, revision, content of the lines that the revisions of ``composed`` maps wrote."""

    def run(batches):
        for batch in batches:
            length, old, revision, line = (c.to_numpy() for c in batch.column(1).flatten().flatten())
            runs = pc.list_value_length(batch.column(1)).to_numpy()
            of = np.repeat(np.arange(len(runs)), runs)
            ends = np.cumsum(length)
            before = ends - length
            before -= before[np.cumsum(runs) - runs][of]  # within the file
            own = np.flatnonzero(old == 0)
            n = length[own]
            at = np.repeat(own, n)
            k = np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[at])), pa.array((before[at] + k + 1).astype(np.int32)), pa.array(revision[at]), batch.column(2).flatten()], ["file", "line", "revision", "content"])

    return maps.select("file", "runs", "texts").mapInArrow(run, "file string, line int, revision long, content string")


def blame(lines: DataFrame, file: str = "file", revision: str = "revision") -> DataFrame:
    """file, line, revision, content of each line of the newest version that some revision of ``lines`` wrote.

    For a history from the empty file on these are all its lines.
    """
    return written(composed(line_maps(lines, file, revision)))


def blame_texts(df: DataFrame, raw: str, revision: str) -> DataFrame:
    """``blame`` of ``diff_lines``, where all lines of a (file, revision) are in one text."""
    return written(composed(text_maps(df, raw, revision)))
