"""Diffs, composed histories and the log source against histories made here."""

import difflib
import random
import stat
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.operators import diffs, vcs
from lodestone.sources import vcs as source


def history(seed, revisions):
    """Versions of a file as lists of (line, revision that wrote it), the first from the empty file."""
    rnd = random.Random(seed)
    now, out = [], []
    for r in range(1, revisions + 1):
        now = list(now)
        for _ in range(rnd.randrange(1, 5)):
            at = rnd.randrange(len(now) + 1)
            if rnd.random() < 0.4 and now:
                del now[at : at + rnd.randrange(1, 4)]
            else:
                now[at:at] = [(rnd.choice(["-- dashes", "++ plus", "@@ -1 +1 @@", "\\ slash", "", " x", f"line {r}.{k}", f"y {rnd.random()}"]), r) for k in range(rnd.randrange(1, 5))]
        out.append(now)
    return out


def unified(a, b, name, r, context):
    """A diff whose kept lines are those of one origin, so that it says who wrote what."""
    lines = ["Index: " + name, "=" * 67, f"--- {name}\t(revision {r - 1})", f"+++ {name}\t(revision {r})"]
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        i1, i2, j1, j2 = group[0][1], group[-1][2], group[0][3], group[-1][4]
        span = lambda lo, hi: f"{lo + 1 if hi > lo else lo},{hi - lo}" if hi - lo != 1 else f"{lo + 1}"
        lines.append(f"@@ -{span(i1, i2)} +{span(j1, j2)} @@")
        for tag, a1, a2, b1, b2 in group:
            lines += [" " + t for t, _ in a[a1:a2]] if tag == "equal" else ["-" + t for t, _ in a[a1:a2]] + ["+" + t for t, _ in b[b1:b2]]
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def told(spark):
    """Diffs of three files over up to 13 revisions, and their last versions."""
    rows, last = [], {}
    for name, seed, n in (("a/x.pc", 1, 13), ("b/x.pc", 2, 8), ("one.pc", 3, 1)):
        versions = [[]] + history(seed, n)
        for r in range(1, n + 1):
            rows.append((r, unified(versions[r - 1], versions[r], name, r, seed % 3)))
        last[name] = versions[-1]
    return spark.createDataFrame(rows, "revision long, raw string").repartition(5), last


def test_blame_from_diffs(spark, told):
    """Blame rebuilt from diffs equals the client's blame text of the same history."""
    df, last = told
    got = sorted(tuple(r) for r in diffs.blame(diffs.diff_lines(df, "raw", "revision")).select("file", "line", "revision", "content").collect())
    text = spark.createDataFrame([(f, "".join(f"{r:>6}      user {t}\n" for t, r in ls)) for f, ls in last.items()], "file string, raw string")
    want = sorted((r["file"], r["line"], int(r["revision"])) for r in vcs.blame_lines(text, "raw", "file").collect())
    assert [g[:3] for g in got] == want
    assert got == sorted((f, i + 1, r, t) for f, ls in last.items() for i, (t, r) in enumerate(ls))


@pytest.mark.parametrize("span", [1024, 3])
def test_blame_of_texts(spark, told, span, monkeypatch):
    """Blame from texts, by spans of any length, equals that from lines; it parses each text once and shuffles maps alone."""
    monkeypatch.setattr(diffs, "SPAN", span)
    monkeypatch.setattr(diffs, "BATCH", 20)
    df, last = told
    df = df.unionByName(spark.createDataFrame([(None, "--- z\n+++ z\n@@ -0,0 +1 @@\n+a"), (3, None), (4, "@@ -0,0 +1 @@\n+of no file")], df.schema))
    got = diffs.blame_texts(df, "raw", "revision")
    assert sorted(tuple(r) for r in got.collect()) == sorted((f, i + 1, r, t) for f, ls in last.items() for i, (t, r) in enumerate(ls))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_lines_of_diffs(spark, told):
    """Old and new numbers point to the line of each version."""
    df, _ = told
    rows = diffs.diff_lines(df, "raw", "revision").collect()
    for name, seed, n in (("a/x.pc", 1, 13), ("b/x.pc", 2, 8)):
        versions = [[]] + history(seed, n)
        mine = [r for r in rows if r["file"] == name]
        assert {r["revision"] for r in mine} <= set(range(1, n + 1))
        for r in mine:
            old, new = versions[r["revision"] - 1], versions[r["revision"]]
            assert (r["old_line"] is None) == (r["kind"] == "insert") and (r["new_line"] is None) == (r["kind"] == "delete")
            assert r["old_line"] is None or old[r["old_line"] - 1][0] == r["content"]
            assert r["new_line"] is None or new[r["new_line"] - 1][0] == r["content"]


def test_odd_diffs(spark):
    texts = [
        None, "", "no diff at all",
        "Index: p.bin\n===\nCannot display: file marked as a binary type.\n",
        "Index: a.c\n===\n--- a.c\t(revision 1)\n+++ a.c\t(revision 2)\n@@ -1,2 +1,2 @@\n--- a.c\n+++ b.c\n keep\n\\ No newline at end of file\n\nProperty changes on: a.c\n___\nAdded: x\n## -0,0 +1 ##\n+value\n",
        "--- old.c\n+++ old.c\n@@ -1 +0,0 @@\r\n-gone\r\n--- next.c\n+++ next.c\n@@ -0,0 +1,9 @@\n+cut",
    ]
    got = diffs.diff_lines(spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "key long, raw string, file string").drop("file"), "raw", "key").collect()
    assert [(r["key"], r["file"], r["hunk"], r["kind"], r["old_line"], r["new_line"], r["content"], r["ends_file"]) for r in sorted(got, key=lambda r: (r["key"], r["pos"]))] == [
        (4, "a.c", 1, "delete", 1, None, "-- a.c", False), (4, "a.c", 1, "insert", None, 1, "++ b.c", False), (4, "a.c", 1, "context", 2, 2, "keep", True),
        (5, "old.c", 1, "delete", 1, None, "gone", False), (5, "next.c", 1, "insert", None, 1, "cut", False),
    ]
    assert diffs.blame(diffs.diff_lines(spark.createDataFrame([], "revision long, raw string"), "raw", "revision")).collect() == []


def test_composing_is_associative():
    versions = [[]] + history(9, 12)
    maps = []
    for r in range(1, 13):
        rows = [(x[1], x[2], x[3], x[4], x[5]) for x in diffs.parsed(unified(versions[r - 1], versions[r], "f", r, 0))]
        maps.append(diffs.runs_of(rows, r))
    line_by_line = lambda runs: [(o + k if o is not None else None, r, n + k if n is not None else None) for length, o, r, n in runs for k in range(min(length, 500))]
    for i, j, k in ((0, 1, 2), (3, 6, 9), (8, 9, 10)):
        a, b, c = maps[i : i + 1][0], maps[j], maps[k]
        assert line_by_line(diffs.compose(diffs.compose(a, b), c))[:400] == line_by_line(diffs.compose(a, diffs.compose(b, c)))[:400]


STUB = """#!{python}
import re, sys
from datetime import datetime, timedelta, timezone
args = sys.argv[1:]
open({seen!r}, "a").write(" ".join(args) + "\\n")
when = lambda r: (datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=r)).strftime("%Y-%m-%dT%H:%M:%S.000000Z")
def number(x):
    if x == "HEAD": return 40
    if x.startswith("{{"):
        return sum(when(r) <= x.strip("{{}}") for r in range(1, 41)) or 1
    return int(x)
lo, hi = map(number, re.split(r":(?![^{{]*}})", args[args.index("-r") + 1]))
revisions = list(range(lo, hi + 1)) if lo <= hi else list(range(lo, hi - 1, -1))
if "--limit" in args: revisions = revisions[: int(args[args.index("--limit") + 1])]
if "--search" in args: revisions = [r for r in revisions if args[args.index("--search") + 1] == "u%d" % (r % 3)]
print("<log>")
for r in revisions:
    paths = "" if "--quiet" in args or r == 7 else "<paths><path action='M'>/src/f%d.pc</path><path action='A'>/doc/g%d.txt</path></paths>" % (r, r)
    print("<logentry revision='%d'><author>u%d</author><date>%s</date>%s<msg>fix &lt;%d&gt;</msg></logentry>" % (r, r % 3, when(r), paths, r))
print("</log>")
"""


@pytest.fixture
def stub(spark, tmp_path):
    program, seen = tmp_path / "client", tmp_path / "seen.txt"
    program.write_text(STUB.format(python=sys.executable, seen=str(seen)))
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source.register(spark)
    read = lambda **more: spark.read.format("vcs_log").options(root=str(tmp_path), program=str(program), step=10, **more).load()

    def asked():
        """The ranges that tasks asked for since the last look."""
        lines = seen.read_text().splitlines() if seen.exists() else []
        seen.write_text("")
        return sorted({line.split("-r ")[1].split()[0] for line in lines if "--verbose" in line}), lines

    return read, asked


def test_log_source(spark, stub):
    read, asked = stub
    rows = read().collect()
    assert len(rows) == 39 * 2 + 1 and {r["revision"] for r in rows} == set(range(1, 41))
    assert asked()[0] == ["11:20", "1:10", "21:30", "31:40"]
    one = next(r for r in rows if r["revision"] == 7)
    assert (one["author"], one["message"], one["action"], one["path"]) == ("u1", "fix <7>", None, None)

    assert {r["revision"] for r in read().where("revision >= 12 AND revision < 18").collect()} == set(range(12, 18))
    assert asked()[0] == ["12:17"]
    assert read().where("revision = 99").collect() == [] and asked()[0] in ([], ["99:99"])
    assert {r["revision"] for r in read().where("author = 'u2' AND revision <= 10").collect()} == {2, 5, 8}
    ranges, lines = asked()
    assert ranges == ["1:10"] and any("--search u2" in line for line in lines)
    since = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(days=33)
    assert {r["revision"] for r in read().where(F.col("date") > F.lit(since)).collect()} == set(range(34, 41))
    assert asked()[0] in (["33:40"], ["34:40"])
    assert {r["revision"] for r in read().where(F.col("date") <= F.lit(since)).where("revision > 25").collect()} == set(range(26, 34))
    assert asked()[0] == ["26:34"]
    assert [r["revision"] for r in read(last=20).where("path = '/src/f15.pc'").collect()] == [15]
    assert all(line.endswith("/src/f15.pc") for line in asked()[1] if "--verbose" in line)
    assert read(first=3, last=2).collect() == [] and read().where("path LIKE '/doc/%'").count() == 39


def test_log_source_by_filters_of_spark_alone(spark, stub):
    """Without pushdown the rows are the same."""
    read, asked = stub
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    source.register(spark)
    assert {r["revision"] for r in read().where("revision >= 12 AND author = 'u0'").collect()} == {r for r in range(12, 41) if r % 3 == 0}
    assert len(asked()[0]) == 4


def test_client_against_a_stub(tmp_path):
    """What the client asks for."""
    program, seen = tmp_path / "client", tmp_path / "seen.txt"
    program.write_text(f"#!{sys.executable}\nimport sys\nopen({str(seen)!r}, 'a').write(' '.join(sys.argv[1:]) + '\\n')\nif 'fail.pc' in sys.argv[-1] and sys.argv[-1].startswith('/'): sys.exit('no such file')\nprint('out')\n")
    program.chmod(program.stat().st_mode | stat.S_IXUSR)
    c = vcs.Client(str(tmp_path), str(program))
    assert c.cat("a.pc", "7") == "out\n" and c.cat("fail.pc") == "out\n"
    c.log("a.pc", 5, "me", "2024-01-01")
    c.diff("a.pc", "12")
    c.blame("a.pc")
    c.status()
    at = tmp_path.resolve()
    assert seen.read_text().splitlines() == [
        f"cat -r 7 {at}/a.pc", f"cat {at}/fail.pc", "cat fail.pc", f"log --verbose --limit 5 --search me -r {{2024-01-01}}:HEAD {at}/a.pc", f"diff -c 12 {at}/a.pc", f"blame {at}/a.pc", f"status {at}",
    ]
    with pytest.raises(RuntimeError):
        c.run("blame", "/fail.pc")
    with pytest.raises(ValueError):
        c.blame("../other.pc")
