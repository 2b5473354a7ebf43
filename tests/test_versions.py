"""Versioned catalogs: commits, deletes, crashes, bucketed lookups, the stream."""

from pathlib import Path

import pytest

from lodestone.operators import parse
from lodestone.plans.catalog import CodeCatalog
from lodestone.plans.store import Conflict, Manifests
from lodestone.plans.versions import VersionedCatalog
from lodestone.sources import files as sources
from lodestone.streaming.incremental import index_stream, newest_functions

FILES = "ord array<string>, file_path string, file string, ext string, text string"
FN = "int {0}(int a) {{ EXEC SQL SELECT X INTO :v FROM {1} WHERE K = 1; {2} }}"


def fn(name, table="TB_A", call=""):
    return FN.format(name, table, call)


def frame(spark, files):
    return spark.createDataFrame([(p.split("/"), p, p.split("/")[-1], p.rsplit(".", 1)[-1], t) for p, t in files.items()], FILES)


def gone(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "file_path string")


def rows(df):
    return sorted(str(r.asDict(True)) for r in df.select(*sorted(df.columns)).collect())


def same(spark, cat, live, version=None):
    """All relations equal those of parsing the live files anew."""
    want = parse.relations(frame(spark, live))
    got = cat.relations(version)
    assert sorted(got) == sorted(want)
    for name in want:
        assert rows(got[name]) == rows(want[name]), name
    assert {(r["file_path"], r["text"]) for r in cat.files(version).collect()} == set(live.items())


ONE = {
    "a/x.pc": fn("AA_ONE", "TB_A", "BB_TWO(a);"), "b/x.pc": fn("BB_TWO", "TB_B", "CC_END(a);"), "b/same.pc": fn("CC_END"), "z/other.pc": fn("CC_END", "TB_Z", "AA_ONE(a);"),
    "a/s.h": "typedef struct {\n    long n;\n} s_t;\n", "t.sql": "CREATE TABLE TB_A (\n    K NUMBER(5) NOT NULL\n);\n",
}


def test_commits(spark, tmp_path):
    """Changes, like-named files, deletes and what reappears, against parsing anew; old versions stay readable."""
    cat = VersionedCatalog(spark, str(tmp_path / "c"))
    assert cat.versions() == [] and cat.commit(frame(spark, ONE)) == 1
    same(spark, cat, ONE)
    two = {**ONE, "a/x.pc": fn("AA_ONE", "TB_NEW"), "n.pc": fn("DD_NEW")}
    assert cat.commit(frame(spark, {k: two[k] for k in ("a/x.pc", "n.pc")})) == 2
    same(spark, cat, two)
    three = {k: v for k, v in two.items() if k not in ("z/other.pc", "a/s.h")}
    assert cat.commit(frame(spark, {}), gone(spark, "z/other.pc", "a/s.h", "never.pc", None)) == 3
    same(spark, cat, three)
    assert cat.relation("functions").where("name = 'CC_END'").first()["file_path"] == "same.pc", "the other definition is there again"
    four = {**three, "a/s.h": "typedef struct {\n    double d;\n} s_t;\n"}
    cat.commit(frame(spark, {"a/s.h": four["a/s.h"]}), gone(spark, "a/s.h"))
    same(spark, cat, four)
    same(spark, cat, ONE, 1)
    same(spark, cat, two, 2)
    for name, key in (("functions", "BB_TWO"), ("functions", "none"), ("function_calls", "BB_TWO"), ("sql_usage", "AA_ONE"), ("structs", "s_t"), ("tables_ddl", "TB_A")):
        col = {"function_calls": "caller", "sql_usage": "function_name"}.get(name, "name")
        assert rows(cat.relation(name, key=key)) == rows(cat.relation(name).where(f"{col} = '{key}'"))
    assert cat.compact() == 5
    same(spark, cat, four)
    assert all(len(f) == 1 for f in cat.manifest()["folders"].values())
    cat.vacuum()
    assert cat.versions() == [5] and len(list((tmp_path / "c" / "functions").iterdir())) == 1
    same(spark, cat, four)
    five = {k: v for k, v in four.items() if k != "n.pc"}
    cat.commit(frame(spark, {}), gone(spark, "n.pc"))
    same(spark, cat, five)
    with pytest.raises(KeyError):
        cat.files(2)
    with pytest.raises(ValueError):
        cat.commit(spark.createDataFrame([(["x"], None, "x", "pc", "")], FILES))


@pytest.mark.parametrize("after", [0, 3, 6])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, after):
    """Whatever has been written when the writer dies."""
    small = {k: ONE[k] for k in ("a/x.pc", "t.sql")}
    cat = VersionedCatalog(spark, str(tmp_path / "c"))
    cat.commit(frame(spark, small))
    want = {name: rows(df) for name, df in cat.relations().items()}
    write, done = VersionedCatalog._write, []

    def dies(self, name, df, version):
        if len(done) == after:
            raise OSError("killed")
        done.append(name)
        return write(self, name, df, version)

    with monkeypatch.context() as m:
        m.setattr(VersionedCatalog, "_write", dies)
        if after == 0:
            m.setattr(Manifests, "publish", lambda *_: pytest.fail("published"))
        with pytest.raises(OSError):
            cat.commit(frame(spark, {"a/x.pc": fn("AA_OTHER")}), gone(spark, "t.sql"))
    assert cat.versions() == [1]
    assert {name: rows(df) for name, df in cat.relations().items()} == want
    if after == 3:
        assert cat.commit(frame(spark, {"a/x.pc": fn("AA_OTHER")}), gone(spark, "t.sql")) == 2
        same(spark, cat, {"a/x.pc": fn("AA_OTHER")})
        cat.vacuum()
        same(spark, cat, {"a/x.pc": fn("AA_OTHER")})


def test_two_writers(spark, tmp_path):
    a = Manifests(spark, str(tmp_path / "c"))
    a.publish({"version": 1, "by": "a"})
    with pytest.raises(Conflict):
        Manifests(spark, str(tmp_path / "c")).publish({"version": 1, "by": "b"})
    assert a.read() == {"version": 1, "by": "a"} and a.numbers() == [1]
    assert not [f for f in (tmp_path / "c" / "manifests").iterdir() if f.name.startswith("_")]


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    cat = VersionedCatalog(spark, str(tmp_path / "c"))
    cat.commit(frame(spark, {f"f{i}.pc": fn(f"AA_F{i}") for i in range(40)}))
    want = rows(cat.relation("functions", key="AA_F7"))
    [holds] = {r["bucket"] for r in cat._stored("functions", cat.manifest()).where("name = 'AA_F7'").select("bucket").collect()}
    for f in Path(tmp_path, "c", "functions").rglob("*.parquet"):
        if f"bucket={holds}" not in str(f):
            f.write_bytes(b"broken")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    assert len(want) == 1 and rows(cat.relation("functions", key="AA_F7")) == want


def test_snapshots_of_a_catalog(spark, tmp_path, monkeypatch):
    """Saving is all or nothing, and versions of a catalog answer queries."""
    root = tmp_path / "src"
    (root / "a").mkdir(parents=True)
    (root / "b").mkdir()
    for p in ("a/x.pc", "b/x.pc"):
        (root / p).write_text(ONE[p])
    cat = CodeCatalog.index(spark, str(root))
    at = str(tmp_path / "saved")
    assert cat.save(at).counts().where("relation = 'functions'").first()["n"] == 2
    (root / "b/x.pc").unlink()
    later = CodeCatalog.index(spark, str(root))
    with monkeypatch.context() as m:
        m.setattr(sources.Manifests, "publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            later.save(at)
    assert CodeCatalog.load(spark, at).counts().where("relation = 'functions'").first()["n"] == 2
    for _ in range(3):
        assert later.save(at).counts().where("relation = 'functions'").first()["n"] == 1
    assert Manifests(spark, at).numbers() == [3, 4]
    stored = VersionedCatalog(spark, str(tmp_path / "v"))
    stored.commit(frame(spark, {p: ONE[p] for p in ("a/x.pc", "b/x.pc")}))
    stored.commit(frame(spark, {}), gone(spark, "b/x.pc"))
    names = lambda v: {r["name"] for r in CodeCatalog.versioned(spark, str(tmp_path / "v"), v).list_services().collect()}
    assert names(1) == {"AA_ONE", "BB_TWO"} and names(None) == {"AA_ONE"}
    with pytest.raises(FileNotFoundError):
        CodeCatalog.load(spark, str(tmp_path / "nothing"))


def test_stream(spark, tmp_path):
    """Like-named files all stay, deleted files vanish, a batch that is run again is committed once."""
    schema = f"{FILES}, version long"
    batches = [
        [("a/x.pc", fn("AA_ONE"), 1), ("b/x.pc", fn("BB_TWO"), 1), ("b/x.pc", fn("BB_OLD"), 0)],
        [("b/x.pc", fn("BB_NEW"), 2), ("c.pc", fn("CC_THREE"), 1)],
        [("a/x.pc", None, 2), ("c.pc", fn("CC_AGAIN"), 3), ("c.pc", None, 2)],
    ]
    want = [{"AA_ONE", "BB_TWO"}, {"AA_ONE", "BB_NEW", "CC_THREE"}, {"BB_NEW", "CC_AGAIN"}]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for batch, names in zip(batches, want, strict=True):
        df = spark.createDataFrame([(p.split("/"), p, p.split("/")[-1], "pc", t, v) for p, t, v in batch], schema)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        index_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, checkpoint).awaitTermination()
        assert {r["name"] for r in newest_functions(spark, out).collect()} == names
    cat = VersionedCatalog(spark, out)
    assert cat.versions() == [1, 2, 3]
    assert cat.commit(frame(spark, {"d.pc": fn("DD")}), None, checkpoint, 2) == 3 and cat.versions() == [1, 2, 3]
