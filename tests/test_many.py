"""Many queries in one plan against one query at a time, and retrieval quality on ten own records."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from lodestone.operators import evaluate, many, search
from lodestone.plans.catalog import CodeCatalog

WEIGHTS = {"description": 3, "body": 1}
#: code, description, callee, table; the function of each record is named in its query by subject alone.
RECORDS = [
    ("AC_OPEN_01", "opens savings account for customer", "CM_AUDIT_01", "TB_ACCOUNT"),
    ("AC_CLOSE_02", "closes dormant account", "CM_AUDIT_01", "TB_DORMANT"),
    ("LN_RATE_01", "computes interest rate of loan", "LN_GRADE_02", "TB_LOAN"),
    ("LN_GRADE_02", "grades credit of borrower", "CM_AUDIT_01", "TB_CREDIT"),
    ("FX_SWAP_01", "books currency swap", "FX_QUOTE_02", "TB_SWAP"),
    ("FX_QUOTE_02", "quotes spot price", "CM_AUDIT_01", "TB_QUOTE"),
    ("CD_BLOCK_01", "blocks stolen card", "CM_NOTIFY_02", "TB_CARD"),
    ("PY_SPLIT_01", "splits payroll payment", "CM_NOTIFY_02", "TB_PAYROLL"),
    ("TX_LEVY_01", "levies withholding tax", "TX_TABLE_02", "TB_LEVY"),
    ("TX_TABLE_02", "reads tax brackets", "", "TB_BRACKET"),
]
COMMON = [("CM_AUDIT_01", "writes audit trail", "", "TB_TRAIL"), ("CM_NOTIFY_02", "sends notice", "", "TB_NOTICE")]
QUERIES = ["savings customer", "dormant", "interest loan", "credit borrower", "currency swap", "spot price", "stolen card", "payroll", "withholding levies", "brackets"]


def tree(root):
    for name, text, callee, table in RECORDS + COMMON:
        stem = name.lower()
        call = f"    {callee}(in);\n" if callee else ""
        (root / f"{name}.pc").write_text(f'/* {text} */\n#include "{stem}_str.h"\nint {name}({stem}_t *in) {{\n    EXEC SQL SELECT A INTO :v FROM {table} WHERE K = :k;\n{call}    return 0;\n}}\n')
        (root / f"{stem}_str.h").write_text(f"/* input of {stem} */\ntypedef struct {{\n    long k;\n}} {stem}_t;\n")
        (root / f"{table}.sql").write_text(f"CREATE TABLE {table} (\n    K NUMBER(10) NOT NULL,\n    A VARCHAR2(5)\n);\n")
    return str(root)


def truth(spark):
    by = {r[0]: r for r in RECORDS + COMMON}
    rows = []
    for query, (name, _, callee, table) in zip(QUERIES, RECORDS, strict=True):
        called, tables, at = [], [table], callee
        while at and len(called) < 2:
            called.append(at)
            tables.append(by[at][3])
            at = by[at][2]
        cats = ([f"{name}.pc"], [f"{name.lower()}_str.h"], [f"{c}.pc" for c in called], [f"{t}.sql" for t in tables])
        need = [f for c in cats for f in c]
        noise = [f"{r[0]}.pc" for r in RECORDS if f"{r[0]}.pc" not in need]
        rows.append((query, name, need, noise, cats))
    return spark.createDataFrame(rows, "query string, target_function string, required_files array<string>, noise_files array<string>, context_categories struct<function_body:array<string>,structs:array<string>,called_functions:array<string>,table_ddl:array<string>>")


@pytest.fixture(scope="module")
def cat(spark, tmp_path_factory):
    return CodeCatalog.index(spark, tree(tmp_path_factory.mktemp("tree"))).save(str(tmp_path_factory.mktemp("cat")))


def test_ten_records(spark, cat):
    """Structural retrieval finds all that each of ten queries needs and nothing else; chunks find less and bring noise."""
    got = cat.run_evaluation(truth(spark)).collect()
    assert len(got) == 30 and all(r["seconds"] > 0 for r in got)
    means = {r["strategy"]: r for r in evaluate.strategy_averages(spark.createDataFrame(got)).collect()}
    s, c = means["structural"], means["chunk"]
    assert (s["n_queries"], s["precision"], s["recall"], s["noise_ratio"], s["context_completeness"]) == (10, 1.0, 1.0, 0.0, 1.0)
    assert c["recall"] < 0.7 and c["noise_ratio"] > 0.1 and c["precision"] < s["precision"]
    assert means["hybrid"]["recall"] > c["recall"]


def test_all_strategies_equal_one_query_at_a_time(spark, cat):
    queries = QUERIES[:4] + ["no such words", "LN_RATE_01", "x", "", "account account"]
    df = spark.createDataFrame([(q,) for q in queries] + [(None,), (QUERIES[0],)], "query string")
    got = {(r["query"], r["strategy"]): r["returned_files"] for r in cat.returned_files_many(df).collect()}
    want = {(q, s): cat.returned_files(q, s) for q in queries for s in ("chunk", "structural", "hybrid")}
    assert got == want


def test_jobs_do_not_grow_with_queries(spark, cat):
    def jobs(queries):
        df = spark.createDataFrame([(q,) for q in queries], "query string")
        group = f"many-{len(queries)}"
        spark.sparkContext.setJobGroup(group, group)
        cat.returned_files_many(df).collect()
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    few, more = jobs(QUERIES[:2]), jobs(QUERIES * 4 + [f"account {i}" for i in range(200)])
    assert more <= few + 6  # a level of the graph more, a shuffle read or a broadcast more


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_keywords(spark, k):
    rnd = random.Random(1)
    words = ["fee", "rate", "fe", "feerate", "日本", "x", "yy", "Fee"]
    rows = [(i, rnd.choice([None, [str(rnd.randrange(9)), None], [str(rnd.randrange(9))]]), " ".join(rnd.choices(words, k=3)), rnd.choice([None, "".join(rnd.choices(words, k=20))])) for i in range(300)]
    df = spark.createDataFrame([(i, f"n{i:03}", o, d, b) for i, o, d, b in rows], "score long, name string, ord array<string>, description string, body string").repartition(5)
    queries = ["fee rate", "fee fee", "feerate yy", "nowhere", "x", "日本 fe", "yy"]
    got = many.keyword_search_many(df, spark.createDataFrame([(q,) for q in [*queries, None, "yy"]], "query string"), WEIGHTS, "name", "ord", k).collect()
    for q in queries:
        from pyspark.sql import functions as F

        want = df.drop("score").withColumn("score", search.keyword_score(q, WEIGHTS)).where("score > 0").orderBy(F.desc("score"), "ord", "name").limit(k).select("name", "score").collect()
        assert [(r["name"], r["score"]) for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == [tuple(r) for r in want]
    none = many.keyword_search_many(df, spark.createDataFrame([("x",), (None,)], "query string"), WEIGHTS, "name", "ord")
    assert none.collect() == [] and none.columns == ["query", "name", "score", "rank"]
    assert many.keyword_search_many(df.where("false"), spark.createDataFrame([("fee",)], "query string"), WEIGHTS, "name", "ord").collect() == []


def test_keywords_hold_no_pairs(spark, monkeypatch):
    """A task's memory doesn't grow with rows times queries; blocks of any size give the same rows."""
    n, q = 4000, 1500
    df = spark.createDataFrame([(i, f"the{i % 97:02} and{i % 89:02} the rest") for i in range(n)], "id long, text string")
    queries = spark.createDataFrame([(f"the and{i % 89:02} rest the{i % 97:02} q{i}",) for i in range(q)], "query string")
    tasks, plain = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: tasks.append((self, run)) or plain(self, run, schema))
    many.keyword_search_many(df, queries, {"text": 1}, "id", "id")
    batches = tasks[0][0].toArrow().combine_chunks().to_batches()
    out = []
    for hits in (many.HITS, 7):
        monkeypatch.setattr(many, "HITS", hits)
        tracemalloc.start()
        table = pa.Table.from_batches(tasks[0][1](batches[:1] if hits > 7 else [batches[0].slice(0, 400)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < n * q  # bytes
        out.append(sorted(tuple(r.values()) for r in table.select(["number", "score", "key"]).to_pylist()))
    monkeypatch.undo()
    assert len(out[0]) == 3 * q
    texts = [f"the{i % 97:02} and{i % 89:02} the rest" for i in range(400)]
    asked = sorted((r["query"] for r in queries.collect()), key=lambda x: int(x.rsplit("q")[1]))
    got = sorted(v[1:] for v in out[1])
    want = sorted(t for x in asked for t in sorted(((sum(w in text for w in x.split()), i) for i, text in enumerate(texts)), key=lambda t: (-t[0], t[1]))[:3])
    assert got == want


def test_index_of_substrings_in_the_catalog(spark, cat, tmp_path):
    plain = [(q, [(r["name"], r["score"]) for r in cat.search_keywords(q).collect()]) for q in ("account", "tax brackets", "TB_")]
    cat.index_substrings(str(tmp_path / "index"))
    assert [(q, [(r["name"], r["score"]) for r in cat.search_keywords(q).collect()]) for q in ("account", "tax brackets", "TB_")] == plain
    cat.keywords = None
