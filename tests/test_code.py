"""Operators over a small source tree written here, traps of the semantics included."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import analyze, chunk, evaluate, graph, lookup, parse, search, vcs
from lodestone.plans import render
from lodestone.plans.catalog import CodeCatalog
from lodestone.plans.store import settled
from lodestone.sources.files import file_text, source_files

AA_PAY = '''/* pay out money */
#include "proframe.h"
#include "aa_pay_str.h"
EXEC SQL INCLUDE SQLCA;

/* pays a fee */
int AA_PAY_01(aa_in_t *in, aa_out_t *out) {
    EXEC SQL BEGIN DECLARE SECTION;
    char v_acct[11];
    double v_amt;
    EXEC SQL END DECLARE SECTION;
    strcpy(v_acct, in->acct);
    /* read the rate */
    EXEC SQL SELECT a.RATE, NVL(SUM(X),0) INTO :v_amt
        FROM TB_RATE a, TB_RATE b WHERE a.K = :v_acct;
    if (SQLCA.sqlcode != 0) {
        strcpy(out->err_cd, "E10");
        strcpy(out->err_msg, "no rate");
        return FAIL;
    }
    EXEC SQL UPDATE TB_ACCT SET B = 1 WHERE K IN (SELECT K FROM TB_OTHER);
    BB_LOG_01(in, out); /* VIP(01) */
    AA_PAY_01(in, out);
    return SUCCESS;
}

int AA_TWO_02(aa_in_t *in) { EXEC SQL DECLARE c CURSOR FOR SELECT X FROM TB_CUR; EXEC SQL FETCH c INTO :x; BB_LOG_01(in); CC_END_01(x); }
'''
BB_LOG = '''int BB_LOG_01(void) {
    EXEC SQL INSERT INTO TB_LOG VALUES (1);
    CC_END_01(a);
'''
HEADER = '''/* pay structs */
typedef struct {
    char acct[13]; /* account */
    double amt;
    char *p;
} aa_in_t;
typedef struct {
    long n;
} aa_out_t;
'''
DDL = '''CREATE TABLE TB_RATE (
    K VARCHAR2(10) NOT NULL,
    ST CHAR(2) DEFAULT '01',
    RATE NUMBER(5,2),
    CONSTRAINT PK_R PRIMARY KEY (K, ST)
);
COMMENT ON TABLE TB_RATE IS 'rates of fees';
'''


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("src")
    (d / "sub").mkdir()
    (d / "aa_pay_01.PC").write_text(AA_PAY)
    (d / "bb_log_01.pc").write_text(BB_LOG)
    (d / "sub" / "cc.pc").write_bytes(b"int CC_END_01(int a)\n{ /* \xff */ return 0; }\n")
    (d / "sub" / "dup.pc").write_text("int CC_END_01(int b)\n{ /* the last one wins */ return 1; }\n")
    (d / "none.pc").write_text("no function here\n")
    (d / "aa_pay_str.h").write_text(HEADER)
    (d / "tb_rate.sql").write_text(DDL)
    (d / "notes.txt").write_text("not read")
    return str(d)


@pytest.fixture(scope="module")
def cat(spark, root, tmp_path_factory):
    return CodeCatalog.index(spark, root).save(str(tmp_path_factory.mktemp("cat") / "c"))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scan(spark, root):
    files = source_files(spark, root)
    assert [r["file_path"] for r in files.orderBy("ord").collect()] == ["aa_pay_01.PC", "aa_pay_str.h", "bb_log_01.pc", "none.pc", "sub/cc.pc", "sub/dup.pc", "tb_rate.sql"]
    assert "�" in file_text(files, "sub/cc.pc").first()["text"]
    assert file_text(files, "../etc/passwd").isEmpty()
    assert source_files(spark, root, recursive=False).count() == 5


def test_functions(cat):
    f = {r["name"]: r for r in cat.rel["functions"].collect()}
    assert set(f) == {"AA_PAY_01", "AA_TWO_02", "BB_LOG_01", "CC_END_01"}
    assert f["AA_PAY_01"]["description"] == "pays a fee" and f["AA_PAY_01"]["params"] == ["aa_in_t *in", "aa_out_t *out"]
    assert f["AA_PAY_01"]["tables_used"] == ["TB_RATE", "TB_ACCT", "TB_OTHER"]
    assert f["BB_LOG_01"]["body"].rstrip().endswith("CC_END_01(a);"), "an unbalanced body runs to the end"
    assert "last one wins" in f["CC_END_01"]["body"], "of equal names the last in path order stays"


def test_calls_and_usage(cat):
    assert sorted(rows(cat.rel["function_calls"])) == [("AA_PAY_01", "BB_LOG_01"), ("AA_PAY_01", "VIP"), ("AA_TWO_02", "BB_LOG_01"), ("AA_TWO_02", "CC_END_01"), ("BB_LOG_01", "CC_END_01")]
    use = [(r["function_name"], r["table_name"], r["operation"]) for r in cat.rel["sql_usage"].orderBy("ord").collect()]
    assert use[:2] == [("AA_PAY_01", "TB_RATE", "SELECT")] * 2, "repeats are kept"
    assert ("AA_PAY_01", "TB_ACCT", "SELECT") in use, "an update with a subquery counts as a SELECT"
    assert ("AA_TWO_02", "TB_CUR", "SELECT") in use and ("BB_LOG_01", "TB_LOG", "INSERT") in use


def test_structs_and_tables(cat):
    s = {r["name"]: r for r in cat.rel["structs"].collect()}
    assert [(f["name"], f["c_type"], f["size"], f["comment"]) for f in s["aa_in_t"]["fields"]][:2] == [("acct", "char", "13", "account"), ("amt", "double", None, None)]
    t = cat.rel["tables_ddl"].first()
    assert t["comment"] == "rates of fees" and t["primary_key"] == ["K", "ST"]
    c = {x["name"]: x for x in t["columns"]}
    assert not c["K"]["nullable"] and c["ST"]["default"] == "'01'," and c["ST"]["default_clean"] == "'01'" and c["RATE"]["data_type"] == "NUMBER(5,2)"


def test_search_and_context(cat):
    found = cat.search("fee rate nothing")
    assert found["matched_function"] == "AA_PAY_01"
    got = [(r["section"], r["filename"]) for r in found["context"].orderBy("section", "pos").collect()]
    assert got[0] == (1, "aa_pay_01.PC") and (2, "aa_pay_str.h") in got and (4, "tb_rate.sql") in got
    parts = {r["role"]: r["content"] for r in found["context"].collect()}
    assert parts["struct"].startswith("/* pay structs */\ntypedef struct {\n    char acct[13];    /* account */") and parts["struct"].endswith("} aa_in_t;")
    assert parts["table (TB_RATE)"].endswith("    PRIMARY KEY (K, ST)\n);\n-- rates of fees")
    assert cat.search("qqqq") is None and cat.search("a") is None
    assert "AA_PAY_01" in render.candidates(found)
    assert [r["score"] for r in cat.search_keywords("fee fee").collect()] == [6], "repeated terms count"


def test_graph_verbs(cat):
    assert cat.call_graph("BB_LOG_01").first().asDict() == {"entry": "BB_LOG_01", "calls": ["CC_END_01"], "called_by": ["AA_PAY_01", "AA_TWO_02"]}
    kind, hit = cat.impact("CC_END_01")
    assert kind == "function" and [(r["name"], r["depth"]) for r in hit.collect()] == [("AA_TWO_02", 1), ("BB_LOG_01", 1), ("AA_PAY_01", 2), ("AA_TWO_02", 2)]
    kind, hit = cat.impact("TB_RATE")
    assert kind == "table" and [r["name"] for r in hit.collect()] == ["AA_PAY_01"]
    assert cat.impact("nothing")[0] == "unknown" and "no known" in render.impact("unknown", "x")
    steps = cat.business_flow("AA_TWO_02").collect()
    assert [(r["name"], r["depth"]) for r in steps] == [("AA_TWO_02", 0), ("BB_LOG_01", 1), ("CC_END_01", 2), ("CC_END_01", 1)]
    assert cat.business_flow("unknown").isEmpty()
    assert [tuple(r) for r in cat.call_tree("AA_TWO_02").collect()] == [("BB_LOG_01", "AA_TWO_02", 1), ("CC_END_01", "AA_TWO_02", 1), ("CC_END_01", "BB_LOG_01", 2)]


def test_lookups(cat):
    d = cat.function("AA_PAY_01").first()
    assert d["calls"] == ["BB_LOG_01", "VIP"] and d["dependency_files"] == ["bb_log_01.pc"] and d["struct_files"] == ["aa_pay_str.h"] and d["ddl_files"] == ["tb_rate.sql"]
    assert cat.function("nope").isEmpty()
    e = cat.find_by_error_code("E10").first()
    assert e["function_name"] == "AA_PAY_01" and e["error_message"] == "no rate" and len(e["context"].split("\n")) == 6
    assert cat.find_by_error_code("E99").isEmpty()
    assert {r["name"] for r in cat.search_by_domain("aa").collect()} == {"AA_PAY_01", "AA_TWO_02", "aa_in_t", "aa_out_t"}
    assert [r["name"] for r in cat.list_services().collect()] == ["AA_PAY_01", "AA_TWO_02", "BB_LOG_01", "CC_END_01"]
    assert {r["relation"]: r["n"] for r in cat.counts().collect()}["function_calls"] == 5
    assert len(cat.find_by_table("TB_RATE").collect()) == 2 and cat.table("TB_RATE").first()["comment"] == "rates of fees"


def test_chunks(spark, root, cat):
    files = source_files(spark, root)
    c = {r["id"]: r for r in chunk.chunk_semantic(files).collect()}
    assert c["aa_pay_01.PC:AA_PAY_01"]["start_line"] == 7, "what stands in the head stays there"
    two = c["aa_pay_01.PC:AA_TWO_02"]
    assert two["text"].startswith("/* pay out money */") and two["has_sql"]
    assert "none.pc:1-2" in c and c["aa_pay_str.h:full"]["has_sql"] is False and c["tb_rate.sql:full"]["has_sql"]
    fixed = chunk.chunk_fixed(files).where("file = 'aa_pay_01.PC'").collect()
    covered = {n for r in fixed for n in range(r["start_line"], r["end_line"] + 1)}
    assert all(i + 1 in covered for i, x in enumerate(AA_PAY.split("\n")) if x.strip())
    near = cat.search_chunks("rates of fees table", 3).collect()
    assert len(near) == 3 and near[0]["score"] >= near[1]["score"]
    assert cat.search_hybrid("pay fee rate")["vector_candidates"]


def test_analysis(cat):
    f = cat.rel["functions"].where("name = 'AA_PAY_01'")
    s = analyze.sql_statements(f).orderBy("line_no").collect()
    assert [(x["operation"], x["tables"], x["into_vars"]) for x in s] == [("SELECT", ["TB_RATE"], ["v_amt"]), ("UPDATE", ["TB_ACCT", "TB_OTHER"], [])]
    assert s[0]["comment"] == "read the rate"
    assert analyze.summary(f).first()["host_variables"] == ["v_acct", "v_amt"]
    assert analyze.summary(f).first()["output_fields"] == ["err_cd", "err_msg"]
    calls = analyze.service_calls(f).orderBy("line_no", "pos").collect()
    assert [c["callee"] for c in calls] == ["NVL", "BB_LOG_01", "VIP", "AA_PAY_01"]
    e = analyze.error_handlers(f).first()
    assert e["action"] == 'strcpy(out->err_cd, "E10"); | strcpy(out->err_msg, "no rate"); | return FAIL;'
    assert "AA_PAY_01" in render.analysis("x", s, calls, [e])


def test_names_of_all_scripts(spark):
    """Names in any script count as words, in tables, columns, structs, fields and calls."""
    body = "{ EXEC SQL SELECT A.이름, 금액 INTO :x FROM TB_한글 a JOIN TB_É2 ON 1 = 1;\u00a0exec\u00a0sql update TB_계좌 set n = 1; 가CALL_ONE(x); CALL_TWO\u00a0(in->계좌, out->é); }"
    r = spark.createDataFrame([(body,)], "body string").select(
        F.transform(parse.statements(F.col("body")), lambda s: s["tables"]).alias("t"), parse.statements(F.col("body"))[0]["columns"].alias("c"), parse.calls(F.col("body"), F.lit("X")).alias("calls"), analyze.fields(F.col("body"), "in").alias("i"), analyze.fields(F.col("body"), "out").alias("o"),
    ).first()
    assert r["t"] == [["TB_한글", "TB_É2"], ["TB_계좌"]] and r["c"] == ["이름", "금액"] and r["calls"] == ["CALL_TWO"] and (r["i"], r["o"]) == (["계좌"], ["é"])
    files = spark.createDataFrame([(["a.h"], "a.h", "h", "typedef struct {\n    char 계좌[3]; /* c */\n} 구조_t;\n"), (["b.sql"], "b.sql", "sql", "CREATE TABLE TB_한글 (\n    이름 CHAR(2)\n);\nCOMMENT ON TABLE TB_한글 IS '표';\n")], "ord array<string>, file string, ext string, text string")
    st, t = parse.parse_structs(files).first(), parse.parse_tables(files).first()
    assert st["name"] == "구조_t" and st["fields"][0]["name"] == "계좌" and (t["name"], t["comment"], t["columns"][0]["name"]) == ("TB_한글", "표", "이름")
    assert [r["name"] for r in search.name_candidates(spark.createDataFrame([("가ABCD EFGH", 1.0)], "text string, score double")).collect()] == ["EFGH"]


def test_traps_of_statements(spark):
    """Cursors, fetches, sequences, subqueries and comma joins as the operators class them."""
    body = "{ EXEC SQL DECLARE c CURSOR FOR SELECT A FROM TB_A a, TB_B b; EXEC SQL FETCH c INTO :x; EXEC SQL CLOSE c; EXEC SQL SELECT SQ_N.NEXTVAL INTO :n FROM DUAL; EXEC SQL INSERT INTO TB_C SELECT X FROM TB_D; EXEC SQL COMMIT; EXEC SQL OPEN TB_CUR; }"
    got = spark.createDataFrame([(body,)], "body string").select(F.explode(parse.statements(F.col("body"))).alias("s")).select("s.operation", "s.tables").collect()
    assert [tuple(r) for r in got] == [("SELECT", ["TB_A", "TB_B"]), ("OTHER", []), ("OTHER", []), ("SELECT", ["SQ_N"]), ("SELECT", ["TB_C", "TB_D"]), ("OTHER", []), ("CURSOR", ["TB_CUR"])]


def test_chunks_of_odd_files(spark):
    text = "/* head */\n#include <a>\n\nint x;\n  int AA_ONE(int a);\nint AA_TWO(int b) {\n  if (a) { b; }\n}\n\n/* lead\n * more */\nint AA_THREE(void)\n{\n  EXEC SQL COMMIT;\n"
    files = spark.createDataFrame([("a.pc", "pc", text), ("b.pc", "pc", ""), ("c.pc", "pc", None), ("d.pc", "pc", "/* only */\n// head")], "file string, ext string, text string")
    got = {r["id"]: (r["start_line"], r["end_line"], r["text"], r["has_sql"]) for r in chunk.chunk_semantic(files).collect()}
    rows_ = text.split("\n")
    assert got["a.pc:AA_ONE"][:2] == (5, 8), "a prototype runs to the braces that follow it"
    assert got["a.pc:AA_THREE"] == (9, len(rows_), "/* head */\n#include <a>\n\n" + "\n".join(rows_[8:]), True)
    assert "a.pc:AA_TWO" not in got and got["b.pc:1-1"] == (1, 1, "", False) and got["c.pc:1-1"][2] == "" and got["d.pc:1-2"][:2] == (1, 2)


def test_views(spark, cat):
    assert [tuple(r) for r in cat.tables_used("AA_PAY_01").collect()] == [("TB_ACCT", "SELECT"), ("TB_OTHER", "SELECT"), ("TB_RATE", "SELECT")]
    assert [r["table_name"] for r in cat.tables_touched("AA_TWO_02").collect()] == ["TB_CUR", "TB_LOG"]
    by = cat.find_by_table("TB_RATE").collect()
    assert [r["comment"] for r in by] == ["rates of fees"] * 2 and by[0]["columns"][0]["name"] == "K" and cat.find_by_table("TB_LOG").first()["comment"] is None
    found = cat.search("fee rate")
    assert tuple(found["related_files"].first()) == ("aa_pay_01.PC", "entry") and "(struct)" in render.files(found["related_files"].collect())
    truth = spark.createDataFrame([("fee rate", ["aa_pay_01.PC"], ["tb_rate.sql"], {"function_body": ["aa_pay_01.PC"], "structs": ["aa_pay_str.h"], "called_functions": [], "table_ddl": []})], "query string, required_files array<string>, noise_files array<string>, context_categories struct<function_body:array<string>,structs:array<string>,called_functions:array<string>,table_ddl:array<string>>")
    full = {r["strategy"]: r for r in cat.search_full("fee rate", truth).collect()}["structural"]
    flags = {f["file"]: (f["is_noise"], f["is_relevant"]) for f in full["files"]}
    assert flags["aa_pay_01.PC"] == (False, True) and flags["tb_rate.sql"] == (True, False) and full["recall"] == 1.0 and full["seconds"] > 0
    assert cat.run_evaluation(truth).count() == 3
    assert render.fenced("a.PC", "x") == "```c\nx\n```" and render.diff(" ") == "No changes." and "### Body" in render.analysis("x", [], [], [], "b")


def test_evaluation(spark, cat):
    truth = spark.createDataFrame(
        [("q", ["a", "b"], ["n"], {"function_body": ["a"], "structs": [], "called_functions": ["c"], "table_ddl": []})],
        "query string, required_files array<string>, noise_files array<string>, context_categories struct<function_body:array<string>,structs:array<string>,called_functions:array<string>,table_ddl:array<string>>",
    )
    res = spark.createDataFrame([("q", "s", ["a", "n", "x", "a"]), ("q", "t", []), ("unknown", "s", ["a"])], "query string, strategy string, returned_files array<string>")
    m = {(r["query"], r["strategy"]): r for r in evaluate.evaluate(res, truth).collect()}
    r = m["q", "s"]
    assert (r["precision"], r["recall"], r["noise_ratio"], r["context_completeness"]) == (0.333, 0.5, 0.333, 0.75) and r["missing_files"] == ["b"]
    assert (m["q", "t"]["precision"], m["q", "t"]["context_completeness"]) == (0.0, 0.5)
    assert m["unknown", "s"]["context_completeness"] == 0.0 and m["unknown", "s"]["recall"] == 0.0
    long = spark.createDataFrame([("q", "s", f) for f in ("a", "n", "x", "a")] + [("unknown", "s", "a")], "query string, strategy string, file string")
    told = spark.createDataFrame([("q", "a", "required"), ("q", "b", "required"), ("q", "n", "noise"), ("q", "n", "noise")], "query string, file string, kind string")
    assert {tuple(x) for x in evaluate.evaluate_rows(long, told).collect()} == {("q", "s", 0.333, 0.5, 0.333), ("unknown", "s", 0.0, 0.0, 0.0)}
    avg = {x["strategy"]: x for x in evaluate.strategy_averages(evaluate.evaluate(res, truth)).collect()}
    assert avg["s"]["n_queries"] == 2 and abs(avg["s"]["precision"] - 0.1665) < 1e-9
    assert cat.search_full("fee rate", truth).count() == 2


def test_version_control_text(spark, tmp_path):
    log = f"{'-' * 72}\nr12 | ann | 2024-01-15 10:30:00 +0900 (Mon) | 2 lines\nChanged paths:\n   M /a.pc\n   A /b.pc\n\nfirst line\nsecond line\n{'-' * 72}\nbroken entry\n{'-' * 72}\n"
    df = spark.createDataFrame([(log,)], "raw string")
    assert [tuple(r) for r in vcs.log_entries(df, "raw").select("revision", "author", "date", "message", "changed").collect()] == [("r12", "ann", "2024-01-15 10:30:00 +0900", "first line\nsecond line", ["M /a.pc", "A /b.pc"])]
    df = spark.createDataFrame([("  12   ann    int a;\n 7 bob\nx\n",)], "raw string")
    assert [tuple(r) for r in vcs.blame_lines(df, "raw", line_start=1, line_end=3).collect()] == [(1, "12", "ann", "int a;"), (2, "7", "bob", ""), (3, "", "", "x")]
    df = spark.createDataFrame([("M       src/a b.pc\n?       new\n\n",)], "raw string")
    assert [tuple(r) for r in vcs.status_lines(df, "raw").collect()] == [("M", "Modified", "src/a b.pc"), ("?", "Untracked", "new")]
    with pytest.raises(ValueError):
        vcs.Client(str(tmp_path)).resolved("../x")


def brute_tree(edges, root, depth):
    out, front = [], [(root, 0)]
    while front:
        node, d = front.pop()
        if d < depth:
            for s, t in edges:
                if s == node:
                    out.append((s, t, d + 1))
                    front.append((t, d + 1))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    edges = sorted({(f"n{rnd.randrange(6)}", f"n{rnd.randrange(6)}") for _ in range(9)})
    df = spark.createDataFrame(edges, "src string, dst string")
    want = brute_tree(edges, "n0", 4)
    assert sorted(rows(graph.tree(df, "n0", 4))) == want
    assert sorted(rows(graph.reached(df, spark.createDataFrame([("n0",)], "name string"), 4))) == sorted({(t, d) for _, t, d in want})
    back = brute_tree([(b, a) for a, b in edges], "n0", 3)
    assert sorted(rows(graph.function_impact(df, "n0", 3))) == sorted({(t, d) for _, t, d in back})
    use = spark.createDataFrame([("n1", "t", "SELECT"), ("n2", "t", "UPDATE"), ("n1", "t", "INSERT")], "function_name string, table_name string, operation string")
    got = {r["name"]: (r["operation"], r["depth"]) for r in graph.table_impact(df, use, "t", 3).collect()}
    seen = {}
    for user, op in (("n1", "INSERT"), ("n2", "UPDATE")):
        seen.setdefault(user, (op, 0))
        for d, name in sorted({(d, t) for _, t, d in brute_tree([(b, a) for a, b in edges], user, 3)}):
            seen.setdefault(name, ("indirect", d))
    assert got == seen


def test_deep_and_bushy_trees(spark):
    """A chain of 120 steps, and 2 ** 20 paths through 20 diamonds."""
    chain = spark.range(130).selectExpr("'c' || id AS src", "'c' || (id + 1) AS dst")
    assert graph.tree(settled(chain), "c0", 20).count() == 20 and graph.function_impact(settled(chain), "c12", 40).count() == 12
    hubs = spark.range(20).selectExpr("'h' || id AS a", "'h' || (id + 1) AS b", "explode(array('l', 'r')) AS side")
    edges = settled(hubs.selectExpr("a AS src", "a || side AS dst").unionByName(hubs.selectExpr("a || side AS src", "b AS dst")))
    t = graph.tree(edges, "h0", 40)
    assert t.where("depth = 40").count() == 2**20 and t.where("dst = 'h3'").count() == 8


def test_pages_of_a_huge_tree(spark):
    """Any page of the 2 ** 40 longest paths in order, and all of a small cyclic graph against a walk."""
    mids = spark.range(5 * 256).selectExpr("'h' || (id div 256) AS a", "'h' || (id div 256) || 'm' || lpad(id % 256, 3, '0') AS m", "'h' || (id div 256 + 1) AS b")
    sizes = graph.path_sizes(settled(mids.selectExpr("a AS src", "m AS dst").unionByName(mids.selectExpr("m AS src", "b AS dst"))), "h0", 10)
    total = 0
    for _ in range(5):
        total = 256 * (2 + total)
    assert sum(r["size"] for r in sizes[0].collect()) == total > 2**40
    for first in (0, total // 3, total - 7):
        got = sorted(graph.paths_page(sizes, "h0", first, 7).collect())
        assert [int(r["rank"]) for r in got] == list(range(first, first + 7)) and [r["path"] for r in got] == sorted(r["path"] for r in got)
    assert got[-1]["path"] == [x for i in range(5) for x in (f"h{i}", f"h{i}m255")] + ["h5"] and graph.paths_page(sizes, "h0", total, 5).count() == 0
    edges = [("a", "b"), ("a", "c"), ("b", "a"), ("c", "c"), ("c", "b"), ("c", "b"), ("b", "d")]

    def walk(path, left):
        for n in sorted({y for x, y in edges if x == path[-1]}) if left else []:
            yield [*path, n]
            yield from walk([*path, n], left - 1)

    want = list(walk(["a"], 5))
    sizes = graph.path_sizes(spark.createDataFrame(edges, "src string, dst string"), "a", 5)
    for first, count in ((0, 10**6), (3, 9)):
        assert [r["path"] for r in sorted(graph.paths_page(sizes, "a", first, count).collect())] == want[first : first + count]
    assert graph.paths_page(graph.path_sizes(spark.createDataFrame(edges, "src string, dst string"), "nowhere", 3), "nowhere", 0, 5).count() == 0


def test_affected_counts(spark):
    """Within four standard errors of exact counts at depths 1 to 5, cycles, hubs and repeated edges included."""
    rnd = random.Random(4)
    edges = [(f"f{rnd.randrange(400)}", f"f{rnd.randrange(400)}") for _ in range(900)] + [(f"u{i}", "hub") for i in range(3000)] + [("hub", "f1"), ("f1", "hub"), ("hub", "f1")]
    callers = {}
    for a, b in edges:
        callers.setdefault(b, set()).add(a)
    want = {}
    for n in callers:
        front, seen = {n}, set()
        for d in range(1, 6):
            front = set().union(*(callers.get(m, set()) for m in front))
            seen |= front
            want[n, d] = len(seen)
    got = {(r["name"], r["depth"]): r["affected"] for r in graph.affected_counts(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert set(got) == set(want) and max(want.values()) > 3000
    assert all(abs(got[k] - n) <= max(1, 4 * 1.04 / 2**7 * n) for k, n in want.items())
    assert graph.affected_counts(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_vector_batch_in_several_blocks(spark):
    """Against all distances, with ties, blocks of all sizes, queries sent and copied, and rows that take no part."""
    made = [(f"k{i:02}", [float(i % 7), float(i % 3)]) for i in range(60)]
    odd = [("n0", None), ("n1", []), ("n2", [1.0, None]), (None, [1.0, 1.0]), ("x", [1.0]), ("nan", [float("nan"), 1.0])]
    df = spark.createDataFrame(made + odd, "id string, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS block", "'q' AS query_key").repartition(3)
    want = []
    for q, v in made[:20] + [odd[4]]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in [*made, odd[4]] if len(w) == len(v))[:3]
        want += [(q, k, d, i + 1, round(1 / (1 + d), 4)) for i, (d, k) in enumerate(near)]
    asked = df.where("id < 'k20' OR id IN ('x', 'nan', 'n0') OR id IS NULL")
    for more in ({}, {"broadcast_rows": 4, "shard_rows": 5}, {"broadcast_rows": 4, "shard_rows": 5, "broadcast_bytes": 0}):
        got = search.vector_search_batch(df, asked, "id", k=3, **more).select("query_key", "id", "distance", "rank", "score")
        assert sorted(rows(got)) == sorted(want)
    assert search.vector_search_batch(df, df.where("false"), "id").count() == 0 == search.vector_search_batch(df.where("false"), df, "id").count()


def test_incremental_index(spark, tmp_path):
    from lodestone.streaming.incremental import index_stream, newest_functions

    schema = "ord array<string>, file string, ext string, text string, version long"
    rows_ = lambda text, v: spark.createDataFrame([(["a.pc"], "a.pc", "pc", text, v)], schema)
    for v, text in ((1, "int AA_ONE(int a) { BB_TWO(a); }"), (2, "int AA_NEW(int a) { return 0; }")):
        rows_(text, v).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["name"] for r in newest_functions(spark, str(tmp_path / "out")).collect()] == ["AA_NEW"]
