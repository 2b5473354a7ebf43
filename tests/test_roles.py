"""Roles of tables in statements with subqueries."""

import pytest

from lodestone.operators import parse
from lodestone.operators.roles import roles, table_access

CASES = {
    "UPDATE TB_ACCT SET B = 1 WHERE K IN (SELECT K FROM TB_OTHER)": [("TB_ACCT", "write", 0, 0), ("TB_OTHER", "read", 1, 1)],
    "DELETE FROM TB_A a WHERE NOT EXISTS (SELECT 1 FROM TB_B b, s.TB_C c WHERE b.K = (SELECT MAX(K) FROM TB_A))": [("TB_A", "write", 0, 0), ("TB_B", "read", 1, 1), ("TB_C", "read", 1, 1), ("TB_A", "read", 2, 2)],
    "DELETE TB_A WHERE X = 1": [("TB_A", "write", 0, 0)],
    "INSERT INTO TB_A (K, B) SELECT K, B FROM TB_B LEFT OUTER JOIN TB_C ON TB_B.K = TB_C.K": [("TB_A", "write", 0, 0), ("TB_B", "read", 0, 0), ("TB_C", "read", 0, 0)],
    "INSERT INTO TB_A VALUES (:a, (SELECT SQ_X.NEXTVAL FROM DUAL))": [("TB_A", "write", 0, 0), ("DUAL", "read", 1, 1)],
    "SELECT X, EXTRACT(YEAR FROM D), TRIM(BOTH ' ' FROM N) INTO :x, :y, :z FROM TB_A, (SELECT K FROM TB_B) b, TB_C WHERE C = 'FROM TB_NO' /* FROM TB_NOT */": [("TB_A", "read", 0, 0), ("TB_B", "read", 1, 1), ("TB_C", "read", 0, 0)],
    "SELECT X INTO :out->x FROM TB_A WHERE K = :k FOR UPDATE OF X NOWAIT": [("TB_A", "read", 0, 0)],
    "DECLARE c CURSOR FOR SELECT X FROM TB_CUR WHERE K = :k FOR UPDATE": [("TB_CUR", "read", 0, 0)],
    "MERGE INTO TB_T t USING TB_S s ON (t.K = s.K) WHEN MATCHED THEN UPDATE SET t.B = s.B WHEN NOT MATCHED THEN INSERT (K) VALUES (s.K)": [("TB_T", "write", 0, 0), ("TB_S", "read", 0, 0)],
    "SELECT K FROM TB_A UNION ALL SELECT K FROM TB_B -- FROM TB_NO\n": [("TB_A", "read", 0, 0), ("TB_B", "read", 0, 0)],
    "UPDATE TB_A SET (X, Y) = (SELECT X, Y FROM TB_B WHERE TB_B.K = TB_A.K), Z = (SELECT Z FROM TB_B": [("TB_A", "write", 0, 0), ("TB_B", "read", 1, 1), ("TB_B", "read", 2, 1)],
    'SELECT 1 FROM "Odd Name" x JOIN 표 ON 1 = 1': [("Odd Name", "read", 0, 0), ("표", "read", 0, 0)],
    "COMMIT WORK": [], "": [], ")) FROM ((": [], "OPEN c": [],
}


@pytest.mark.parametrize("statement", CASES)
def test_roles(statement):
    assert roles(statement) == CASES[statement]


def test_long_statements_are_read_once():
    """A hundred thousand list entries and two thousand levels."""
    wide = "SELECT X FROM TB_A WHERE K IN (" + ", ".join(f"'{i}'" for i in range(100_000)) + ") AND Y IN (SELECT Y FROM TB_Z)"
    assert roles(wide) == [("TB_A", "read", 0, 0), ("TB_Z", "read", 1, 1)]
    deep = "SELECT 1 FROM (" * 2000 + "SELECT 1 FROM TB_END" + ")" * 2000
    assert roles(deep) == [("TB_END", "read", 2000, 2000)]


def test_access_of_functions(spark):
    """Through parsed functions; the columns of statements stay as they are."""
    text = "int AA_PAY_01(int a) {\n    EXEC SQL UPDATE TB_ACCT SET B = 1 WHERE K IN (SELECT K FROM TB_OTHER);\n    EXEC SQL SELECT X INTO :v FROM TB_ACCT;\n}\n"
    files = spark.createDataFrame([(["a.pc"], "a.pc", "pc", text), (["b.pc"], "b.pc", "pc", None)], "ord array<string>, file string, ext string, text string")
    parsed = parse.parse_functions(files)
    got = sorted(tuple(r) for r in table_access(parsed).collect())
    assert got == [("AA_PAY_01", 0, "UPDATE", "TB_ACCT", "write", 0, 0), ("AA_PAY_01", 0, "UPDATE", "TB_OTHER", "read", 1, 1), ("AA_PAY_01", 1, "SELECT", "TB_ACCT", "read", 0, 0)]
    held = parsed.first()["statements"]
    assert [s["operation"] for s in held] == ["SELECT", "SELECT"], "the class by any word in the statement, as before"
    assert [s["tables"] for s in held] == [["TB_ACCT", "TB_OTHER"], ["TB_ACCT"]]
