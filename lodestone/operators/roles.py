"""Which tables an embedded statement reads and which it writes, subqueries included.

A statement's words go through a small state machine with a level for each open bracket: a table
name is what stands where a clause of its level expects one. The first table of UPDATE, DELETE,
INSERT INTO and MERGE INTO is written, those of FROM lists, JOIN and MERGE's USING are read, in subqueries
and derived tables likewise. FROM within a function's brackets (EXTRACT, TRIM), host variables,
strings, comments and FOR UPDATE name no table.

Defined results: null and blank statements have no tables; a table that is read and written, or used in several
subqueries, has a row for each; names keep their case, without what qualifies them; brackets left open are closed at the end.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = re.compile(r"/\*.*?\*/|--[^\n]*|'(?:[^']|'')*'|:\w+(?:[.\->]+\w+)*|[^\W\d][\w$#]*(?:\s*\.\s*[^\W\d][\w$#]*)*|\"[^\"]+\"|[(),]", re.S)
TABLE = StructType([StructField("table_name", StringType()), StructField("role", StringType()), StructField("part", IntegerType()), StructField("level", IntegerType())])
ENDS = {"WHERE", "SET", "ON", "VALUES", "GROUP", "ORDER", "HAVING", "UNION", "MINUS", "INTERSECT", "CONNECT", "START", "WHEN", "RETURNING", "FOR", "USING"}
SKIPPED = {"ONLY", "LATERAL", "TABLE"}


def roles(statement: str) -> list[tuple[str, str, int, int]]:
    """(table, read or write, number of the subquery, its level) in order; the statement itself is number 0 on level 0."""
    out, parts, last = [], 0, ""
    now = {"verb": "", "part": 0, "level": 0, "expect": "", "listed": False, "free": True}
    open_ = []
    for token in WORD.findall(statement):
        up = token.upper()
        if token.startswith(("/*", "--", "'")):
            continue
        if token == "(":
            open_.append(now)
            now = {"verb": "", "part": now["part"], "level": now["level"], "expect": "", "listed": False, "free": True}
        elif token == ")":
            if open_:
                now = open_.pop()
                now["expect"] = ""
        elif token == ",":
            now["expect"] = "read" if now["listed"] else ""
        elif up == "SELECT":
            if not now["verb"] and open_:
                parts += 1
                now["part"], now["level"] = parts, now["level"] + 1
            now |= {"verb": up if now["verb"] != "INSERT" else "SELECT", "expect": "", "listed": False}
        elif up in ("INSERT", "MERGE") and not now["verb"]:
            now["verb"] = up
        elif up in ("UPDATE", "DELETE") and last != "FOR":
            if not now["verb"]:
                now |= {"verb": up, "expect": "write"}
        elif up == "INTO":
            now["expect"] = "write" if now["verb"] in ("INSERT", "MERGE") and now["free"] else ""
        elif up == "FROM":
            if now["verb"]:
                write = now["verb"] == "DELETE" and now["free"]
                now |= {"expect": "write" if write else "read", "listed": not write}
        elif up == "JOIN" or (up == "USING" and now["verb"] == "MERGE"):
            now |= {"expect": "read", "listed": False}
        elif up in ENDS:
            now |= {"expect": "", "listed": False}
        elif now["expect"] and up not in SKIPPED:
            if not token.startswith(":"):
                out.append((token.strip('"').split(".")[-1].strip(), now["expect"], now["part"], now["level"]))
                now["free"] = now["free"] and now["expect"] != "write"
            now["expect"] = ""
        last = up
    return list(dict.fromkeys(out))


@F.pandas_udf(ArrayType(TABLE))
def _tables(statements: pd.Series) -> pd.Series:
    names = [f.name for f in TABLE.fields]
    return statements.map(lambda s: [dict(zip(names, t, strict=True)) for t in roles(s or "")])


def table_roles(statement: Column) -> Column:
    """ARRAY<STRUCT<table_name, role, part, level>> of a statement's text."""
    return _tables(statement)


def table_access(functions: DataFrame, key: str = "name", statements: str = "statements") -> DataFrame:
    """key, pos, operation, table_name, role, part, level of every table of every statement; ``statements`` as ``parse.statements`` gives them.

    ``operation`` is the statement's own verb, whatever its subqueries do; a cursor's is that of its query.
    """
    bare = F.regexp_replace("s.raw_sql", r"(?i)^EXEC\s+SQL\s+(?:DECLARE\s+\w+\s+CURSOR\s+FOR\s+)?", "")
    each = functions.select(F.col(key), F.posexplode(statements).alias("pos", "s")).select(key, "pos", bare.alias("text"))
    told = each.select(key, "pos", F.upper(F.regexp_extract("text", r"^\s*(\w+)", 1)).alias("operation"), F.explode(table_roles(F.col("text"))).alias("t"))
    return told.select(key, "pos", "operation", "t.*")
