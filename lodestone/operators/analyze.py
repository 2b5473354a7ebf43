"""Analysis of function bodies, line by line, as column expressions over the array of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import all_of, lines, strip
from lodestone.operators import patterns as pat

def fields(body: Column, side: str) -> Column:
    """Sorted distinct fields of ``in`` or ``out``."""
    return F.array_sort(F.array_distinct(all_of(body, pat.SIDE.format(side))))


def _starts_sql(line: Column) -> Column:
    up = F.upper(line)
    return up.contains("EXEC SQL") & ~up.contains("DECLARE SECTION") & ~up.contains("INCLUDE")


def sql_spans(ls: Column) -> Column:
    """(first, last) 0-based lines of each embedded statement: from a start to the next line that ends in a semicolon."""
    none = F.array().cast("array<struct<first:int,last:int>>")
    zero = F.struct(F.lit(-1).alias("open"), none.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        i, line = x["i"], x["line"]
        begin = F.when(acc["open"] >= 0, acc["open"]).when(_starts_sql(line), i).otherwise(F.lit(-1))
        ends = (begin >= 0) & (line.rlike(r"(?U);\s*$") | (i == F.size(ls) - 1))
        done = F.when(ends, F.concat(acc["done"], F.array(F.struct(begin.alias("first"), i.alias("last"))))).otherwise(acc["done"])
        return F.struct(F.when(ends, F.lit(-1)).otherwise(begin).alias("open"), done.alias("done"))

    return F.aggregate(F.transform(ls, lambda x, i: F.struct(i.alias("i"), x.alias("line"))), zero, step, lambda acc: acc["done"])


def filled(ls: Column) -> Column:
    """The place of each line that is not blank, null for others; made once for a body."""
    return F.transform(ls, lambda x, i: F.when(x.rlike(r"(?U)\S"), i))


def coded(ls: Column) -> Column:
    """The place of each line that is neither blank nor an opening brace, null for others."""
    return F.transform(ls, lambda x, i: F.when(~strip(x).isin("", "{"), i))


def _above(ls: Column, places: Column, at: Column) -> Column:
    """The nearest line above ``at`` that has a place, trimmed; looks at places, not at texts."""
    return strip(F.coalesce(F.get(ls, F.array_max(F.slice(places, 1, at))), F.lit("")))


def comment_above(ls: Column, places: Column, at: Column) -> Column:
    """The comment on the nearest line above that is not blank; empty if that is code. ``places``: ``filled``."""
    near = _above(ls, places, at)
    whole = near.startswith("/*") & near.endswith("*/")
    part = near.startswith("/*") | near.startswith("*") | near.endswith("*/")
    return F.when(whole & (F.length(near) >= 4), strip(F.regexp_extract(near, r"(?s)^/\*(.*)\*/$", 1))).when(part, strip(F.regexp_replace(near, r"^[/* ]+|[ */]+$", ""))).otherwise("")


def condition_above(ls: Column, places: Column, at: Column) -> Column:
    """The nearest line above that is neither blank nor an opening brace, if it begins an ``if``; else empty. ``places``: ``coded``."""
    near = _above(ls, places, at)
    return F.when(near.startswith("if ") | near.startswith("if("), near).otherwise("")


def sql_statements(functions: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """name, line_no, operation, raw_sql, tables, into_vars, comment, condition of each embedded statement."""
    ls = F.col("ls")
    told = lambda s: F.struct(
        (s["first"] + 1).alias("line_no"), F.array_join(F.slice(ls, s["first"] + 1, s["last"] - s["first"] + 1), " ").alias("raw"),
        comment_above(ls, F.col("filled"), s["first"]).alias("comment"), condition_above(ls, F.col("coded"), s["first"]).alias("condition"),
    )
    # All that depends on other lines is taken before the rows are made, so none carries the body along.
    each = functions.select(F.col(name).alias("name"), lines(F.col(body)).alias("ls")).select("name", "ls", filled(ls).alias("filled"), coded(ls).alias("coded"))
    each = each.select("name", F.explode(F.transform(sql_spans(ls), told)).alias("s")).select("name", "s.*")
    made = each.withColumn("raw_sql", strip(F.regexp_replace("raw", r"(?U)\s+", " ")))
    op = F.upper(F.regexp_extract(F.replace("raw_sql", F.lit("EXEC SQL"), F.lit("")), rf"(?iU)^\s*({pat.FIRST_WORDS})", 1))
    return made.select(
        "name", "line_no", F.when(op == "", "OTHER").otherwise(op).alias("operation"), "raw_sql",
        F.filter(all_of(F.col("raw_sql"), pat.USED), lambda t: F.upper(t).startswith("TB_")).alias("tables"), all_of(F.col("raw_sql"), pat.INTO).alias("into_vars"), "comment", "condition",
    )


def host_variables(body: Column) -> Column:
    """Names declared between BEGIN and END DECLARE SECTION, in all such sections."""
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        begin, end = line.contains("BEGIN DECLARE SECTION"), line.contains("END DECLARE SECTION")
        var = F.regexp_extract(line, pat.HOST_VARIABLE, 1)
        take = acc["inside"] & ~begin & ~end & (var != "")
        return F.struct(F.when(begin, F.lit(True)).when(end, F.lit(False)).otherwise(acc["inside"]).alias("inside"), F.when(take, F.concat(acc["vars"], F.array(var))).otherwise(acc["vars"]).alias("vars"))

    return F.aggregate(lines(body), F.struct(F.lit(False).alias("inside"), none.alias("vars")), step, lambda acc: acc["vars"])


def _lines_with(functions: DataFrame, name: str, body: str, keep, more) -> DataFrame:
    """name, line_no, line and what ``more`` says of (lines, 0-based place), for the lines that ``keep`` takes."""
    ls = F.col("ls")
    rows = F.filter(F.transform(ls, lambda x, i: F.when(keep(x), F.struct((i + 1).alias("line_no"), x.alias("line"), more(ls, i).alias("more")))), lambda x: x.isNotNull())
    return functions.select(F.col(name).alias("name"), lines(F.col(body)).alias("ls")).select("name", "ls", filled(ls).alias("filled")).select("name", F.explode(rows).alias("x")).select("name", "x.*")


def service_calls(functions: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """name, line_no, pos, callee, args, comment of each upper-case call, SQL functions included."""
    each = _lines_with(functions, name, body, lambda x: ~x.contains("DECLARE") & x.rlike(pat.CALL), lambda ls, i: comment_above(ls, F.col("filled"), i))
    found = each.select("name", "line_no", "more", F.posexplode(F.arrays_zip(all_of(F.col("line"), pat.CALL, 1).alias("callee"), all_of(F.col("line"), pat.CALL, 2).alias("args"))).alias("pos", "c"))
    kept = found.where(~F.col("c.callee").startswith("EXEC") & ~F.col("c.callee").startswith("SQL"))
    return kept.select("name", "line_no", "pos", F.col("c.callee").alias("callee"), strip(F.col("c.args")).alias("args"), F.col("more").alias("comment"))


def error_handlers(functions: DataFrame, name: str = "name", body: str = "body", reach: int = 4) -> DataFrame:
    """name, line_no, condition, action of each check of the SQL state; the action is what the next lines set or return."""

    def action(ls: Column, i: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.slice(ls, i + 2, reach), strip), lambda x: x.contains("return") | x.contains("err_cd") | x.contains("err_msg")), " | ")

    each = _lines_with(functions, name, body, lambda x: x.rlike(pat.SQLCA), action)
    return each.select("name", "line_no", strip(F.col("line")).alias("condition"), F.col("more").alias("action"))


def summary(functions: DataFrame) -> DataFrame:
    """name, description, input_fields, output_fields, host_variables of each function."""
    return functions.select("name", "description", fields(F.col("body"), "in").alias("input_fields"), fields(F.col("body"), "out").alias("output_fields"), host_variables(F.col("body")).alias("host_variables"))
