"""Parsing operators: C functions with embedded SQL, structs and table definitions.

Only the cutting of function bodies, which needs brace matching, runs in Python
(one Arrow pass over the files); statements, tables, calls, fields and columns are
column expressions.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import BLOCK_COMMENT, all_of, listed, or_null, strip
from lodestone.operators import patterns as pat
from lodestone.plans.store import settled

#: Characters before a function in which its own comment may stand.
NEAR = 200
RAW = "ord array<string>, file string, name string, params_raw string, body string, before string, text string, pos int"


def functions_of(text: str) -> list[tuple[str, str, str, str]]:
    """Name, parameter list, body and the text just before, of each function of a file.

    A body runs from its first brace to the one that balances it, or to the end;
    braces in strings and comments count.
    """
    braces = [(m.start(), 1 if m[0] == "{" else -1) for m in re.finditer(r"[{}]", text)]
    where = {p: i for i, (p, _) in enumerate(braces)}
    level = [0, *accumulate(d for _, d in braces)]
    out = []
    for m in re.finditer(pat.FUNCTION_START, text, re.M):
        open_at = text.index("{", m.start())
        i = where[open_at]
        end = next((braces[j][0] + 1 for j in range(i, len(braces)) if level[j + 1] <= level[i]), len(text))
        out.append((m[1], m[2].strip(), text[open_at:end], text[max(0, m.start() - NEAR) : m.start()]))
    return out


def raw_functions(files: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in RAW.split(", ")]
    types = (pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())

    def run(batches):
        for batch in batches:
            rows = [(o, f, *fn[:4], t, i) for o, f, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, fn in enumerate(functions_of(t or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.where(F.col("ext") == "pc").select("ord", "file", "text").mapInArrow(run, RAW)


def place(*extra: Column) -> Column:
    """An order key: the file's, then positions within it."""
    return F.concat(F.col("ord"), F.array(*[F.lpad(e.cast("string"), 9, "0") for e in extra]))


def statement_texts(body: Column) -> Column:
    """Embedded statements in order, without declarations and includes."""
    return F.filter(F.transform(all_of(body, pat.SQL_BLOCK), strip), lambda s: ~s.rlike(pat.NO_STATEMENT))


def operation(s: Column) -> Column:
    """Class of a statement, by the first pattern of this order that occurs anywhere in it."""
    first, *rest = pat.OPERATIONS
    out = F.when(s.rlike(first[1]), first[0])
    for name, pattern in rest:
        out = out.when(s.rlike(pattern), name)
    return out.otherwise("OTHER")


def statement_tables(s: Column, op: Column) -> Column:
    """Tables of a statement; those of a SELECT keep repeats."""
    named = all_of(s, pat.TABLE_NAMES)
    joined = F.filter(all_of(s, pat.JOINED), lambda t: F.upper(t).startswith("TB_"))
    out = F.when(op == "SELECT", F.concat(named, F.array_distinct(F.array_except(joined, named))))
    for name, pattern in pat.TARGETS.items():
        out = out.when(op == name, all_of(s, pattern))
    return out.otherwise(F.array().cast("array<string>"))


def select_columns(s: Column, op: Column) -> Column:
    """Names between SELECT and INTO, without qualifiers; split at every comma."""
    part = F.regexp_extract(s, pat.SELECTED, 1)
    bare = F.transform(F.split(part, ","), lambda c: F.regexp_replace(F.substring_index(strip(c), ".", -1), "^:+", ""))
    return F.when(op == "SELECT", F.filter(bare, lambda c: (c != "") & (c != "*"))).otherwise(F.array().cast("array<string>"))


def statements(text: Column) -> Column:
    """ARRAY<STRUCT<operation, tables, columns, raw_sql>> of a body."""
    return F.transform(
        statement_texts(text),
        lambda s: F.struct(operation(s).alias("operation"), statement_tables(s, operation(s)).alias("tables"), select_columns(s, operation(s)).alias("columns"), F.concat(F.lit("EXEC SQL "), s, F.lit(";")).alias("raw_sql")),
    )


def calls(body: Column, own: Column) -> Column:
    """Sorted distinct names called in a body; comments are not told from code."""
    names = all_of(F.regexp_replace(body, pat.SQL_BLOCK, ""), pat.CALLED)
    known = F.array(*[F.lit(w) for w in pat.NOT_CALLS])
    return F.array_sort(F.filter(F.array_distinct(F.array_except(names, known)), lambda c: (c != own) & ~c.startswith("TB_") & ~c.startswith("SQ_")))


def includes(text: Column) -> Column:
    return all_of(text, pat.INCLUDE)


def description(before: Column, text: Column) -> Column:
    """The last comment just before a function, else the file's first, else empty."""
    near = F.try_element_at(all_of(before, BLOCK_COMMENT), F.lit(-1))
    return strip(F.coalesce(near, F.try_element_at(all_of(text, BLOCK_COMMENT), F.lit(1)), F.lit("")))


def parse_functions(files: DataFrame) -> DataFrame:
    """functions: ord, name, file_path, description, body, params, statements, calls, tables_used, includes."""
    f = raw_functions(files)
    f = f.select(
        place(F.col("pos")).alias("ord"), "name", F.col("file").alias("file_path"), description(F.col("before"), F.col("text")).alias("description"), "body",
        listed(F.col("params_raw")).alias("params"), statements(F.col("body")).alias("statements"), calls(F.col("body"), F.col("name")).alias("calls"), includes(F.col("text")).alias("includes"),
    )
    return f.withColumn("tables_used", F.array_distinct(F.flatten(F.transform("statements", lambda s: s["tables"]))))


def struct_fields(body: Column) -> Column:
    parts = F.arrays_zip(*[all_of(body, pat.FIELD, g).alias(n) for g, n in ((1, "t"), (2, "n"), (3, "s"), (4, "c"))])
    return F.transform(parts, lambda f: F.struct(f["n"].alias("name"), strip(f["t"]).alias("c_type"), or_null(F.regexp_replace(f["s"], r"[\[\] ]", "")).alias("size"), or_null(f["c"]).alias("comment")))


def parse_structs(files: DataFrame) -> DataFrame:
    """structs: ord, name, file_path, description, fields."""
    h = files.where(F.col("ext") == "h")
    first = strip(F.coalesce(F.try_element_at(all_of(F.col("text"), BLOCK_COMMENT), F.lit(1)), F.lit("")))
    each = h.select("ord", "file", first.alias("description"), F.posexplode(F.arrays_zip(all_of(F.col("text"), pat.STRUCT, 1).alias("body"), all_of(F.col("text"), pat.STRUCT, 2).alias("name"))).alias("pos", "s"))
    return each.select(place(F.col("pos")).alias("ord"), F.col("s.name").alias("name"), F.col("file").alias("file_path"), "description", struct_fields(F.col("s.body")).alias("fields"))


def table_columns(body: Column) -> Column:
    """Columns of a definition; ``default`` keeps what follows to the next space, ``default_clean`` drops a last comma."""
    parts = F.arrays_zip(*[all_of(body, pat.COLUMN, g).alias(n) for g, n in ((1, "n"), (2, "t"), (3, "s"), (4, "nn"), (5, "d"))])

    def made(c: Column) -> Column:
        default = or_null(strip(F.replace(c["d"], F.lit("DEFAULT "), F.lit(""))))
        return F.struct(c["n"].alias("name"), F.concat(c["t"], c["s"]).alias("data_type"), (c["nn"] == "").alias("nullable"), default.alias("default"), F.regexp_replace(default, ",$", "").alias("default_clean"))

    return F.transform(parts, made)


def parse_tables(files: DataFrame) -> DataFrame:
    """tables_ddl: ord, name, file_path, comment, columns, primary_key."""
    sql = files.where(F.col("ext") == "sql")
    each = sql.select("ord", "file", "text", F.posexplode(F.arrays_zip(all_of(F.col("text"), pat.TABLE, 1).alias("name"), all_of(F.col("text"), pat.TABLE, 2).alias("body"))).alias("pos", "t"))
    comment = F.when(F.regexp_extract("text", pat.TABLE_COMMENT, 1) == F.col("t.name"), or_null(F.regexp_extract("text", pat.TABLE_COMMENT, 2)))
    return each.select(
        place(F.col("pos")).alias("ord"), F.col("t.name").alias("name"), F.col("file").alias("file_path"), comment.alias("comment"), table_columns(F.col("t.body")).alias("columns"),
        listed(F.regexp_extract("t.body", pat.PRIMARY_KEY, 1)).alias("primary_key"),
    )


def spark_type(data_type: Column) -> Column:
    """Our extension: the Spark type that a column type of a definition stands for."""
    return (
        F.when(data_type.rlike(r"(?i)^(VARCHAR2|CHAR)"), "string")
        .when(data_type.rlike(r"(?i)^NUMBER\s*\(\d+\s*,\s*\d+\)"), F.concat(F.lit("decimal"), F.regexp_extract(data_type, r"(\(.*\))", 1)))
        .when(data_type.rlike(r"(?i)^NUMBER\s*\(\d+\)"), F.concat(F.lit("decimal("), F.regexp_extract(data_type, r"\((\d+)", 1), F.lit(",0)")))
        .when(data_type.rlike(r"(?i)^NUMBER"), "decimal(38,10)")
        .otherwise("timestamp")
    )


def last_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """One row for each key, the last in order: an aggregate, so it combines before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("row")).select(key, "row.*").select(*df.columns)


def parsed_rows(files: DataFrame) -> dict[str, DataFrame]:
    """The five relations before names are made unique, in order of paths, each row with its file's path as ``source``.

    Functions are cut and parsed once and written; three of the relations derive from that table.
    """
    files = files.withColumn("ord", F.split("file_path", "/"))
    placed = lambda df: df.withColumn("source", F.array_join(F.slice("ord", 1, F.size("ord") - 1), "/"))
    parsed = settled(placed(parse_functions(files)))
    usage = parsed.select("source", "ord", "name", F.posexplode("statements").alias("si", "s")).select("source", "ord", "name", "si", "s", F.posexplode("s.tables").alias("ti", "table_name"))
    return {
        "functions": parsed.drop("statements", "calls"),
        "function_calls": parsed.select(F.col("name").alias("caller"), F.explode("calls").alias("callee"), "source").distinct(),
        "sql_usage": usage.select(place(F.col("si"), F.col("ti")).alias("ord"), F.col("name").alias("function_name"), "table_name", F.col("s.operation").alias("operation"), F.col("s.raw_sql").alias("raw_sql"), "source"),
        "structs": placed(parse_structs(files)),
        "tables_ddl": placed(parse_tables(files)),
    }


def relations(files: DataFrame) -> dict[str, DataFrame]:
    """The five relations of a source tree: names unique (the last wins), edges a set, usage a bag.

    Functions are cut and parsed once and written; three of the relations derive from that table.
    """
    parsed = settled(parse_functions(files))
    kept = last_wins(parsed, "name")
    usage = parsed.select("ord", "name", F.posexplode("statements").alias("si", "s")).select("ord", "name", "si", "s", F.posexplode("s.tables").alias("ti", "table_name"))
    return {
        "functions": kept.drop("statements", "calls"),
        "function_calls": parsed.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct(),
        "sql_usage": usage.select(place(F.col("si"), F.col("ti")).alias("ord"), F.col("name").alias("function_name"), "table_name", F.col("s.operation").alias("operation"), F.col("s.raw_sql").alias("raw_sql")),
        "structs": last_wins(parse_structs(files), "name"),
        "tables_ddl": last_wins(parse_tables(files), "name"),
    }
