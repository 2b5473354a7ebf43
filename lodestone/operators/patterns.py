"""Fixed values of the source language: its patterns and word lists, which right results depend on.

``(?U)`` makes \\w, \\s and \\b hold for all scripts, as names may be written in any.
"""

# Functions
FUNCTION_START = r"^int\s+([A-Z][A-Z0-9_]+)\s*\(([^)]*)\)\s*\{"
FUNCTION_LINE = r"int\s+([A-Z][A-Z0-9_]+)\s*\("
INCLUDE = r'(?U)#include\s+"([^"]+)"'
CALLED = r"(?U)\b([A-Z][A-Z0-9_]{2,})\s*\("
#: Words before a parenthesis that are no calls.
NOT_CALLS = (
    "EXEC", "SQL", "BEGIN", "END", "DECLARE", "SECTION", "SELECT", "INSERT",
    "UPDATE", "DELETE", "FROM", "WHERE", "INTO", "SET", "VALUES", "AND", "OR",
    "NOT", "NULL", "BETWEEN", "ORDER", "BY", "SYSDATE", "DUAL", "NEXTVAL",
    "CURRVAL", "LPAD", "SUM", "COUNT", "CONSTRAINT", "PRIMARY", "KEY",
    "DEFAULT", "CREATE", "TABLE", "COMMENT", "OPEN", "CLOSE", "FETCH",
    "CURSOR", "FOR", "INCLUDE", "SQLCA", "SUCCESS", "FAIL",
    "TO_CHAR", "TO_DATE", "VARCHAR2", "NUMBER", "CHAR",
)

# Embedded statements
SQL_BLOCK = r"(?isU)EXEC\s+SQL\s+(.*?);"
NO_STATEMENT = r"(?iU)^(BEGIN\s+DECLARE|END\s+DECLARE|INCLUDE)"
#: Classes of statements in the order in which they are tried, anywhere in the text.
OPERATIONS = (
    ("SELECT", r"(?isU)\bSELECT\b.*?\bFROM\s+\w+"),
    ("INSERT", r"(?iU)\bINSERT\s+INTO\s+\w+"),
    ("UPDATE", r"(?iU)\bUPDATE\s+\w+"),
    ("DELETE", r"(?iU)\bDELETE\s+FROM\s+\w+"),
    ("DECLARE", r"(?iU)\bDECLARE\b"),
    ("CURSOR", r"(?iU)\bOPEN\b"),
)
TABLE_NAMES = r"(?iU)\b(TB_\w+|SQ_\w+)\b"
JOINED = r"(?iU)\b(?:FROM|JOIN)\s+(\w+)"
#: Tables of statements other than SELECT.
TARGETS = {"INSERT": r"(?iU)\bINSERT\s+INTO\s+(\w+)", "UPDATE": r"(?iU)\bUPDATE\s+(\w+)", "DELETE": r"(?iU)\bDELETE\s+FROM\s+(\w+)", "CURSOR": r"(?U)\b(TB_\w+)\b"}
SELECTED = r"(?isU)\bSELECT\s+(.*?)\s+INTO\b"

# Structs and table definitions
STRUCT = r"(?sU)typedef\s+struct\s*\{(.*?)\}\s*(\w+)\s*;"
FIELD = r"(?mU)^\s+([\w\s\*]+?)\s+(\w+)\s*(\[\s*\d+\s*\])?\s*;(?:\s*/\*\s*(.*?)\s*\*/)?"
TABLE = r"(?isU)CREATE\s+TABLE\s+(\w+)\s*\((.*?)\);"
COLUMN = r"(?imU)^\s+(\w+)\s+(VARCHAR2|NUMBER|CHAR|DATE|TIMESTAMP)\s*(\([^)]+\))?\s*(NOT\s+NULL)?\s*(DEFAULT\s+\S+)?"
TABLE_COMMENT = r"(?iU)COMMENT\s+ON\s+TABLE\s+(\w+)\s+IS\s+'([^']+)'"
PRIMARY_KEY = r"(?iU)PRIMARY\s+KEY\s*\(([^)]+)\)"

# Chunks: what lines of a file's head, and lines that lead up to a function, begin with
HEAD_LINE = ("/*", "*", "//", "#", "EXEC SQL INCLUDE")
LEAD_LINE = ("/*", "*")

# Search
NAME = r"(?U)\b([A-Z][A-Z0-9_]{3,})\b"
#: Upper-case words that name no function.
NOT_NAMES = (
    "EXEC", "SQL", "BEGIN", "END", "DECLARE", "SECTION", "SELECT", "INSERT",
    "UPDATE", "DELETE", "FROM", "WHERE", "INTO", "SET", "VALUES", "AND", "OR",
    "NOT", "NULL", "BETWEEN", "ORDER", "SYSDATE", "DUAL", "NEXTVAL",
    "CURRVAL", "LPAD", "SUM", "COUNT", "CONSTRAINT", "PRIMARY", "KEY",
    "DEFAULT", "CREATE", "TABLE", "COMMENT", "OPEN", "CLOSE", "FETCH",
    "CURSOR", "INCLUDE", "SQLCA", "SUCCESS", "FAIL", "VARCHAR2", "NUMBER",
    "CHAR", "TO_CHAR", "TO_DATE",
)
#: The header that every file includes and that is no part of a context.
COMMON_HEADER = "proframe.h"

# Analysis of bodies
FIRST_WORDS = "SELECT|INSERT|UPDATE|DELETE|DECLARE|OPEN|FETCH|CLOSE|COMMIT|ROLLBACK"
SQLCA = r"(?U)SQLCA\.sqlcode\s*!=\s*0|SQLCA\.sqlcode\s*<\s*0|SQLCA\.sqlerrd"
SIDE = r"(?U)\b{}->(\w+)"
USED = r"(?iU)\b(?:FROM|INTO|UPDATE|JOIN)\s+(\w+)"
INTO = r"(?iU)INTO\s+:(\w+)"
HOST_VARIABLE = r"(?U)^\s+\w+\s+(\w+)"
CALL = r"(?U)\b([A-Z][A-Z0-9_]{2,})\s*\(([^)]*)\)"

# Version control
STATUS = {"M": "Modified", "A": "Added", "D": "Deleted", "?": "Untracked", "!": "Missing", "C": "Conflict", "X": "External", "I": "Ignored", "~": "Type changed", "R": "Replaced"}
CHANGED_PATHS = r"(?m)^[ \t]*Changed paths:[ \t]*$((?:\n[ \t]*[MADR] .*)*)"
