"""Markdown of catalog results, for a person or a tool to read."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby


def services(rows: Iterable) -> str:
    return "\n".join(f"{r['name']:<16} {(r['description'] or '')[:38]}" for r in rows)


def candidates(found: dict | None) -> str:
    if not found:
        return "No match."
    out = [f"## {found['matched_function']}", found["description"] or "", "", "| candidate | score |", "|---|---:|"]
    out += [f"| {c['name']} | {c['score']} |" for c in found["candidates"]]
    return "\n".join(out)


def tree(rows: Iterable) -> str:
    return "\n".join(f"{'  ' * (r['depth'] - 1)}- {r['caller']} -> {r['callee']}" for r in rows) or "No calls."


def impact(kind: str, name: str, rows: Iterable = ()) -> str:
    if kind == "unknown":
        return f"{name} is no known function or table."
    rows = sorted(rows, key=lambda r: r["depth"])
    out = [f"## Impact of {name}: {len(rows)}"]
    for depth, group in groupby(rows, key=lambda r: r["depth"]):
        out.append(f"### depth {depth}")
        out += [f"- {r['name']}: {r['description']}" for r in group]
    return "\n".join(out)


def flow(rows: Iterable) -> str:
    out = []
    for r in rows:
        ops = ", ".join(f"{o['operation']} {o['table_name']}" for o in r["sql_operations"])
        out.append(f"{'  ' * r['depth']}- {r['name']}" + (f" [{ops}]" if ops else ""))
    return "\n".join(out) or "No such entry."


def occurrences(code: str, rows: Iterable) -> str:
    out = [f"### {r['function_name']} ({r['file_path']}:{r['line_no']})\n{r['error_message']}\n```c\n{r['context']}\n```" for r in rows]
    return "\n\n".join(out) or f"{code} is set nowhere."


def comparison(metrics: Iterable, averages: Iterable) -> str:
    cells = ("precision", "recall", "noise_ratio", "context_completeness")
    head = "| query | strategy | " + " | ".join(cells) + " |\n|---|---|" + "---:|" * len(cells)
    line = lambda q, r: f"| {q} | {r['strategy']} | " + " | ".join(f"{r[c]:.3f}" for c in cells) + " |"
    return "\n".join([head, *(line(r["query"], r) for r in metrics), *(line("mean", r) for r in averages)])


def fenced(path: str, text: str) -> str:
    """A file's text in a block marked with its language."""
    language = {"pc": "c", "c": "c", "h": "c", "sql": "sql", "py": "python", "xml": "xml"}.get(path.rpartition(".")[2].lower(), "")
    return f"```{language}\n{text}\n```"


def diff(text: str) -> str:
    return f"```diff\n{text}\n```" if text.strip() else "No changes."


def files(rows: Iterable) -> str:
    """Related files with their roles."""
    return "\n".join(f"- {r['filename']} ({r['role']})" for r in rows) or "No files."


def analysis(name: str, statements: Iterable, calls: Iterable, errors: Iterable, raw_body: str | None = None) -> str:
    seen, out = set(), [f"## {name}", "### Statements"]
    out += [f"- L{s['line_no']} {s['operation']} {', '.join(s['tables'])}" for s in statements]
    out.append("### Calls")
    for c in calls:
        if c["callee"] not in seen:
            seen.add(c["callee"])
            out.append(f"- L{c['line_no']} {c['callee']}({c['args']})")
    out.append("### Errors")
    out += [f"- L{e['line_no']} {e['condition']}: {e['action']}" for e in errors]
    if raw_body is not None:
        out += ["### Body", fenced(f"{name}.pc", raw_body)]
    return "\n".join(out)


def status(rows: Iterable) -> str:
    return "\n".join(f"- {r['code']} ({r['label']}) {r['path']}" for r in rows) or "Clean."


def log(rows: Iterable) -> str:
    return "\n\n".join(f"### {r['revision']}\n{r['author']}, {r['date']}\n{r['message']}\n" + "\n".join(f"- {c}" for c in r["changed"]) for r in rows) or "No entries."


def blame(rows: Iterable) -> str:
    escaped = ((r, r["content"].replace("|", "\\|")) for r in rows)
    return "\n".join(["| Line | Rev | Author | Content |", "|---:|---:|---|---|", *(f"| {r['line']} | {r['revision']} | {r['author']} | {c} |" for r, c in escaped)])
