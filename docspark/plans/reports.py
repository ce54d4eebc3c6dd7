"""Report renderers: Markdown, HTML and JSON from rows already aggregated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from docspark.functions.text import html_escape, markdown_cell


def rows_of(df: DataFrame, most: int = 1000) -> list[dict]:
    """A report's rows; a report has a bounded number of them."""
    out = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(out) > most:
        raise ValueError(f"a report table has at most {most} rows")
    return out


def to_markdown(title: str, tables: dict[str, list[dict]]) -> str:
    parts = [f"# {title}"]
    for name, rows in tables.items():
        cols = list(rows[0]) if rows else []
        parts += ["", f"## {name}", "", "| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
        parts += ["| " + " | ".join(markdown_cell(str(r[c])) for c in cols) + " |" for r in rows]
    return "\n".join(parts) + "\n"


def to_html(title: str, tables: dict[str, list[dict]]) -> str:
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html_escape(title)}</title><h1>{html_escape(title)}</h1>"]
    for name, rows in tables.items():
        cols = list(rows[0]) if rows else []
        parts.append(f"<h2>{html_escape(name)}</h2><table><tr>" + "".join(f"<th>{html_escape(c)}</th>" for c in cols) + "</tr>")
        parts += ["<tr>" + "".join(f"<td>{html_escape(str(r[c]))}</td>" for c in cols) + "</tr>" for r in rows]
        parts.append("</table>")
    return "\n".join(parts) + "\n"


def to_json(title: str, tables: dict[str, list[dict]]) -> str:
    return json.dumps({"title": title, "tables": tables}, indent=2, default=str, sort_keys=True) + "\n"


def write(base: str, title: str, tables: dict[str, list[dict]]) -> None:
    for ext, render in (("md", to_markdown), ("html", to_html), ("json", to_json)):
        with open(f"{base}.{ext}", "w", encoding="utf-8") as f:
            f.write(render(title, tables))


def flatten(value, path: str = "") -> list[tuple[str, str]]:
    """(path, value) of every leaf, for comparing two reports."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in flatten(value[k], f"{path}.{k}" if path else str(k))]
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in flatten(v, f"{path}[{k}]")]
    return [(path, json.dumps(value))]
