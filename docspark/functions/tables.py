"""Pipe tables: cells of a row, and rows as one table in canonical form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import col, let, strip


def pipe_cells(row: Column | str) -> Column:
    """The cells of a pipe row: split at bars without a backslash, stripped, with escaped bars restored."""
    inner = F.regexp_replace(F.regexp_replace(strip(row), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def cell(x: Column) -> Column:
    """A cell's canonical form: one line, bars escaped."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "\n", "<br>")
    return strip(F.replace(one, F.lit("|"), F.lit("\\|")))


def linearize(rows: Column | str) -> Column:
    """array<array<string>> as a pipe table: head, rule, body; rows padded to the widest. No rows give the empty string."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def whole(rows: Column, width: Column) -> Column:
        padded = lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r))))
        rule = F.array(line(F.array_repeat(F.lit("---"), width)))
        return let(F.transform(rows, lambda r: line(padded(r))), lambda body: F.array_join(F.concat(F.slice(body, 1, 1), rule, F.slice(body, F.lit(2), F.greatest(F.lit(0), F.size(body) - 1))), "\n"))

    table = let(col(rows), lambda r: let(F.array_max(F.transform(r, F.size)), lambda w: whole(r, w)))
    return F.when(F.size(rows) > 0, table).otherwise("")


def python_cells(row: str) -> list[str]:
    """`pipe_cells` for parsers that work in Python."""
    inner = row.strip().removeprefix("|")
    inner = inner.removesuffix("|")
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


def python_linearize(rows: list[list[str | None]]) -> str:
    """`linearize` for parsers that work in Python."""
    if not rows:
        return ""
    width = max(map(len, rows))
    text = [[re.sub(r"\r\n?|\n", "<br>", c or "").replace("|", "\\|").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    text.insert(1, ["---"] * width)
    return "\n".join(f"| {' | '.join(r)} |" for r in text)
