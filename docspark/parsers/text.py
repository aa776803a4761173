"""Plain text as elements, in column expressions only: runs of lines that aren't blank are paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from docspark.functions.text import BLANK, col, let, strip, unix_lines
from docspark.types import ELEMENT, LOCATOR, PARSED, WARNING


def paragraphs(text: Column | str) -> Column:
    """array<struct<line:int, content:string>>: each run with the number of its first line. Null for null.

    A run begins at a line that isn't blank and follows a blank one or the start, and ends before the next blank one or the
    end; firsts and lasts pair up by position. Row-local, and linear in the lines.
    """

    def runs(lines: Column, full: Column) -> Column:
        at = lambda i: F.get(full, i)
        edge = lambda step: F.filter(F.transform(full, lambda f, i: F.when(f & ~F.coalesce(at(i + step), F.lit(False)), i)), lambda i: i.isNotNull())
        run = lambda first, last: F.struct((first + 1).alias("line"), strip(F.array_join(F.slice(lines, first + 1, last - first + 1), "\n")).alias("content"))
        return F.zip_with(edge(-1), edge(1), run)

    has = lambda line: F.regexp_like(line, F.lit(f"[^{BLANK}]"))
    return let(F.split(unix_lines(col(text)), "\n"), lambda lines: let(F.transform(lines, has), lambda full: runs(lines, full)))


def _typed(ddl: str, **values: Column) -> Column:
    """A struct of a DDL type: the values given, and nulls for the rest."""
    kind = DataType.fromDDL(ddl)
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])


def parsed(text: Column | str, document: Column | str) -> Column:
    """The paragraphs of `text` in the form of types.PARSED; null for null."""
    place = lambda r: _typed(LOCATOR, family=F.lit("line_address"), line=r["line"])
    element = lambda r, i: _typed(ELEMENT, ord=i, element_id=F.concat(col(document), F.format_string("::e%04d", i)), type=F.lit("paragraph"), content=r["content"], source_locator=place(r), confidence=F.lit(0.95), metadata=F.lit("{}"))
    nothing = F.array(_typed(WARNING, code=F.lit("text_no_content"), reason=F.lit("text_no_content")))
    whole = let(paragraphs(text), lambda runs: _typed(PARSED, elements=F.transform(runs, element), warnings=F.when(F.size(runs) == 0, nothing).otherwise(F.array()), metadata=F.lit('{"text": true}')))
    return F.when(col(text).isNotNull(), whole)
