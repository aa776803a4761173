"""What parsers share: collecting elements, and running a parser over a column."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from docspark.plans.local import with_local
from docspark.types import PARSED


class ParseError(Exception):
    """A failure of one document, with the code that its error carries."""

    def __init__(self, code: str, message: str = "", details: dict | None = None):
        super().__init__(message or code)
        self.code, self.message, self.details = code, message or code, details


@dataclass
class Sections:
    """The headings above a position."""

    stack: list[tuple[int, str]] = field(default_factory=list)

    def enter(self, level: int, title: str) -> None:
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))

    def path(self) -> str | None:
        return " > ".join(t for _, t in self.stack) or None


@dataclass
class Output:
    """Elements and warnings of one document, in order."""

    document_id: str
    confidence: float = 0.95
    elements: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def add(self, kind: str, content: str | None, locator: dict, /, resource: str | None = None, confidence: float | None = None, **metadata) -> None:
        n = len(self.elements)
        self.elements.append(
            {
                "ord": n,
                "element_id": f"{self.document_id}::e{n:04d}",
                "type": kind,
                "content": content,
                "resource_path": resource,
                "parent_id": None,
                "source_locator": locator,
                "confidence": self.confidence if confidence is None else confidence,
                "metadata": json.dumps(metadata, ensure_ascii=False, sort_keys=True),
            }
        )

    def warn(self, code: str, reason: str = "", /, **details) -> None:
        self.warnings.append({"code": code, "reason": reason or code, "details": json.dumps(details, ensure_ascii=False, sort_keys=True) if details else None})

    def result(self) -> dict:
        return {"elements": self.elements, "warnings": self.warnings, "error": None, "metadata": json.dumps(self.metadata, ensure_ascii=False, sort_keys=True)}


def failure(code: str, message: str, details: dict | None = None) -> dict:
    return {"elements": [], "warnings": [], "error": {"code": code, "message": message, "details": json.dumps(details) if details else None}, "metadata": None}


def guarded(parse: Callable[[object, str], Output]) -> Callable[[object, str], dict | None]:
    """A parser that answers every input: null gives null, a failure gives an error."""

    def run(content: object, document_id: str) -> dict | None:
        if content is None:
            return None
        try:
            return parse(content, document_id or "doc").result()
        except ParseError as e:
            return failure(e.code, e.message, e.details)
        except Exception as e:  # noqa: BLE001 - a document must not end the job
            return failure("unexpected_parser_error", str(e)[:500], {"exception_type": type(e).__name__})

    return run


def parse_column(df: DataFrame, content: str, document_id: str, parse: Callable[[object, str], Output], keep: list[str] | None = None) -> DataFrame:
    """`df` with `parsed` (see types.PARSED). Row-local; the content itself is kept only if `keep` names it."""
    return with_local(df, "parsed", PARSED, guarded(parse), content, document_id, keep=keep)


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    return enumerate(text.splitlines(), 1)
