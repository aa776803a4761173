"""Text that an extraction library returns as a whole: cut at blank lines, its headings guessed by form.

Where the library itself (kreuzberg) isn't installed, its parser answers `kreuzberg_unavailable`.
"""

from __future__ import annotations

import re

from docspark.parsers.base import Output, ParseError

#: Fixed value: a marked heading.
MARKED = re.compile(r"\s*(?P<marks>#{1,6})\s+(?P<text>\S.*?)\s*$")
#: The longest line taken for a heading, and the marks that end a sentence.
SHORT, ENDS = 80, ("。", ".", "!", "?", "！", "？")


def heading(line: str) -> tuple[int, str] | None:
    """(level, text) of a block's first line if it looks like a heading; level 0 if only its shortness says so."""
    if m := MARKED.match(line):
        return len(m["marks"]), m["text"]
    bare = line.strip()
    return (0, bare) if bare and len(bare) <= SHORT and not bare.endswith(ENDS) else None


def blocks(content: str, document_id: str, source_type: str, tables: list[str] | None = None) -> Output:
    """Elements of extracted content. Locators only tell the order of blocks, so they are marked as placeholders."""
    out, n = Output(document_id, confidence=0.5), 0

    def add(kind: str, text: str, confidence: float, **metadata) -> None:
        nonlocal n
        place = {"family": "page_geometry", "page": 1, "extra": {"_kreuzberg_placeholder": "true"}} if source_type == "pdf" else {"family": "structural_index", "paragraph_index": n, "extra": {"_kreuzberg_heuristic": "true"}}
        out.add(kind, text, place, confidence=confidence, **metadata)
        n += 1

    for block in filter(None, (b.strip() for b in re.split(r"\n\s*\n", content))):
        first, *rest = block.splitlines()
        if found := heading(first):
            level, text = found
            add("heading", text, 0.6, level=level, heuristic=None if level else "short_line")
            block = "\n".join(rest).strip()
        if block:
            add("paragraph", block, 0.5, kreuzberg_heuristic=True)
    for text in filter(None, tables or []):
        add("table", text, 0.6, source="kreuzberg")
    if not out.elements:
        out.warn("kreuzberg_no_structured_elements")
    elif source_type == "pdf":
        out.warn("kreuzberg_pdf_no_bbox")
    return out


def parse(data: bytes, document_id: str) -> Output:
    """The blocks of what the library returns as text, then its tables."""
    try:
        import kreuzberg
    except ImportError as e:
        raise ParseError("kreuzberg_unavailable", "the extraction library is not installed") from e
    kind = "docx" if data[:2] == b"PK" else "pdf"
    mime = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pdf": "application/pdf"}[kind]
    try:
        found = kreuzberg.extract_bytes_sync(data, mime)
    except Exception as e:
        raise ParseError("kreuzberg_extract_failed", str(e)[:500], {"exception_type": type(e).__name__}) from e
    return blocks(found.content or "", document_id, kind, [t.markdown for t in getattr(found, "tables", None) or []])
