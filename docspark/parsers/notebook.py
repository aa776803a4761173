"""Notebooks (nbformat 4) as elements: Markdown cells through the Markdown parser, code and raw cells as paragraphs."""

from __future__ import annotations

import json

from docspark.parsers import markdown
from docspark.parsers.base import Output, ParseError


def _whole(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool)


def source_text(source: object) -> str | None:
    """A cell's source: a string, or a list of strings to be joined; null for anything else."""
    if isinstance(source, str):
        return source
    if isinstance(source, list) and all(isinstance(x, str) for x in source):
        return "".join(source)
    return None


def language(metadata: object) -> str:
    """The kernel's language, the one of language_info, or none."""
    for holder, key in (("kernelspec", "language"), ("language_info", "name")):
        value = metadata.get(holder, {}) if isinstance(metadata, dict) else {}
        value = value.get(key) if isinstance(value, dict) else None
        if isinstance(value, str) and value:
            return value
    return ""


def parse(text: str, document_id: str) -> Output:
    try:
        book = json.loads(text)
    except ValueError as e:
        raise ParseError("ipynb_invalid_json", str(e)) from e
    if not isinstance(book, dict):
        raise ParseError("ipynb_bad_structure", "no object at the top")
    if not _whole(major := book.get("nbformat")):
        raise ParseError("ipynb_bad_structure", "nbformat is no integer", {"field": "nbformat"})
    if major != 4:
        raise ParseError("ipynb_unsupported_version", f"nbformat {major}", {"nbformat": major})
    if not _whole(minor := book.get("nbformat_minor")) or minor < 0:
        raise ParseError("ipynb_bad_structure", "nbformat_minor is no natural number", {"field": "nbformat_minor"})
    cells = book.get("cells") or []
    if not isinstance(cells, list):
        raise ParseError("ipynb_bad_structure", "cells is no array")
    speaks = language(book.get("metadata"))
    out = Output(document_id, metadata={"ipynb": True, "nbformat": major, "nbformat_minor": minor, "cell_count": len(cells), "language": speaks})
    for n, cell in enumerate(cells):
        if not isinstance(cell, dict):
            out.warn("ipynb_bad_cell", cell_index=n)
            continue
        for key, kind in (("outputs", list), ("attachments", dict)):
            if isinstance(held := cell.get(key), kind) and held:
                out.warn(f"ipynb_{key}_ignored", cell_index=n, count=len(held))
        kind, source = cell.get("cell_type") or "unknown", source_text(cell.get("source"))
        if source is None:
            out.warn("ipynb_bad_cell", cell_index=n, field="source")
        elif kind == "markdown":
            _markdown_cell(source, n, out)
        elif kind not in ("code", "raw"):
            out.warn("ipynb_unknown_cell_type", cell_index=n, cell_type=str(kind))
        elif source.strip():
            role = {"kind": "code_cell", "language": speaks} if kind == "code" else {"kind": "raw_cell"}
            out.add("paragraph", source, {"family": "container_line", "cell_index": n, "cell_type": kind, "line": 1}, **role)
        elif kind == "code":
            out.warn("ipynb_empty_code_cell", cell_index=n)
    if not out.elements:
        out.warn("ipynb_no_content")
    return out


def _markdown_cell(source: str, n: int, out: Output) -> None:
    inner = Output(out.document_id)
    markdown.body(source, inner, lambda line, path: {"family": "container_line", "cell_index": n, "cell_type": "markdown", "line": line, "section_path": path})
    for w in inner.warnings:
        out.warn(w["code"], w["reason"], **json.loads(w["details"] or "{}"), cell_index=n)
    for e in inner.elements:
        metadata = json.loads(e["metadata"])
        if e["type"] == "image" and e["resource_path"].startswith("attachment:"):
            out.warn("ipynb_attachment_ref_skipped", cell_index=n, ref=e["resource_path"], alt=metadata.get("alt", ""))
        else:
            out.add(e["type"], e["content"], e["source_locator"], resource=e["resource_path"], **metadata)
