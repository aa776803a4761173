"""DOCX as elements, read from the package's XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from docspark.functions.tables import python_linearize
from docspark.parsers.base import Output, ParseError

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Fixed value: how a caption begins.
CAPTION = re.compile(r"\s*(?:Table|Figure|Fig\.?|表|图)\s*[0-9０-９]+[\.、:：]", re.I)
EMPTY = "(空段落)"  # fixed: the content of an empty paragraph


def flow(node: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables in reading order, also those within content controls."""
    for child in node:
        if child.tag in (f"{W}p", f"{W}tbl"):
            yield child
        elif child.tag == f"{W}sdt":
            for content in child.findall(f"{W}sdtContent"):
                yield from flow(content)


def text_of(paragraph: ElementTree.Element) -> str:
    out = []
    for node in paragraph.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag in (f"{W}tab",) and node.get(f"{W}val") is None:
            out.append("\t")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def rows_of(table: ElementTree.Element) -> list[list[str]]:
    """The cells' text; a merged cell repeats its content in each place that it covers."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            text = "\n".join(text_of(p) for p in tc.findall(f"{W}p"))
            if merge is not None and merge.get(f"{W}val", "continue") != "restart" and rows and len(rows[-1]) > len(row):
                text = rows[-1][len(row)]
            row += [text] * max(1, int(span.get(f"{W}val", "1")) if span is not None else 1)
        rows.append(row)
    return rows


def heading(style: str) -> int | None:
    """The level that a style's name gives."""
    name = style.strip().lower()
    if name == "title":
        return 1
    if name.startswith("heading"):
        number = name.removeprefix("heading").strip()
        return max(1, int(number)) if re.fullmatch(r"-?\d+", number) else 1
    return None


def parse(data: bytes, document_id: str) -> Output:
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError("docx_open_failed", str(e)) from e
    names: dict[str, str] = {}
    if "word/styles.xml" in package.namelist():
        for style in ElementTree.fromstring(package.read("word/styles.xml")).findall(f"{W}style"):
            name = style.find(f"{W}name")
            names[style.get(f"{W}styleId", "")] = name.get(f"{W}val", "") if name is not None else ""
    targets: dict[str, str] = {}
    if "word/_rels/document.xml.rels" in package.namelist():
        for link in ElementTree.fromstring(package.read("word/_rels/document.xml.rels")):
            target = link.get("Target", "")
            targets[link.get("Id", "")] = target if link.get("TargetMode") == "External" else posixpath.normpath(posixpath.join("/word", target))
    out = Output(document_id, confidence=0.9, metadata={"docx": True})
    paragraphs = tables = 0
    for node in flow(body if body is not None else ElementTree.Element("none")):
        if node.tag == f"{W}tbl":
            rows = rows_of(node)
            if rows:
                out.add("table", python_linearize(rows), {"family": "structural_index", "table_index": tables, "section": 0}, row_count=len(rows), col_count=max(map(len, rows)), source="python-docx")
            tables += 1
            continue
        place = {"family": "structural_index", "paragraph_index": paragraphs, "section": 0}
        text, style = text_of(node).strip(), node.find(f"{W}pPr/{W}pStyle")
        name = names.get(style.get(f"{W}val", ""), "") if style is not None else ""
        if not text:
            out.add("paragraph", EMPTY, place, empty=True)
        elif CAPTION.match(text):
            out.add("caption", text, place, heuristic="caption_regex")
        elif level := heading(name):
            out.add("heading", text, place, level=level, style=name)
        else:
            out.add("paragraph", text, place, style=name)
        for blip in node.iter(f"{A}blip"):
            if link := blip.get(f"{R}embed") or blip.get(f"{R}link"):
                out.add("image", None, {**place, "relationship_id": link, "target_partname": targets.get(link)}, resource=targets.get(link) or link)
        paragraphs += 1
    return out
