"""HTML as elements: the tag stream is recorded, then reduced to blocks, lists and (nested) tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

from docspark.functions.tables import python_linearize
from docspark.parsers.base import Output, Sections

# Tags that head sections, and tags whose text isn't shown.
HEADINGS = {f"h{n}": n for n in range(1, 7)}
UNSEEN = {"script", "style", "head", "title", "meta", "link", "noscript"}


class _Recorder(HTMLParser):
    """Tags and text as (event, tag or text, attributes, line)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[str, str, dict, int]] = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag.lower(), {k: v or "" for k, v in attrs}, self.getpos()[0]))

    def handle_startendtag(self, tag, attrs):
        self.events.append(("single", tag.lower(), {k: v or "" for k, v in attrs}, self.getpos()[0]))

    def handle_endtag(self, tag):
        self.events.append(("close", tag.lower(), {}, self.getpos()[0]))

    def handle_data(self, data):
        self.events.append(("text", data, {}, self.getpos()[0]))


@dataclass
class _Table:
    """An open table: rows that are whole, the open row, and the text of the open cell."""

    line: int
    index: int
    rows: list[list[str]] = field(default_factory=list)
    row: list[str] | None = None
    cell: list[str] | None = None
    parted: bool = False  # the open cell held another table


@dataclass
class _Block:
    kind: str
    line: int
    level: int = 0
    ordered: bool = False
    text: list[str] = field(default_factory=list)


class _Reducer:
    def __init__(self, document_id: str):
        self.out, self.sections = Output(document_id), Sections()
        self.block: _Block | None = None
        self.tables: list[_Table] = []
        self.opened = 0
        self.unseen: list[str] = []
        self.lists: list[str] = []
        self.depth = {"pre": 0, "blockquote": 0}

    def locator(self, line: int) -> dict:
        return {"family": "line_address", "line": line, "section_path": self.sections.path()}

    def flush(self) -> None:
        block, self.block = self.block, None
        text = "".join(block.text).strip() if block else ""
        if not text:
            return
        if block.kind == "heading":
            self.sections.enter(block.level, text)
            self.out.add("heading", text, self.locator(block.line), level=block.level)
        elif block.kind == "list_item":
            self.out.add("list_item", text, self.locator(block.line), ordered=block.ordered, marker="ordered" if block.ordered else "unordered")
        else:
            role = {"pre": "preformatted", "blockquote": "blockquote"}.get(block.kind)
            self.out.add("paragraph", text, self.locator(block.line), **({"kind": role} if role else {}))

    def start(self, kind: str, line: int, **more) -> None:
        self.flush()
        self.block = _Block(kind, line, **more)

    def image(self, attributes: dict, line: int) -> None:
        if source := attributes.get("src", "").strip():
            self.flush()
            self.out.add("image", None, self.locator(line), resource=source, confidence=0.9, alt=attributes.get("alt", ""))

    def inline(self, tag: str, attributes: dict, line: int) -> bool:
        """img, br and hr, which hold nothing."""
        if tag == "img":
            self.image(attributes, line)
        elif tag == "br":
            if self.block:
                self.block.text.append(" ")
        elif tag == "hr":
            self.flush()
        else:
            return False
        return True

    # tables

    def cell_text(self, table: _Table, position: str, line: int) -> None:
        """Text beside a table in a cell becomes a paragraph that names the cell."""
        if text := "".join(table.cell or []).strip():
            place = {"table_index": table.index, "table_start_line": table.line, "row_index": len(table.rows), "cell_index": len(table.row or [])}
            self.out.add("paragraph", text, self.locator(line), confidence=0.9, origin="table_cell_text", position=position, **place)

    def close_cell(self, table: _Table, line: int) -> None:
        if table.parted:
            self.cell_text(table, "after_inner_table", line)
        if table.row is not None:
            table.row.append("" if table.parted else "".join(table.cell).strip())
        table.cell, table.parted = None, False

    def open_table(self, line: int) -> None:
        self.flush()
        if self.tables:
            outer = self.tables[-1]
            if outer.cell is not None:
                self.cell_text(outer, "before_inner_table", line)
                outer.cell, outer.parted = None, True
            self.out.warn("html_nested_table")
        self.tables.append(_Table(line, self.opened))
        self.opened += 1

    def close_table(self) -> None:
        table = self.tables.pop()
        if self.tables and self.tables[-1].parted and self.tables[-1].cell is None:
            self.tables[-1].cell = []
        if content := python_linearize(table.rows):
            size = {"row_count": len(table.rows), "col_count": max(map(len, table.rows))}
            self.out.add("table", content, self.locator(table.line), confidence=0.9, source="html_table", table_index=table.index, **size)

    def in_table(self, event: str, tag: str, attributes: dict, line: int) -> None:
        table = self.tables[-1]
        if event != "close":
            if tag == "img":
                self.image(attributes, line)
            elif tag == "tr":
                if table.row is not None:
                    if table.cell is not None and table.parted:
                        self.close_cell(table, line)
                    table.rows.append(table.row)
                table.row, table.cell, table.parted = [], None, False
            elif tag in ("td", "th"):
                table.row = [] if table.row is None else table.row
                if table.cell is not None:
                    self.close_cell(table, line)
                table.cell, table.parted = [], False
        elif tag in ("tr", "td", "th"):
            if table.cell is not None:
                self.close_cell(table, line)
            if tag == "tr" and table.row is not None:
                table.rows.append(table.row)
                table.row = None

    # events

    def opening(self, event: str, tag: str, attributes: dict, line: int) -> None:
        if event == "single" and self.inline(tag, attributes, line):
            return
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.append(tag)
        elif tag in UNSEEN:
            self.unseen.append(tag)
        elif tag == "table":
            self.open_table(line)
        elif self.tables:
            self.in_table(event, tag, attributes, line)
        elif tag in HEADINGS:
            self.start("heading", line, level=HEADINGS[tag])
        elif tag == "p":
            if not self.block:
                self.start("paragraph", line)
        elif tag == "li":
            self.start("list_item", line, ordered=self.lists[-1:] == ["ol"])
        elif tag in self.depth:
            self.depth[tag] += 1
            if self.depth[tag] == 1:
                self.start(tag, line)
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append(tag)
        else:
            self.inline(tag, attributes, line)

    def closing(self, tag: str, line: int) -> None:
        open_kind = self.block.kind if self.block else None
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
        elif self.tables:
            if tag == "table":
                self.close_table()
            else:
                self.in_table("close", tag, {}, line)
        elif tag in self.depth:
            if self.depth[tag]:
                self.depth[tag] -= 1
                if not self.depth[tag] and open_kind == tag:
                    self.flush()
        elif tag in ("ul", "ol"):
            if self.lists[-1:] == [tag]:
                self.lists.pop()
            self.flush()
        elif open_kind == {"p": "paragraph", "li": "list_item"}.get(tag, "heading" if tag in HEADINGS else ""):
            self.flush()

    def text(self, data: str, line: int) -> None:
        if self.unseen:
            return
        if self.tables:
            if self.tables[-1].cell is not None:
                self.tables[-1].cell.append(data)
        elif self.block:
            self.block.text.append(data)
        elif data.strip():
            self.start("paragraph", line)
            self.block.text.append(data)


def parse(text: str, document_id: str) -> Output:
    recorder, reducer = _Recorder(), _Reducer(document_id)
    recorder.feed(text)
    recorder.close()
    for event, what, attributes, line in recorder.events:
        if event == "text":
            reducer.text(what, line)
        elif event == "close":
            reducer.closing(what, line)
        else:
            reducer.opening(event, what, attributes, line)
    reducer.flush()
    if not reducer.out.elements:
        reducer.out.warn("html_no_content")
    reducer.out.metadata = {"html": True}
    return reducer.out
