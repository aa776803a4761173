import io
import json
import random
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from docspark.functions import geometry
from docspark.functions.tables import linearize, pipe_cells, python_cells, python_linearize
from docspark.parsers import docx, extracted, html, markdown, notebook, pages
from docspark.parsers.base import guarded, parse_column


def flat(out):
    return [(e["type"], e["content"]) for e in out.elements]


def meta(e):
    return json.loads(e["metadata"])


def test_markdown_blocks():
    text = "# T #\n\nintro\nmore\n- a\n2) b\n> q\n>r\n```py\n# no\n```\n---\n![alt](u.png)\n## S\n| h1 | h2 |\n| --- | --- |\n| a\\|b |\n  # indented\n"
    out = markdown.parse(text, "d")
    assert flat(out) == [
        ("heading", "T"), ("paragraph", "intro\nmore"), ("list_item", "a"), ("list_item", "b"), ("paragraph", "q\nr"), ("paragraph", "# no"), ("image", None),
        ("heading", "S"), ("table", "| h1 | h2 |\n| --- | --- |\n| a\\|b |  |"), ("paragraph", "# indented"),
    ]
    e = out.elements
    assert e[0]["element_id"] == "d::e0000" and e[0]["source_locator"] == {"family": "line_address", "line": 1, "section_path": "T"}
    assert e[7]["source_locator"]["section_path"] == "T > S" and meta(e[7]) == {"level": 2}
    assert meta(e[2]) == {"ordered": False, "marker": "unordered"} and meta(e[3])["ordered"] and meta(e[4]) == {"kind": "blockquote"}
    assert meta(e[5]) == {"kind": "code_block", "language": "py"} and e[6]["resource_path"] == "u.png" and meta(e[6]) == {"alt": "alt"}
    assert meta(e[8]) == {"row_count": 2, "col_count": 2, "source": "markdown_pipe_table"}


@pytest.mark.parametrize(
    "text,codes,content",
    [
        ("#  \n", ["empty_markdown_construct_ignored", "md_no_content"], []), ("```\n```", ["md_empty_code_block", "md_no_content"], []),
        ("````\ncode\n```", [], [("paragraph", "code")]), ("```\nopen", [], [("paragraph", "open")]), ("﻿# T", [], [("paragraph", "﻿# T")]),
        ("# \n", [], [("paragraph", "#")]), ("", ["md_no_content"], []), ("``` two words\nx", [], [("paragraph", "``` two words\nx")]),
    ],
)
def test_markdown_edges(text, codes, content):
    out = markdown.parse(text, "d")
    assert [w["code"] for w in out.warnings] == codes and flat(out) == content


def test_front_matter_and_tasks():
    out = markdown.parse_enhanced("---\nship: Möwe\nport: 'Kiel: Nord'\ncrew: 7\nstops:\n  - Kiel\nholds: {a: 1}\n---\n- [X] loaded\n- [ ] sealed\n- neither", "d")
    assert out.metadata == {"markdown": True, "ship": "Möwe", "port": "Kiel: Nord", "crew": "7"}
    assert [w["code"] for w in out.warnings] == ["frontmatter_value_skipped", "frontmatter_line_skipped", "frontmatter_value_skipped"]
    assert [(e["content"], meta(e).get("checked")) for e in out.elements] == [("loaded", True), ("sealed", False), ("neither", None)]
    assert flat(markdown.parse_enhanced("---\nnever: closed", "d")) == [("paragraph", "never: closed")]


def test_html_blocks():
    page = "<head><title>x</title></head><h1>A</h1><p>one<br>two</p>loose<h2>B</h2><ol><li>i</li></ol><ul><li>j</ul><pre> p </pre><blockquote>q</blockquote><img src=a.png alt=z><p>a<p>b</p>"
    out = html.parse(page, "d")
    assert flat(out) == [("heading", "A"), ("paragraph", "one two"), ("paragraph", "loose"), ("heading", "B"), ("list_item", "i"), ("list_item", "j"), ("paragraph", "p"), ("paragraph", "q"), ("image", None), ("paragraph", "ab")]
    assert out.elements[4]["source_locator"]["section_path"] == "A > B" and meta(out.elements[4])["ordered"] and not meta(out.elements[5])["ordered"]
    assert [meta(out.elements[i]).get("kind") for i in (6, 7)] == ["preformatted", "blockquote"] and out.elements[8]["confidence"] == 0.9


def test_html_tables():
    out = html.parse("<table><tr><th>Pier<th>Depth</tr><tr><td>a|b<td></tr><tr><td>c</td></tr></table>", "d")
    assert flat(out) == [("table", "| Pier | Depth |\n| --- | --- |\n| a\\|b |  |\n| c |  |")] and meta(out.elements[0])["table_index"] == 0
    out = html.parse("<p>top</p><table><tr><td>quay <table><tr><th>buoy</th><th>light</th></tr><tr><td>1</td><td>red</td></tr></table> crane</td><td>shed</td></tr></table><p>end</p>", "d")
    assert flat(out) == [("paragraph", "top"), ("paragraph", "quay"), ("table", "| buoy | light |\n| --- | --- |\n| 1 | red |"), ("paragraph", "crane"), ("table", "|  | shed |\n| --- | --- |"), ("paragraph", "end")]
    assert [w["code"] for w in out.warnings] == ["html_nested_table"] and [meta(e).get("position") for e in out.elements] == [None, "before_inner_table", None, "after_inner_table", None, None]
    rings = "x"
    for n in range(4):
        rings = f"<table><tr><td>ring{n} {rings}</td></tr></table>"
    out = html.parse(rings, "d")
    text = " ".join(e["content"] for e in out.elements)
    assert [e["type"] for e in out.elements].count("table") == 4 and len(out.warnings) == 3 and all(text.count(f"ring{n}") == 1 for n in range(4))
    assert html.parse("<table><tr><td>never closed", "d").elements == [] and html.parse("<meta><p>gone</p>", "d").elements == []


def book(**more):
    return json.dumps({"nbformat": 4, "nbformat_minor": 5, "cells": [], **more})


def test_notebook():
    cells = [
        {"cell_type": "markdown", "source": ["# T\n", "![a](attachment:x.png)\n", "text"]}, {"cell_type": "code", "source": "x = 1\n", "outputs": [1]}, {"cell_type": "code", "source": " "},
        {"cell_type": "raw", "source": "r"}, {"cell_type": "raw", "source": ""}, {"cell_type": "odd", "source": ""}, 5, {"cell_type": "code", "source": [1]},
    ]
    out = notebook.parse(book(cells=cells, metadata={"kernelspec": {"language": ""}, "language_info": {"name": "python"}}), "d")
    assert flat(out) == [("heading", "T"), ("paragraph", "text"), ("paragraph", "x = 1\n"), ("paragraph", "r")]
    assert [w["code"] for w in out.warnings] == ["ipynb_attachment_ref_skipped", "ipynb_outputs_ignored", "ipynb_empty_code_cell", "ipynb_unknown_cell_type", "ipynb_bad_cell", "ipynb_bad_cell"]
    assert out.elements[1]["source_locator"] == {"family": "container_line", "cell_index": 0, "cell_type": "markdown", "line": 3, "section_path": "T"}
    assert meta(out.elements[2]) == {"kind": "code_cell", "language": "python"} and out.metadata["cell_count"] == 8


@pytest.mark.parametrize("change", [{"nbformat": v} for v in (None, "four", [4], False, 4.5)] + [{"nbformat_minor": v} for v in (-3, "5", None, True)] + [{"cells": v} for v in ("none", {"a": 1}, 7)], ids=str)
def test_notebook_structure(change):
    assert guarded(notebook.parse)(book(**change), "d")["error"]["code"] == "ipynb_bad_structure"


def test_notebook_versions_and_json():
    assert {n for n in range(1, 9) if (guarded(notebook.parse)(book(nbformat=n), "d")["error"] or {}).get("code") == "ipynb_unsupported_version"} == {1, 2, 3, 5, 6, 7, 8}
    assert [guarded(notebook.parse)(t, "d")["error"]["code"] for t in ("not json", "7", '"book"')] == ["ipynb_invalid_json", "ipynb_bad_structure", "ipynb_bad_structure"]


def package(body, styles="", rels=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="x">{rels}</Relationships>')
    return data.getvalue()


def test_docx():
    p = lambda t, s="": f'<w:p>{s and f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>"}<w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda *t: f"<w:tc>{''.join(map(p, t))}</w:tc>"
    body = p("Head", "h2") + p("") + f"<w:sdt><w:sdtContent>{p('in')}</w:sdtContent></w:sdt>" + p("Figure 1. flow") + '<w:p><w:r><a:blip r:embed="rId5"/></w:r></w:p>' + "<w:tbl/>" + f"<w:tbl><w:tr>{cell('p1', 'p2')}{cell('x')}</w:tr></w:tbl>"
    out = docx.parse(package(body, '<w:style w:styleId="h2"><w:name w:val="Heading 2"/></w:style>', '<Relationship Id="rId5" Target="media/i.png"/>'), "d")
    assert flat(out) == [("heading", "Head"), ("paragraph", "(空段落)"), ("paragraph", "in"), ("caption", "Figure 1. flow"), ("paragraph", "(空段落)"), ("image", None), ("table", "| p1<br>p2 | x |\n| --- | --- |")]
    assert [e["source_locator"].get("paragraph_index") for e in out.elements] == [0, 1, 2, 3, 4, 4, None] and out.elements[6]["source_locator"]["table_index"] == 1
    assert out.elements[5]["source_locator"]["target_partname"] == "/word/media/i.png" and meta(out.elements[0])["level"] == 2
    assert guarded(docx.parse)(b"PK no zip", "d")["error"]["code"] == "docx_open_failed"
    assert guarded(pages.parse)(b"%PDF", "d")["error"]["code"] == "pdfplumber_unavailable"


def word(text, x, y, h=10, w=10.0, chars=True):
    b = {"x0": float(x), "x1": x + w, "top": float(y), "bottom": float(y + h)}
    return {"text": text, **b, "chars": [b] if chars else None}


def test_lines_and_paragraphs():
    words = [word("b", 20, 1), word("a", 0, 0), word("c", 0, 12), word("Figure 1:", 0, 60), word("x", 30, 61)]
    lines = pages.group_lines(words)
    assert [(x["text"], x["paragraph"]) for x in lines] == [("a b", 0), ("c", 0), ("Figure 1: x", 1)] and lines[0]["bbox"] == [0.0, 0.0, 30.0, 11.0]
    assert pages.caption_words(words) == [3, 4] and pages.group_lines(None) == []
    flat_words = [word(str(n), 0, 12 * n, 0 if n < 2 else 10) for n in range(5)]  # heights of 0 count in the median
    assert [x["paragraph"] for x in pages.group_lines(flat_words)] == [0, 0, 0, 0, 0] and [x["paragraph"] for x in pages.group_lines(flat_words[:3])] == [0, 1, 2]


def test_captions_in_paragraphs():
    line = lambda text, y, x1=90.0: {"text": text, "bbox": [0.0, y, x1, y + 10.0], "paragraph": 0}
    lines = [line("The depth is in", 0.0), line("Fig. ２: depth", 11.0), line("and more", 22.0), line("Table 3: no area", 33.0, 0.0), line("Figure 2: again", 11.0)]
    stay, out = pages.split_captions(lines, [])
    assert [x["text"] for x in stay] == ["The depth is in", "and more", "Table 3: no area"] and [x["text"] for x in out] == ["Fig. ２: depth"]
    assert pages.split_captions(lines, [([0.0, 0.0, 200.0, 200.0], "figure:2")])[1] == []
    assert [pages.label(t) for t in ("图１２：x", "Fig 7.", "表格 3", "none")] == ["figure:12", "figure:7", "table:3", None]


def slow_clusters(shapes):
    """Joins any two near boxes until none are left."""
    boxes = [([s["x0"], s["top"], s["x1"], s["bottom"]], s["curve"]) for s in shapes if s["x1"] > s["x0"] and s["bottom"] > s["top"]]
    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i) if pages.apart(boxes[i][0], boxes[j][0]) <= 15), None)
        if not pair:
            return sorted(b for b, c in boxes if c and b[2] - b[0] >= 100 and b[3] - b[1] >= 100)
        (a, c), (b, d) = boxes.pop(pair[0]), boxes.pop(pair[1])
        boxes.append((pages.hull([a, b]), c or d))


def test_vector_clusters():
    shape = lambda x, y, w, h, c=False: {"x0": float(x), "x1": float(x + w), "top": float(y), "bottom": float(y + h), "curve": c}
    rnd = random.Random(5)
    for _ in range(150):
        shapes = [shape(rnd.randrange(600), rnd.randrange(600), rnd.randrange(90), rnd.randrange(90), rnd.random() < 0.3) for _ in range(rnd.randrange(30))]
        assert sorted(pages.vector_clusters(shapes)) == slow_clusters(shapes)
    assert pages.vector_clusters(None) == [] and pages.vector_clusters([shape(0, 0, 200, 200)]) == [] and pages.vector_clusters([shape(0, 0, 100, 100, True)]) == [[0.0, 0.0, 100.0, 100.0]]


def test_page_composition(spark):
    cells = [[float(x), float(y), x + 100.0, y + 20.0] for y in (200, 220) for x in (0, 100)]
    table = {"bbox": [0.0, 200.0, 200.0, 240.0], "cells": cells, "rows": [["Pier", "Depth"], ["n|1", None]]}
    thin = {"bbox": [0.0, 400.0, 50.0, 420.0], "cells": [[0.0, 400.0, 50.0, 420.0]], "rows": [["x"]]}
    words = [word(t, x, y, w=len(t) * 5.0) for t, x, y in (("Tides", 0, 0), ("The", 0, 40), ("ebb.", 30, 40), ("Table", 0, 51), ("1:", 40, 51), ("depth", 60, 51), ("It", 0, 62), ("ends.", 20, 62), ("Pier", 5, 205), ("Depth", 105, 205), ("n|1", 5, 225), ("0", 105, 225), ("x", 5, 405))]
    image = {"x0": 150.0, "x1": 350.0, "top": 230.0, "bottom": 330.0, "tag": "Im1"}
    shapes = [{"x0": 300.0, "x1": 420.0, "top": 500.0, "bottom": 640.0, "curve": True}]
    page = {"page": 2, "width": 600.0, "height": 800.0, "words": words, "tables": [thin, table], "images": [image, {**image, "x1": 0.0}], "shapes": shapes}
    first = {"page": 1, "width": 600.0, "height": 800.0, "words": [word("Figure 4: first", 0, 0, w=80.0)], "tables": None, "images": None, "shapes": None}
    out = pages.compose([page, first], "d")
    assert flat(out) == [
        ("caption", "Figure 4: first"), ("heading", "Tides"), ("caption", "Table 1: depth"), ("paragraph", "The ebb. It ends."), ("heading", "x"), ("table", "| Pier | Depth |\n| --- | --- |\n| n\\|1 |  |"), ("image", None), ("image", None),
    ]
    assert [e["source_locator"]["page"] for e in out.elements] == [1] + [2] * 7 and out.elements[2]["source_locator"]["bbox"] == [0.0, 51.0, 85.0, 61.0]
    assert [w["code"] for w in out.warnings] == ["table_figure_partial_overlap"] and meta(out.elements[6])["tag"] == "Im1" and meta(out.elements[7])["kind"] == "vector_cluster"
    covered = pages.compose([{**page, "images": [{**image, "x0": 0.0, "top": 200.0}]}], "d")
    assert "table" not in [e["type"] for e in covered.elements] and any("Depth" in (e["content"] or "") for e in covered.elements)
    assert [w["code"] for w in pages.compose([], "d").warnings] == ["pdf_no_text_extracted"]
    df = spark.createDataFrame([("d", [first, page]), ("e", None)], f"document_id string, pages array<{pages.PAGE}>")
    got = {r.document_id: r.parsed for r in parse_column(df, "pages", "document_id", pages.compose).collect()}
    assert len(got["d"].elements) == 8 and got["e"] is None


def test_pages_of_a_library(monkeypatch):
    """What pdfplumber says of a page is composed to elements; what it can't open is an error of the document."""
    from types import SimpleNamespace as Has

    class Pdf:
        def __init__(self, data):
            if data.read() != b"%PDF good":
                raise ValueError("no PDF")
            table = Has(bbox=(0, 200, 200, 240), cells=[(x, y, x + 100, y + 20) for y in (200, 220) for x in (0, 100)] + [None], extract=lambda: [["a", "b"], ["c", None]])
            words = [word(t, x, y) for t, x, y in (("Tides", 0, 0), ("a", 5, 205), ("b", 105, 205), ("c", 5, 225), ("d", 105, 225))]
            image = {"x0": 300, "x1": 350, "top": 0, "bottom": 50, "tag": "Im1"}
            page = Has(width=600, height=800, extract_words=lambda **_: words, find_tables=lambda: [table], images=[image], curves=[{"x0": 300, "x1": 420, "top": 500, "bottom": 640}], rects=[], lines=[{"x0": 0, "x1": 9, "top": 5, "bottom": 5}])
            self.pages = [page, page]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "pdfplumber", Has(open=Pdf))
    out = pages.parse(b"%PDF good", "d")
    assert [(e["type"], e["source_locator"]["page"]) for e in out.elements] == [(t, n) for n in (1, 2) for t in ("heading", "table", "image", "image")]
    assert guarded(pages.parse)(b"%PDF bad", "d")["error"]["code"] == "pdfplumber_open_failed"


def test_text_of_a_library(monkeypatch):
    from types import SimpleNamespace as Has

    def extract(data, mime):
        if b"bad" in data:
            raise ValueError("bad")
        return Has(content=f"Tides\n\n{mime[:15]} ebbs.", tables=[Has(markdown="| a |\n| - |")])

    assert guarded(extracted.parse)(b"%PDF", "d")["error"]["code"] == "kreuzberg_unavailable"
    monkeypatch.setitem(sys.modules, "kreuzberg", Has(extract_bytes_sync=extract))
    out = extracted.parse(b"%PDF", "d")
    assert flat(out) == [("heading", "Tides"), ("paragraph", "application/pdf ebbs."), ("table", "| a |\n| - |")] and [w["code"] for w in out.warnings] == ["kreuzberg_pdf_no_bbox"]
    assert extracted.parse(b"PK", "d").elements[2]["source_locator"]["paragraph_index"] == 2 and guarded(extracted.parse)(b"bad", "d")["error"]["code"] == "kreuzberg_extract_failed"


def test_gate_is_that_of_columns(spark):
    rnd, rows = random.Random(3), []
    some = lambda n: [[x, y, x + rnd.randrange(1, 150), y + rnd.randrange(1, 150)] for x, y in ((float(rnd.randrange(80)), float(rnd.randrange(80))) for _ in range(n))]
    for n in range(200):
        rows.append((n, [0.0, 0.0, 100.0, 100.0], rnd.randrange(1, 5), rnd.randrange(4, 8), rnd.randrange(3, 20), some(rnd.randrange(2)), some(rnd.randrange(3)), rnd.choice([0.0, 3000.0, 20000.0])))
    df = spark.createDataFrame(rows, "n int, b array<double>, r int, c int, w int, raster array<array<double>>, vector array<array<double>>, page double")
    got = df.select("n", geometry.table_gate_override("b", *map(F.col, "rcw"), "raster", "vector", F.col("page")).alias("g")).orderBy("n").collect()
    want = [pages.gate(*r[1:]) for r in rows]
    assert [(g.g.accepted, g.g.fraction) for g in got] == [(a, s if a and s > 0 else None) for a, s, _, _ in want] and {a for a, *_ in want} == {True, False}


def test_tables_agree(spark):
    rows = [["h1", "h|2"], ["a\r\nb", None, " c "], []]
    df = spark.createDataFrame([(rows,), ([],), (None,)], "r array<array<string>>")
    got = [r[0] for r in df.select(linearize("r")).collect()]
    assert got[0] == python_linearize(rows) == "| h1 | h\\|2 |  |\n| --- | --- | --- |\n| a<br>b |  | c |\n|  |  |  |" and got[1] == python_linearize([]) == ""
    lines = ["| a\\|b | c |", "x", "||", " | d | "]
    assert [list(r[0]) for r in spark.createDataFrame([(x,) for x in lines], "s string").select(pipe_cells("s")).collect()] == [python_cells(x) for x in lines]
