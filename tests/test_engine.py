import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docspark import pipeline
from docspark.registry import Capability, RegistrationError, Registry, built_in
from docspark.sources import files
from docspark.streaming.documents import ingest

ROOT = Path(__file__).resolve().parents[1]


def capability(**more):
    return Capability(**{"name": "p", "version": "1", "extensions": (".x",), "priority": 5, "source_types": ("x",), "family": "line_address", **more})


def test_contracts():
    r = Registry()
    r.register(capability())
    for bad in ({"name": ""}, {"version": ""}, {"extensions": ()}, {"extensions": (".X",)}, {"extensions": ("x",)}, {"priority": 0}, {"priority": True}, {"source_types": ("No",)}, {"family": "other"}):
        with pytest.raises(RegistrationError):
            r.register(capability(**{"name": "q", "extensions": (".q",), "source_types": ("q",), **bad}))
    with pytest.raises(RegistrationError, match="already"):
        r.register(capability())
    with pytest.raises(RegistrationError, match="bound"):
        r.register(capability(name="q", family="page_geometry"))
    r.register(capability(name="tie"))
    with pytest.warns(UserWarning):
        assert r.discover(".x").name == "p"
    with pytest.raises(ValueError):
        r.discover(".none")
    with pytest.raises(ValueError):
        r.get("none")


def test_routes_and_audit(spark):
    r = built_in()
    df = spark.createDataFrame([("a.md",), ("b.markdown",), ("c.pdf",), ("d.HTML",), ("e.zip",)], "path string")
    assert [x[0] for x in df.select(r.route("path")).collect()] == ["markdown_enhanced", "markdown_enhanced", "fallback", "html", "fallback"]
    assert [x[0] for x in df.select(r.route("path", "fallback")).collect()] == ["markdown", "fallback", "fallback", "fallback", "fallback"]
    audit = {x.extension: x for x in r.audit(spark).collect()}
    assert audit[".md"].first == "markdown_enhanced" and audit[".md"].parsers == 2 and not audit[".md"].contested


def test_plugins(tmp_path, monkeypatch):
    (tmp_path / "plug_ok.py").write_text("from docspark.registry import Capability\ndef register_parsers(r):\n    r.register(Capability('plug', '1', ('.plug',), 1, ('plug',), 'line_address'))\n")
    (tmp_path / "plug_bad.py").write_text("def register_parsers(r):\n    raise RuntimeError('no')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    r = built_in()
    r.load(["plug_ok", "plug_ok"])
    assert r.discover(".plug").origin == "plug_ok"
    with pytest.raises(RegistrationError, match="plugin_register_failed"):
        r.load(["plug_bad"])
    with pytest.raises(RegistrationError, match="plugin_import_failed"):
        r.load(["plug_absent"])


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# T\n\ntext", encoding="utf-8")
    (tmp_path / "in" / "sub" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "b.md").write_bytes(b"x\xff")
    (tmp_path / "in" / "c.txt").write_text("not in folders", encoding="utf-8")
    return tmp_path


def test_pipeline_errors_keep_rows(spark):
    rows = [(1, "a.md", "# T\n\nx"), (2, "b.txt", "p\n\nq"), (3, "c.txt", None), (4, "d.html", "<p></p>"), (5, "e.ipynb", "{"), (6, "f.zip", "x"), (1, "a.md", "# T\n\nx")]
    df = pipeline.from_texts(spark.createDataFrame(rows, "id int, path string, text string"), "text", "path")
    got = sorted((r.id, r.error_code, r.elements and len(r.elements), r.chunks and len(r.chunks)) for r in pipeline.documents(df, "text", None).collect())
    assert got == [(1, None, 2, 1), (1, None, 2, 1), (2, None, 2, 1), (3, "file_not_found", None, None), (4, "no_extracted_elements", None, None), (5, "ipynb_invalid_json", None, None), (6, "unsupported_type", None, None)]
    assert pipeline.documents(df.limit(0), "text", None).count() == 0


def test_parsers_take_their_own_files_alone(spark):
    rows = [(p, "# x\n\ny") for p in ("a.md", "b.markdown", "c.txt", "d.html", "e", "f.ipynb")]
    df = pipeline.from_texts(spark.createDataFrame(rows, "path string, text string"), "text", "path")
    by = lambda parser: {r.path[0] for r in pipeline.documents(df, "text", None, parser=parser).where("error_code is null").collect()}
    assert [by(p) for p in ("markdown", "text", "html", "fallback", "auto")] == [{"a", "b"}, {"c"}, {"d"}, {"a"}, {"a", "b", "c", "d"}]
    assert {r.error_code for r in pipeline.documents(df, "text", None, parser="ipynb").collect()} == {"unsupported_type", "ipynb_invalid_json"}


def test_gates(spark, monkeypatch):
    """Documents against the schema or their parser's contract, and a chunker that fails, are errors of the document."""
    from docspark.operators import chunking
    from docspark.parsers.base import Output

    def parse(text, document_id):
        out = Output(document_id)
        out.add("paragraph", "" if text == "empty" else text, {"family": "page_geometry" if text == "family" else "line_address", "line": 0 if text == "line" else 1}, confidence=2.0 if text == "sure" else 0.5)
        return out

    r = Registry()
    r.register(capability(name="own", extensions=(".x",), source_types=("xx",), parse=parse))
    rows = [(n, f"{n}.x", t) for n, t in enumerate(["fine", "empty", "line", "sure", "family", "break"])]
    df = pipeline.from_texts(spark.createDataFrame(rows, "id int, path string, text string"), "text", "path").withColumn("source_type", F.lit("xx"))
    real = chunking.packed
    monkeypatch.setattr(pipeline, "packed", lambda e, *more: real([{"content": 1}] if e[0]["content"] == "break" else e, *more))
    got = {r.text: (r.error_code, r.elements is None, r.error_details) for r in pipeline.documents(df, "text", None, r).collect()}
    assert {k: v[0] for k, v in got.items()} == {"fine": None, "empty": "schema_validation_failed", "line": "schema_validation_failed", "sure": "schema_validation_failed", "family": None, "break": "chunker_failed"}
    assert "confidence.range" in got["sure"][2] and got["sure"][1] and not got["fine"][1]
    wrong = {r.text: r.error_code for r in pipeline.documents(df.withColumn("source_type", F.when(F.col("text") == "fine", "text").otherwise("markdown")), "text", None, r).collect()}
    assert wrong["fine"] == "parser_contract_mismatch" and wrong["family"] == "schema_validation_failed"


def test_relations_in_documents(spark):
    """Those of one document's elements are those of the joins over all, in order; and they are part of the document."""
    import random

    from docspark.operators import relations
    from docspark.types import ELEMENT

    rnd, rows = random.Random(6), []
    for n in range(60):
        kind, items = ("pdf", "docx")[n % 2], []
        for i in range(rnd.randrange(1, 14)):
            t = rnd.choice(["image", "table", "caption", "caption", "paragraph", "heading"])
            text = {"caption": f"{rnd.choice(['Figure', 'fig.', '图', 'Table', '表'])} {rnd.randrange(1, 4)}: x", "paragraph": f"see Figure {rnd.randrange(1, 5)}, figure ２ and 表 {rnd.randrange(1, 4)}"}.get(t, "x")
            y = float(rnd.randrange(0, 200))
            loc = {"page": rnd.randrange(1, 3), "bbox": [float(rnd.randrange(50)), y, 60.0, y + 20]} if kind == "pdf" else {"paragraph_index": i}
            items.append({"ord": i, "element_id": f"e{i:02d}", "type": t, "content": text, "resource_path": None, "parent_id": None, "source_locator": loc, "confidence": None, "metadata": None})
        rows.append((f"d{n:02d}", kind, items))
    df = spark.createDataFrame(rows, f"document_id string, source_type string, elements array<{ELEMENT}>")
    flat = df.select("document_id", "source_type", F.explode("elements").alias("e")).select("document_id", "source_type", "e.*")
    want = {}
    for r in relations.all_relations(flat).collect():
        want.setdefault(r.document_id, []).append((r.type, r.from_id, r.to_id, json.loads(r.metadata)))
    got = {d: [(x["type"], x["from_id"], x["to_id"], json.loads(x["metadata"])) for x in relations.within([e for e in items], kind)] for d, kind, items in rows}
    key = lambda x: (*x[:3], json.dumps(x[3], sort_keys=True))
    assert {d: sorted(x, key=key) for d, x in got.items() if x} == {d: sorted(x, key=key) for d, x in want.items()} and len(want) > 30
    assert all([x[:3] for x in g] == sorted(x[:3] for x in g) for g in got.values())


def test_written_and_unread_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"x": 1}', "p/a"), ("no/such", "{}", "p/b")], "stem string, body string, path string")
    status = {r.path: r.error_code for r in files.write_documents(rows, str(tmp_path / "o"), "stem", "body", "path").collect()}
    assert status == {"p/a": None, "p/b": "write_failed"} and [p.name for p in (tmp_path / "o").iterdir()] == ["a.json"]
    assert [tuple(r) for r in files.unread(rows, rows.where("stem = 'a'")).collect()] == [("p/b", "hash_io_error")]


def test_files_and_collisions(spark, folder):
    got = files.identified(files.collisions(files.binary_files(spark, str(folder / "in"))))
    rows = {Path(r.path).name: r for r in got.collect()}
    assert set(rows) == {"a.md", "a.pdf", "b.md"} and rows["b.md"].text == "x�" and rows["a.pdf"].text is None
    assert [rows[n].stem_collision for n in ("a.md", "a.pdf", "b.md")] == [False, True, False]


def test_streaming_equals_batch(spark, folder):
    q = ingest(spark, str(folder / "in"), str(folder / "out"), str(folder / "progress"))
    q.awaitTermination(120)
    got = sorted((Path(r.path).name, r.error_code) for r in spark.read.parquet(str(folder / "out")).collect())
    assert got == [("a.md", None), ("a.pdf", "pdfplumber_unavailable"), ("b.md", None), ("c.txt", None)]


def test_command_line(folder):
    run = subprocess.run([sys.executable, "-m", "docspark.cli", "batch-parse", str(folder / "in"), "-o", str(folder / "o"), "--log-file", str(folder / "log")], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    summary = json.loads((folder / "o" / "summary.json").read_text())
    assert run.returncode == 1 and (summary["total"], summary["success"], summary["failed"]) == (3, 2, 1), run.stderr[-2000:]
    assert sorted(p.name for p in (folder / "o").iterdir()) == ["a.json", "b.json", "summary.json"]
    document = json.loads((folder / "o" / "a.json").read_text())
    assert document["elements"][0]["parent_id"] is None and document["chunks"][0]["text"] == "T text"
    assert [json.loads(x)["event"] for x in (folder / "log").read_text().splitlines()] == ["batch_start", "batch_done", "file_failed"]


def test_explanations():
    r = built_in()
    assert r.explain(".md")["winner"] == "markdown_enhanced" and r.explain(".md")["reason"] == "priority" and r.explain(".zip")["reason"] == "no_candidates"
    assert r.explain(".html") == {"extension": ".html", "candidates": [{"name": "html", "priority": 100}], "winner": "html", "reason": "single_candidate", "tied_names": []}
    assert r.inspect("ipynb")["locator_family"] == "container_line" and [x["name"] for x in r.listing()][0] == "markdown_enhanced"


def test_extracted_blocks():
    from docspark.parsers import extracted

    out = extracted.blocks("# Title\nbody text.\n\nShort line\n\nA sentence.\n\n", "d", "docx")
    assert [(e["type"], e["content"]) for e in out.elements] == [("heading", "Title"), ("paragraph", "body text."), ("heading", "Short line"), ("paragraph", "A sentence.")]
    assert [e["source_locator"]["paragraph_index"] for e in out.elements] == [0, 1, 2, 3]
    assert [w["code"] for w in extracted.blocks(" ", "d", "pdf").warnings] == ["kreuzberg_no_structured_elements"]


def test_image_resources(spark):
    from docspark.operators import metrics

    elements = spark.createDataFrame([("d", "e1", "image", "media/a.png"), ("d", "e2", "image", "b.png"), ("d", "e3", "image", None), ("d", "e4", "paragraph", "a.png")], "document_id string, element_id string, type string, resource_path string")
    there = spark.createDataFrame([("file:/x/a.png", 5), ("/x/b.png", 0), ("/y/a.png", 5)], "path string, length long")
    assert [tuple(r) for r in metrics.image_resources(elements, there).collect()] == [("d", 1, 3)]


def office(*images):
    """A DOCX with a paragraph and images of the given parts."""
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        pictures = "".join(f'<w:p><w:r><a:blip r:embed="r{n}"/></w:r></w:p>' for n in range(len(images)))
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Quay plan.</w:t></w:r></w:p>{pictures}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{n}" Target="media/{i}"/>' for n, i in enumerate(images)) + "</Relationships>")
        for i in images[:-1]:
            z.writestr(f"word/media/{i}", i)
    return data.getvalue()


def test_images_are_tied_to_elements(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.docx", bytearray(office("one.png", "two.png", "absent.png"))), ("x/b.docx", bytearray(b"PK no"))], "path string, content binary")
    out = files.with_images(pipeline.documents(files.identified(rows), "text", "content"), "content", str(tmp_path / "images")).collect()
    good = next(r for r in out if r.error_code is None)
    paths = [e.resource_path for e in good.elements if e.type == "image"]
    names = [f"image_{good.document_id[4:]}_docx_{n:02d}.png" for n in range(2)]
    assert paths == [*(str(tmp_path / "images" / n) for n in names), "/word/media/absent.png"] and {p.name: p.read_text() for p in (tmp_path / "images").iterdir()} == {names[0]: "one.png", names[1]: "two.png"}
    assert [e.type for e in good.elements] == ["paragraph", *["paragraph", "image"] * 3] and good.elements[2].source_locator.target_partname == "/word/media/one.png"


def test_the_first_input_given_wins(spark):
    rows = spark.createDataFrame([("z/a.md", 0), ("b/a.md", 1)], "path string, given int")
    assert {r.path: r.stem_collision for r in files.collisions(rows, order="given").collect()} == {"z/a.md": False, "b/a.md": True}
    assert {r.path: r.stem_collision for r in files.collisions(rows).collect()} == {"z/a.md": True, "b/a.md": False}


def test_validate_command(tmp_path):
    good = {"document_id": "d", "path": "a.txt", "parser_name": "text", "source_type": "text", "source_hash": "0" * 64, "elements": [{"element_id": "e", "type": "paragraph", "content": "x", "source_locator": {"family": "line_address", "line": 1}}], "chunks": []}
    bad = {**good, "source_hash": "x", "elements": [{**good["elements"][0], "type": "odd", "content": ""}]}
    for name, document in (("good", good), ("bad", bad)):
        (tmp_path / f"{name}.json").write_text(json.dumps(document))
    run = lambda name: subprocess.run([sys.executable, "-m", "docspark.cli", "validate", str(tmp_path / f"{name}.json")], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=200)
    assert run("good").returncode == 0
    out = run("bad")
    assert out.returncode == 1 and sorted(json.loads(x)["code"] for x in out.stdout.split("\n") if x.startswith("{")) == ["content.any_of", "source_hash.pattern", "type.enum"]
