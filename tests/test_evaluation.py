import json

import pytest

from docspark import evaluation


@pytest.fixture
def project(tmp_path):
    (tmp_path / "a.md").write_text("# First\n\nSome text here.\n\n## Second\n\n- item one\n- item two\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("only text", encoding="utf-8")
    (tmp_path / "bad.ipynb").write_text("{", encoding="utf-8")
    (tmp_path / "a.note.json").write_text(json.dumps({"heading_order": [{"level": 1, "text": "First"}, {"level": 2, "text": "Second"}, {"level": 2, "text": "Third"}], "chunk_boundary_anchors": [{"marker": "Second", "position": "before"}, {"marker": "none", "position": "after"}]}), encoding="utf-8")
    manifest = {
        "manifest_version": "1.1",
        "documents": [
            {"doc_id": "a", "path": "a.md", "source_type": "markdown", "categories": ["x"], "paired_with": "b", "annotation_file": "a.note.json", "expectations": {"element_count_by_type": {"heading": 3, "list_item": 2}, "required_markers": ["Some text"], "forbidden_markers": ["absent"], "max_silent_drop_count": 0}},
            {"doc_id": "b", "path": "b.txt", "source_type": "text", "expectations": {"must_not_error_codes": ["no_extracted_elements"]}},
            {"doc_id": "gone", "path": "gone.md", "source_type": "markdown"},
        ],
        "expected_failures": [{"doc_id": "f", "path": "bad.ipynb", "expected_error_code": "ipynb_invalid_json", "source_type": "ipynb"}],
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest), encoding="utf-8")
    return tmp_path


def test_report(spark, project):
    report = evaluation.run(spark, str(project / "manifest.json"), str(project))
    a, b, gone = report["documents"]
    assert a["pipeline_success"] and a["element_count_by_type"] == {"heading": 2, "list_item": 2, "paragraph": 1} and a["silent_drop_count"] == 1
    assert (a["required_markers_ok"], a["forbidden_markers_ok"], a["max_silent_drop_count_ok"], a["must_not_error_codes_ok"]) == (True, True, False, None)
    assert a["text_preservation_equal"] and a["chunk_reference_intact_ratio"] == a["heading_boundary_compliance"] == a["text_char_multiset_recall"] == 1.0
    assert a["heading_order_prf"] == {"precision": 1.0, "recall": 2 / 3, "f1": 0.8} and a["chunk_boundary_prf"]["recall"] == 1.0 and a["missing_markers"] == ["none"]
    assert b["pipeline_success"] and b["must_not_error_codes_ok"] and b["heading_boundary_compliance"] is None and b["heading_order_prf"] is None
    assert gone["error_code"] == "file_not_found" and not gone["pipeline_success"] and gone["text_preservation_equal"] is None
    assert report["expected_failures"] == [{"doc_id": "f", "expected": "ipynb_invalid_json", "actual": "ipynb_invalid_json", "matched": True}]
    assert report["devset"]["content_groups"] == 2 and report["devset"]["categories"] == ["x"] and report["summary"]["success_rate"] == pytest.approx(2 / 3)
    assert report["summary"]["expectation_checks"]["max_silent_drop_count"] == {"evaluated": 1, "passed": 0, "failed": 1}
    assert a["schema_valid"] and gone["schema_valid"] is None and a["chunk_boundary_recall"] == 1.0 and set(report["summary"]["macro_averages"]) == set(evaluation.RATIOS)
    assert gone["reasons"] == dict.fromkeys(evaluation.RATIOS, "pipeline_failed") and a["reasons"] == {"pdf_locator_valid_ratio": "not_a_pdf", "docx_locator_valid_ratio": "not_a_docx", "image_resource_exists_ratio": "no_images"}
    assert b["reasons"]["chunk_boundary_f1"] == "no_annotation" and report["summary"]["partition_violations"] == 0
    assert report["provenance"]["max_chars"] == 800 and report["provenance"]["git_dirty"] is True and evaluation.report_errors(report) == []
    for broken in ({"summary": {}}, {"documents": [{}]}, {"documents": [{**a, "schema_valid": 2}]}, {"documents": [{**a, "reasons": {}}]}, {"provenance": {}}, {"devset": []}):
        assert evaluation.report_errors({**report, **broken})
        with pytest.raises(ValueError):
            evaluation.write({**report, **broken}, str(project / "no.json"))
    assert evaluation.report_errors([]) and evaluation.report_errors({"documents": []})
    evaluation.write(report, str(project / "report.json"))
    assert evaluation.same(report, json.loads((project / "report.json").read_text())) == []


def test_manifest_errors(project):
    def broken(**change):
        manifest = json.loads((project / "manifest.json").read_text())
        manifest["documents"][0] |= change
        (project / "m.json").write_text(json.dumps(manifest))
        with pytest.raises(evaluation.ManifestError):
            evaluation.load_manifest(str(project / "m.json"), str(project))

    broken(path="../x.md"), broken(path="/etc/x.md"), broken(path="a\\b.md"), broken(path="C:/x.md"), broken(doc_id="b"), broken(doc_id=""), broken(expectations={"max_silent_drop_count": 1})
    (project / "m.json").write_text("{")
    with pytest.raises(evaluation.ManifestError):
        evaluation.load_manifest(str(project / "m.json"), str(project))
    assert evaluation.load_annotation(str(project / "none")) is None and evaluation.load_annotation(str(project / "m.json")) is None


def test_partition_of_elements_by_chunks(spark):
    from docspark.types import CHUNK, ELEMENT

    e = lambda i, t, c: (0, i, t, c, None, None, None, None, None)
    c = lambda *spans: ("c", "t", [], None, list(spans))
    rows = [
        ("whole", [e("a", "paragraph", " x y "), e("i", "image", "alt"), e("b", "paragraph", "  ")], [c(("a", 1, 4))]), ("split", [e("a", "paragraph", "abc def")], [c(("a", 0, 3)), c(("a", 4, 7))]),
        ("twice", [e("a", "paragraph", "abc")], [c(("a", 0, 3)), c(("a", 0, 3))]), ("lost", [e("a", "paragraph", "abc"), e("b", "paragraph", "d")], [c(("a", 0, 2))]), ("none", None, None),
    ]
    df = spark.createDataFrame(rows, f"document_id string, elements array<{ELEMENT}>, chunks array<{CHUNK}>")
    assert {(r.document_id, r.element_id, r.held, r.visible) for r in evaluation.partitioned(df).collect()} == {("twice", "a", 6, 3), ("lost", "a", 2, 3), ("lost", "b", 0, 1)}


def test_command(project, monkeypatch, spark, capsys):
    from docspark import cli

    out = str(project / "r.json")
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["evaluate", "--manifest", str(project / "manifest.json"), "--output", out, "--root", str(project), "--log-file", str(project / "logs" / "x.jsonl"), "--max-chars", "64"]) == 0
    assert [json.loads(x)["event"] for x in (project / "logs" / "x.jsonl").read_text().splitlines()] == ["evaluation_start", "evaluation_done"]
    assert cli.main(["validate-report", out]) == 0 and cli.main(["validate-report", str(project / "manifest.json")]) == 1 and cli.main(["validate-report", str(project / "none")]) == 2
    assert cli.main(["evaluate", "--manifest", str(project / "b.txt"), "--output", out, "--root", str(project)]) == 2
    capsys.readouterr()
    for args, code in ((["parse", str(project / "a.md"), "-o", out, "--parser", "nope"], "unknown_parser"), (["parse", str(project / "none"), "-o", out], "file_not_found"), (["parse", str(project / "manifest.json"), "-o", out, "--parser", "auto"], "unsupported_type"), (["parse", str(project / "a.md"), "-o", out, "--plugin", "no_such_module"], "plugin_import_failed"), (["parse", str(project / "a.md"), "-o", str(project / "no" / "x.json")], "write_failed")):
        assert cli.main(args) == 1 and json.loads(capsys.readouterr().err.splitlines()[-1])["errors"][0]["code"] == code
    assert cli.main(["parse", str(project / "a.md"), "-o", out]) == 0 and json.loads(open(out).read())["parser_name"] == "markdown"


def test_types_of_the_manifest(spark, project):
    rows = [("a", f"file:{project}/a.md", "text"), ("b", f"file:{project}/b.txt", "odd"), ("c", f"file:{project}/manifest.json", None)]
    got = evaluation.parse_entries(spark, spark.createDataFrame(rows, "doc_id string, path string, source_type string")).collect()
    assert {(r.doc_id, r.error_code, r.elements and r.elements[0].type) for r in got} == {("a", None, "paragraph"), ("b", "unsupported_type", None), ("c", "unsupported_type", None)}
