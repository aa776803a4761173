import re

from pyspark.sql import functions as F

from docspark.functions import geometry as G
from docspark.functions import text as T


def one(spark, column, *values, ddl="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {ddl}").select(column).collect()]


ODD = ["a　b  c😀\u001cz", " x ", "", None, "  ", "a᠎b"]


def test_white_space_is_that_of_unicode(spark):
    assert one(spark, T.normalize("x"), *ODD) == [" ".join((t or "").split()) for t in ODD]
    assert one(spark, T.squeeze("x"), *ODD) == ["".join(c for c in t or "" if not c.isspace()) for t in ODD]
    assert one(spark, T.strip("x"), *ODD) == [t if t is None else t.strip() for t in ODD]
    assert one(spark, T.leading("x"), *ODD) == [t if t is None else len(t) - len(t.lstrip()) for t in ODD]


def test_lines_and_sentences(spark):
    texts = ["a\r\nb\rc\x0bd e\n", "", "x", "\n\n"]
    assert [list(x) for x in one(spark, T.split_lines("x"), *texts)] == [t.splitlines() for t in texts]
    texts = ["One. Two!  Three。四 five", "no end"]
    assert [list(x) for x in one(spark, T.sentences("x"), *texts)] == [re.split(r"(?<=[。！？!?\.])\s+", t) for t in texts]


def test_identity(spark):
    digest = "ab" * 32
    assert one(spark, T.document_id("x"), digest, "short", None) == [f"doc-{digest[:16]}", None, None]
    assert one(spark, T.numbered(F.lit("d"), "e", "x"), 7, 12345, ddl="int") == ["d::e0007", "d::e12345"]
    assert one(spark, T.decode("x"), b"A\xff\xffB", b"\xe2\x82", b"a\r\nb\rc", ddl="binary") == ["A��B", "�", "a\nb\nc"]
    assert one(spark, T.source_type("x"), "a/B.MD", "x\\y.htm", ".hidden", "n", "a.ipynb", None) == ["markdown", "html", None, None, "ipynb", None]


def test_captions(spark):
    yes, no = ["Figure3:The", "Table1:Comparison", "Figure 3: Overview", "图 3：系统", "表 1：结果", "Fig. ２.x"], ["The model is shown in Figure 3.", "我们在图 3 中展示", "Figure3Thearch", None]
    assert one(spark, T.is_caption("x"), *yes, *no) == [True] * 6 + [False] * 4
    assert one(spark, T.caption_label("x"), "Table 07: x", "图１２：y", "none") == ["table:7", "figure:12", None]
    assert one(spark, T.block_type("x"), "Figure 1: a", "Short title", "A sentence.", "x" * 81) == ["caption", "heading", "paragraph", "paragraph"]
    assert one(spark, T.heading_level("x"), "Title", "heading 3", "Heading 0", "heading x", "Normal", None) == [1, 3, 1, 1, None, None]


def test_front_matter_and_tasks(spark):
    got = one(spark, T.frontmatter("x"), '---\na: 1\nb: "q"\na: 2\nl: [1]\nbad\n---\nbody', "---\nopen", "text", None, "---\n---\n")
    assert got == [{"a": "2", "b": "q"}, None, None, None, {}]
    got = one(spark, T.task_item("x"), "[x] a", "[ ] b", "[y] c", None)
    assert [g and (g.checked, g.text) for g in got] == [(True, "a"), (False, "b"), None, None]


def gate(spark, rows, cols, words, raster=(), vector=(), page=None):
    box = F.array(*map(F.lit, (0.0, 0.0, 100.0, 100.0)))
    boxes = lambda bs: F.array(*[F.array(*map(F.lit, b)) for b in bs]) if bs else F.array().cast("array<array<double>>")
    args = (box, F.lit(rows), F.lit(cols), F.lit(words), boxes(raster), boxes(vector))
    column = G.table_gate(*args) if page is None else G.table_gate_override(*args, F.lit(page))
    return spark.range(1).select(column.alias("g")).first().g


def test_table_gates(spark):
    half, less, full, huge = [0.0, 0.0, 100.0, 50.0], [0.0, 0.0, 100.0, 49.9], [0.0, 0.0, 100.0, 100.0], [0.0, 0.0, 300.0, 300.0]
    assert gate(spark, 3, 1, 16).accepted and gate(spark, 3, 1, 16).fraction is None
    assert not gate(spark, 3, 1, 16, [half]).accepted
    kept = gate(spark, 3, 1, 16, [less])
    assert kept.accepted and kept.family == "raster" and abs(kept.fraction - 0.499) < 1e-9
    assert not gate(spark, 3, 1, 16, (), [full]).accepted
    assert [gate(spark, 3, 1, w).accepted for w in (3, 4)] == [False, True] and [gate(spark, r, 1, 16).accepted for r in (1, 2)] == [False, True]
    assert gate(spark, 4, 5, 16).partial_coverage and not gate(spark, 4, 4, 16).partial_coverage
    assert [gate(spark, 3, c, 16, (), [huge], 10_000.0).accepted for c in (5, 6, 7)] == [False, True, True]
    assert not gate(spark, 3, 6, 16, [full], [huge], 10_000.0).accepted and not gate(spark, 3, 6, 16, (), [huge, full], 10_000.0).accepted
    assert not gate(spark, 3, 6, 16, (), [huge], 0.0).accepted


def test_boxes(spark):
    assert one(spark, G.valid_box("x"), [1.0, 2.0, 3.0, 4.0], [1.0], None, [1.0, 2.0, 3.0, float("nan")], [1.0, 2.0, 3.0, None], ddl="array<double>") == [True, False, False, False, False]
