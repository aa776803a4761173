import itertools
import json
import random

from pyspark.sql import functions as F

from docspark.operators import metrics, relations
from docspark.types import LOCATOR

SCHEMA = f"document_id string, ord int, element_id string, type string, content string, source_locator {LOCATOR}, source_type string"
NONE = dict.fromkeys(["family", "page", "bbox", "paragraph_index", "table_index", "section", "relationship_id", "target_partname", "line", "section_path", "cell_index", "cell_type", "extra"])


def make(spark, kind, *rows):
    """rows: (id, type, content, locator)"""
    return spark.createDataFrame([("d", n, i, t, c, {**NONE, **loc}, kind) for n, (i, t, c, loc) in enumerate(rows)], SCHEMA)


def ends(df):
    return sorted((r.type, r.from_id, r.to_id) for r in df.collect())


def at(p):
    return {"paragraph_index": p}


def box(x0, top, x1, bottom, page=1):
    return {"page": page, "bbox": [float(x0), float(top), float(x1), float(bottom)]}


def test_docx_captions(spark):
    own = make(spark, "docx", ("i1", "image", None, at(3)), ("i2", "image", None, at(4)), ("c1", "caption", "Figure 1. flow", at(5)), ("c2", "caption", "Table 1. m", at(6)), ("t1", "table", "| a |", {}), ("i3", "image", None, at(5)))
    assert ends(relations.figure_captions_docx(own)) == [("has_caption", "i2", "c1")]
    assert ends(relations.table_captions_docx(own)) == [("table_has_caption", "t1", "c2")]
    shared = make(spark, "docx", ("i1", "image", None, at(1)), ("i2", "image", None, at(1)), ("c", "caption", "图 2 x", at(2)))
    assert len(ends(relations.figure_captions_docx(shared))) == 2


def test_pdf_captions(spark):
    own = make(
        spark, "pdf", ("i1", "image", None, box(0, 300, 100, 330.5)), ("i2", "image", None, box(0, 300, 100, 320)), ("c1", "caption", "Figure 1. x", box(50, 342, 90, 350)), ("c2", "caption", "Figure 2. y", box(0, 342, 10, 350)),
        ("far", "image", None, box(0, 0, 100, 200)), ("side", "image", None, box(500, 300, 600, 330)), ("other", "image", None, box(0, 300, 100, 330, 2)), ("t", "table", "| |", box(0, 400, 90, 500)), ("ct", "caption", "Table 1. z", box(0, 380, 50, 390)),
    )
    assert ends(relations.captions_pdf(own, "image")) == [("has_caption", "i1", "c1"), ("has_caption", "i2", "c2")]
    assert json.loads(relations.captions_pdf(own, "image").where("from_id = 'i1'").first().metadata)["gap"] == 11.5
    assert ends(relations.captions_pdf(own, "table")) == [("table_has_caption", "t", "ct")]
    touching = make(spark, "pdf", ("i", "image", None, box(0, 0, 100, 50)), ("c", "caption", "Figure 1. x", box(0, 50, 100, 60)))
    assert ends(relations.captions_pdf(touching, "image")) == []


def test_references(spark):
    own = make(spark, "docx", ("i1", "image", None, at(0)), ("i2", "image", None, at(1)), ("c", "caption", "Figure 1. x", at(2)), ("p", "paragraph", "see Figure 1 and figure 1, Figure 2, Figure 99, turntable 5", at(3)), ("t1", "table", "|", {}), ("t2", "table", "|", {}), ("q", "paragraph", "见表２", at(4)))
    got = sorted((r.from_id, r.type, r.to_id, json.loads(r.metadata)["label_source"], json.loads(r.metadata)["label"]) for r in relations.references(own, relations.figure_captions_docx(own)).collect())
    assert got == [("p", "references_figure", "i2", "caption_label", "Figure 1"), ("p", "references_figure", "i2", "ordinal_fallback", "Figure 2"), ("q", "references_table", "t2", "ordinal_fallback", "表２")]
    assert relations.all_relations(own.limit(0)).count() == 0


def slow_boundaries(texts, anchors, tolerance):
    stream, ends = " ".join(texts), [len(" ".join(texts[:n])) for n in range(1, len(texts))]
    truth = [stream.index(a["marker"]) + len(a["marker"]) * (a["position"] != "before") for a in anchors if a["marker"] in stream]
    free, goals, matched = dict(enumerate(ends)), dict(enumerate(truth)), 0
    for d in range(tolerance + 1):
        for i in sorted(free):
            for j in sorted(goals):
                if i in free and j in goals and abs(free[i] - goals[j]) == d:
                    del free[i], goals[j]
                    matched += 1
    return matched


def test_boundaries():
    rnd = random.Random(4)
    for _ in range(200):
        texts = [" ".join("".join(rnd.choice("abc") for _ in range(3)) for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 9))]
        anchors = [{"marker": "".join(rnd.choice("abc") for _ in range(3)), "position": rnd.choice(["before", "after", None])} for _ in range(rnd.randrange(6))]
        got = metrics.boundaries(texts, anchors, tolerance := rnd.randrange(12))
        assert got["matched"] == slow_boundaries(texts, anchors, tolerance) and got["predicted"] == len(texts) - 1 and got["truth"] + len(got["missing"]) == len(anchors)
    assert metrics.boundaries(None, [{"marker": "x", "position": "after"}]) == {"predicted": 0, "truth": 0, "matched": 0, "missing": ["x"]}
    assert metrics.boundaries([" a ", None, "b"], [{"marker": "b", "position": "before"}], 1) == {"predicted": 2, "truth": 1, "matched": 1, "missing": []}


def test_order_and_prf(spark):
    rnd = random.Random(7)
    for _ in range(100):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(7))] for _ in range(2))
        common = max(n for n in range(len(a) + 1) for c in itertools.combinations(a, n) if any(c == d for d in itertools.combinations(b, n)))
        assert metrics.longest_common(a, b) == common
    assert metrics.longest_common(range(50_000), range(50_000, 0, -1)) == 1
    df = spark.createDataFrame([(0, 5, 0), (0, 0, 0), (4, 0, 0), (4, 5, 0), (2, 4, 2)], "p int, t int, m int")
    got = [tuple(r) for r in df.select(*metrics.prf(F.col("p"), F.col("t"), F.col("m"))).collect()]
    assert got == [(None, 0.0, None), (None, None, None), (0.0, None, None), (0.0, 0.0, 0.0), (1.0, 0.5, 2 / 3)]


def test_pairs_and_macro(spark):
    assert metrics.relation_pairs([{"a": "fig one", "b": "cap one"}, {"a": "fig one", "b": "cap one"}], [{"a": "one", "b": "one"}]) == {"predicted": 2, "truth": 1, "matched": 1}
    row = metrics.macro(spark.createDataFrame([(True, 1.0), (False, None), (None, None)], "ok boolean, x double"), ["ok", "x"]).first()
    assert tuple(row) == (3, 0.5, 1, 1.0, 2)
    groups = metrics.content_groups(spark.createDataFrame([("a", "b"), ("b", None), ("c", None)], "doc_id string, paired_with string")).first()
    assert tuple(groups) == (1, 1, 2)
    cell = spark.range(1).select(metrics.ratio(F.lit(1), F.lit(0), "no_elements").alias("a"), metrics.ratio(F.lit(1), F.lit(2), "no").alias("b")).first()
    assert (cell.a.value, cell.a.reason, cell.b.value, cell.b.reason) == (None, "no_elements", 0.5, None)
    assert spark.createDataFrame([("x y", None, "a\\b/c.png")], "c string, a string, r string").select(metrics.identifying_text("c", "a", "r")).first()[0] == "x y c.png"
