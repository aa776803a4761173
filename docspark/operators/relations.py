"""Relations between elements: captions of figures and tables, and mentions of both in text.

Elements are rows (document_id, ord, element_id, type, content, source_locator, source_type), one for each element. Joins meet
on the document and, for geometry, the page, or on the document and a position; the greedy one-to-one match folds over the
few candidates of one page.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.geometry import valid_box, x_overlap
from docspark.plans.local import with_local

#: Fixed value: how far below (above) its object a caption may begin (end).
GAP = 50.0


def _edge(kind: str, rule: str, **more: Column) -> list[Column]:
    metadata = F.to_json(F.struct(F.lit(rule).alias("rule"), *[c.alias(k) for k, c in more.items()]))
    return ["document_id", F.lit(kind).alias("type"), "from_id", "to_id", metadata.alias("metadata")]


def figure_captions_docx(elements: DataFrame) -> DataFrame:
    """An image in a paragraph and the figure caption in the next one; all images of the paragraph share it."""
    own = elements.where("source_type = 'docx'").withColumn("p", F.col("source_locator.paragraph_index"))
    images = own.where("type = 'image'").select("document_id", (F.col("p") + 1).alias("p"), F.col("element_id").alias("from_id"))
    captions = own.where((F.col("type") == "caption") & F.col("content").rlike(T.FIGURE_CAPTION)).select("document_id", "p", F.col("element_id").alias("to_id"))
    return images.join(captions, ["document_id", "p"]).select(*_edge("has_caption", "docx_adjacent_paragraph"))


def table_captions_docx(elements: DataFrame) -> DataFrame:
    """A table and the table caption right before it in the list of elements. Positions are joined, not sorted in a window."""
    own = elements.where("source_type = 'docx'")
    tables = own.where("type = 'table'").select("document_id", (F.col("ord") - 1).alias("ord"), F.col("element_id").alias("from_id"))
    captions = own.where((F.col("type") == "caption") & F.col("content").rlike(T.TABLE_CAPTION)).select("document_id", "ord", F.col("element_id").alias("to_id"))
    return tables.join(captions, ["document_id", "ord"]).select(*_edge("table_has_caption", "docx_preceding_block"))


def candidates_pdf(elements: DataFrame, kind: str) -> DataFrame:
    """(document_id, page, from_id, to_id, gap): objects and captions of one page that overlap in x, the caption below an image
    or above a table by more than 0 and at most GAP."""
    own = elements.where("source_type = 'pdf'").where(valid_box("source_locator.bbox")).select("document_id", F.col("source_locator.page").alias("page"), "element_id", "type", "content", F.col("source_locator.bbox").alias("box"))
    pattern = T.FIGURE_CAPTION if kind == "image" else T.TABLE_CAPTION
    objects = own.where(F.col("type") == kind).select("document_id", "page", F.col("element_id").alias("from_id"), F.col("box").alias("a"))
    captions = own.where((F.col("type") == "caption") & F.col("content").rlike(pattern)).select("document_id", "page", F.col("element_id").alias("to_id"), F.col("box").alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = b[1] - a[3] if kind == "image" else a[1] - b[3]
    return objects.join(captions, ["document_id", "page"]).withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") <= GAP) & (x_overlap("a", "b") > 0)).drop("a", "b")


def greedy(pairs: list[dict] | None) -> list[dict]:
    """A one-to-one choice: pairs (gap, from_id, to_id) in order, each end used once."""
    used: set[tuple[str, str]] = set()
    out = []
    for p in sorted(pairs or [], key=lambda p: (p["gap"], p["from_id"], p["to_id"])):
        ends = {("from", p["from_id"]), ("to", p["to_id"])}
        if not used & ends:
            used |= ends
            out.append(p)
    return out


def captions_pdf(elements: DataFrame, kind: str) -> DataFrame:
    """The caption of each image or table of a page, matched greedily by gap. Only candidate pairs of a page are brought
    together; their number is bounded by what fits on a page."""
    pair = "struct<gap:double,from_id:string,to_id:string>"
    pages = candidates_pdf(elements, kind).groupBy("document_id", "page").agg(F.collect_list(F.struct("gap", "from_id", "to_id")).alias("pairs"))
    chosen = with_local(pages, "chosen", f"array<{pair}>", greedy, "pairs", keep=["document_id"])
    rows = chosen.select("document_id", F.explode("chosen").alias("c")).select("document_id", "c.*")
    name, rule = ("has_caption", "pdf_caption_below") if kind == "image" else ("table_has_caption", "pdf_caption_above")
    return rows.select(*_edge(name, rule, gap=F.col("gap")))


def references(elements: DataFrame, caption_edges: DataFrame) -> DataFrame:
    """Mentions of figures and tables in text, resolved by the number in a caption, else by order in the document.

    A number is taken once for each element and family. Mentions that nothing answers give no row. DOCX and PDF only.
    """
    own = elements.where("source_type in ('pdf', 'docx')")
    text = own.where("type in ('paragraph', 'heading', 'list_item')").select("document_id", F.col("element_id").alias("from_id"), "content")
    found = []
    for family, pattern in (("figure", T.FIGURE_MENTION), ("table", T.TABLE_MENTION)):
        whole = F.regexp_extract_all("content", F.lit(pattern), 0)
        mentions = text.select("document_id", "from_id", F.posexplode(whole).alias("pos", "label")).withColumn("n", T.ascii_digits(F.regexp_extract("label", r"([0-9０-９]+)$", 1)).cast("decimal(38,0)"))
        found.append(mentions.groupBy("document_id", "from_id", "n").agg(F.min_by("label", "pos").alias("label")).withColumn("family", F.lit(family)))
    mentions = found[0].unionByName(found[1])
    kinds = own.where("type in ('image', 'table')").select("document_id", F.col("element_id").alias("to_id"), "ord", F.when(F.col("type") == "image", "figure").otherwise("table").alias("family"))
    # one-based order within the document and family; a document's objects are counted, its text isn't sorted
    pool = kinds.withColumn("n", F.row_number().over(Window.partitionBy("document_id", "family").orderBy("ord")).cast("decimal(38,0)"))
    number = lambda p: T.ascii_digits(F.regexp_extract("content", p.replace("(?i)", "(?i)^"), 1))
    named = own.where("type = 'caption'").select("document_id", F.col("element_id").alias("caption"), F.col("ord").alias("caption_ord"), "content")
    ends = caption_edges.select("document_id", F.col("from_id").alias("target"), F.col("to_id").alias("caption"))
    ends = ends.groupBy("document_id", "caption").agg(F.max("target").alias("target"))
    labels = named.join(ends, ["document_id", "caption"]).join(kinds.select("document_id", F.col("to_id").alias("target"), "family"), ["document_id", "target"])
    label = F.when(F.col("family") == "figure", number(T.FIGURE_MENTION)).otherwise(number(T.TABLE_MENTION))
    labels = labels.withColumn("n", F.nullif(label, F.lit("")).cast("decimal(38,0)")).where("n is not null").groupBy("document_id", "family", "n").agg(F.min_by("target", "caption_ord").alias("labelled"))
    out = mentions.join(labels, ["document_id", "family", "n"], "left").join(pool.drop("ord"), ["document_id", "family", "n"], "left")
    out = out.withColumn("source", F.when(F.col("labelled").isNotNull(), "caption_label").otherwise("ordinal_fallback")).withColumn("to_id", F.coalesce("labelled", "to_id")).where("to_id is not null")
    metadata = F.to_json(F.struct(F.lit("deterministic").alias("confidence"), "label", F.col("source").alias("label_source"), F.lit("ordinal_document_order").alias("resolution_method")))
    return out.select("document_id", F.concat(F.lit("references_"), "family").alias("type"), "from_id", "to_id", metadata.alias("metadata"))


def all_relations(elements: DataFrame) -> DataFrame:
    """Every relation of every document."""
    captions = figure_captions_docx(elements).unionByName(table_captions_docx(elements)).unionByName(captions_pdf(elements, "image")).unionByName(captions_pdf(elements, "table"))
    return captions.unionByName(references(elements, captions))


def ordered(edges: Column) -> Column:
    """A document's relations in their order: by type and ends."""
    return F.array_sort(edges)


_FIGURE, _TABLE, _FIGURES, _TABLES = (re.compile(p) for p in (T.FIGURE_CAPTION, T.TABLE_CAPTION, T.FIGURE_MENTION, T.TABLE_MENTION))


def _boxed(e: dict) -> list[float] | None:
    b = (e["source_locator"] or {}).get("bbox")
    return b if b and len(b) == 4 and all(x is not None and abs(x) < float("inf") for x in b) else None


def within(elements: list[dict] | None, source_type: str | None) -> list[dict]:
    """The relations of one document in their order, by the rules of `all_relations`, without leaving its row. DOCX and PDF only."""
    if source_type not in ("docx", "pdf"):
        return []
    by = defaultdict(list)
    for e in sorted(elements or [], key=lambda e: e["ord"]):
        by[e["type"]].append(e)
    place = lambda e, k: (e["source_locator"] or {}).get(k)
    named = {"image": [c for c in by["caption"] if _FIGURE.match(c["content"] or "")], "table": [c for c in by["caption"] if _TABLE.match(c["content"] or "")]}
    edges: list[tuple[str, str, str, dict]] = []
    if source_type == "docx":
        edges += [("has_caption", i["element_id"], c["element_id"], {"rule": "docx_adjacent_paragraph"}) for i in by["image"] for c in named["image"] if place(i, "paragraph_index") is not None and place(c, "paragraph_index") == place(i, "paragraph_index") + 1]
        edges += [("table_has_caption", t["element_id"], c["element_id"], {"rule": "docx_preceding_block"}) for t in by["table"] for c in named["table"] if c["ord"] == t["ord"] - 1]
    else:
        for kind, name, rule in (("image", "has_caption", "pdf_caption_below"), ("table", "table_has_caption", "pdf_caption_above")):
            pages = defaultdict(list)
            for c in named[kind]:
                if (b := _boxed(c)) and place(c, "page") is not None:
                    pages[place(c, "page")].append((c["element_id"], b))
            for page in sorted(pages):
                pairs = []
                for o in by[kind]:
                    if (a := _boxed(o)) and place(o, "page") == page:
                        gaps = [(b[1] - a[3] if kind == "image" else a[1] - b[3], c) for c, b in pages[page] if min(a[2], b[2]) > max(a[0], b[0])]
                        pairs += [{"gap": g, "from_id": o["element_id"], "to_id": c} for g, c in gaps if 0 < g <= GAP]
                edges += [(name, p["from_id"], p["to_id"], {"rule": rule, "gap": p["gap"]}) for p in greedy(pairs)]
    objects = {"figure": by["image"], "table": by["table"]}
    family = {o["element_id"]: f for f, found in objects.items() for o in found}
    held = defaultdict(str)
    for _, target, caption, _ in edges:
        held[caption] = max(held[caption], target)
    digits = lambda m: int(m[1])  # noqa: E731  # full-width digits too
    labelled: dict[tuple[str, int], str] = {}
    for c in by["caption"]:
        target = held.get(c["element_id"], "")
        if target in family and (m := (_FIGURES if family[target] == "figure" else _TABLES).match(c["content"] or "")):
            labelled.setdefault((family[target], digits(m)), target)
    for e in (e for kind in ("paragraph", "heading", "list_item") for e in by[kind]):
        for f, pattern in (("figure", _FIGURES), ("table", _TABLES)):
            mentions = {digits(m): m[0] for m in reversed([*pattern.finditer(e["content"] or "")])}
            for n, label in mentions.items():
                to = labelled.get((f, n)) or (objects[f][n - 1]["element_id"] if 0 < n <= len(objects[f]) else None)
                if to:
                    edges.append((f"references_{f}", e["element_id"], to, {"confidence": "deterministic", "label": label, "label_source": "caption_label" if (f, n) in labelled else "ordinal_fallback", "resolution_method": "ordinal_document_order"}))
    edges.sort(key=lambda x: x[:3])
    return [{"type": t, "from_id": a, "to_id": b, "metadata": json.dumps(m, ensure_ascii=False, separators=(",", ":"))} for t, a, b, m in edges]
