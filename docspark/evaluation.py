"""Evaluation of a set of documents: manifest and annotations in, metrics of each document and a summary out.

The manifest is small and checked on the driver; documents are parsed, chunked and measured as rows.
"""

from __future__ import annotations

import datetime
import importlib.metadata
import json
import os
import platform
import re
import subprocess
import time

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import metrics
from docspark.pipeline import documents
from docspark.plans.local import with_local
from docspark.registry import Registry, built_in
from docspark.sources.files import binary_files, identified
from docspark.types import CHUNK, ELEMENT, RELATION

VERSIONS = ("1.0", "1.1")
#: Metrics that the summary averages, each with why a document that was parsed may have no value.
RATIOS = {
    "schema_valid": "no_schema_check", "pdf_locator_valid_ratio": "not_a_pdf", "docx_locator_valid_ratio": "not_a_docx", "image_resource_exists_ratio": "no_images", "chunk_reference_intact_ratio": "no_chunks",
    "text_preservation_equal": "no_text", "text_char_multiset_precision": "no_text", "text_char_multiset_recall": "no_text", "heading_boundary_compliance": "no_headings",
    "chunk_boundary_precision": "no_boundaries", "chunk_boundary_recall": "no_boundaries", "chunk_boundary_f1": "no_boundaries",
}
SECTIONS = ("report_version", "devset", "documents", "expected_failures", "summary", "provenance")
PROVENANCE = ("git_commit", "git_dirty", "report_version", "parser_name", "dependencies", "max_chars", "tolerance_chars", "run_timestamp_iso", "python", "pyspark", "total_ms")
CHECKS = ("required_markers", "forbidden_markers", "must_not_error_codes", "max_silent_drop_count")
#: What differs between two runs of the same documents.
VOLATILE = ("total_ms", "provenance")
ENTRY = (
    "doc_id string, path string, source_type string, sha256 string, categories array<string>, paired_with string, "
    "expect struct<element_count_by_type:map<string,int>,required_markers:array<string>,forbidden_markers:array<string>,must_not_error_codes:array<string>,max_silent_drop_count:int>, "
    "anchors array<struct<marker:string,position:string>>, headings array<struct<level:int,text:string>>, figure_pairs array<struct<a:string,b:string>>, table_pairs array<struct<a:string,b:string>>"
)


class ManifestError(ValueError):
    """The manifest is invalid."""


def safe(root: str, path: object) -> str:
    """A relative path with forward slashes that stays within root."""
    if not isinstance(path, str) or not path or "\\" in path or os.path.isabs(path) or re.match(r"[A-Za-z]:", path):
        raise ManifestError(f"not a relative path with forward slashes: {path!r}")
    whole = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([whole, os.path.realpath(root)]) != os.path.realpath(root):
        raise ManifestError(f"outside of the project: {path!r}")
    return whole


def load_manifest(path: str, root: str) -> dict:
    """The manifest as a dict, if its version, entries, paths and expectations are valid."""
    with open(path, encoding="utf-8") as f:
        try:
            manifest = json.load(f)
        except ValueError as e:
            raise ManifestError(str(e)) from e
    if not isinstance(manifest, dict) or manifest.get("manifest_version", manifest.get("version")) not in VERSIONS:
        raise ManifestError("unknown version")
    names: set[str] = set()
    for entry in [*manifest.get("documents", []), *manifest.get("expected_failures", [])]:
        if not isinstance(entry, dict) or not entry.get("doc_id") or entry["doc_id"] in names:
            raise ManifestError("doc_id is missing or repeated")
        names.add(entry["doc_id"])
        safe(root, entry.get("path"))
        if entry.get("annotation_file"):
            safe(root, entry["annotation_file"])
        expect = entry.get("expectations") or {}
        if "max_silent_drop_count" in expect and "element_count_by_type" not in expect:
            raise ManifestError(f"{entry['doc_id']}: max_silent_drop_count needs element_count_by_type")
    return manifest


def load_annotation(path: str | None) -> dict | None:
    """An annotation file; null where it is missing or unreadable."""
    if not path or not os.path.isfile(path):
        return None
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else None
    except (OSError, ValueError):
        return None


def entries(spark: SparkSession, manifest: dict, root: str) -> DataFrame:
    """The manifest's documents with their annotations as rows (ENTRY)."""
    rows = []
    for d in manifest.get("documents", []):
        note = load_annotation(safe(root, d["annotation_file"]) if d.get("annotation_file") else None) or {}
        expect = {"element_count_by_type": None, "required_markers": None, "forbidden_markers": None, "must_not_error_codes": None, "max_silent_drop_count": None} | (d.get("expectations") or {})
        pairs = lambda key, one: [{"a": x.get(one), "b": x.get("caption_text")} for x in note[key]] if key in note else None  # noqa: B023, E731
        rows.append((d["doc_id"], f"file:{safe(root, d['path'])}", d.get("source_type"), d.get("sha256"), d.get("categories") or [], d.get("paired_with"), {k: expect[k] for k in list(expect)[:5]}, note.get("chunk_boundary_anchors"), note.get("heading_order"), pairs("figure_caption_pairs", "figure_marker"), pairs("table_caption_pairs", "table_marker")))
    return spark.createDataFrame(rows, ENTRY)


def measured(parsed: DataFrame, notes: DataFrame, tolerance: int = metrics.TOLERANCE, images: DataFrame | None = None) -> DataFrame:
    """One row of metrics for each document of `notes` (ENTRY), whether it was parsed or not.

    parsed: (doc_id, source_type, elements, chunks, relations, error_code). Metrics of a failed document are null. images: (path,
    length) of image files. reasons says of each averaged metric without a value why it has none.
    """
    own = notes.drop("source_type").join(parsed, "doc_id", "left")
    exploded = own.select("doc_id", F.col("doc_id").alias("document_id"), "source_type", F.explode("elements").alias("e")).select("document_id", "source_type", "e.*")
    chunks = own.select(F.col("doc_id").alias("document_id"), F.explode("chunks").alias("c")).select("document_id", "c.*")
    by = lambda df, *columns: df.withColumnRenamed("document_id", "doc_id").select("doc_id", *columns)
    counts = metrics.element_counts(exploded)
    expected = own.select(F.col("doc_id").alias("document_id"), F.explode("expect.element_count_by_type").alias("type", "n"))
    overlap = metrics.character_overlap(metrics.character_counts(exploded.where("type <> 'image'"), "content"), metrics.character_counts(chunks, "text"))
    there = metrics.image_resources(exploded, images) if images is not None else None
    out = own
    for part in (
        by(metrics.locator_ratio(exploded, "pdf"), F.col("ratio").alias("pdf_locator_valid_ratio")),
        by(metrics.locator_ratio(exploded, "docx"), F.col("ratio").alias("docx_locator_valid_ratio")),
        by(metrics.chunk_references(chunks, exploded), (F.col("intact") / F.col("chunks")).alias("chunk_reference_intact_ratio")),
        by(metrics.heading_compliance(exploded, chunks), (F.col("first") / F.col("headings")).alias("heading_boundary_compliance")),
        by(overlap, F.col("precision").alias("text_char_multiset_precision"), F.col("recall").alias("text_char_multiset_recall")),
        by(metrics.silent_drops(expected, counts), F.col("dropped").alias("silent_drop_count")),
        by(counts.groupBy("document_id").agg(F.sum("n").alias("element_count_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("element_count_by_type")), "element_count_total", "element_count_by_type"),
        *([by(there, (F.col("present") / F.col("images")).alias("image_resource_exists_ratio"))] if there is not None else []),
    ):
        out = out.join(part, "doc_id", "left")
    ok = F.col("error_code").isNull() & F.col("elements").isNotNull()
    words = F.array_join(F.transform(F.filter("elements", lambda e: e["type"] != "image"), lambda e: F.coalesce(e["content"], F.lit(""))), "\n")
    if there is None:
        out = out.withColumn("image_resource_exists_ratio", F.lit(None).cast("double"))
    # what the schema finds wrong is an error of the document, found before its contract is looked at
    out = out.withColumn("pipeline_success", ok).withColumn("schema_valid", F.when(ok | (F.col("error_code") == "parser_contract_mismatch"), True).when(F.col("error_code") == "schema_validation_failed", False))
    out = out.withColumn("text_preservation_equal", F.when(ok, T.squeeze(words) == T.squeeze(F.array_join("chunks.text", " "))))
    for name, markers, want in (("required_markers", "expect.required_markers", True), ("forbidden_markers", "expect.forbidden_markers", False)):
        missing = metrics.missing_markers(F.col(markers), words)
        out = out.withColumn(f"{name}_ok", F.when(ok & F.col(markers).isNotNull(), (F.size(missing) == 0) if want else (F.size(missing) == F.size(markers))))
    codes = F.col("expect.must_not_error_codes")
    out = out.withColumn("must_not_error_codes_ok", F.when(codes.isNotNull(), ~F.coalesce(F.array_contains(codes, F.col("error_code")), F.lit(False))))
    out = out.withColumn("max_silent_drop_count_ok", F.when(ok & F.col("expect.max_silent_drop_count").isNotNull(), F.col("silent_drop_count") <= F.col("expect.max_silent_drop_count")))
    heads = F.transform(F.filter("elements", lambda e: e["type"] == "heading"), lambda e: F.concat_ws("|", F.coalesce(F.get_json_object(e["metadata"], "$.level"), F.lit("")), T.normalize(e["content"])))
    truth = F.transform("headings", lambda h: F.concat_ws("|", h["level"].cast("string"), T.normalize(h["text"])))
    out = out.withColumn("_found", heads).withColumn("_true", truth).withColumn("_texts", F.col("chunks.text"))
    out = metrics.heading_order(out, "_found", "_true")
    out = metrics.chunk_boundaries(out, "_texts", "anchors", tolerance)
    named = lambda name, p, t, m, has: F.when(ok & has, F.struct(*metrics.prf(p, t, m))).alias(name)
    known = F.map_from_entries(F.transform("elements", lambda e: F.struct(e["element_id"], metrics_text(e))))
    for name, pairs, kind in (("figure_caption_prf", "figure_pairs", "has_caption"), ("table_caption_prf", "table_pairs", "table_has_caption")):
        mine = F.transform(F.filter("relations", lambda r, kind=kind: r["type"] == kind), lambda r: F.struct(F.col("_known")[r["from_id"]].alias("a"), F.col("_known")[r["to_id"]].alias("b")))
        out = out.withColumn("_known", known).withColumn("_pairs", F.coalesce(mine, F.array().cast("array<struct<a:string,b:string>>"))).withColumn("_truth", F.transform(pairs, lambda t: F.struct(T.normalize(t["a"]).alias("a"), T.normalize(t["b"]).alias("b")))).drop("_known")
        out = _paired(out, name, ok, pairs)
    out = out.select(
        "*",
        named("heading_order_prf", F.size("_found"), F.size("_true"), F.col("matched"), F.col("headings").isNotNull()),
        named("chunk_boundary_prf", F.col("boundary.predicted"), F.col("boundary.truth"), F.col("boundary.matched"), F.col("anchors").isNotNull()),
        F.col("boundary.missing").alias("missing_markers"),
    )
    out = out.withColumns({f"chunk_boundary_{k}": F.col("chunk_boundary_prf")[k] for k in ("precision", "recall", "f1")})
    why = F.create_map([x for c, reason in RATIOS.items() for x in (F.lit(c), F.when(F.col(c).isNull(), F.when(ok, F.when(F.lit(c.startswith("chunk_boundary")) & F.col("anchors").isNull(), "no_annotation").otherwise(reason)).otherwise("pipeline_failed")))])
    out = out.withColumn("reasons", F.map_filter(why, lambda _, v: v.isNotNull()))
    return out.select("doc_id", "path", "source_type", "categories", "paired_with", "error_code", "pipeline_success", "element_count_total", "element_count_by_type", "silent_drop_count", *RATIOS, "reasons", *[f"{c}_ok" for c in CHECKS], "heading_order_prf", "chunk_boundary_prf", "missing_markers", "figure_caption_prf", "table_caption_prf")


def metrics_text(e: F.Column) -> F.Column:
    return metrics.identifying_text(e["content"], F.get_json_object(e["metadata"], "$.alt"), F.coalesce(e["resource_path"], F.lit("")))


def _paired(df: DataFrame, name: str, ok: F.Column, pairs: str) -> DataFrame:
    out = with_local(df, "_m", "struct<predicted:int,truth:int,matched:int>", metrics.relation_pairs, "_pairs", "_truth")
    value = F.when(ok & F.col(pairs).isNotNull(), F.struct(*metrics.prf(F.col("_m.predicted"), F.col("_m.truth"), F.col("_m.matched"))))
    return out.withColumn(name, value).drop("_m", "_pairs", "_truth")


def parse_entries(spark: SparkSession, notes: DataFrame, registry: Registry | None = None, limit: int = 800, parser: str = "auto") -> DataFrame:
    """(doc_id, source_type, elements, chunks, relations, error_code): one scan of all files that the manifest names.

    `auto` parses by the source type that the manifest names, Markdown plain. A type that no parser is registered for is
    `unsupported_type`, as is a file of none.
    """
    registry = registry or built_in()
    paths = [r.path for r in notes.select("path").distinct().collect() if os.path.isfile(r.path.removeprefix("file:"))]
    if not paths:
        empty = f"doc_id string, source_type string, elements array<{ELEMENT}>, chunks array<{CHUNK}>, relations array<{RELATION}>, error_code string"
        return spark.createDataFrame([], empty)
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "content")
    key = F.regexp_replace("path", "^file:/*", "/")
    wanted = notes.select(key.alias("path"), "doc_id", F.col("source_type").alias("wanted"))
    rows = identified(files.withColumn("path", key)).join(wanted, "path").withColumn("source_type", F.coalesce("wanted", "source_type"))
    rows = rows.withColumn("text", F.when(F.col("source_type").isin("pdf", "docx"), None).otherwise(T.decode("content")))
    plain = Registry()
    for c in registry.parsers.values():
        if c.name != "markdown_enhanced":
            plain.register(c)
    plain.families["pdf"] = "page_geometry"
    known = sorted({s for c in plain.parsers.values() for s in c.source_types} | {"pdf"})
    # the parser of a manifest's type, whatever the file's name
    suffix = F.create_map([F.lit(x) for s in known for x in (s, next((e for c in plain.parsers.values() if s in c.source_types for e in c.extensions if plain.candidates(e)[0].name == c.name), ".pdf"))])
    suffix = F.when(F.col("source_type") == "docx", ".docx").when(F.col("source_type") == "pdf", ".pdf").otherwise(suffix[F.col("source_type")])
    supported = F.coalesce(F.col("source_type").isin(*known), F.lit(False))
    out = documents(rows.where(supported).withColumn("path", F.concat("path", suffix)), "text", "content", plain, parser, limit).select("doc_id", "source_type", "elements", "chunks", "relations", "error_code")
    other = rows.where(~supported).select("doc_id", "source_type", F.lit("unsupported_type").alias("error_code"))
    return out.unionByName(other, allowMissingColumns=True)


def summarise(rows: DataFrame) -> dict:
    """Counts, success rate, macro averages (with how many documents had no value) and checks, as one aggregation."""
    parts = [F.count("*").alias("documents"), F.count_if(F.col("pipeline_success")).alias("succeeded"), F.sum("element_count_total").alias("elements"), F.count("element_count_total").alias("participating"), F.sum("silent_drop_count").alias("silent_drops")]
    for c in RATIOS:
        parts += [F.avg(F.col(c).cast("double")).alias(f"{c}_mean"), F.count_if(F.col(c).isNull()).alias(f"{c}_none")]
    for c in CHECKS:
        parts += [F.count(f"{c}_ok").alias(f"{c}_evaluated"), F.count_if(F.col(f"{c}_ok")).alias(f"{c}_passed")]
    r = rows.agg(*parts).first()
    return {
        "counts": {"documents": r.documents, "elements": r.elements, "participating_docs": r.participating},
        "success_rate": r.succeeded / r.documents if r.documents else None,
        "silent_drop_total": r.silent_drops,
        "macro_averages": {c: {"value": r[f"{c}_mean"], "not_evaluated": r[f"{c}_none"]} for c in RATIOS},
        "expectation_checks": {c: {"evaluated": r[f"{c}_evaluated"], "passed": r[f"{c}_passed"], "failed": r[f"{c}_evaluated"] - r[f"{c}_passed"]} for c in CHECKS},
    }


def git_state(root: str) -> dict:
    """The commit of a folder and whether it has changes; without an answer none, and dirty."""
    try:
        ask = lambda *words: subprocess.run(["git", *words], cwd=root, capture_output=True, text=True, timeout=10)
        commit, status = ask("rev-parse", "HEAD"), ask("status", "--porcelain")
        return {"git_commit": commit.stdout.strip() or None if commit.returncode == 0 else None, "git_dirty": bool(status.returncode or status.stdout.strip())}
    except (OSError, subprocess.SubprocessError):
        return {"git_commit": None, "git_dirty": True}


def versions() -> dict:
    """The installed versions of the libraries that parsers may use, null for those that aren't there."""
    out = {}
    for name in ("pdfplumber", "python-docx", "pypdfium2", "kreuzberg", "pyarrow"):
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = None
    return out


def run(spark: SparkSession, manifest_path: str, root: str, limit: int = 800, tolerance: int = metrics.TOLERANCE, parser: str = "auto", images: str | None = None) -> dict:
    """The evaluation report of a manifest: devset, documents, expected failures, summary, provenance. images: a folder of image files."""
    began, manifest = time.time(), load_manifest(manifest_path, root)
    notes, failing = entries(spark, manifest, root), manifest.get("expected_failures", [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(images).select("path", "length") if images else None
    parsed = parse_entries(spark, notes, limit=limit, parser=parser).cache()
    rows = measured(parsed, notes, tolerance, files).withColumn("error_code", F.coalesce("error_code", F.when(~F.col("pipeline_success"), "file_not_found"))).cache()
    groups = metrics.content_groups(notes).first()
    codes = {}
    if failing:
        bad = spark.createDataFrame([(f["doc_id"], f"file:{safe(root, f['path'])}", f.get("source_type")) for f in failing], "doc_id string, path string, source_type string")
        codes = {r.doc_id: r.error_code for r in parse_entries(spark, bad, limit=limit, parser=parser).select("doc_id", "error_code").collect()}  # as many as the manifest names
    found = [(f, codes.get(f["doc_id"], "file_not_found")) for f in failing]
    kinds = notes.groupBy("source_type").count().collect()
    return {
        "report_version": "1.3",
        "devset": {"files": sum(k["count"] for k in kinds), "by_type": {k.source_type: k["count"] for k in kinds}, "categories": sorted({c for r in notes.select("categories").collect() for c in r.categories}), "content_groups": groups.groups if groups else 0},
        "documents": [r.asDict(recursive=True) for r in rows.orderBy("doc_id").toLocalIterator()],
        "expected_failures": [{"doc_id": f["doc_id"], "expected": f.get("expected_error_code"), "actual": code, "matched": code == f.get("expected_error_code")} for f, code in found],
        "summary": {**summarise(rows), "partition_violations": partitioned(parsed.withColumnRenamed("doc_id", "document_id")).count()},
        "provenance": {
            **git_state(root), "report_version": "1.3", "parser_name": parser, "dependencies": versions(), "max_chars": limit, "tolerance_chars": tolerance,
            "run_timestamp_iso": datetime.datetime.now().astimezone().isoformat(), "python": platform.python_version(), "pyspark": pyspark.__version__, "total_ms": round((time.time() - began) * 1000),
        },
    }


def report_errors(report: object) -> list[str]:
    """What is wrong with a report: sections that are missing, values of the wrong kind, ratios out of range."""
    if not isinstance(report, dict):
        return ["the report is no object"]
    out = [f"{x} is missing" for x in SECTIONS if x not in report]
    if out:
        return out
    kinds = {"devset": dict, "documents": list, "expected_failures": list, "summary": dict, "provenance": dict, "report_version": str}
    out += [f"{k} must be {t.__name__}" for k, t in kinds.items() if not isinstance(report[k], t)]
    if out:
        return out
    out += [f"provenance.{k} is missing" for k in PROVENANCE if k not in report["provenance"]]
    out += [f"summary.{k} is missing" for k in ("counts", "success_rate", "silent_drop_total", "macro_averages", "expectation_checks") if k not in report["summary"]]
    number = lambda v: isinstance(v, int | float)
    for c in RATIOS:
        cell = report["summary"].get("macro_averages", {}).get(c)
        if not isinstance(cell, dict) or not (cell.get("value") is None or number(cell["value"]) and 0 <= cell["value"] <= 1) or not isinstance(cell.get("not_evaluated"), int):
            out.append(f"summary.macro_averages.{c} must have a value from 0 to 1 or null and a count")
    for n, d in enumerate(report["documents"]):
        if not isinstance(d, dict) or not d.get("doc_id") or not isinstance(d.get("pipeline_success"), bool):
            out.append(f"documents.{n} must have doc_id and pipeline_success")
            continue
        out += [f"documents.{n}.{c} must be from 0 to 1 or null" for c in RATIOS if c not in d or not (d[c] is None or number(d[c]) and 0 <= d[c] <= 1)]
        out += [f"documents.{n}.{c} has no reason" for c in RATIOS if d.get(c) is None and c not in (d.get("reasons") or {})]
    out += [f"expected_failures.{n} must have doc_id and matched" for n, f in enumerate(report["expected_failures"]) if not isinstance(f, dict) or not f.get("doc_id") or not isinstance(f.get("matched"), bool)]
    return out


def write(report: dict, path: str) -> None:
    """Writes a report after checking it."""
    if broken := report_errors(json.loads(json.dumps(report, default=str))):
        raise ValueError("; ".join(broken[:20]))
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2, default=str)


def same(a: dict, b: dict) -> list[str]:
    """The ids of documents that differ between two reports, apart from what may differ."""
    strip = lambda d: {k: v for k, v in d.items() if k not in VOLATILE}
    left, right = ({d["doc_id"]: strip(d) for d in x["documents"]} for x in (a, b))
    return sorted(k for k in left.keys() | right.keys() if left.get(k) != right.get(k))


def partitioned(documents: DataFrame) -> DataFrame:
    """(document_id, element_id, held, visible): elements whose visible characters the spans of chunks don't hold once each; split
    elements are held by several chunks in turn. Images and blank elements are in no chunk."""
    own = documents.select("document_id", F.explode("elements").alias("e")).where("e.type <> 'image'").select("document_id", "e.element_id", "e.content")
    spans = documents.select("document_id", F.explode("chunks").alias("c")).select("document_id", F.explode("c.source_spans").alias("s")).select("document_id", "s.*")
    piece = F.length(T.squeeze(F.substring("content", F.col("start") + 1, F.col("end") - F.col("start"))))
    each = own.join(spans, ["document_id", "element_id"], "left").groupBy("document_id", "element_id").agg(F.coalesce(F.sum(piece), F.lit(0)).alias("held"), F.coalesce(F.length(T.squeeze(F.first("content"))), F.lit(0)).alias("visible"))
    return each.where("held <> visible")
