"""Command line: parse one file, parse many, check documents, evaluate a manifest, show the parsers."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import functions as F

from docspark import evaluation
from docspark.operators.validation import chunk_violations, element_violations, explode_violations, header_violations, relation_violations
from docspark.pipeline import documents
from docspark.registry import RegistrationError, built_in
from docspark.session import session
from docspark.sources.files import as_json, binary_files, collisions, identified, summary, unread, with_images, write_documents
from docspark.types import CHUNK, ELEMENT, RELATION, SCHEMA_VERSIONS

FIELDS = ["document_id", "path", "source_type", "source_hash", "parser_name", "elements", "chunks", "relations", "warnings", "metadata"]


def log_event(log: str | None, verbose: bool, name: str, level: str = "INFO", **more) -> None:
    """A line of JSON to a log, which grows, and to the error output if wanted."""
    line = json.dumps({"timestamp": time.time(), "level": level, "event": name, **more}, ensure_ascii=False)
    if verbose:
        print(line, file=sys.stderr)
    if log:
        os.makedirs(os.path.dirname(os.path.abspath(log)), exist_ok=True)
        with open(log, "a", encoding="utf-8") as f:
            f.write(f"{line}\n")


def refuse(path: str, code: str, message: str) -> int:
    """Prints one structured error and gives the exit code for it."""
    print(json.dumps({"input": path, "errors": [{"code": code, "message": message}]}, ensure_ascii=False), file=sys.stderr)
    return 1


def run(paths: list[str], output: str, parser: str, limit: int, plugins: list[str], log: str | None, single: bool, verbose: bool = False, images: str | None = None) -> int:
    registry = built_in()
    try:
        registry.load(plugins)
    except RegistrationError as e:
        return refuse(paths[0], str(e).split(":")[0], str(e))
    if parser != "auto" and parser not in registry.parsers:
        return refuse(paths[0], "unknown_parser", f"{parser!r} is none of {sorted(registry.parsers)}")
    if missing := [p for p in paths if not os.path.exists(p) and not any(c in p for c in "*?[")]:
        return refuse(missing[0], "file_not_found", "there is no such file")
    if single and parser == "auto" and not registry.candidates(os.path.splitext(paths[0])[1]):
        return refuse(paths[0], "unsupported_type", "no parser takes such files")
    spark, began = session(), time.time()
    files = binary_files(spark, paths[0]).withColumn("given", F.lit(0))
    for n, p in enumerate(paths[1:], 1):
        files = files.unionByName(binary_files(spark, p).withColumn("given", F.lit(n)))
    log_event(log, verbose, "batch_start", parser=parser, max_chars=limit)
    read = documents(identified(collisions(files, order="given")), "text", "content", registry, parser, limit)
    out = read.withColumn("error_code", F.coalesce(F.when(F.col("stem_collision"), "stem_collision"), "error_code"))
    out = with_images(out, "content", images or os.path.join(os.path.dirname(os.path.abspath(output)) if single else output, "images")).drop("content", "text").cache()
    good = out.where("error_code is null")
    if single:
        failed = out.where("error_code is not null").select("path", "error_code", "error_details").toLocalIterator()
        if errors := [{"code": r.error_code, "message": r.error_details or r.error_code} for r in failed]:
            print(json.dumps({"input": paths[0], "errors": errors}, ensure_ascii=False), file=sys.stderr)
            return 1
        try:
            with open(output, "w", encoding="utf-8") as f:
                f.writelines(json.dumps(json.loads(r.value), ensure_ascii=False, indent=2) for r in as_json(good, FIELDS).toLocalIterator())
        except OSError as e:
            return refuse(paths[0], "write_failed", str(e))
        return 0
    body = F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})
    written = write_documents(good.withColumn("_body", body), output, "stem", "_body", "path")
    status = out.where("error_code is not null").select("path", "error_code").unionByName(written).unionByName(unread(files, out)).cache()
    result = summary(status, time.time() - began, spark.sparkContext.defaultParallelism)
    with open(os.path.join(output, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(result, f, ensure_ascii=False, indent=2)
    log_event(log, verbose, "batch_done", **{k: v for k, v in result.items() if k != "errors"})
    for e in result["errors"]:
        log_event(log, verbose, "file_failed", "ERROR", **e)
    return int(result["failed"] > 0)


def evaluate(manifest: str, output: str, root: str, limit: int, tolerance: int, parser: str, log: str | None, verbose: bool) -> int:
    """Writes the evaluation report of a manifest; 2 if the manifest or the report is invalid."""
    try:
        log_event(log, verbose, "evaluation_start", manifest=manifest)
        report = evaluation.run(session(), manifest, root, limit, tolerance, parser)
        evaluation.write(report, output)
    except (evaluation.ManifestError, OSError, ValueError) as e:
        print(json.dumps({"input": manifest, "errors": [{"code": "invalid_manifest", "message": str(e)}]}), file=sys.stderr)
        return 2
    log_event(log, verbose, "evaluation_done", documents=len(report["documents"]), success_rate=report["summary"]["success_rate"])
    return 0


def validate_report(path: str) -> int:
    """Prints what is wrong with an evaluation report; 1 if anything is, 2 if there is no such file."""
    if not os.path.isfile(path):
        return refuse(path, "file_not_found", "there is no such file") + 1
    with open(path, encoding="utf-8") as f:
        try:
            broken = evaluation.report_errors(json.load(f))
        except ValueError as e:
            broken = [str(e)]
    print("\n".join(broken))
    return int(bool(broken))


def validate(paths: list[str]) -> int:
    """Prints the violations of documents written as JSON; 1 if there are any or a file is no such document."""
    spark = session()
    schema = f"document_id string, source_path string, path string, source_type string, source_hash string, parser_name string, parser_version string, schema_version string, warnings string, errors string, elements array<{ELEMENT}>, chunks array<{CHUNK}>, relations array<{RELATION}>"
    texts = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", schema).alias("d"))
    rows = texts.select("file", "d.*").withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSIONS[-1]))).withColumn("source_path", F.coalesce("source_path", "path"))
    # what this program writes names no parser version and no errors
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("parser_version", "errors", "warnings")})
    of = lambda items, rules, key: explode_violations(rows.select("file", "source_type", "schema_version", F.explode(items).alias("x")).select("file", "source_type", "schema_version", "x.*"), rules, "file", key).withColumnRenamed(key, "item")
    broken = explode_violations(rows, header_violations(), "file").withColumn("item", F.lit(None).cast("string"))
    for part in (of("elements", element_violations(), "element_id"), of("chunks", chunk_violations(), "chunk_id"), of("relations", relation_violations(), "from_id")):
        broken = broken.unionByName(part)
    none = rows.where("elements is null").select("file", F.lit("elements.required").alias("code"), F.lit("elements").alias("path"), F.lit(None).cast("string").alias("item"))
    found = [*broken.unionByName(none).toJSON().toLocalIterator()]
    print("\n".join(found))
    return int(bool(found))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="docspark")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("parse", "batch-parse"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="+")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--parser", default="fallback")
        c.add_argument("--max-chars", type=int, default=800)
        c.add_argument("--plugin", action="append", default=[])
        c.add_argument("--log-file")
        c.add_argument("--verbose", action="store_true")
        c.add_argument("--images", help="folder for image files; images beside the output by default")
    for name in ("parsers", "audit"):
        commands.add_parser(name).add_argument("--plugin", action="append", default=[])
    commands.add_parser("validate").add_argument("paths", nargs="+")
    c = commands.add_parser("evaluate")
    for name in ("--manifest", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--root", default=".")
    c.add_argument("--parser", default="auto")
    c.add_argument("--max-chars", type=int, default=800)
    c.add_argument("--tolerance-chars", type=int, default=30)
    c.add_argument("--log-file")
    c.add_argument("--verbose", action="store_true")
    commands.add_parser("validate-report").add_argument("path")
    for name, what in (("inspect", "name"), ("explain", "path")):
        c = commands.add_parser(name)
        c.add_argument(what)
        c.add_argument("--plugin", action="append", default=[])
    a = top.parse_args(argv)
    if a.command == "validate":
        return validate(a.paths)
    if a.command == "evaluate":
        return evaluate(a.manifest, a.output, a.root, a.max_chars, a.tolerance_chars, a.parser, a.log_file, a.verbose)
    if a.command == "validate-report":
        return validate_report(a.path)
    if a.command in ("parse", "batch-parse"):
        return run(a.paths, a.output, a.parser, a.max_chars, a.plugin, a.log_file, a.command == "parse", a.verbose, a.images)
    registry = built_in()
    registry.load(a.plugin)
    if a.command in ("inspect", "explain"):
        print(json.dumps(registry.inspect(a.name) if a.command == "inspect" else registry.explain(os.path.splitext(a.path)[1].lower()), ensure_ascii=False))
        return 0
    table = registry.table(session()) if a.command == "parsers" else registry.audit(session())
    for row in table.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    sys.exit(main())
