"""From files or text columns to checked documents with elements, chunks, relations and errors. Row-local throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators.chunking import packed
from docspark.operators.relations import within
from docspark.operators.validation import contract_ok, document_violations, shown
from docspark.parsers import text as plain
from docspark.parsers.base import guarded
from docspark.plans.local import with_local
from docspark.registry import Registry, built_in
from docspark.types import CHUNK, PARSED, RELATION, SCHEMA_VERSIONS


def parse(df: DataFrame, content: str, data: str | None, document_id: str, parser: str, registry: Registry | None = None) -> DataFrame:
    """`df` with parsed: each row by the parser that the column `parser` names.

    content has decoded text and data, if given, raw bytes for formats that aren't text. An unknown name or a parser without
    its input gives an error, as does any failure of a parser.
    """
    functions = {n: guarded(c.parse) for n, c in (registry or built_in()).parsers.items() if c.parse}

    def run(text: str | None, raw: bytes | None, document: str, name: str | None) -> dict | None:
        if name == "text":
            return None
        if name not in functions:
            return guarded(_unknown)(name or "", document)
        return functions[name](bytes(raw) if name in ("fallback", "kreuzberg") and raw is not None else text, document)

    # one pass for all parsers; plain text is expressions
    out = df if data else df.withColumn("_data", F.lit(None).cast("binary"))
    out = with_local(out, "_parsed", PARSED, run, content, data or "_data", document_id, parser, keep=df.columns)
    return out.withColumn("parsed", F.when(F.col(parser) == "text", plain.parsed(content, document_id)).otherwise(F.col("_parsed"))).drop("_parsed")


def _unknown(name: str, document_id: str):
    from docspark.parsers.base import ParseError

    raise ParseError("unsupported_type" if name == "" else "unknown_parser", f"unknown parser {name!r}")


def documents(df: DataFrame, content: str, data: str | None, registry: Registry | None = None, parser: str = "auto", limit: int = 800) -> DataFrame:
    """Documents of rows (path, source_hash, document_id, source_type, content[, data]): elements, chunks, relations, warnings,
    metadata, error_code and error_details.

    A document with an error keeps its row, with null elements, chunks and relations, so nothing is lost. Errors come in the order of
    the stages: no content, a file that its parser doesn't take, the parser's own, the chunker's, no elements, against the schema, against the parser's contract.
    """
    registry = registry or built_in()
    routed = df.withColumn("parser_name", registry.route("path", parser))
    parsed = parse(routed, content, data, "document_id", "parser_name", registry)
    # from here on the row has what a document has, nothing that only a failed one has, and each part once
    parts = {"elements": F.when(F.col("parsed.error").isNull(), F.col("parsed.elements")), "warnings": F.col("parsed.warnings"), "metadata": F.col("parsed.metadata"), "_error": F.col("parsed.error"), "_absent": F.col("parsed").isNull()}
    out = parsed.withColumns(parts).drop("parsed")
    more = f"struct<chunks:array<{CHUNK}>,relations:array<{RELATION}>>"
    out = with_local(out, "_more", more, lambda e, d, s: {"chunks": packed(e, d, s, limit), "relations": related(e, s)} if e else None, "elements", "document_id", "source_type")
    out = out.withColumns({"chunks": F.col("_more.chunks"), "relations": F.col("_more.relations")}).drop("_more")
    declared = F.create_map([x for c in registry.parsers.values() for x in (F.lit(c.name), F.array(*map(F.lit, c.source_types)))])[F.col("parser_name")]
    declared = F.when(F.col("parser_name") == "fallback", F.array_union(declared, F.array(F.lit("pdf")))).otherwise(declared)
    broken = document_violations(F.col("source_type"), F.lit(SCHEMA_VERSIONS[-1]))
    out = out.withColumn("_broken", broken)
    takes = F.create_map([x for c in registry.parsers.values() for x in (F.lit(c.name), F.array(*map(F.lit, c.extensions)))])[F.col("parser_name")]
    code = F.coalesce(
        F.when(F.col("_absent"), "file_not_found"),
        F.when(~F.array_contains(takes, T.extension("path")), "unsupported_type"),
        F.col("_error.code"),
        F.when((F.size("elements") > 0) & F.col("chunks").isNull(), "chunker_failed"),
        F.when(F.size("elements") == 0, "no_extracted_elements"),
        F.when(F.size("_broken") > 0, "schema_validation_failed"),
        F.when(~contract_ok(F.col("source_type"), F.transform("elements", lambda e: e["source_locator"]["family"]), declared), "parser_contract_mismatch"),
    )
    details = F.when(F.col("error_code") == "schema_validation_failed", F.to_json(shown(F.col("_broken")))).otherwise(F.col("_error.details"))
    out = out.withColumn("error_code", code).withColumn("error_details", details)
    keep = lambda c: F.when(F.col("error_code").isNull(), F.col(c))
    return out.withColumns({c: keep(c) for c in ("elements", "chunks", "relations")}).drop("_error", "_absent", "_broken")


def related(elements: list[dict] | None, source_type: str | None) -> list[dict] | None:
    try:
        return within(elements, source_type)
    except Exception:  # noqa: BLE001 - what the schema finds wrong has no relations
        return []


def from_texts(df: DataFrame, text: str, path: str) -> DataFrame:
    """Rows of a table of texts as input of `documents`; a text's identity is its own hash."""
    hashed = df.withColumn("source_hash", T.source_hash(text))
    return hashed.withColumn("document_id", T.document_id("source_hash")).withColumn("source_type", T.source_type(path))
