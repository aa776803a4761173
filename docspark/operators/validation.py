"""Checks of documents against the versioned schema, as expressions that list violations; and the order of errors.

Each rule reads its fields through `at`, so that the same rules serve rows of a table and entries of an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.geometry import valid_box
from docspark.types import ELEMENT_TYPES, FAMILIES, SCHEMA_VERSIONS

#: How many violations an error carries.
SHOWN = 20


def violations(*rules: tuple[str, str, Column]) -> Column:
    """array<struct<code, path>> of the rules (code, path, condition) that are broken; an unknown condition counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for code, path, ok in rules]), lambda v: v.isNotNull())


def header_violations() -> Column:
    """Rules on document_id, source_path, source_type, source_hash, parser_name and schema_version."""
    version, kind = F.col("schema_version"), F.col("source_type")
    legacy = F.when(version == "0.1.0", kind.isin("pdf", "docx")).when(version <= "0.5.0", kind.isin(*FAMILIES)).otherwise(kind.rlike(r"^[a-z][a-z0-9_]{0,31}$"))
    return violations(
        ("document_id.required", "document_id", F.length("document_id") > 0),
        ("source_path.required", "source_path", F.length("source_path") > 0),
        ("source_path.slashes", "source_path", ~F.contains(F.col("source_path"), F.lit("\\"))),
        ("source_hash.pattern", "source_hash", F.col("source_hash").rlike("^[0-9a-f]{64}$")),
        ("schema_version.enum", "schema_version", version.isin(*SCHEMA_VERSIONS)),
        ("source_type.version", "source_type", legacy),
        ("parser_name.required", "parser_name", F.length("parser_name") > 0),
        ("parser_version.required", "parser_version", F.col("parser_version").isNotNull()),
        ("warnings.required", "warnings", F.col("warnings").isNotNull()),
        ("errors.required", "errors", F.col("errors").isNotNull()),
    )


Field = Callable[[str], Column]


def due_family(source_type: Column) -> Column:
    return F.create_map([F.lit(x) for pair in FAMILIES.items() for x in pair])[source_type]


def locator_ok(source_type: Column, locator: Column) -> Column:
    """The shape that a source type's locators have."""
    at = lambda k: locator[k]
    box = at("bbox").isNull() | valid_box(at("bbox"))
    line = at("line").isNull() | (at("line") >= 1)
    cell = at("cell_index").isNull() | (at("cell_index") >= 0)
    kind = at("cell_type").isNull() | at("cell_type").isin("markdown", "code", "raw")
    docx = F.coalesce(*[at(k).cast("string") for k in ("paragraph_index", "table_index", "section", "relationship_id", "target_partname")]).isNotNull()
    return F.when(source_type == "pdf", (at("page") >= 1) & box).when(source_type == "docx", docx).when(source_type == "ipynb", cell & kind & line).otherwise(line)


def element_violations(at: Field = F.col, source_type: Column | None = None, version: Column | None = None) -> Column:
    """Rules on one element, with source_type and schema_version of its document."""
    kind = F.col("source_type") if source_type is None else source_type
    version = F.col("schema_version") if version is None else version
    family, due = at("source_locator")["family"], due_family(kind)
    return violations(
        ("element_id.required", "element_id", F.length(at("element_id")) > 0),
        ("type.enum", "type", at("type").isin(*ELEMENT_TYPES)),
        ("content.any_of", "content", (F.length(at("content")) > 0) | (F.length(at("resource_path")) > 0)),
        ("confidence.range", "confidence", at("confidence").isNull() | at("confidence").between(0, 1)),
        ("locator.required", "source_locator", at("source_locator").isNotNull()),
        ("locator.shape", "source_locator", kind.isNull() | locator_ok(kind, at("source_locator"))),
        ("locator.family", "source_locator.family", F.when(version < "0.3.0", family.isNull()).otherwise(due.isNull() | family.isNull() | (family == due))),
    )


def chunk_violations(at: Field = F.col) -> Column:
    """Rules on one chunk."""
    spans = at("source_spans")
    return violations(
        ("chunk_id.required", "chunk_id", F.length(at("chunk_id")) > 0),
        ("text.required", "text", F.length(at("text")) > 0),
        ("source_element_ids.min", "source_element_ids", F.size(at("source_element_ids")) > 0),
        ("source_element_ids.empty", "source_element_ids", F.forall(at("source_element_ids"), lambda x: F.length(x) > 0)),
        ("char_count.stale", "metadata.char_count", at("metadata")["char_count"] == F.length(at("text"))),
        ("source_spans.range", "source_spans", spans.isNull() | F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] >= s["start"]))),
    )


def relation_violations(at: Field = F.col, version: Column | None = None) -> Column:
    """Rules on one relation with schema_version of its document: which types a version may hold."""
    kind, version = at("type"), F.col("schema_version") if version is None else version
    since = F.when(kind == "has_caption", "0.4.0").when(kind == "table_has_caption", "0.5.0").otherwise("0.1.0")
    return violations(
        ("type.enum", "type", kind.isin("has_caption", "table_has_caption", "references_figure", "references_table")),
        ("type.version", "type", version.isNull() | (version >= since)),
        ("from_id.required", "from_id", F.length(at("from_id")) > 0),
        ("to_id.required", "to_id", F.length(at("to_id")) > 0),
    )


def document_violations(source_type: Column, version: Column, elements: str = "elements", chunks: str = "chunks", relations: str = "relations") -> Column:
    """array<struct<code, path>> of all parts of a document in one row; the path begins with the part and the entry's position."""

    def of(items: str, rules: Callable[[Field], Column]) -> Column:
        each = F.transform(items, lambda x, n: F.transform(rules(lambda k: x[k]), lambda v: F.struct(v["code"].alias("code"), F.concat_ws(".", F.lit(items), n.cast("string"), v["path"]).alias("path"))))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<code:string,path:string>>"))

    return F.concat(of(elements, lambda at: element_violations(at, source_type, version)), of(chunks, chunk_violations), of(relations, lambda at: relation_violations(at, version)))


def contract_ok(source_type: Column, families: Column, declared: Column) -> Column:
    """Whether a parser declares a source type, and all locators have the family bound to it."""
    return F.coalesce(F.array_contains(declared, source_type) & F.forall(families, lambda f: F.coalesce(f == due_family(source_type), due_family(source_type).isNull())), F.lit(False))


def shown(broken: Column) -> Column:
    """The violations that an error carries."""
    return F.slice(F.array_sort(broken), 1, SHOWN)


def explode_violations(df: DataFrame, broken: Column, *columns: str) -> DataFrame:
    return df.select(*columns, F.explode(broken).alias("v")).select(*columns, "v.code", "v.path")
