"""Text functions as column expressions, with the semantics of Unicode white space and code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space. Java's \s and trim know ASCII only.
BLANK = r"\x09-\x0D\x1C-\x20\x85\xA0  -     　"
BLANKS = f"[{BLANK}]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: an expression that is used several times would be evaluated as often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(x), f"^{BLANKS}+|{BLANKS}+$", "")


def leading(x: Column | str) -> Column:
    """The number of white-space characters at the start."""
    return F.length(col(x)) - F.length(F.regexp_replace(col(x), f"^{BLANKS}+", ""))


def normalize(x: Column | str) -> Column:
    """Runs of white space become one space; none at the ends. Null becomes the empty string."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), f"{BLANKS}+", " "), "^ | $", "")


def squeeze(x: Column | str) -> Column:
    """Without any white space."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), BLANKS, "")


def unix_lines(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "\r\n?", "\n")


def split_lines(x: Column | str) -> Column:
    """Lines at any line break, without an empty last one."""
    parts = F.split(col(x), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def sentences(x: Column | str) -> Column:
    """Pieces between white space that follows the end of a sentence."""
    return F.split(col(x), f"(?<=[。！？!?\\.]){BLANKS}+")


def decode(data: Column | str) -> Column:
    """Bytes as UTF-8, each bad byte replaced, with line feeds only."""
    return unix_lines(F.make_valid_utf8(col(data).cast("string")))


def source_hash(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def document_id(source: Column | str) -> Column:
    """The identity of a document from the 64 digits of its hash; null for anything else."""
    return F.when(F.length(col(source)) == 64, F.concat(F.lit("doc-"), F.substring(col(source), 1, 16)))


def numbered(document: Column | str, mark: str, ordinal: Column | str) -> Column:
    """Identity of the n-th part of a document; four digits at least, never cut."""
    return F.concat(col(document), F.format_string(f"::{mark}%04d", col(ordinal)))


# How captions begin, as blocks and as ends of relations, and how text mentions figures and tables.
CAPTION = r"(?i)^\s*(?:Table|Figure|Fig\.?|表|图)\s*[0-9０-９]+[\.、:：]"
FIGURE_CAPTION = r"(?i)^(?:Figure|Fig\.?|图)\s*[0-9]+[\.、:：\s]"
TABLE_CAPTION = r"(?i)^(?:Table|表格|表)\s*[0-9]+[\.、:：\s]"
FIGURE_MENTION = r"(?i)(?:Figure|Fig\.?|图)\s*([0-9０-９]+)"
TABLE_MENTION = r"(?i)(?:Table|表格|表)\s*([0-9０-９]+)"
_WIDE = dict(zip("０１２３４５６７８９", "0123456789", strict=True))


def ascii_digits(x: Column | str) -> Column:
    return F.translate(col(x), "".join(_WIDE), "".join(_WIDE.values()))


def is_caption(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(CAPTION), F.lit(False))


def caption_label(x: Column | str) -> Column:
    """`figure:N` or `table:N` of a caption, else null."""
    number = ascii_digits(F.regexp_extract(col(x), r"(?i)^\s*(?:Table|Figure|Fig\.?|表|图)\s*([0-9０-９]+)", 1)).cast("long")
    family = F.when(col(x).rlike(r"(?i)^\s*(?:Table|表)"), "table").otherwise("figure")
    return F.when(is_caption(x), F.concat_ws(":", family, number))


def block_type(x: Column | str) -> Column:
    """caption, heading (at most 80 characters, no mark at the end) or paragraph."""
    short = (F.length(col(x)) <= 80) & ~col(x).rlike(r"[\.。！？!?;；:：,，]$")
    return F.when(is_caption(x), "caption").when(short, "heading").otherwise("paragraph")


def heading_level(style: Column | str) -> Column:
    """The level that a paragraph style names: 1 for title, N for `heading N` (at least 1), null for other styles."""
    name = F.lower(F.trim(col(style)))
    number = F.regexp_extract(name, r"^heading\s*(-?\d+)\s*$", 1).try_cast("int")
    return F.when(name == "title", 1).when(name.startswith("heading"), F.greatest(F.lit(1), F.coalesce(number, F.lit(1))))


def extension(path: Column | str) -> Column:
    """The lower-case extension of a path with either kind of slash, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(col(path), r"\\", "/"), r"[^/.](\.[^./]+)$", 1))


SOURCE_TYPES = {".pdf": "pdf", ".docx": "docx", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".txt": "text", ".text": "text", ".ipynb": "ipynb"}


def source_type(path: Column | str) -> Column:
    """The source type that an extension means, null where none does."""
    return F.create_map([F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])[extension(path)]


def frontmatter(x: Column | str) -> Column:
    """The flat `key: scalar` pairs of a block between two --- lines at the start; the last of a repeated key counts.

    One layer of quotes is taken off; lists, maps and empty values are left out. Null where there is no such block.
    """
    block = F.regexp_extract(col(x), r"^\s*---[ \t]*\n((?:(?![ \t]*---[ \t]*(?:\n|$))[^\n]*\n)*)[ \t]*---[ \t]*(?:\n|$)", 1)
    has = col(x).rlike(r"^[ \t]*---[ \t]*\n(?:(?![ \t]*---[ \t]*(?:\n|$))[^\n]*\n)*[ \t]*---[ \t]*(?:\n|$)")
    lines = F.filter(F.split(block, "\n"), lambda r: r.rlike(r"^[A-Za-z0-9_\-]+:"))
    quoted = lambda r: strip(F.regexp_replace(r, r"^[A-Za-z0-9_\-]+:", ""))
    value = lambda r: F.regexp_replace(quoted(r), "^([\"'])(.*)\\1$", "$2")
    pairs = F.transform(lines, lambda r: F.struct(F.regexp_extract(r, r"^([A-Za-z0-9_\-]+):", 1).alias("k"), value(r).alias("v")))
    pairs = F.filter(pairs, lambda p: (p["v"] != "") & ~p["v"].rlike(r"^[\[{]"))
    last = F.aggregate(F.reverse(pairs), F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(F.array(p), a)))
    return F.when(has, F.map_from_entries(last))


def task_item(x: Column | str) -> Column:
    """struct<checked, text> of an item that begins with a check box, null for others."""
    return F.when(col(x).rlike(r"^\[[ xX]\]\s+"), F.struct((F.lower(F.substring(col(x), 2, 1)) == "x").alias("checked"), F.regexp_extract(col(x), r"(?s)^\[[ xX]\]\s+(.*)$", 1).alias("text")))
