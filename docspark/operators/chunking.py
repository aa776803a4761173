"""Structural chunking: a document's elements packed into chunks that name their sources and spans. Row-local."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame

from docspark.plans.local import with_local
from docspark.types import CHUNK

# Fixed value: the gap after a sentence.
SENTENCE_GAP = re.compile(r"(?<=[。！？!?\.])\s+")
BLANK = re.compile(r"\s")
APART = ("table", "caption")


def hard_split(text: str, limit: int, offset: int = 0) -> Iterator[tuple[str, str | None, int, int]]:
    """(piece, boundary, start, end) of text without sentence ends: cut at the last white space in the window's second half,
    else after `limit` characters."""
    blanks = [m.start() for m in BLANK.finditer(text)]
    end = len(text.rstrip())
    at = len(text) - len(text.lstrip())
    while at < end:
        if end - at <= limit and len(text) - at <= limit:
            yield text[at:end], None, offset + at, offset + end
            return
        k = bisect_right(blanks, at + limit) - 1
        if k >= 0 and blanks[k] >= at + limit // 2:
            piece = text[at : blanks[k]].rstrip()
            after = blanks[k] + 1
            while after < len(text) and text[after].isspace():
                after += 1
            yield piece, "whitespace" if after < len(text) else None, offset + at, offset + at + len(piece)
            at = after
        else:
            yield text[at : at + limit], "forced_char", offset + at, offset + at + limit
            at += limit
            while at < len(text) and text[at].isspace():
                at += 1


def split_long(text: str, limit: int) -> list[tuple[str, str | None, int, int]]:
    """(piece, boundary, start, end) of a text: sentences joined by one space while they fit, longer ones split hard.

    Offsets are those in the stripped text. Blank text has no pieces.
    """
    text = text.strip()
    if len(text) <= limit:
        return [(text, None, 0, len(text))] if text else []
    pieces, at = [], 0
    for gap in [*SENTENCE_GAP.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        sentence = text[at:stop]
        if len(sentence) > limit:
            pieces += hard_split(sentence, limit, at)
        elif sentence:
            pieces.append((sentence, None, at, stop))
        at = gap.end() if gap else stop
    out: list[tuple[str, str | None, int, int]] = []
    for piece in pieces:
        if out and len(out[-1][0]) + 1 + len(piece[0]) <= limit:
            joined, _, start, _ = out[-1]
            out[-1] = (f"{joined} {piece[0]}", piece[1], start, piece[3])
        else:
            out.append(piece)
    return out


def pack(elements: list[dict] | None, document_id: str, source_type: str | None, limit: int) -> list[dict]:
    """The chunks of a document's elements in order.

    Headings begin a chunk, tables and captions stand alone, long text is split; the rest is packed while the lengths fit.
    Joining spaces of earlier parts aren't counted, so a chunk of k parts may exceed the limit by k - 2. The cells of a
    notebook never share a chunk. Images and blank elements are left out. Null elements give no chunks.
    """
    if limit < 32:
        raise ValueError("the limit must be 32 at least")
    chunks: list[dict] = []
    held: list[tuple[str, str, int, int]] = []

    def emit(parts: list[tuple[str, str, int, int]], strategy: str, boundary: str | None = None) -> None:
        text = " ".join(p[0] for p in parts)
        chunks.append(
            {
                "chunk_id": f"{document_id}::c{len(chunks):04d}",
                "text": text,
                "source_element_ids": list(dict.fromkeys(p[1] for p in parts)),
                "metadata": {"strategy": strategy, "max_chars": limit, "char_count": len(text), "split_boundary_after": boundary},
                "source_spans": [{"element_id": e, "start": s, "end": z} for _, e, s, z in parts],
            }
        )

    def flush() -> None:
        if held:
            emit(held, "sequential")
            held.clear()

    cell: object = None
    for e in elements or []:
        content = e["content"] or ""
        text = content.strip()
        if e["type"] == "image" or not text:
            continue
        if source_type == "ipynb":
            number = (e["source_locator"] or {}).get("cell_index")
            now = object() if number is None else number  # an element outside of cells stands for itself
            if now != cell:
                flush()
                cell = now
        start = len(content) - len(content.lstrip())
        part = (text, e["element_id"], start, start + len(text))
        if e["type"] in APART:
            flush()
            emit([part], f"isolated_{e['type']}")
        elif e["type"] == "heading":
            flush()
            held.append(part)
        elif len(text) > limit:
            flush()
            for piece, boundary, s, z in split_long(text, limit):
                emit([(piece, e["element_id"], start + s, start + z)], "long_paragraph_sentence_split", boundary)
        else:
            size = sum(len(p[0]) for p in held)
            if held and size + 1 + len(text) > limit:
                flush()
            held.append(part)
    flush()
    return chunks


def packed(elements: list[dict] | None, document_id: str, source_type: str | None, limit: int) -> list[dict] | None:
    """`pack`, with null for a document that can't be chunked."""
    try:
        return pack(elements, document_id, source_type, limit)
    except Exception:  # noqa: BLE001 - a document must not end the job
        return None


def chunk(df: DataFrame, elements: str, document_id: str, source_type: str, limit: int = 800) -> DataFrame:
    """`df` with `chunks`, null for a document that can't be chunked (`chunker_failed`); a limit under 32 is an error."""
    if limit < 32:
        raise ValueError("the limit must be 32 at least")

    return with_local(df, "chunks", f"array<{CHUNK}>", lambda e, d, s: packed(e, d, s, limit), elements, document_id, source_type)
