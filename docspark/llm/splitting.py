"""Splitting oversized items at natural boundaries, with an overlap between consecutive pieces.

Content-defined chunking: a rolling hash over the last characters marks each position by content alone. Between the least and
the largest size of a piece, the position of the smallest hash is the landmark; the cut snaps to the natural boundary nearest
to it. Landmarks don't depend on where a piece began, so after an edit the cuts soon fall on the same places again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters under the rolling hash, and its multiplier.
WINDOW, FACTOR = 16, np.uint64(0x9E3779B97F4A7C15)
#: Natural boundaries, strongest first; a cut lies at the end of a match.
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[ \t\r]*\n+")),
    ("line", re.compile(r"\n")),
    ("sentence", re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[”’」』）]*")),
    ("clause", re.compile(r"[,;:](?=\s)|[，；：、]")),
    ("word", re.compile(r"\s+")),
)
#: How much nearer a weaker kind must be to be taken instead: none of a weaker kind is while the window holds a sentence end.
STRONG = 3
CLUSTER = regex.compile(r"\X")
PIECES = "piece int, start int, end int, text string, boundary string, overlap int"


def rolling(text: str) -> np.ndarray:
    """For each cut position 1..len(text) the hash of the WINDOW characters before it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h, factor = np.zeros(len(codes), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(min(WINDOW, len(codes))):
            h[back:] += (codes[: len(codes) - back] + np.uint64(0x1F)) * factor
            factor *= FACTOR
        return (h ^ (h >> np.uint64(29))) * FACTOR


def joins(text: str, at: int) -> bool:
    """Whether a cut at `at` would part what a reader sees as one character."""
    if not 0 < at < len(text) or (text[at - 1] < "̀" and text[at] < "̀" and text[at - 1 : at + 1] != "\r\n"):
        return False
    low = max(0, at - 32)
    return at - low not in {m.end() for m in CLUSTER.finditer(text[low : at + 32])}


def split(text: str | None, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces of at most `limit` characters; each begins `overlap` before the end of the one before.

    boundary says what the piece ends at: a kind of BOUNDARIES, `forced` within a word that fills the window, `end` for the
    last. A text within the limit is one piece; null and empty texts have none. An overlap below 0 or of the limit or more is an
    error, as no piece could follow (`split_items` says what it does with such rows).
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("the limit must be positive, the overlap from 0 and below it")
    if not text:
        return []
    if len(text) <= limit:
        return [(0, len(text), "end")]
    marks = rolling(text)
    natural = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for _, p in BOUNDARIES]
    out, start, least = [], 0, max(overlap + 1, limit // 2)
    while len(text) - start > limit:
        low, high = start + least, start + limit
        landmark = low + int(marks[low - 1 : high].argmin())
        cut, kind = 0, "forced"
        within = [p[np.searchsorted(p, low) : np.searchsorted(p, high, side="right")] for p in natural]
        for level in (range(STRONG), range(STRONG, len(within))):
            found = [(abs(int(x) - landmark), i, int(x)) for i in level for x in within[i] if not joins(text, int(x)) and not joins(text, int(x) - overlap)]
            if found:
                _, i, cut = min(found)
                kind = BOUNDARIES[i][0]
                break
        if not cut:
            whole = [x for x in range(low, high + 1) if not joins(text, x) and not joins(text, x - overlap)]
            cut = min(whole, key=lambda x: (abs(x - landmark), x)) if whole else landmark
        out.append((start, cut, kind))
        start = cut - overlap
    return [*out, (start, len(text), "end")]


def split_items(items: DataFrame, text: str, limit: str, overlap: str, carry: list[str]) -> DataFrame:
    """The pieces (PIECES) of each row whose text exceeds its limit, with the columns `carry`.

    overlap is what consecutive pieces of the row share: what the row asks for (null: 0) wherever a piece within the limit can move
    on with it. An overlap below 0 counts as 0 and one of the limit or more as the limit less one, which the column then says; a limit
    below 1 counts as 1. Only rows over their limit reach Python; those within it, without a text or without a limit have no pieces.
    Row-local.
    """
    big = items.where(F.length(text) > F.col(limit)).select(*carry, F.col(text).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap).cast("int"), F.lit(0)).alias("_overlap"))
    schema = ", ".join([*(f"`{c}` {big.schema[c].dataType.simpleString()}" for c in carry), PIECES])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False, name=None):
                own, (t, most, shared) = r[:-3], r[-3:]
                most = max(1, most)
                shared = min(max(0, shared), most - 1)
                rows += [(*own, i, s, e, t[s:e], b, shared) for i, (s, e, b) in enumerate(split(t, most, shared))]
            yield pd.DataFrame(rows, columns=[*carry, "piece", "start", "end", "text", "boundary", "overlap"])

    return big.mapInPandas(run, schema)


def own_span(identity: str) -> F.Column:
    """source_spans of a piece that points into the item itself."""
    return F.array(F.struct(F.col(identity).alias("element_id"), F.col("start"), F.col("end")))


def mapped_spans(spans: str, length: str, identity: str) -> F.Column:
    """source_spans of a chunk's piece: the parts of the chunk's own spans that it covers.

    The chunk's text is its spans' texts joined by one character; where the lengths don't say so, or spans are missing, the
    piece points into the chunk.
    """
    s = F.col(spans)
    total = F.aggregate(s, F.lit(0), lambda a, x: a + x["end"] - x["start"]) + F.size(s) - 1
    step = lambda a, x: F.struct(
        (a["at"] + x["end"] - x["start"] + 1).alias("at"),
        F.concat(a["out"], F.array(F.struct(x["element_id"].alias("element_id"), (x["start"] + F.greatest(F.lit(0), F.col("start") - a["at"])).alias("start"), (x["start"] + F.least(x["end"] - x["start"], F.col("end") - a["at"])).alias("end")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<element_id:string,start:int,end:int>>").alias("out"))
    parts = F.filter(F.aggregate(s, zero, step)["out"], lambda x: x["end"] > x["start"])
    return F.when(s.isNotNull() & (F.size(s) > 0) & (total == F.col(length)), parts).otherwise(own_span(identity))
