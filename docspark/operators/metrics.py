"""Quality metrics of documents. A ratio without a denominator is null with a reason, never 1."""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.functions.geometry import valid_box
from docspark.plans.local import with_local

#: Fixed value: how far a predicted boundary may lie from an anchor, in characters.
TOLERANCE = 30


def cell(value: Column, reason: Column | str) -> Column:
    """struct<value, reason>: the reason stands only where there is no value."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(value.cast("double").alias("value"), F.when(value.isNull(), reason).alias("reason"))


def ratio(good: Column, all_: Column, reason: str) -> Column:
    return cell(F.when(all_ > 0, good / all_), reason)


def element_counts(elements: DataFrame) -> DataFrame:
    """(document_id, type, n); a missing type counts as unknown. Combines before the shuffle."""
    return elements.groupBy("document_id", F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def pdf_locator_ok() -> Column:
    """A page from 1, and a box where the type is text."""
    boxed = ~F.col("type").isin("heading", "paragraph", "caption", "list_item") | valid_box("source_locator.bbox")
    return F.coalesce((F.col("source_locator.page") >= 1) & boxed, F.lit(False))


def docx_locator_ok() -> Column:
    """No page and no box, but a place in the structure."""
    place = F.coalesce(*[F.col(f"source_locator.{k}").cast("string") for k in ("section", "paragraph_index", "table_index", "relationship_id")], F.when(F.size("source_locator.extra") > 0, F.lit("")))
    return F.col("source_locator.page").isNull() & F.col("source_locator.bbox").isNull() & place.isNotNull()


def locator_ratio(elements: DataFrame, kind: str) -> DataFrame:
    """(document_id, valid, elements, ratio) of documents of a source type, pdf or docx."""
    ok = pdf_locator_ok() if kind == "pdf" else docx_locator_ok()
    own = elements.where(F.col("source_type") == kind).groupBy("document_id").agg(F.count_if(ok).alias("valid"), F.count("*").alias("elements"))
    return own.withColumn("ratio", F.col("valid") / F.col("elements"))


def image_resources(elements: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, present, images): images whose resource_path, or its file name, is one of `files` (path, length) with content."""
    name = lambda c: F.regexp_extract(F.regexp_replace(c, r"\\\\", "/"), r"([^/]*)$", 1)
    there = files.where("length > 0").select(F.explode(F.array_distinct(F.array(F.regexp_replace("path", "^file:/*", "/"), name("path")))).alias("key"), F.lit(1).alias("there")).distinct()
    own = elements.where("type = 'image'").select("document_id", "element_id", "resource_path", F.explode_outer(F.array_distinct(F.array("resource_path", name("resource_path")))).alias("key"))
    each = own.join(there, "key", "left").groupBy("document_id", "element_id").agg(F.max("there").alias("there"))
    return each.groupBy("document_id").agg(F.count("there").alias("present"), F.count("*").alias("images"))


def chunk_references(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(document_id, intact, chunks): chunks whose every reference is an element of the document. A semi-join on both keys."""
    refs = chunks.select("document_id", "chunk_id", F.explode_outer("source_element_ids").alias("element_id"))
    known = elements.select("document_id", "element_id", F.lit(1).alias("known")).distinct()
    each = refs.join(known, ["document_id", "element_id"], "left").groupBy("document_id", "chunk_id").agg((F.count("*") == F.sum("known")).alias("intact"))
    return each.groupBy("document_id").agg(F.count_if("intact").alias("intact"), F.count("*").alias("chunks"))


def character_counts(rows: DataFrame, text: str) -> DataFrame:
    """(document_id, c, n): how often each visible character occurs."""
    letters = F.explode(F.split(T.squeeze(text), "")).alias("c")
    return rows.select("document_id", letters).where("c <> ''").groupBy("document_id", "c").agg(F.count("*").alias("n"))


def character_overlap(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(document_id, common, expected, actual, precision, recall) of two multisets of characters (character_counts)."""
    both = expected.withColumnRenamed("n", "e").join(actual.withColumnRenamed("n", "a"), ["document_id", "c"], "full")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    sums = both.groupBy("document_id").agg(F.sum(F.least(e, a)).alias("common"), F.sum(e).alias("expected"), F.sum(a).alias("actual"))
    share = lambda c: F.when(F.col(c) > 0, F.col("common") / F.col(c))
    return sums.withColumn("precision", share("actual")).withColumn("recall", share("expected"))


def heading_compliance(elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, first, headings): headings that begin a chunk."""
    firsts = chunks.select("document_id", F.try_element_at("source_element_ids", F.lit(1)).alias("element_id"), F.lit(1).alias("first")).distinct()
    own = elements.where("type = 'heading'").select("document_id", "element_id").join(firsts, ["document_id", "element_id"], "left")
    return own.groupBy("document_id").agg(F.coalesce(F.sum("first"), F.lit(0)).alias("first"), F.count("*").alias("headings"))


def silent_drops(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """(document_id, dropped): expected (document_id, type, n) less what there is, never below 0 for a type."""
    both = expected.withColumnRenamed("n", "want").join(counts, ["document_id", "type"], "left")
    return both.groupBy("document_id").agg(F.sum(F.greatest(F.lit(0), F.col("want") - F.coalesce("n", F.lit(0)))).alias("dropped"))


def missing_markers(markers: Column, text: Column) -> Column:
    """Those of an array of markers that a text doesn't hold, both normalised."""
    whole = T.normalize(text)
    return F.filter(markers, lambda m: F.instr(whole, T.normalize(m)) == 0)


def prf(predicted: Column, truth: Column, matched: Column) -> list[Column]:
    """precision, recall and f1 by the table of what is null: nothing predicted, nothing to be found, neither."""
    precision = F.when(predicted > 0, matched / predicted)
    recall = F.when(truth > 0, F.when(predicted > 0, matched / truth).otherwise(0.0))
    both = precision + recall
    f1 = F.when(both > 0, 2 * precision * recall / both).when(both == 0, 0.0)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def longest_common(a: list, b: list) -> int:
    """The length of the longest common subsequence: of all pairs of equal items, the longest run that rises in both lists.

    ends[n] is the smallest place in b at which a run of n + 1 ends. Linear but for a logarithm where items differ from each other.
    """
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    ends: list[int] = []
    for x in a:
        for j in reversed(places.get(x, ())):
            at = bisect.bisect_left(ends, j)
            ends[at : at + 1] = [j]
    return len(ends)


def heading_order(df: DataFrame, found: str, truth: str) -> DataFrame:
    """`df` with matched: the headings (arrays of strings that hold level and text) found in the true order."""
    return with_local(df, "matched", "int", lambda a, b: longest_common(a or [], b or []), found, truth)


def boundaries(texts: list[str] | None, anchors: list[dict] | None, tolerance: int = TOLERANCE) -> dict:
    """Ends of chunks (but the last) against anchors (marker, position) in the joined text: predicted, truth, matched, missing.

    Ends are sums of lengths, as chunks are joined by one space; a blank chunk ends where the one before it does. Only the first
    occurrence of a marker counts, as it stands. Pairs within the tolerance match one to one, the nearest first; only ends in the
    window around an anchor are paired with it.
    """
    texts = [" ".join((t or "").split()) for t in texts or []]
    stream = " ".join(filter(None, texts))
    ends = [e - 1 if e else 0 for e in itertools.accumulate(len(t) + 1 if t else 0 for t in texts[:-1])]  # in order
    places = [(stream.find(m), m, a["position"]) for a in anchors or [] for m in [a["marker"] or ""]]
    truth = [at if position == "before" else at + len(m) for at, m, position in places if at >= 0]
    pairs = []
    for j, goal in enumerate(truth):
        window = range(bisect.bisect_left(ends, goal - tolerance), bisect.bisect_right(ends, goal + tolerance))
        pairs += ((abs(ends[i] - goal), i, j) for i in window)
    free_ends, free_goals = set(range(len(ends))), set(range(len(truth)))
    for _, i, j in sorted(pairs):
        if i in free_ends and j in free_goals:
            free_ends.remove(i)
            free_goals.remove(j)
    return {"predicted": len(ends), "truth": len(truth), "matched": len(ends) - len(free_ends), "missing": [m for at, m, _ in places if at < 0]}


BOUNDARY = "struct<predicted:int,truth:int,matched:int,missing:array<string>>"


def chunk_boundaries(df: DataFrame, texts: str, anchors: str, tolerance: int = TOLERANCE) -> DataFrame:
    """`df` with boundary (BOUNDARY); anchors is array<struct<marker, position>>."""
    return with_local(df, "boundary", BOUNDARY, lambda t, a: boundaries(t, a, tolerance), texts, anchors)


def relation_pairs(predicted: list[dict] | None, truth: list[dict] | None) -> dict:
    """Predicted pairs (a, b) that hold the texts of true pairs (a, b), each used once: predicted, truth, matched."""
    used: set[int] = set()
    matched = 0
    for p in predicted or []:
        for j, t in enumerate(truth or []):
            if j not in used and (t["a"] or "") in (p["a"] or "") and (t["b"] or "") in (p["b"] or ""):
                used.add(j)
                matched += 1
                break
    return {"predicted": len(predicted or []), "truth": len(truth or []), "matched": matched}


def identifying_text(content: Column | str, alt: Column | str, resource: Column | str) -> Column:
    """What an element is known by: its content, alternative text and file name, normalised."""
    name = F.regexp_extract(F.regexp_replace(T.col(resource), r"\\", "/"), r"([^/]*)$", 1)
    return T.normalize(F.concat_ws(" ", T.col(content), T.col(alt), name))


def macro(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row: for each column its mean over rows that have a value, and how many have none. Booleans count as 0 and 1."""
    parts = []
    for c in names:
        value = F.col(c).cast("double")
        parts += [F.avg(value).alias(f"{c}_mean"), F.count_if(value.isNull()).alias(f"{c}_not_evaluated")]
    return rows.agg(F.count("*").alias("documents"), *parts)


def content_groups(entries: DataFrame) -> DataFrame:
    """One row (pairs, unpaired, groups) of documents (doc_id, paired_with): pairs count once whichever side names the other."""
    pairs = entries.where("paired_with is not null").select(F.least("doc_id", "paired_with").alias("a"), F.greatest("doc_id", "paired_with").alias("b")).distinct()
    paired = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    alone = entries.join(paired, "doc_id", "left_anti")
    counts = pairs.agg(F.count("*").alias("pairs")).withColumn("k", F.lit(1)).join(alone.agg(F.count("*").alias("unpaired")).withColumn("k", F.lit(1)), "k")
    return counts.select("pairs", "unpaired", (F.col("pairs") + F.col("unpaired")).alias("groups"))
