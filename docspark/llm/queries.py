"""Queries of the data problems 2, 3, 6, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import lookalike, markup, packing, splitting, tokenizer, truncation
from docspark.plans.lineage import Cuts
from docspark.sources.tables import earliest, spread, table


#: Tokens of a container where size_limits has no row for it.
CAPACITY = 2048


def _capacity(spark: SparkSession, folder: str) -> int:
    row = table(spark, folder, "size_limits").where("use_for = 'pack' and item_type = 'document'").first()
    return int(row.capacity) if row else CAPACITY


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode(spread(table(spark, folder, "documents")), "doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each document, or piece of a document over the capacity, and its container."""
    counts = Cuts(spark).cut(tokenizer.count_tokens(spread(table(spark, folder, "documents")), "doc_id", "text"))  # read twice below
    out = packing.pack(counts, "doc_id", "n_tokens", _capacity(spark, folder))
    return out.select("doc_id", F.col("piece").cast("int").alias("piece"), F.col("first").alias("first_token"), F.col("n").alias("n_tokens"), F.col("container").alias("container_id"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: their number by tenths of the capacity."""
    capacity = _capacity(spark, folder)
    filled = p9_containers(spark, folder).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return filled.groupBy(F.floor(F.col("n") * 10 / capacity).cast("int").alias("tenths")).agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("n").alias("tokens"))


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(spread(table(spark, folder, "documents")), "doc_id", "text", "lang", "source")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).where("cut").select("doc_id")


def p10_report(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates, of its texts that aren't null, empty or blank."""
    by = _truncated(spark, folder).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("truncated"))
    return by.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 4))


#: Which of an element's rows counts: the earliest; of several, the one with the smallest hash of what it holds.
FIRST = ["element_id", "recorded_at", "tie"]


def _tie(*columns: str) -> F.Column:
    return F.xxhash64(*columns)


def _prose(spark: SparkSession, folder: str) -> DataFrame:
    code = F.coalesce(F.get_json_object("metadata", "$.kind") == "code_block", F.lit(False))
    counts = (F.coalesce("type", F.lit("")) != "table") & ~code
    rows = spread(table(spark, folder, "elements")).withColumn("counts", counts)
    return rows.select("element_id", "recorded_at", _tie("type", "metadata", "content").alias("tie"), "counts", F.when(F.col("counts"), F.col("content")).alias("content"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = markup.kinds_of(_prose(spark, folder), [*FIRST, "counts"], "content")
    first = earliest(rows, "element_id", [*FIRST[1:], "counts", "kinds"])  # kinds are shuffled, contents aren't
    return first.where("counts").select("element_id", F.explode("kinds").alias("markup"))


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The clean text of every prose element, with the roles of its blocks. Prose is what the element's earliest row is."""
    rows = markup.clean(_prose(spark, folder), [*FIRST, "counts"], "content")
    first = earliest(rows, "element_id", [*FIRST[1:], "counts", "markup", "clean", "blocks"])
    return first.where("counts").select("element_id", "markup", "clean", "blocks")


def _oversized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Elements and chunks over their limits, of each key the earliest row. Contents are fetched for these alone, by what the row holds:
    rows of a key that hold the same are one."""
    sizes = table(spark, folder, "size_limits").where("use_for = 'split'").groupBy("item_type").agg(F.min(F.struct("capacity", "overlap")).alias("x"))
    by = {r.item_type: r.x for r in sizes.collect()}  # one row for each element type, which are eight
    pick = lambda k: F.create_map([F.lit(v) for t, x in by.items() for v in (t, x[k])])[F.col("type")] if by else F.lit(None).cast("int")
    most, shared = pick("capacity"), pick("overlap")
    usual, usual_shared = (F.lit(by["chunk"][k] if "chunk" in by else None).cast("int") for k in ("capacity", "overlap"))
    rows = table(spark, folder, "elements").select("element_id", "recorded_at", _tie("type", "content").alias("tie"), "type", F.length("content").alias("n"), "content")
    first = earliest(rows.drop("content"), "element_id", ["recorded_at", "tie", "type", "n"]).withColumns({"most": most, "shared": shared}).where("n > most")
    elements = rows.where(F.col("n") > most).select("element_id", "tie", "content").join(first.drop("recorded_at"), ["element_id", "tie"]).dropDuplicates(["element_id"])
    rows = table(spark, folder, "chunks").select("chunk_id", "recorded_at", _tie("text", "metadata", "source_spans").alias("tie"), F.col("metadata.max_chars").alias("own_limit"), F.length("text").alias("n"), "text", "source_spans")
    first = earliest(rows.drop("text", "source_spans"), "chunk_id", ["recorded_at", "tie", "n", "own_limit"]).withColumns({"most": F.coalesce("own_limit", usual), "shared": usual_shared}).where("n > most")
    chunks = rows.select("chunk_id", "tie", "text", "source_spans").join(first.select("chunk_id", "tie", "n", "most", "shared"), ["chunk_id", "tie"]).dropDuplicates(["chunk_id"])
    return elements, chunks


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    elements, chunks = _oversized(spark, folder)
    spans = "array<struct<element_id:string,start:int,end:int>>"
    own = splitting.split_items(elements, "content", "most", "shared", ["element_id"]).withColumn("source_spans", splitting.own_span("element_id").cast(spans))
    parts = splitting.split_items(chunks, "text", "most", "shared", ["chunk_id", "n", "source_spans"]).withColumn("source_spans", splitting.mapped_spans("source_spans", "n", "chunk_id").cast(spans))
    columns = ["piece", F.col("start").alias("start"), F.col("end").alias("end"), "text", "boundary", "overlap", "source_spans"]
    return own.select(F.lit("element").alias("item_kind"), F.col("element_id").alias("item_id"), *columns).unionByName(parts.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), *columns))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece = 1").select("item_kind", "item_id")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _looks(spark: SparkSession, folder: str) -> DataFrame:
    """(item_kind, id, look, stored) of the earliest row of each element and chunk with a text."""
    elements = spread(table(spark, folder, "elements")).select(F.lit("element").alias("item_kind"), F.col("element_id").alias("id"), "recorded_at", F.col("content").alias("text"))
    chunks = spread(table(spark, folder, "chunks")).select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("id"), "recorded_at", "text")
    rows = lookalike.looks(elements.unionByName(chunks), ["item_kind", "id", "recorded_at"], "text")  # hashes are shuffled, texts aren't
    first = F.min(F.struct(F.col("recorded_at").isNull(), "recorded_at", "look", "stored")).alias("r")  # rows without a time come last
    return rows.where("id is not null").groupBy("item_kind", "id").agg(first).select("item_kind", "id", "r.look", "r.stored").where("look is not null")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.same_look(Cuts(spark).cut(_looks(spark, folder)), "item_kind", "id")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each item whose text looks like a differing one, with its class and the number of its links."""
    return lookalike.classes(Cuts(spark).cut(_looks(spark, folder)), "item_kind", "id")


def p6_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored row of elements and chunks in the consistent form."""
    elements = spread(table(spark, folder, "elements")).select(F.lit("element").alias("item_kind"), F.col("element_id").alias("item_id"), "recorded_at", F.col("content").alias("text"))
    chunks = spread(table(spark, folder, "chunks")).select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "recorded_at", "text")
    return lookalike.consistent(elements.unionByName(chunks), ["item_kind", "item_id", "recorded_at"], "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_clean, p3_found, p3_pieces, p6_found, p6_classes, p6_texts, p8_ids, p9_containers, p9_fill, p10_found, p10_report)}
SQL = {
    "p3_found": """WITH l AS (SELECT item_type, capacity FROM size_limits WHERE use_for = 'split'),
e AS (SELECT element_id, arg_min(struct_pack(t := type, n := length(content)), recorded_at) r FROM elements GROUP BY 1),
c AS (SELECT chunk_id, arg_min(struct_pack(n := length(text), m := metadata.max_chars), recorded_at) r FROM chunks GROUP BY 1)
SELECT 'element' AS item_kind, element_id AS item_id FROM e JOIN l ON item_type = r.t WHERE r.n > capacity
UNION ALL SELECT 'chunk', chunk_id FROM c WHERE r.n > coalesce(r.m, (SELECT capacity FROM l WHERE item_type = 'chunk'))""",
}
