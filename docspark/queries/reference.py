"""Queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark import pipeline
from docspark.functions import geometry as G
from docspark.functions import tables, text as T
from docspark.operators import chunking, metrics, relations, validation
from docspark.parsers import html, markdown, notebook
from docspark.parsers import text as plain
from docspark.parsers.base import parse_column
from docspark.plans.local import with_local
from docspark.registry import built_in
from docspark.sources.files import collisions
from docspark.sources.tables import earliest, spread, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the tables, of each key the earliest row


def _elements(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    rows = table(spark, folder, "elements")
    return earliest(rows, "element_id", ["recorded_at", "document_id", "ord", "type", *columns])


def _headers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return earliest(table(spark, folder, "parsed_docs"), "document_id", ["recorded_at", "source_type", "schema_version", *columns])


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return earliest(table(spark, folder, "chunks"), "chunk_id", ["recorded_at", "document_id", *columns])


def _typed(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    kinds = _headers(spark, folder).select("document_id", "source_type", "schema_version")
    return _elements(spark, folder, *columns).join(kinds, "document_id", "left")


E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id ORDER BY recorded_at) AS rn FROM elements) WHERE rn = 1)"
H = "h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY recorded_at) AS rn FROM parsed_docs) WHERE rn = 1)"
C = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY recorded_at) AS rn FROM chunks) WHERE rn = 1)"
R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY recorded_at) AS rn FROM relations) WHERE rn = 1)"
TE = f"{E}, {H}, t AS (SELECT e.*, h.source_type, h.schema_version FROM e LEFT JOIN h USING (document_id))"
B = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{B}+|{B}+$', '', 'g')"


def _norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '{B}+', ' ', 'g'), '^ | $', '', 'g')"


def _squeeze(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{B}', '', 'g')"


BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# identity, routing


@query("SELECT doc_id, sha256(text) AS source_hash, 'doc-' || substr(sha256(text), 1, 16) AS document_id FROM documents WHERE text IS NOT NULL")
def doc_identity(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.withColumn("source_hash", T.source_hash("text")).select("doc_id", "source_hash", T.document_id("source_hash").alias("document_id"))


_EXT = r"lower(regexp_extract(replace(source_path, '\', '/'), '[^/.](\.[^./]+)$', 1))"


@query(f"""WITH x AS (SELECT doc_id, {_EXT} AS e FROM documents) SELECT doc_id, CASE e WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown'
WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.txt' THEN 'text' WHEN '.text' THEN 'text' WHEN '.ipynb' THEN 'ipynb' END AS source_type,
CASE WHEN e IN ('.md', '.markdown') THEN 'markdown_enhanced' WHEN e IN ('.html', '.htm') THEN 'html' WHEN e IN ('.txt', '.text') THEN 'text' WHEN e = '.ipynb' THEN 'ipynb' ELSE 'fallback' END AS parser_name FROM x""")
def route_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.source_type("source_path").alias("source_type"), built_in().route("source_path").alias("parser_name"))


@query(r"""WITH x AS (SELECT source_path, regexp_replace(regexp_extract(replace(source_path, '\', '/'), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM documents)
SELECT stem, CAST(count(*) - 1 AS BIGINT) AS collisions FROM x GROUP BY 1 HAVING count(*) > 1""")
def stem_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return collisions(table(spark, folder, "documents").select("source_path"), "source_path").groupBy("stem").agg(F.count_if("stem_collision").alias("collisions")).where("collisions > 0")


@query(r"""WITH x AS (SELECT source_path, regexp_replace(regexp_extract(replace(source_path, '\', '/'), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM parsed_docs)
SELECT stem, CAST(count(*) - 1 AS BIGINT) AS collisions FROM x GROUP BY 1 HAVING count(*) > 1""")
def stem_collisions_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all delivered headers, so that what was delivered again collides."""
    return collisions(table(spark, folder, "parsed_docs").select("source_path"), "source_path").groupBy("stem").agg(F.count_if("stem_collision").alias("collisions")).where("collisions > 0")


@query()
def parser_capabilities(spark: SparkSession, folder: str) -> DataFrame:
    return built_in().audit(spark)


# text


@query(f"SELECT doc_id, md5({_norm('text')}) AS normalized, CAST(length({_squeeze('text')}) AS BIGINT) AS visible FROM documents")
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(T.normalize("text")).alias("normalized"), F.length(T.squeeze("text")).cast("long").alias("visible"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)),
b AS (SELECT *, regexp_replace(s, '{B}+', '', 'g') = '' AS blank FROM l), g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM b)
SELECT doc_id, CAST(min(n) AS INT) AS line, md5({_strip("string_agg(s, chr(10) ORDER BY n)")}) AS content FROM g WHERE NOT blank GROUP BY doc_id, g""")
def text_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.explode(plain.paragraphs("text")).alias("p"))
    return rows.select("doc_id", F.col("p.line").alias("line"), F.md5("p.content").alias("content"))


@query(rf"""SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, CAST(list_max([length(x) FOR x IN s]) AS BIGINT) AS longest
FROM (SELECT doc_id, string_split(regexp_replace(text, '([。！？!?.]){B}+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", T.sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


_CAP = r"(?i)^[ \t\n\x0B\f\r]*(?:Table|Figure|Fig\.?|表|图)[ \t\n\x0B\f\r]*[0-9０-９]+[.、:：]"


@query(rf"""WITH {E} SELECT element_id, CASE WHEN regexp_matches(content, '{_CAP}') THEN 'caption' WHEN length(content) <= 80 AND NOT regexp_matches(content, '[.。！？!?;；:：,，]$') THEN 'heading' ELSE 'paragraph' END AS block_type,
CASE WHEN regexp_matches(content, '{_CAP}') THEN (CASE WHEN regexp_matches(content, '(?i)^\s*(?:Table|表)') THEN 'table:' ELSE 'figure:' END)
|| CAST(translate(regexp_extract(content, '(?i)^\s*(?:Table|Figure|Fig\.?|表|图)\s*([0-9０-９]+)', 1), '０１２３４５６７８９', '0123456789') AS BIGINT) END AS label FROM e WHERE content IS NOT NULL AND type IN ('caption', 'paragraph', 'heading')""")
def block_types(spark: SparkSession, folder: str) -> DataFrame:
    rows = _elements(spark, folder, "content").where("content is not null and type in ('caption', 'paragraph', 'heading')")
    return rows.select("element_id", T.block_type("content").alias("block_type"), T.caption_label("content").alias("label"))


# tables


@query(rf"""WITH {E}, l AS (SELECT element_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT element_id, string_split(content, chr(10)) AS s FROM e WHERE type = 'table' AND content IS NOT NULL)),
p AS (SELECT element_id, n, string_split(regexp_replace(regexp_replace({_strip('line')}, '^\|', ''), '\|$', '').replace('\|', chr(1)), '|') AS c FROM l)
SELECT element_id, CAST(n AS INT) AS line, CAST(len(c) AS INT) AS cells, md5(array_to_string([{_strip("replace(x, chr(1), '|')")} FOR x IN c], chr(2))) AS content FROM p""")
def pipe_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _elements(spark, folder, "content").where("type = 'table'").select("element_id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    cells = rows.withColumn("c", tables.pipe_cells("line"))
    return cells.select("element_id", (F.col("n") + 1).cast("int").alias("line"), F.size("c").cast("int").alias("cells"), F.md5(F.array_join("c", "\x02")).alias("content"))


@query(rf"""WITH {E}, l AS (SELECT element_id, [string_split(replace(regexp_replace(regexp_replace({_strip('x')}, '^\|', ''), '\|$', ''), '\|', chr(1)), '|') FOR x IN string_split(content, chr(10))] AS r FROM e WHERE type = 'table' AND content IS NOT NULL),
k AS (SELECT element_id, [[{_strip("replace(replace(replace(y, chr(1), '|'), '|', chr(92) || '|'), chr(10), '<br>')")} FOR y IN x] FOR x IN r] AS r, list_max([len(x) FOR x IN r]) AS w FROM l),
q AS (SELECT element_id, w, ['| ' || array_to_string(list_concat(x, [ '' FOR i IN range(w - len(x))]), ' | ') || ' |' FOR x IN r] AS s FROM k)
SELECT element_id, md5(array_to_string(list_concat(s[1:1], ['| ' || array_to_string(['---' FOR i IN range(w)], ' | ') || ' |'], s[2:]), chr(10))) AS content FROM q""")
def table_linearize(spark: SparkSession, folder: str) -> DataFrame:
    rows = _elements(spark, folder, "content").where("type = 'table' and content is not null")
    cells = F.transform(F.split("content", "\n"), tables.pipe_cells)
    return rows.select("element_id", F.md5(tables.linearize(cells)).alias("content"))


# formats


def _markdown(spark: SparkSession, folder: str) -> DataFrame:
    """The texts as Markdown: their numbered headings get the mark of a heading."""
    marked = F.regexp_replace("text", r"(^|\n)([0-9])\.([0-9]) ", "$1## $2.$3 ")
    rows = spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", marked.alias("text"), F.concat(F.lit("d"), "doc_id").alias("d"))
    parsed = parse_column(rows, "text", "d", markdown.parse, keep=["doc_id"])
    return parsed.select("doc_id", F.explode("parsed.elements").alias("e")).select("doc_id", "e.*")


_HEAD = "regexp_extract(s, '^#{1,6}[ ]+(.+?)[ ]*#*[ ]*$', 1)"
_ITEM = "regexp_extract(s, '^(?:[-*+]|[0-9]+[.)])[ ]+(.+)$', 1)"
_LINES = rf"""l AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '(^|\n)([0-9])\.([0-9]) ', '\1## \2.\3 ', 'g'), '{BREAK}') AS s FROM documents WHERE text IS NOT NULL)),
f AS (SELECT *, regexp_matches(s, '^```+[ \t]*[\w+-]*[ \t]*$') AS fence FROM l), k AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM f), o AS (SELECT * FROM k WHERE k % 2 = 0 AND NOT fence)
"""


@query(rf"WITH {_LINES} SELECT doc_id, CAST(n AS INT) AS line, CAST(length(regexp_extract(s, '^(#+)', 1)) AS INT) AS level, {_strip(_HEAD)} AS title FROM o WHERE regexp_matches(s, '^#{{1,6}}[ ]+.')")
def md_headings(spark: SparkSession, folder: str) -> DataFrame:
    rows = _markdown(spark, folder).where("type = 'heading'")
    return rows.select("doc_id", F.col("source_locator.line").alias("line"), F.get_json_object("metadata", "$.level").cast("int").alias("level"), F.col("content").alias("title"))


@query(rf"""WITH {_LINES} SELECT doc_id, CAST(n AS INT) AS line, regexp_matches(s, '^[0-9]') AS ordered, {_strip(_ITEM)} AS item FROM o
WHERE regexp_matches(s, '^(?:[-*+]|[0-9]+[.)])[ ]+[^ ]') AND NOT regexp_matches(s, '^[-*_](?:\s*[-*_]){{2,}}\s*$')""")
def md_list_items(spark: SparkSession, folder: str) -> DataFrame:
    rows = _markdown(spark, folder).where("type = 'list_item'")
    return rows.select("doc_id", F.col("source_locator.line").alias("line"), (F.get_json_object("metadata", "$.ordered") == "true").alias("ordered"), F.col("content").alias("item"))


@query()
def md_elements(spark: SparkSession, folder: str) -> DataFrame:
    return _markdown(spark, folder).select("doc_id", "ord", "type", F.col("source_locator.line").alias("line"), F.col("source_locator.section_path").alias("section_path"), "content", "resource_path", "metadata")


@query("SELECT doc_id, source AS title, lang FROM documents")
def md_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    head = F.concat(F.lit("---\ntitle: '"), "source", F.lit("'\nlist: [1]\nlang: \""), F.coalesce("lang", F.lit("")), F.lit('"\n---\n'), F.coalesce("text", F.lit("")))
    rows = table(spark, folder, "documents").select("doc_id", T.frontmatter(head).alias("m"))
    return rows.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["lang"].alias("lang"))


@query(rf"WITH {E} SELECT element_id, regexp_matches(element_id, '[02468]$') AS checked, regexp_replace(content, '^[ \t\n\x0B\f\r]+', '') AS text FROM e WHERE type = 'list_item' AND content IS NOT NULL")
def md_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Every list item as an item with a check box."""
    rows = _elements(spark, folder, "content").where("type = 'list_item' and content is not null")
    mark = F.when(F.col("element_id").rlike("[02468]$"), "[x] ").otherwise("[ ] ")
    return rows.select("element_id", T.task_item(F.concat(mark, "content")).alias("t")).where("t is not null").select("element_id", "t.checked", "t.text")


def _page(text: str) -> F.Column:
    """A text as a page of HTML, one paragraph for each line."""
    safe = F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<head><title>unseen</title></head><p>"), F.replace(F.regexp_replace(safe, "\r", ""), F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p>"))


@query(f"""WITH l AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(n AS INT) AS line, md5({_strip('s')}) AS content FROM l WHERE {_strip('s')} <> ''""")
def html_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", _page("text").alias("page"), F.concat(F.lit("d"), "doc_id").alias("d"))
    parsed = parse_column(rows, "page", "d", html.parse, keep=["doc_id"]).select("doc_id", F.explode("parsed.elements").alias("e"))
    return parsed.select("doc_id", F.col("e.source_locator.line").alias("line"), F.md5("e.content").alias("content"))


@query(f"""SELECT doc_id, 0 AS cell_index, 'code' AS cell_type, md5(text) AS content FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> '' UNION ALL
SELECT doc_id, 1, 'raw', md5(source) FROM documents WHERE text IS NOT NULL""")
def notebook_cells(spark: SparkSession, folder: str) -> DataFrame:
    cells = F.array(F.struct(F.lit("code").alias("cell_type"), F.col("text").alias("source")), F.struct(F.lit("raw").alias("cell_type"), F.col("source").alias("source")))
    book = F.to_json(F.struct(F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"), cells.alias("cells")))
    rows = spread(table(spark, folder, "documents")).where("text is not null").select("doc_id", book.alias("book"), F.concat(F.lit("d"), "doc_id").alias("d"))
    parsed = parse_column(rows, "book", "d", notebook.parse, keep=["doc_id"]).select("doc_id", F.explode("parsed.elements").alias("e"))
    return parsed.select("doc_id", "e.source_locator.cell_index", "e.source_locator.cell_type", F.md5("e.content").alias("content"))


@query(rf"""WITH {E}, l AS (SELECT element_id, [string_split(replace(regexp_replace(regexp_replace({_strip('x')}, '^\|', ''), '\|$', ''), '\|', chr(1)), '|') FOR x IN string_split(content, chr(10))] AS r FROM e WHERE type = 'table' AND content IS NOT NULL),
k AS (SELECT element_id, [[replace({_norm("replace(y, chr(1), '|')")}, '|', chr(92) || '|') FOR y IN x] FOR x IN r] AS r, list_max([len(x) FOR x IN r]) AS w FROM l),
q AS (SELECT element_id, len(r) AS n, w, ['| ' || array_to_string(list_concat(x, [ '' FOR i IN range(w - len(x))]), ' | ') || ' |' FOR x IN r] AS s FROM k)
SELECT element_id, CAST(n AS INT) AS row_count, CAST(w AS INT) AS col_count, md5(array_to_string(list_concat(s[1:1], ['| ' || array_to_string(['---' FOR i IN range(w)], ' | ') || ' |'], s[2:]), chr(10))) AS content FROM q""")
def html_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Every table as a table of HTML, its first row of head cells, read again."""
    rows = _elements(spark, folder, "content").where("type = 'table' and content is not null")
    cell = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(f"</{tag}>"))
    line = lambda x, n: F.concat(F.lit("<tr>"), F.array_join(F.when(n == 0, F.transform(tables.pipe_cells(x), cell("th"))).otherwise(F.transform(tables.pipe_cells(x), cell("td"))), ""), F.lit("</tr>"))
    page = F.concat(F.lit("<h1>x</h1><table>"), F.array_join(F.transform(F.split("content", "\n"), line), "\n"), F.lit("</table>"))
    parsed = parse_column(rows.select("element_id", page.alias("page")), "page", "element_id", html.parse, keep=["element_id"]).select("element_id", F.explode("parsed.elements").alias("e")).where("e.type = 'table'")
    number = lambda k: F.get_json_object("e.metadata", f"$.{k}").cast("int").alias(k)
    return parsed.select("element_id", number("row_count"), number("col_count"), F.md5("e.content").alias("content"))


@query(f"""WITH b AS (SELECT doc_id, source, {_norm('lang')} AS l FROM documents) SELECT doc_id, 0 AS cell_index, 'heading' AS type, 1 AS line, source AS section_path, source AS content FROM b
UNION ALL SELECT doc_id, 0, 'list_item', 3, source, 'tag ' || l FROM b WHERE l <> '' UNION ALL SELECT doc_id, 1, 'table', 1, NULL, '| source | lang |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || source || ' | x |' FROM b""")
def notebook_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Notebooks of markdown cells: a heading and a list item, then a table in a cell of its own, where sections begin anew."""
    lang = T.normalize("lang")
    first = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.when(lang != "", F.concat(F.lit("- tag "), lang)).otherwise(F.lit("")))
    second = F.concat(F.lit("| source | lang |\n|---|---|\n| "), "source", F.lit(" | x |"))
    cells = F.array(*[F.struct(F.lit("markdown").alias("cell_type"), c.alias("source")) for c in (first, second)])
    book = F.to_json(F.struct(F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"), cells.alias("cells")))
    rows = spread(table(spark, folder, "documents")).select("doc_id", book.alias("book"), F.concat(F.lit("d"), "doc_id").alias("d"))
    parsed = parse_column(rows, "book", "d", notebook.parse, keep=["doc_id"]).select("doc_id", F.explode("parsed.elements").alias("e"))
    return parsed.select("doc_id", "e.source_locator.cell_index", "e.type", "e.source_locator.line", "e.source_locator.section_path", "e.content")


# the pipeline


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = spread(table(spark, folder, "documents")).select("doc_id", "text", F.concat(F.lit("in/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")).alias("path"))
    return pipeline.documents(pipeline.from_texts(rows, "text", "path"), "text", None)


@query(f"""SELECT doc_id, CASE WHEN text IS NULL THEN 'file_not_found' WHEN {_strip('text')} = '' THEN 'no_extracted_elements' END AS error_code FROM documents""")
def pipeline_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", "error_code")


@query()
def pipeline_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("doc_id", "source_type", F.posexplode("chunks").alias("n", "c"))
    return rows.select("doc_id", "source_type", "n", "c.chunk_id", "c.text", F.col("c.metadata.strategy").alias("strategy"), F.size("c.source_spans").alias("spans"))


@query(f"SELECT doc_id, CAST(length({_squeeze('text')}) AS BIGINT) AS visible FROM documents WHERE text IS NOT NULL AND {_strip('text')} <> ''")
def chunk_preservation(spark: SparkSession, folder: str) -> DataFrame:
    """Of each document, read as plain text, the visible characters that its chunks hold."""
    texts = spread(table(spark, folder, "documents")).select("doc_id", "text", F.concat(F.lit("in/"), "doc_id", F.lit(".txt")).alias("path"))
    rows = pipeline.documents(pipeline.from_texts(texts, "text", "path"), "text", None).where("chunks is not null")
    return rows.select("doc_id", F.length(T.squeeze(F.array_join("chunks.text", " "))).cast("long").alias("visible"))


@query()
def chunk_preservation_all(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document, read as plain text and as Markdown, the visible characters of its elements and of its chunks."""
    path = F.explode(F.array(*[F.concat(F.lit("in/"), "doc_id", F.lit(e)) for e in (".txt", ".md")])).alias("path")
    rows = pipeline.documents(pipeline.from_texts(spread(table(spark, folder, "documents")).select("doc_id", "text", path), "text", "path"), "text", None)
    visible = lambda c: F.length(T.squeeze(F.array_join(c, " "))).cast("long")
    return rows.where("chunks is not null").select("doc_id", "source_type", visible("elements.content").alias("in_elements"), visible("chunks.text").alias("in_chunks"))


@query()
def chunk_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Long-text split of every element of the elements table, at 800 characters."""
    rows = _elements(spark, folder, "content")
    ddl = "array<struct<text:string,boundary:string,start:int,end:int>>"
    split = lambda t: [{"text": p, "boundary": b, "start": s, "end": z} for p, b, s, z in chunking.split_long(t or "", 800)]
    return with_local(rows, "pieces", ddl, split, "content", keep=["element_id"]).select("element_id", F.posexplode("pieces").alias("n", "p")).select("element_id", "n", "p.*")


# geometry




def _page_objects(spark: SparkSession, folder: str) -> DataFrame:
    rows = _elements(spark, folder, "source_locator").where(G.valid_box("source_locator.bbox") & F.col("source_locator.page").isNotNull())
    own = rows.select("document_id", F.col("source_locator.page").alias("page"), "element_id", "type", F.col("source_locator.bbox").alias("box"))
    images = own.where("type = 'image'").groupBy("document_id", "page").agg(F.collect_list("box").alias("images"))
    return own.where("type in ('table', 'paragraph')").join(images, ["document_id", "page"])


_PAGE = f"""WITH {E}, o AS (SELECT document_id, source_locator.page AS page, element_id, type, source_locator.bbox AS b FROM e WHERE len(source_locator.bbox) = 4 AND source_locator.page IS NOT NULL),
p AS (SELECT a.*, i.b AS c FROM o a JOIN o i USING (document_id, page) WHERE a.type IN ('table', 'paragraph') AND i.type = 'image'),
s AS (SELECT element_id, type, max(CASE WHEN (b[3] - b[1]) * (b[4] - b[2]) > 0 AND least(b[3], c[3]) > greatest(b[1], c[1]) AND least(b[4], c[4]) > greatest(b[2], c[2])
THEN (least(b[3], c[3]) - greatest(b[1], c[1])) * (least(b[4], c[4]) - greatest(b[2], c[2])) / ((b[3] - b[1]) * (b[4] - b[2])) ELSE 0 END) AS f FROM p GROUP BY 1, 2)
"""


@query(_PAGE + "SELECT element_id, round(f, 6) AS overlap FROM s")
def bbox_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return _page_objects(spark, folder).select("element_id", F.round(G.overlap("box", "images"), 6).alias("overlap"))


_GATE = _PAGE + rf""", d AS (SELECT element_id, string_split(content, chr(10)) AS r, [len(string_split(regexp_replace(regexp_replace({_strip('x')}, '^\|', ''), '\|$', ''), '|')) FOR x IN string_split(content, chr(10))] AS k,
len(regexp_extract_all(content, '[^\s|]+')) AS words FROM e WHERE type = 'table' AND content IS NOT NULL),
z AS (SELECT element_id, f, len(r) AS n, list_max(k) AS m, words FROM s JOIN d USING (element_id) WHERE s.type = 'table')
"""


def _gated(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of pages that have images, with their rows, columns and words (bars in cells count as columns)."""
    words = _elements(spark, folder, "content").where("type = 'table' and content is not null").select("element_id", "content")
    lines = F.split("content", "\n")
    bare = lambda x: F.regexp_replace(F.regexp_replace(T.strip(x), r"^\|", ""), r"\|$", "")
    counts = words.select("element_id", F.size(lines).alias("n"), F.array_max(F.transform(lines, lambda x: F.size(F.split(bare(x), r"\|")))).alias("m"), F.size(F.regexp_extract_all("content", F.lit(r"[^\s|]+"), 0)).alias("words"))
    return _page_objects(spark, folder).where("type = 'table'").join(counts, "element_id")


@query(_GATE + """SELECT element_id, f < 0.5 AND words >= 4 AND n >= 2 AS accepted, CASE WHEN f < 0.5 AND words >= 4 AND n >= 2 AND f > 0 THEN round(f, 6) END AS fraction, f < 0.5 AND words >= 4 AND n >= 2 AND words < n * m AS partial_coverage FROM z""")
def table_gate(spark: SparkSession, folder: str) -> DataFrame:
    gate = G.table_gate("box", F.col("n"), F.col("m"), F.col("words"), "images", F.array().cast("array<array<double>>"))
    return _gated(spark, folder).select("element_id", gate.alias("g")).select("element_id", "g.accepted", F.round("g.fraction", 6).alias("fraction"), "g.partial_coverage")


@query(_GATE + """, v AS (SELECT o.element_id, max(CASE WHEN w > 1000 THEN q ELSE 0 END) AS large, max(CASE WHEN w > 1000 THEN 0 ELSE q END) AS local FROM (
SELECT a.element_id, (i.b[3] - i.b[1]) * (i.b[4] - i.b[2]) AS w, CASE WHEN (a.b[3] - a.b[1]) * (a.b[4] - a.b[2]) > 0 AND least(a.b[3], i.b[3]) > greatest(a.b[1], i.b[1]) AND least(a.b[4], i.b[4]) > greatest(a.b[2], i.b[2])
THEN (least(a.b[3], i.b[3]) - greatest(a.b[1], i.b[1])) * (least(a.b[4], i.b[4]) - greatest(a.b[2], i.b[2])) / ((a.b[3] - a.b[1]) * (a.b[4] - a.b[2])) ELSE 0 END AS q FROM o a JOIN o i USING (document_id, page) WHERE a.type = 'table' AND i.type = 'image') o GROUP BY 1)
SELECT element_id, words >= 4 AND n >= 2 AND (f < 0.5 OR (m + 3 >= 6 AND large >= 0.5 AND local < 0.5)) AS accepted FROM z JOIN v USING (element_id)""")
def table_gate_oversize(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a page as vector figures of a page of 1,000 square points, the tables three columns wider than they are."""
    gate = G.table_gate_override("box", F.col("n"), F.col("m") + 3, F.col("words"), F.array().cast("array<array<double>>"), "images", F.lit(1000.0))
    return _gated(spark, folder).select("element_id", gate["accepted"].alias("accepted"))


@query()
def page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Elements with boxes as the words of their pages, grouped to lines and paragraphs."""
    from docspark.parsers import pages

    rows = _elements(spark, folder, "content", "source_locator").where(G.valid_box("source_locator.bbox") & F.col("content").isNotNull())
    b = F.col("source_locator.bbox")
    word = F.struct("element_id", F.col("content").alias("text"), b[0].alias("x0"), b[1].alias("top"), b[2].alias("x1"), b[3].alias("bottom"))
    by = rows.groupBy("document_id", F.col("source_locator.page").alias("page")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    lines = with_local(by, "lines", pages.LINES, pages.group_lines, "words", keep=["document_id", "page"])
    return lines.select("document_id", "page", F.explode("lines").alias("l")).select("document_id", "page", "l.line", "l.paragraph", "l.text", F.size("l.words").alias("words"))


@query()
def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Pages rebuilt from the boxes of all elements, images as raster images, tables with one cell a column, text as its words side by
    side, composed to elements again."""
    from docspark.parsers import pages

    rows = _elements(spark, folder, "content", "source_locator").where(G.valid_box("source_locator.bbox") & F.col("source_locator.page").isNotNull())
    own = rows.select("document_id", F.col("source_locator.page").alias("page"), "element_id", "type", F.coalesce("content", F.lit("")).alias("content"), F.col("source_locator.bbox").alias("b"))
    b, x0 = F.col("b"), F.col("b")[0]
    text = F.filter(F.split("content", r"[\s|]+"), lambda w: w != "")
    wide = (b[2] - b[0]) / F.greatest(F.size(text), F.lit(1))
    spot = lambda n: [(x0 + wide * n).alias("x0"), (x0 + wide * (n + 1)).alias("x1"), b[1].alias("top"), b[3].alias("bottom")]
    words = F.when(F.col("type") != "image", F.transform(text, lambda w, n: F.struct(w.alias("text"), *spot(n), F.array(F.struct(*spot(n))).alias("chars"))))
    table_ = F.when(F.col("type") == "table", F.struct(b.alias("bbox"), F.array(F.array(x0, b[1], b[2] + 0.001, b[3] + 0.001)).alias("cells"), F.transform(F.split("content", "\n"), tables.pipe_cells).alias("rows")))
    image = F.when(F.col("type") == "image", F.struct(x0.alias("x0"), b[2].alias("x1"), b[1].alias("top"), b[3].alias("bottom"), F.col("element_id").alias("tag")))
    item = F.struct("element_id", words.alias("words"), table_.alias("t"), image.alias("i"))
    by = own.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))  # what is on a page
    page = F.struct(F.col("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.flatten(F.filter("items.words", F.isnotnull)).alias("words"), F.filter("items.t", F.isnotnull).alias("tables"), F.filter("items.i", F.isnotnull).alias("images"), F.lit(None).alias("shapes"))
    shaped = by.select("document_id", "page", F.array(page).cast(f"array<{pages.PAGE}>").alias("pages"))
    parsed = parse_column(shaped, "pages", "document_id", pages.compose, keep=["document_id", "page"])
    return parsed.select("document_id", "page", F.posexplode("parsed.elements").alias("n", "e")).select("document_id", "page", "n", "e.type", F.md5(F.coalesce("e.content", F.lit(""))).alias("content"))


# relations


def _related(spark: SparkSession, folder: str) -> DataFrame:
    return _typed(spark, folder, "content", "source_locator")


@query(f"""WITH {TE} SELECT i.document_id, 'has_caption' AS type, i.element_id AS from_id, c.element_id AS to_id FROM t i JOIN t c ON i.document_id = c.document_id AND c.source_locator.paragraph_index = i.source_locator.paragraph_index + 1
WHERE i.source_type = 'docx' AND c.source_type = 'docx' AND i.type = 'image' AND c.type = 'caption' AND regexp_matches(c.content, '^(?:Figure|Fig\\.?|图)\\s*[0-9]+[.、:：\\s]')""".replace("\\\\", "\\"))
def figure_captions_docx(spark: SparkSession, folder: str) -> DataFrame:
    return relations.figure_captions_docx(_related(spark, folder)).drop("metadata")


@query(f"""WITH {TE}, q AS (SELECT *, lag(element_id) OVER w AS pe, lag(type) OVER w AS pt, lag(content) OVER w AS pc, lag(ord) OVER w AS po FROM t WHERE source_type = 'docx' WINDOW w AS (PARTITION BY document_id ORDER BY ord))
SELECT document_id, 'table_has_caption' AS type, element_id AS from_id, pe AS to_id FROM q WHERE type = 'table' AND pt = 'caption' AND po = ord - 1 AND regexp_matches(pc, '^(?:Table|表格|表)\\s*[0-9]+[.、:：\\s]')""".replace("\\\\", "\\"))
def table_captions_docx(spark: SparkSession, folder: str) -> DataFrame:
    return relations.table_captions_docx(_related(spark, folder)).drop("metadata")


def _candidates_sql(kind: str, pattern: str, gap: str) -> str:
    return rf"""WITH {TE}, b AS (SELECT document_id, element_id, type, content, source_locator.page AS page, source_locator.bbox AS x FROM t WHERE source_type = 'pdf' AND len(source_locator.bbox) = 4)
SELECT o.document_id, o.page, o.element_id AS from_id, c.element_id AS to_id, round({gap}, 6) AS gap FROM b o JOIN b c USING (document_id, page) WHERE o.type = '{kind}' AND c.type = 'caption' AND regexp_matches(c.content, '{pattern}')
AND {gap} > 0 AND {gap} <= 50 AND least(o.x[3], c.x[3]) - greatest(o.x[1], c.x[1]) > 0"""


@query(_candidates_sql("image", r"^(?:Figure|Fig\.?|图)\s*[0-9]+[.、:：\s]", "c.x[2] - o.x[4]"))
def figure_candidates_pdf(spark: SparkSession, folder: str) -> DataFrame:
    return relations.candidates_pdf(_related(spark, folder), "image").withColumn("gap", F.round("gap", 6))


@query(_candidates_sql("table", r"^(?:Table|表格|表)\s*[0-9]+[.、:：\s]", "o.x[2] - c.x[4]"))
def table_candidates_pdf(spark: SparkSession, folder: str) -> DataFrame:
    return relations.candidates_pdf(_related(spark, folder), "table").withColumn("gap", F.round("gap", 6))


_B = "b AS (SELECT document_id, element_id, type, content, source_locator.page AS page, source_locator.bbox AS x FROM t WHERE source_type = 'pdf' AND len(source_locator.bbox) = 4)"


def _pairs_sql(kind: str, name: str, pattern: str, gap: str) -> str:
    return rf"""SELECT o.document_id, o.page, '{name}' AS type, o.element_id AS from_id, c.element_id AS to_id, {gap} AS gap FROM b o JOIN b c USING (document_id, page) WHERE o.type = '{kind}' AND c.type = 'caption' AND regexp_matches(c.content, '{pattern}')
AND {gap} > 0 AND {gap} <= 50 AND least(o.x[3], c.x[3]) - greatest(o.x[1], c.x[1]) > 0"""


_FIGURE, _TABLE = r"^(?:Figure|Fig\.?|图)\s*[0-9]+[.、:：\s]", r"^(?:Table|表格|表)\s*[0-9]+[.、:：\s]"
# the greedy match of a page, one pair after the other in order
_GREEDY = f"""{_B}, c2 AS ({_pairs_sql('image', 'has_caption', _FIGURE, 'c.x[2] - o.x[4]')} UNION ALL {_pairs_sql('table', 'table_has_caption', _TABLE, 'o.x[2] - c.x[4]')}),
k2 AS (SELECT *, row_number() OVER (PARTITION BY document_id, page, type ORDER BY gap, from_id, to_id) AS k FROM c2),
g AS (SELECT document_id, page, type, from_id, to_id, gap, k, ['f' || from_id, 't' || to_id] AS used, true AS taken FROM k2 WHERE k = 1
UNION ALL SELECT n.document_id, n.page, n.type, n.from_id, n.to_id, n.gap, n.k, CASE WHEN list_has_any(g.used, ['f' || n.from_id, 't' || n.to_id]) THEN g.used ELSE list_concat(g.used, ['f' || n.from_id, 't' || n.to_id]) END,
NOT list_has_any(g.used, ['f' || n.from_id, 't' || n.to_id]) FROM g JOIN k2 n ON n.document_id = g.document_id AND n.page = g.page AND n.type = g.type AND n.k = g.k + 1)"""


@query(f"WITH RECURSIVE {TE}, {_GREEDY} SELECT document_id, type, from_id, to_id, round(gap, 6) AS gap FROM g WHERE taken")
def captions_pdf(spark: SparkSession, folder: str) -> DataFrame:
    rows = _related(spark, folder)
    both = relations.captions_pdf(rows, "image").unionByName(relations.captions_pdf(rows, "table"))
    return both.select("document_id", "type", "from_id", "to_id", F.round(F.get_json_object("metadata", "$.gap").cast("double"), 6).alias("gap"))


_REF = r"""m AS (SELECT document_id, element_id, fam, CAST(translate(regexp_extract(x, '([0-9０-９]+)$', 1), '０１２３４５６７８９', '0123456789') AS HUGEINT) AS n FROM (
SELECT document_id, element_id, 'figure' AS fam, unnest(regexp_extract_all(content, '(?i)(?:Figure|Fig\.?|图)\s*[0-9０-９]+')) AS x FROM t WHERE source_type IN ('pdf', 'docx') AND type IN ('paragraph', 'heading', 'list_item')
UNION ALL SELECT document_id, element_id, 'table', unnest(regexp_extract_all(content, '(?i)(?:Table|表格|表)\s*[0-9０-９]+')) FROM t WHERE source_type IN ('pdf', 'docx') AND type IN ('paragraph', 'heading', 'list_item'))),
p AS (SELECT document_id, element_id AS to_id, CASE type WHEN 'image' THEN 'figure' ELSE 'table' END AS fam, row_number() OVER (PARTITION BY document_id, type ORDER BY ord) AS n FROM t WHERE source_type IN ('pdf', 'docx') AND type IN ('image', 'table'))
"""


@query(f"WITH {TE}, {_REF} SELECT DISTINCT m.document_id, 'references_' || fam AS type, m.element_id AS from_id, p.to_id FROM m JOIN p USING (document_id, fam, n)")
def references_by_order(spark: SparkSession, folder: str) -> DataFrame:
    """References as they resolve where no caption is attached to any object."""
    rows = _related(spark, folder)
    none = rows.limit(0).select("document_id", F.lit("").alias("type"), F.col("element_id").alias("from_id"), F.col("element_id").alias("to_id"))
    return relations.references(rows, none).drop("metadata").distinct()


@query(rf"""WITH RECURSIVE {TE}, {_GREEDY}, q AS (SELECT *, lag(element_id) OVER w AS pe, lag(type) OVER w AS pt, lag(content) OVER w AS pc, lag(ord) OVER w AS po FROM t WHERE source_type = 'docx' WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
cap AS (SELECT document_id, type, from_id, to_id FROM g WHERE taken
UNION ALL SELECT i.document_id, 'has_caption', i.element_id, c.element_id FROM t i JOIN t c ON i.document_id = c.document_id AND c.source_locator.paragraph_index = i.source_locator.paragraph_index + 1
WHERE i.source_type = 'docx' AND c.source_type = 'docx' AND i.type = 'image' AND c.type = 'caption' AND regexp_matches(c.content, '{_FIGURE}')
UNION ALL SELECT document_id, 'table_has_caption', element_id, pe FROM q WHERE type = 'table' AND pt = 'caption' AND po = ord - 1 AND regexp_matches(pc, '{_TABLE}')),
{_REF}, ends AS (SELECT document_id, to_id AS caption, max(from_id) AS target FROM cap GROUP BY 1, 2),
y AS (SELECT c.document_id, CASE o.type WHEN 'image' THEN 'figure' ELSE 'table' END AS fam, target, c.ord, regexp_extract(c.content, CASE o.type WHEN 'image' THEN '(?i)^(?:Figure|Fig\.?|图)\s*([0-9０-９]+)' ELSE '(?i)^(?:Table|表格|表)\s*([0-9０-９]+)' END, 1) AS d
FROM ends JOIN t c ON c.document_id = ends.document_id AND c.element_id = caption AND c.type = 'caption' JOIN t o ON o.document_id = ends.document_id AND o.element_id = target),
lab AS (SELECT document_id, fam, CAST(translate(d, '０１２３４５６７８９', '0123456789') AS HUGEINT) AS n, arg_min(target, ord) AS labelled FROM y WHERE d <> '' GROUP BY 1, 2, 3)
SELECT document_id, type, from_id, to_id FROM cap UNION ALL
SELECT DISTINCT m.document_id, 'references_' || m.fam, m.element_id, coalesce(labelled, p.to_id) FROM (SELECT DISTINCT * FROM m) m LEFT JOIN lab USING (document_id, fam, n) LEFT JOIN p USING (document_id, fam, n) WHERE coalesce(labelled, p.to_id) IS NOT NULL""")
def all_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Every relation of every document; references of one element to one object by two numbers count once."""
    return relations.all_relations(_related(spark, folder)).drop("metadata").distinct()


# validation


@query(f"""WITH {H}, v AS (SELECT document_id, unnest([CASE WHEN NOT coalesce(regexp_matches(source_hash, '^[0-9a-f]{{64}}$'), false) THEN 'source_hash.pattern' END,
CASE WHEN NOT coalesce(schema_version IN ('0.1.0', '0.2.0', '0.3.0', '0.4.0', '0.5.0', '0.6.0'), false) THEN 'schema_version.enum' END,
CASE WHEN NOT coalesce(CASE WHEN schema_version = '0.1.0' THEN source_type IN ('pdf', 'docx') WHEN schema_version <= '0.5.0' THEN source_type IN ('markdown', 'html', 'text', 'docx', 'pdf', 'ipynb') ELSE regexp_matches(source_type, '^[a-z][a-z0-9_]{{0,31}}$') END, false) THEN 'source_type.version' END,
CASE WHEN NOT coalesce(length(document_id) > 0, false) THEN 'document_id.required' END, CASE WHEN NOT coalesce(length(source_path) > 0, false) THEN 'source_path.required' END,
CASE WHEN coalesce(contains(source_path, chr(92)), true) THEN 'source_path.slashes' END, CASE WHEN NOT coalesce(length(parser_name) > 0, false) THEN 'parser_name.required' END,
CASE WHEN parser_version IS NULL THEN 'parser_version.required' END, CASE WHEN warnings IS NULL THEN 'warnings.required' END, CASE WHEN errors IS NULL THEN 'errors.required' END]) AS code FROM h)
SELECT document_id, code, split_part(code, '.', 1) AS path FROM v WHERE code IS NOT NULL""")
def header_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _headers(spark, folder, "source_path", "source_hash", "parser_name", "parser_version", "warnings", "errors")
    return validation.explode_violations(rows, validation.header_violations(), "document_id")


@query(f"""WITH {TE}, x AS (SELECT *, source_locator.family AS f, CASE WHEN source_type IN ('markdown', 'html', 'text') THEN 'line_address' WHEN source_type = 'docx' THEN 'structural_index' WHEN source_type = 'pdf' THEN 'page_geometry' WHEN source_type = 'ipynb' THEN 'container_line' END AS due,
CASE WHEN source_type = 'pdf' THEN source_locator.page >= 1 AND (source_locator.bbox IS NULL OR len(source_locator.bbox) = 4)
WHEN source_type = 'docx' THEN source_locator.paragraph_index IS NOT NULL OR source_locator.table_index IS NOT NULL OR source_locator.section IS NOT NULL OR source_locator.relationship_id IS NOT NULL OR source_locator.target_partname IS NOT NULL
WHEN source_type = 'ipynb' THEN (source_locator.cell_index IS NULL OR source_locator.cell_index >= 0) AND (source_locator.cell_type IS NULL OR source_locator.cell_type IN ('markdown', 'code', 'raw')) AND (source_locator.line IS NULL OR source_locator.line >= 1)
ELSE source_locator.line IS NULL OR source_locator.line >= 1 END AS shape FROM t),
v AS (SELECT element_id, unnest([CASE WHEN NOT coalesce(length(element_id) > 0, false) THEN 'element_id.required' END, CASE WHEN NOT coalesce(type IN ('heading', 'paragraph', 'list_item', 'table', 'image', 'caption', 'header', 'footer'), false) THEN 'type.enum' END,
CASE WHEN NOT coalesce(length(content) > 0 OR length(resource_path) > 0, false) THEN 'content.any_of' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence.range' END,
CASE WHEN source_locator IS NULL THEN 'locator.required' END, CASE WHEN NOT coalesce(source_type IS NULL OR shape, false) THEN 'locator.shape' END,
CASE WHEN NOT coalesce(CASE WHEN schema_version < '0.3.0' THEN f IS NULL ELSE due IS NULL OR f IS NULL OR f = due END, false) THEN 'locator.family' END]) AS code FROM x)
SELECT element_id, code FROM v WHERE code IS NOT NULL""")
def element_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _typed(spark, folder, "content", "resource_path", "source_locator", "confidence")
    return validation.explode_violations(rows, validation.element_violations(), "element_id").drop("path")


_KINDS = ("pdf", "docx", "ipynb", "text")


@query(f"""WITH {E}, x AS (SELECT source_locator AS l, unnest({list(_KINDS)}) AS kind FROM e), v AS (SELECT kind, unnest([CASE WHEN NOT coalesce(CASE kind WHEN 'pdf' THEN l.page >= 1 AND (l.bbox IS NULL OR len(l.bbox) = 4)
WHEN 'docx' THEN l.paragraph_index IS NOT NULL OR l.table_index IS NOT NULL OR l.section IS NOT NULL OR l.relationship_id IS NOT NULL OR l.target_partname IS NOT NULL
WHEN 'ipynb' THEN (l.cell_index IS NULL OR l.cell_index >= 0) AND (l.cell_type IS NULL OR l.cell_type IN ('markdown', 'code', 'raw')) AND (l.line IS NULL OR l.line >= 1) ELSE l.line IS NULL OR l.line >= 1 END, false) THEN 'locator.shape' END,
CASE WHEN l.family IS NOT NULL AND l.family <> CASE kind WHEN 'pdf' THEN 'page_geometry' WHEN 'docx' THEN 'structural_index' WHEN 'ipynb' THEN 'container_line' ELSE 'line_address' END THEN 'locator.family' END]) AS code FROM x)
SELECT kind, code, count(*) AS elements FROM v WHERE code IS NOT NULL GROUP BY 1, 2""")
def element_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How many elements would break the rules on locators if their document were of each source type."""
    rows = _elements(spark, folder, "content", "resource_path", "source_locator", "confidence").withColumn("kind", F.explode(F.array(*map(F.lit, _KINDS))))
    broken = validation.explode_violations(rows, validation.element_violations(F.col, F.col("kind"), F.lit("0.6.0")), "kind").where("code in ('locator.shape', 'locator.family')")
    return broken.groupBy("kind", "code").agg(F.count("*").alias("elements"))


@query(f"""WITH {C}, v AS (SELECT chunk_id, unnest([CASE WHEN NOT coalesce(length(chunk_id) > 0, false) THEN 'chunk_id.required' END, CASE WHEN NOT coalesce(length(text) > 0, false) THEN 'text.required' END,
CASE WHEN NOT coalesce(len(source_element_ids) > 0, false) THEN 'source_element_ids.min' END, CASE WHEN source_element_ids IS NULL OR len([x FOR x IN source_element_ids IF coalesce(length(x), 0) = 0]) > 0 THEN 'source_element_ids.empty' END,
CASE WHEN NOT coalesce(metadata.char_count = length(text), false) THEN 'char_count.stale' END,
CASE WHEN source_spans IS NOT NULL AND len([s FOR s IN source_spans IF NOT (s.start >= 0 AND s."end" >= s.start)]) > 0 THEN 'source_spans.range' END]) AS code FROM c) SELECT chunk_id, code FROM v WHERE code IS NOT NULL""")
def chunk_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = _chunks(spark, folder, "text", "source_element_ids", "metadata", "source_spans")
    return validation.explode_violations(rows, validation.chunk_violations(), "chunk_id").drop("path")


@query(f"""WITH {R}, {H}, x AS (SELECT r.*, h.schema_version AS sv FROM r LEFT JOIN h USING (document_id)), v AS (SELECT relation_id, unnest([
CASE WHEN NOT coalesce(type IN ('has_caption', 'table_has_caption', 'references_figure', 'references_table'), false) THEN 'type.enum' END,
CASE WHEN sv < CASE type WHEN 'has_caption' THEN '0.4.0' WHEN 'table_has_caption' THEN '0.5.0' ELSE '0.1.0' END THEN 'type.version' END,
CASE WHEN NOT coalesce(length(from_id) > 0, false) THEN 'from_id.required' END, CASE WHEN NOT coalesce(length(to_id) > 0, false) THEN 'to_id.required' END]) AS code FROM x) SELECT relation_id, code FROM v WHERE code IS NOT NULL""")
def relation_violations(spark: SparkSession, folder: str) -> DataFrame:
    rows = earliest(table(spark, folder, "relations"), "relation_id", ["recorded_at", "document_id", "type", "from_id", "to_id"])
    rows = rows.join(_headers(spark, folder).select("document_id", "schema_version"), "document_id", "left")
    return validation.explode_violations(rows, validation.relation_violations(), "relation_id").drop("path")


# metrics


@query(f"WITH {E} SELECT document_id, coalesce(type, 'unknown') AS type, count(*) AS n FROM e GROUP BY 1, 2")
def element_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.element_counts(_elements(spark, folder))


@query(f"""WITH {TE} SELECT document_id, count(*) FILTER (source_locator.page >= 1 AND (type NOT IN ('heading', 'paragraph', 'caption', 'list_item') OR coalesce(len(source_locator.bbox) = 4, false))) AS valid, count(*) AS elements,
round(count(*) FILTER (source_locator.page >= 1 AND (type NOT IN ('heading', 'paragraph', 'caption', 'list_item') OR coalesce(len(source_locator.bbox) = 4, false))) / count(*), 6) AS ratio FROM t WHERE source_type = 'pdf' GROUP BY 1""")
def locator_ratio_pdf(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.locator_ratio(_typed(spark, folder, "source_locator"), "pdf").withColumn("ratio", F.round("ratio", 6))


_DOCX = "source_locator.page IS NULL AND source_locator.bbox IS NULL AND (source_locator.section IS NOT NULL OR source_locator.paragraph_index IS NOT NULL OR source_locator.table_index IS NOT NULL OR source_locator.relationship_id IS NOT NULL OR coalesce(cardinality(source_locator.extra) > 0, false))"


@query(f"WITH {TE} SELECT document_id, count(*) FILTER ({_DOCX}) AS valid, count(*) AS elements, round(count(*) FILTER ({_DOCX}) / count(*), 6) AS ratio FROM t WHERE source_type = 'docx' GROUP BY 1")
def locator_ratio_docx(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.locator_ratio(_typed(spark, folder, "source_locator"), "docx").withColumn("ratio", F.round("ratio", 6))


@query(f"""WITH {E}, {C}, x AS (SELECT document_id, chunk_id, unnest(CASE WHEN coalesce(len(source_element_ids), 0) = 0 THEN [NULL] ELSE source_element_ids END) AS element_id FROM c),
k AS (SELECT x.document_id, chunk_id, count(*) = count(e.element_id) AS ok FROM x LEFT JOIN e ON e.document_id = x.document_id AND e.element_id = x.element_id GROUP BY 1, 2)
SELECT document_id, count(*) FILTER (ok) AS intact, count(*) AS chunks FROM k GROUP BY 1""")
def chunk_references(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.chunk_references(_chunks(spark, folder, "source_element_ids"), _elements(spark, folder))


_CHARS = "SELECT document_id, ch, count(*) AS n FROM (SELECT document_id, unnest(string_split({s}, '')) AS ch FROM {t}) WHERE ch <> '' GROUP BY 1, 2"


@query(f"""WITH {E}, {C}, x AS ({_CHARS.format(s=_squeeze('content'), t="e WHERE type <> 'image'").replace("FROM e WHERE type <> 'image')", "FROM (SELECT * FROM e WHERE type <> 'image'))")}), y AS ({_CHARS.format(s=_squeeze('text'), t='c')})
SELECT document_id, sum(least(coalesce(x.n, 0), coalesce(y.n, 0)))::BIGINT AS common, sum(coalesce(x.n, 0))::BIGINT AS expected, sum(coalesce(y.n, 0))::BIGINT AS actual,
round(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / nullif(sum(coalesce(y.n, 0)), 0), 6) AS precision, round(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / nullif(sum(coalesce(x.n, 0)), 0), 6) AS recall FROM x FULL JOIN y USING (document_id, ch) GROUP BY 1""")
def character_overlap(spark: SparkSession, folder: str) -> DataFrame:
    expected = metrics.character_counts(_elements(spark, folder, "content").where("type <> 'image'"), "content")
    both = metrics.character_overlap(expected, metrics.character_counts(_chunks(spark, folder, "text"), "text"))
    return both.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


@query(f"""WITH {E}, {C}, f AS (SELECT DISTINCT document_id, source_element_ids[1] AS element_id FROM c) SELECT document_id, count(f.element_id) AS first, count(*) AS headings FROM (SELECT * FROM e WHERE type = 'heading') LEFT JOIN f USING (document_id, element_id) GROUP BY 1""")
def heading_compliance(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.heading_compliance(_elements(spark, folder), _chunks(spark, folder, "source_element_ids"))


@query(f"""WITH {E}, {R}, w AS (SELECT document_id, CASE WHEN type IN ('has_caption', 'table_has_caption') THEN 'caption' WHEN type = 'references_figure' THEN 'image' ELSE 'table' END AS type, count(*) AS n FROM r GROUP BY 1, 2),
k AS (SELECT document_id, type, count(*) AS n FROM e GROUP BY 1, 2) SELECT document_id, CAST(sum(greatest(0, w.n - coalesce(k.n, 0))) AS BIGINT) AS dropped FROM w LEFT JOIN k USING (document_id, type) GROUP BY 1""")
def silent_drops(spark: SparkSession, folder: str) -> DataFrame:
    """Fewer captions, images or tables than the relations of a document speak of."""
    links = earliest(table(spark, folder, "relations"), "relation_id", ["recorded_at", "document_id", "type"])
    kind = F.when(F.col("type").isin("has_caption", "table_has_caption"), "caption").when(F.col("type") == "references_figure", "image").otherwise("table")
    expected = links.groupBy("document_id", kind.alias("type")).agg(F.count("*").alias("n"))
    return metrics.silent_drops(expected, metrics.element_counts(_elements(spark, folder)))


@query(f"SELECT doc_id, CAST((NOT contains({_norm('text')}, source))::INT + (NOT contains({_norm('text')}, 'The'))::INT AS INT) AS missing FROM documents")
def required_markers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(metrics.missing_markers(F.array("source", F.lit(" The ")), F.col("text"))).alias("missing"))


@query()
def boundary_prf(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk boundaries of each document against the starts of its headings."""
    order = F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int")
    texts = _chunks(spark, folder, "text").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("n"), "text"))).alias("t")).select("document_id", F.col("t.text").alias("texts"))
    heads = _elements(spark, folder, "content").where("type = 'heading' and content is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("h"))
    anchors = heads.select("document_id", F.transform("h", lambda x: F.struct(x["content"].alias("marker"), F.lit("before").alias("position"))).alias("anchors"))
    rows = metrics.chunk_boundaries(texts.join(anchors, "document_id", "left"), "texts", "anchors").select("document_id", "boundary.*")
    return rows.select("document_id", "predicted", "truth", "matched", *metrics.prf(F.col("predicted"), F.col("truth"), F.col("matched")))


@query()
def heading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Headings as the chunks hold them against their order in the document."""
    heads = _elements(spark, folder, "content").where("type = 'heading' and content is not null")
    place = _chunks(spark, folder, "source_element_ids").select(F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int").alias("n"), F.explode("source_element_ids").alias("element_id"))
    found = heads.join(place, "element_id").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "element_id"))).alias("x")).select("document_id", F.col("x.element_id").alias("found"))
    truth = heads.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "element_id"))).alias("x")).select("document_id", F.col("x.element_id").alias("truth"))
    rows = metrics.heading_order(truth.join(found, "document_id", "left"), "found", "truth")
    return rows.select("document_id", "matched", *metrics.prf(F.size(F.coalesce("found", F.array().cast("array<string>"))), F.size("truth"), F.col("matched")))


@query(f"""WITH {TE}, d AS (SELECT source_type, document_id, avg((content IS NOT NULL)::INT) AS filled, avg((parent_id IS NOT NULL)::INT) AS linked, CASE WHEN source_type = 'pdf' THEN avg((source_locator.page >= 1)::INT) END AS paged FROM t GROUP BY 1, 2)
SELECT count(*) AS documents, round(avg(filled), 6) AS filled_mean, count(*) FILTER (filled IS NULL) AS filled_not_evaluated, round(avg(linked), 6) AS linked_mean, count(*) FILTER (linked IS NULL) AS linked_not_evaluated, round(avg(paged), 6) AS paged_mean, count(*) FILTER (paged IS NULL) AS paged_not_evaluated FROM d""")
def summary_macro(spark: SparkSession, folder: str) -> DataFrame:
    rows = _typed(spark, folder, "content", "parent_id", "source_locator")
    share = lambda c: F.avg(c.cast("int"))
    by = rows.groupBy("source_type", "document_id").agg(share(F.col("content").isNotNull()).alias("filled"), share(F.col("parent_id").isNotNull()).alias("linked"), share(F.col("source_locator.page") >= 1).alias("p"))
    out = metrics.macro(by.withColumn("paged", F.when(F.col("source_type") == "pdf", F.col("p"))), ["filled", "linked", "paged"])
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in out.columns])


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 WHEN doc_id % 3 = 1 THEN doc_id - 1 END AS p FROM documents), a AS (SELECT DISTINCT least(doc_id, p) AS x, greatest(doc_id, p) AS y FROM d WHERE p IS NOT NULL),
b AS (SELECT x AS doc_id FROM a UNION SELECT y FROM a) SELECT (SELECT count(*) FROM a) AS pairs, (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS unpaired, (SELECT count(*) FROM a) + (SELECT count(*) FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS groups""")
def content_groups(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    return metrics.content_groups(table(spark, folder, "documents").select("doc_id", F.when(d % 3 == 0, d + 1).when(d % 3 == 1, d - 1).alias("paired_with")))


@query(f"""WITH {H} SELECT source_type, count(*) AS documents, count(*) FILTER (len(errors) = 0) AS succeeded, round(count(*) FILTER (len(errors) = 0) / count(*), 6) AS success_rate FROM h GROUP BY 1""")
def success_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _headers(spark, folder, "errors").groupBy("source_type").agg(F.count("*").alias("documents"), F.count_if(F.size("errors") == 0).alias("succeeded"))
    return rows.withColumn("success_rate", F.round(F.col("succeeded") / F.col("documents"), 6))
