"""Queries of the general data problems 1, 4, 5 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators import drift, hierarchy, nesting, references
from docspark.plans.lineage import Cuts
from docspark.sources.tables import earliest, spread, table

NESTED = (("elements", "element_id", "source_locator"),)
LONE = ("source_spans", "cells", "runs", "notes", "replies")
PARSED = (("elements", "metadata"),)


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads that are JSON, as variants. Those that Spark's own reader refuses (a name given twice, deep nesting, long numbers)
    are written anew for it by `nesting.plain`, once, so that no other payload goes through Python."""
    raw = spread(table(spark, folder, "raw_docs")).where("payload is not null").select("raw_id", "feed", F.col("run_no").alias("run"), "received_at", "payload")
    refused = raw.where("try_parse_json(payload) is null").withColumn("payload", F.udf(lambda x: nesting.plain(x), "string")("payload"))
    read = F.expr("try_parse_json(payload)").alias("v")
    return raw.unionByName(Cuts(spark).cut(refused)).select("raw_id", "feed", "run", "received_at", read).where("v is not null")


def _full(level: str, field: str) -> F.Column:
    """A field with its level before it; the absent side of a change stays empty."""
    return F.when(F.col(field) == "", "").when(F.col(level) == "", F.col(field)).otherwise(F.concat(level, F.lit("."), field))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    changes, _ = drift.drift(_payloads(spark, folder).select("feed", "run", "v"), NESTED)
    return changes.select("feed", F.col("run").alias("run_no"), _full("level", "old_field").alias("old_field"), _full("new_level", "new_field").alias("new_field"), "change")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).where("change <> 'moved'").distinct()


def p1_moved(spark: SparkSession, folder: str) -> DataFrame:
    """Fields that moved between the top level and source_locator, with values that agree; p1_found has them removed and added."""
    return _changes(spark, folder).where("change = 'moved'").drop("change")


TOP = ("document_id", "source_type", "schema_version", "source_path", "source_hash", "parser_name", "parser_version")
OWN = ("element_id", "type", "content", "parent_id", "resource_path", "confidence", "metadata")
INNER = ("family", "page", "bbox", "paragraph_index", "section", "relationship_id", "line", "section_path", "cell_index", "cell_type")
#: Document fields that are lists or objects whatever the writer, so that one entry is no sign of a retyped field; the column of each.
WHOLE = {"warnings": "warnings", "errors": "errors", "metadata": "document_metadata"}
#: Top-level lists whose entries are rows of their own, not fields of a document.
LISTS = ("elements", "chunks", "relations")


def p1_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every element of every payload with its document's fields, under consistent names, in one form whatever its writer.

    Fields beyond the fixed columns are in the maps document_extra, locator_extra (by consistent name) and element_extra; a field
    that a payload holds as null is a null there. Payloads without a feed or run have no run before them, so that their fields keep
    their names; a payload that is no object is a row without fields. A lone value in the place of the elements is one element; what is no
    object there is in element_extra as `value`, and a source_locator that is none as `source_locator_own`.
    """
    payloads = _payloads(spark, folder)
    _, names = drift.drift(payloads.select("feed", "run", "v"), NESTED)
    deep = "elements.source_locator"
    # by consistent name the field that has it: on its own level, and where it has moved to or from the other
    places = (("", "", "top"), ("", deep, "top_moved"), (deep, deep, "inner"), (deep, "", "inner_moved"))
    held = lambda to, at: F.collect_list(F.when((F.col("name_level") == to) & (F.col("level") == at), F.struct("name", "field")))
    maps = names.groupBy("feed", "run").agg(*[F.map_from_entries(F.array_sort(held(to, at))).alias(alias) for to, at, alias in places])
    parsed = lambda v, path, kind: f"try_variant_get(try_parse_json(try_variant_get({v}, '{path}', 'string')), '$', '{kind}')"
    objects = {"doc": "try_variant_get(v, '$', 'map<string, variant>')", "loc": f"coalesce(try_variant_get(el, '$.source_locator', 'map<string, variant>'), {parsed('el', '$.source_locator', 'map<string, variant>')})", "own": "coalesce(try_variant_get(el, '$', 'map<string, variant>'), CASE WHEN el IS NOT NULL THEN map('value', el) END)"}

    def named(held: str, here: str, moved: str, other: str) -> F.Column:
        """The map `here` (field by name) with the fields that neither it nor `moved` has, under names that it and `other` haven't."""
        known = f"concat(map_values(coalesce({here}, map())), map_values(coalesce({moved}, map())))"
        taken = f"concat(map_keys(coalesce({here}, map())), map_keys(coalesce({other}, map())))"
        own = f"transform(filter(map_keys(coalesce({held}, map())), k -> NOT array_contains({known}, k)), k -> struct(CASE WHEN array_contains({taken}, k) THEN k || '_own' ELSE k END, k))"
        return F.expr(f"map_concat(coalesce({here}, map()), map_from_entries({own}))")

    rows = payloads.join(maps, ["feed", "run"], "left").withColumn("doc", F.expr(objects["doc"])).withColumn("top", named("doc", "top", "inner_moved", "top_moved"))
    rows = rows.withColumn("list", F.expr("doc[top['elements']]")).withColumn("list", F.expr(f"CASE WHEN list IS NULL OR schema_of_variant(list) = 'VOID' THEN NULL ELSE coalesce(try_variant_get(list, '$', 'array<variant>'), try_variant_get({drift.unwrap('list')}, '$', 'array<variant>'), {parsed('list', '$', 'array<variant>')}, array(list)) END"))
    rows = rows.select("*", F.posexplode_outer("list").alias("pos", "el")).withColumns({x: F.expr(objects[x]) for x in ("loc", "own")}).withColumn("inner", named("loc", "inner", "top_moved", "inner_moved"))

    def text(value: str) -> str:
        return f"nullif(coalesce(try_variant_get({drift.unwrap(value)}, '$', 'string'), to_json({value})), 'null')"

    def extra(fixed: tuple[str, ...], *sources: tuple[str, str]) -> F.Column:
        """The fields of maps (held, named by (name, field)) under their names but for the fixed ones."""
        rest = lambda held, named: f"filter(map_entries({named}), x -> x.key NOT IN ({', '.join(map(repr, fixed))}) AND map_contains_key({held}, x.value))"
        parts = [f"map_from_entries(transform({rest(held, named)}, x -> struct(x.key, {text(f'{held}[x.value]')})))" for held, named in sources]
        return F.expr(f"map_concat({', '.join(f'coalesce({x}, map())' for x in parts)})" if len(parts) > 1 else parts[0])

    same = "map_from_entries(transform(map_keys(own), k -> struct(CASE WHEN k = 'source_locator' AND loc IS NULL THEN 'source_locator_own' ELSE k END, k)))"
    own = [F.expr(f"try_variant_get(el, '$.{c}', 'string')").alias(c) for c in OWN]
    tops = [F.expr(text(f"coalesce(doc[top[{c!r}]], loc[top_moved[{c!r}]])")).alias(c) for c in TOP]
    inners = [F.expr(text(f"coalesce(loc[inner[{c!r}]], doc[inner_moved[{c!r}]])")).alias(c) for c in INNER]
    extras = [
        extra((*TOP, *WHOLE, *LISTS), ("doc", "top"), ("loc", "top_moved")).alias("document_extra"),
        extra(INNER, ("loc", "inner"), ("doc", "inner_moved")).alias("locator_extra"),
        extra((*OWN, "source_locator"), ("own", same)).alias("element_extra"),
    ]
    whole = [F.expr(f"nullif(try_variant_get(doc[top[{c!r}]], '$', 'string'), 'null')").alias(alias) for c, alias in WHOLE.items()]
    return rows.select("raw_id", "feed", F.col("run").alias("run_no"), *tops, *whole, F.col("pos").cast("int").alias("ord"), *own, *inners, *extras)


def p1_lost(spark: SparkSession, folder: str) -> DataFrame:
    """Fields, by consistent name, that payloads hold and p1_table has in no column and no map: none."""
    payloads = _payloads(spark, folder)
    _, names = drift.drift(payloads.select("feed", "run", "v"), NESTED)
    whole = p1_table(spark, folder).where("element_id is not null")
    kept = [F.array(*[F.lit(c) for c in fixed]) for fixed in ((*TOP, *WHOLE, *LISTS), INNER)]
    found = whole.select("feed", F.col("run_no").alias("run"), F.explode(F.array(*[F.struct(F.lit(level).alias("name_level"), F.concat(k, F.coalesce(F.map_keys(m), F.array())).alias("names")) for level, k, m in (("", kept[0], "document_extra"), ("elements.source_locator", kept[1], "locator_extra"))])).alias("x"))
    found = found.select("feed", "run", "x.name_level", F.explode("x.names").alias("name")).distinct()
    held = names.join(found.select("feed", "run").distinct(), ["feed", "run"], "left_semi")
    return held.join(found, ["feed", "run", "name_level", "name"], "left_anti").select("feed", F.col("run").alias("run_no"), "name_level", "name")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    chunks = earliest(table(spark, folder, "chunks").select("chunk_id", "recorded_at", "source_element_ids"), "chunk_id", ["recorded_at", "source_element_ids"])
    relations = earliest(table(spark, folder, "relations").select("relation_id", "recorded_at", "from_id", "to_id"), "relation_id", ["recorded_at", "from_id", "to_id"])
    named = chunks.select(F.lit("chunks").alias("ref_table"), F.col("chunk_id").alias("ref_key"), F.lit("source_element_ids").alias("ref_field"), F.explode(F.array_distinct("source_element_ids")).alias("element_id"), "recorded_at")
    ends = F.explode(F.array(F.struct(F.lit("from_id").alias("f"), F.col("from_id").alias("e")), F.struct(F.lit("to_id").alias("f"), F.col("to_id").alias("e")))).alias("x")
    linked = relations.select(F.lit("relations").alias("ref_table"), F.col("relation_id").cast("string").alias("ref_key"), ends, "recorded_at").select("ref_table", "ref_key", F.col("x.f").alias("ref_field"), F.col("x.e").alias("element_id"), "recorded_at")
    return named.unionByName(linked)


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    valid = references.validity(table(spark, folder, "elements"), "element_id")
    return references.orphans(_references(spark, folder), valid, "element_id", "recorded_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "ref_key", "ref_field", "element_id", "reason")


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, month of the referencing row and reason."""
    rows = _orphans(spark, folder).withColumn("period", F.date_format("recorded_at", "yyyy-MM"))
    return rows.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"))


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.flatten(spread(table(spark, folder, "raw_docs")), "raw_id", "payload", LONE, PARSED)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.bridge(_occurrences(spark, folder)).where("parent_path is not null").select(F.col("record").alias("raw_id"), "node_path", "parent_path")


def p5_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.bridge(_occurrences(spark, folder)).withColumnRenamed("record", "raw_id")


def p5_objects(spark: SparkSession, folder: str) -> DataFrame:
    return nesting.stored_objects(_occurrences(spark, folder))


def p5_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads that are no JSON and so have no rows in the other tables."""
    return nesting.unreadable(table(spark, folder, "raw_docs"), "raw_id", "payload").select(F.col("record").alias("raw_id"), "reason")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    cuts = Cuts(spark)
    nodes = cuts.cut(hierarchy.parent_rows(table(spark, folder, "elements"), "element_id", "parent_id", "recorded_at"))
    return hierarchy.cycles(nodes, cuts).select(F.col("v").alias("element_id"), "cycle_id", "place")


def p7_paths(spark: SparkSession, folder: str) -> DataFrame:
    nodes = hierarchy.parent_rows(table(spark, folder, "elements"), "element_id", "parent_id", "recorded_at")
    out = hierarchy.hierarchy(nodes)
    return out.select(F.col("v").alias("element_id"), F.col("root").alias("root_id"), "depth", "path", "descendants", F.col("start").alias("first_position"), F.col("stop").alias("end_position"))


def p7_tree(spark: SparkSession, folder: str) -> DataFrame:
    """p7_paths without the positions, which any order of siblings may give."""
    return p7_paths(spark, folder).drop("first_position", "end_position")


def p7_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """For each root the rows of its tree, and the sums of their depths and descendants as intervals of positions give them: a row
    lies in as many intervals as it has rows above it."""
    rows = p7_paths(spark, folder)
    sums = rows.groupBy("root_id").agg(F.count("*").alias("members"), F.countDistinct("first_position").alias("positions"), F.max("first_position").alias("last"), F.sum("depth").alias("depths"), F.sum(F.col("end_position") - F.col("first_position") - 1).alias("below"))
    return sums.select("root_id", "members", "positions", (F.col("last") + 1).alias("length"), "depths", "below")


MONTH = "strftime(r.recorded_at, '%Y-%m')"
_REFS = """WITH c AS (SELECT chunk_id, arg_min(source_element_ids, recorded_at) ids, min(recorded_at) recorded_at FROM chunks GROUP BY 1),
l AS (SELECT relation_id, first(from_id ORDER BY recorded_at) from_id, first(to_id ORDER BY recorded_at) to_id, min(recorded_at) recorded_at FROM relations GROUP BY 1),
r AS (SELECT DISTINCT 'chunks' AS ref_table, chunk_id AS ref_key, 'source_element_ids' AS ref_field, unnest(ids) AS element_id, recorded_at FROM c
UNION ALL SELECT 'relations', CAST(relation_id AS VARCHAR), 'from_id', from_id, recorded_at FROM l
UNION ALL SELECT 'relations', CAST(relation_id AS VARCHAR), 'to_id', to_id, recorded_at FROM l),
e AS (SELECT element_id, min(recorded_at) f, min(deleted_at) d FROM elements GROUP BY 1),
o AS (SELECT r.*, CASE WHEN e.element_id IS NULL THEN 'missing' WHEN e.d <= r.recorded_at THEN 'deleted' WHEN e.f > r.recorded_at THEN 'late' END AS reason
FROM r LEFT JOIN e USING (element_id) WHERE r.element_id IS NOT NULL AND r.element_id <> '')
"""
_TREE = """WITH RECURSIVE n AS (SELECT element_id AS v, nullif(first(parent_id ORDER BY recorded_at), '') AS p FROM elements GROUP BY 1),
k AS (SELECT a.v, b.v AS p FROM n a LEFT JOIN n b ON a.p = b.v),
t AS (SELECT v, v AS root_id, 0 AS depth, v AS path FROM k WHERE p IS NULL
UNION ALL SELECT k.v, t.root_id, t.depth + 1, t.path || '/' || k.v FROM t JOIN k ON k.p = t.v)
"""


_NEST = r"""WITH RECURSIVE w AS (SELECT raw_id, '' AS path, '' AS list, '' AS parent, false AS node, CAST(payload AS JSON) AS v FROM raw_docs WHERE payload IS NOT NULL AND json_valid(payload)
UNION ALL SELECT raw_id, CASE WHEN c.key IS NULL THEN path || '[' || c.i || ']' WHEN path = '' THEN c.key ELSE path || '.' || c.key END, CASE WHEN c.key IS NULL THEN path ELSE '' END, CASE WHEN node THEN path ELSE parent END, c.key IS NULL AND json_type(c.v) = 'OBJECT',
CASE WHEN node AND list = 'elements' AND c.key = 'metadata' AND json_type(c.v) = 'VARCHAR' AND json_valid(c.v->>'$') AND json_type(c.v->>'$') = 'OBJECT' THEN CAST(c.v->>'$' AS JSON)
WHEN c.key IN ('source_spans', 'cells', 'runs', 'notes', 'replies') AND json_type(c.v) = 'OBJECT' THEN json_array(c.v) ELSE c.v END
FROM (SELECT raw_id, path, list, parent, node, unnest(CASE json_type(v) WHEN 'OBJECT' THEN [{'key': k, 'i': 0, 'v': json_extract(v, '$."' || k || '"')} FOR k IN json_keys(v)]
WHEN 'ARRAY' THEN [{'key': NULL::VARCHAR, 'i': j::INT, 'v': json_extract(v, '$[' || j || ']')} FOR j IN range(json_array_length(v)::BIGINT)] END) AS c FROM w WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
"""


QUERIES = {f.__name__: f for f in (p1_found, p1_moved, p1_table, p1_lost, p4_found, p4_report, p5_found, p5_bridge, p5_objects, p5_unreadable, p7_found, p7_paths, p7_tree, p7_intervals)}
SQL = {
    "p1_found": """WITH d AS (SELECT feed, run_no AS run, CAST(payload AS JSON) AS v FROM raw_docs WHERE payload IS NOT NULL AND json_valid(payload) AND feed IS NOT NULL AND run_no IS NOT NULL),
x AS (SELECT feed, run, v->>'$.document_id' AS root, unnest(json_extract(v, '$.elements[*]')) AS e FROM d WHERE json_type(v) = 'OBJECT'),
o AS (SELECT feed, run, '' AS level, v->>'$.document_id' AS owner, v AS b FROM d WHERE json_type(v) = 'OBJECT' UNION ALL SELECT feed, run, 'elements.source_locator', e->>'$.element_id', json_extract(e, '$.source_locator') FROM x WHERE json_type(e, '$.source_locator') = 'OBJECT'),
k AS (SELECT feed, run, level, owner, b, unnest(json_keys(b)) AS f FROM o),
s AS (SELECT feed, run, level, owner, f, json_extract(b, '$."' || f || '"') AS w, CASE json_type(b, '$."' || f || '"') WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS kind FROM k),
h AS (SELECT feed, run, level, f, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM s GROUP BY ALL), r AS (SELECT DISTINCT feed, run FROM h),
gone AS (SELECT a.feed, a.run + 1 AS run, a.level, a.f FROM h a JOIN r ON r.feed = a.feed AND r.run = a.run + 1 ANTI JOIN h b ON b.feed = a.feed AND b.run = a.run + 1 AND b.level = a.level AND b.f = a.f),
come AS (SELECT a.feed, a.run, a.level, a.f FROM h a JOIN r ON r.feed = a.feed AND r.run = a.run - 1 ANTI JOIN h b ON b.feed = a.feed AND b.run = a.run - 1 AND b.level = a.level AND b.f = a.f),
l AS (SELECT feed, run, level, f, owner, min(kind || CAST(w AS VARCHAR)) AS lo, max(kind || CAST(w AS VARCHAR)) AS hi FROM s WHERE kind IS NOT NULL AND owner IS NOT NULL GROUP BY ALL),
m AS (SELECT g.feed, g.run, g.level, g.f AS f0, c.f AS f1 FROM gone g JOIN come c USING (feed, run, level) JOIN l a ON a.feed = g.feed AND a.run = g.run - 1 AND a.level = g.level AND a.f = g.f
JOIN l b ON b.feed = c.feed AND b.run = c.run AND b.level = c.level AND b.f = c.f AND b.owner = a.owner GROUP BY ALL HAVING avg((a.lo = b.lo AND a.hi = b.hi)::INT) >= 0.9),
u AS (SELECT feed, run, level, f0, f1, 'renamed' AS change FROM m UNION ALL SELECT feed, run, level, f, '', 'removed' FROM gone ANTI JOIN m ON m.feed = gone.feed AND m.run = gone.run AND m.level = gone.level AND m.f0 = gone.f
UNION ALL SELECT feed, run, level, '', f, 'added' FROM come ANTI JOIN m ON m.feed = come.feed AND m.run = come.run AND m.level = come.level AND m.f1 = come.f
UNION ALL SELECT b.feed, b.run, b.level, b.f, b.f, 'retyped' FROM h a JOIN h b ON b.feed = a.feed AND b.run = a.run + 1 AND b.level = a.level AND b.f = a.f WHERE len(a.kinds) > 0 AND len(b.kinds) > 0 AND a.kinds <> b.kinds)
SELECT DISTINCT feed, run AS run_no, CASE WHEN f0 = '' OR level = '' THEN f0 ELSE level || '.' || f0 END AS old_field, CASE WHEN f1 = '' OR level = '' THEN f1 ELSE level || '.' || f1 END AS new_field, change FROM u""",
    "p5_found": _NEST + "SELECT DISTINCT raw_id, path AS node_path, parent AS parent_path FROM w WHERE node",
    "p5_unreadable": "SELECT raw_id, 'no_json' AS reason FROM raw_docs WHERE payload IS NOT NULL AND NOT json_valid(payload)",
    "p1_lost": "SELECT feed, run_no, '' AS name_level, '' AS name FROM raw_docs WHERE false",
    "p4_found": _REFS + "SELECT ref_table, ref_key, ref_field, element_id, reason FROM o WHERE reason IS NOT NULL",
    "p4_report": _REFS + "SELECT ref_table, strftime(recorded_at, '%Y-%m') AS period, reason, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL",
    "p7_tree": _TREE + """, a AS (SELECT v, v AS x FROM t UNION ALL SELECT k.p, a.x FROM a JOIN k ON k.v = a.v WHERE k.p IS NOT NULL), d AS (SELECT v, count(*) - 1 AS n FROM a GROUP BY 1)
SELECT t.v AS element_id, root_id, CAST(depth AS BIGINT) AS depth, path, d.n AS descendants FROM t JOIN d USING (v)""",
    "p7_intervals": _TREE + "SELECT root_id, count(*) AS members, count(*) AS positions, count(*) AS length, CAST(sum(depth) AS BIGINT) AS depths, CAST(sum(depth) AS BIGINT) AS below FROM t GROUP BY 1",
    "p7_found": _TREE.replace("t AS (SELECT v, v AS root_id", "tt AS (SELECT v, v AS root_id").split("tt AS")[0]
    + """w AS (SELECT v, p, v AS s FROM k WHERE p IS NOT NULL UNION SELECT k.v, k.p, w.s FROM w JOIN k ON k.v = w.p),
c AS (SELECT DISTINCT s AS v FROM w WHERE p = s), m AS (SELECT w.s AS v, min(w.v) AS cycle_id FROM w JOIN c ON w.s = c.v GROUP BY 1)
SELECT w.s AS element_id, min(m.cycle_id) AS cycle_id, CASE WHEN bool_or(w.s = c.v) AND w.s IN (SELECT v FROM c) THEN 'on' ELSE 'under' END AS place
FROM w JOIN c ON w.v = c.v JOIN m ON m.v = c.v GROUP BY w.s""",
}
